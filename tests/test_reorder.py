"""Streams that reorder: shuffled files give the batch result, and no state is left behind; alignment over long sessions."""

import random

import pytest
from pyspark.sql import functions as F

from convqa.config import CallConfig
from convqa.operators import alignment
from convqa.streaming import frames as fr

CFG = CallConfig(settle_ms=5_000, confirm_ms=500, turn_timeout_ms=20_000)
LOG = "session_id string, send_no bigint, at bigint, seq bigint, kind string, sentence string"
KINDS = ("sentence", "chunk", "error", "detection", "source")


def log(sessions, seed):
    """Frames of all five kinds, with gaps around the limits of every phase."""
    rnd, rows = random.Random(seed), []
    for s in range(sessions):
        at, seq = rnd.randint(0, 1000), 0
        for send in range(1, 6):
            rows.append((f"s{s}", send, at, seq, "send", None))
            for _ in range(rnd.randint(0, 9)):
                at += rnd.choice((0, 200, 900, 4_900, 5_000, 5_001, 5_200, 5_501))
                seq += 1
                kind = rnd.choice(KINDS)
                rows.append((f"s{s}", send, at, seq, kind, rnd.choice("xyz") if kind == "sentence" else None))
            at += rnd.choice((1, 4_000, 30_000))
            seq += 1
    return rows


def stream(spark, folder, rows, schema, operator, delay="10 minutes"):
    """Run an operator over files of shuffled rows whose order holds only within the delay, and a last row far ahead."""
    src, out, state = (str(folder / n) for n in ("in", "out", "state"))
    last = max(r[2] for r in rows)
    for low in range(0, last + 1, 120_000):  # files of two minutes, their rows in any order
        part = [r for r in rows if low <= r[2] < low + 120_000]
        random.Random(low).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(src)
    ahead = [("ahead", *[None] * (len(rows[0]) - 1))]
    spark.createDataFrame(ahead, schema).withColumn("at", F.lit(last + 10**9)).fillna({"seq": 0, "kind": "chunk"} if "seq" in schema else {"turn": 0}).coalesce(1).write.mode("append").json(src)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).json(src).withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", delay)
    query = operator(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    rows_left = [op["numRowsTotal"] for op in (query.lastProgress or {}).get("stateOperators", [])]
    return spark.read.parquet(out).where("session_id <> 'ahead'"), rows_left


def plain_clock(rows):
    """The rule told once more, second by second of its events: who fires first, a deadline or a frame."""
    out = {}
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        by.setdefault(r[0], []).append(r)
    for session, events in by.items():
        sends = [i for i, r in enumerate(events) if r[4] == "send"]
        for n, i in enumerate(sends):
            stop = sends[n + 1] if n + 1 < len(sends) else len(events)
            until = events[stop][2] if stop < len(events) else float("inf")
            active = [r for r in events[i + 1:stop] if r[4] != "source"]
            said, first, settle, sent = [], None, None, events[i][2]
            waiting, limit, seen, how = True, sent + CFG.turn_timeout_ms, 0, None
            for at, kind, text in [(r[2], r[4], r[5]) for r in active] + [(until, None, None)]:
                due = limit if not waiting or settle is None else min(limit, settle)
                if waiting and due < at:
                    waiting, limit, seen = False, due + CFG.confirm_ms, len(said)
                if not waiting and limit < at:
                    how = "timeout" if first is None else "silence"
                    break
                if kind is None:
                    how = "next-send"
                    break
                if kind in ("sentence", "chunk"):
                    first = at if first is None else first
                if kind == "sentence":
                    said.append(text)
                settle = at + CFG.settle_ms
                if not waiting:
                    if len(said) == seen:
                        how = "timeout" if first is None else "silence"
                        break
                    waiting, limit = True, at + CFG.turn_timeout_ms
            out[session, events[i][1]] = (" ".join(said), None if first is None else first - sent, how)
    return out


def as_dict(rows):
    return {(r.session_id, r.send_no): (r.answer, r.latency_ms, r.closed_by) for r in rows}


def test_clock_in_batch_and_stream(spark, tmp_path):
    rows = log(12, 5)
    want = plain_clock(rows)
    batch = fr.close_turns_batch(spark.createDataFrame(rows, LOG), CFG).collect()
    assert as_dict(batch) == want and len(batch) == len(want)
    got, left = stream(spark, tmp_path, rows, LOG, lambda s: fr.close_turns_stream(s, CFG))
    got = got.collect()
    assert as_dict(got) == want and len(got) == len(want)
    assert all(n <= 4 for n in left)  # what is left belongs to the row far ahead


def test_one_hot_session_is_dealt_by_question(spark):
    rows = [("hot", n // 3 + 1, n * 7_000, n, "send" if n % 3 == 0 else "sentence", None if n % 3 == 0 else "w") for n in range(600)]
    closed = fr.close_turns_batch(spark.createDataFrame(rows, LOG), CFG)
    assert as_dict(closed.collect()) == plain_clock(rows)
    assert "hashpartitioning(session_id" in (plan := closed._jdf.queryExecution().executedPlan().toString()) and "part" in plan


def test_carry_in_order(spark, tmp_path):
    rnd = random.Random(2)
    schema = "session_id string, turn bigint, at bigint, files array<string>, saw boolean, ended boolean"
    rows, want = [], {}
    for s in range(6):
        current, at = [], rnd.randint(0, 10_000)
        for turn in range(1, 30):
            files, saw = ([f"f{rnd.randrange(9)}"] if rnd.random() < 0.5 else []), rnd.choice((True, False, None))
            rows.append((f"s{s}", turn, at, files, saw, False))
            if saw is not False:
                current = files
            want[f"s{s}", turn] = list(current)
            at += rnd.choice((100, 30_000))
        rows.append((f"s{s}", 99, at, None, None, True))
    got, left = stream(spark, tmp_path, rows, schema, fr.carry_sources_in_order)
    assert {(r.session_id, r.turn): list(r.source_file_ids) for r in got.collect()} == want
    assert all(n <= 4 for n in left)


def plain_cursors(utterances, questions):
    """The cursor of each utterance, one after the other."""
    pos, answered, out = 0, False, []
    for words, chars, replied in utterances:
        own = frozenset(words)
        here = alignment.overlap(own, questions[pos - 1]) if pos else 0
        last = pos == len(questions)
        there = 0 if last else alignment.overlap(own, questions[pos])
        if pos and (last or alignment.stays(here, there, answered, chars)):
            answered = answered or replied
        else:
            pos, answered = pos + 1, replied
        out.append(pos)
    return out


@pytest.mark.parametrize("span,width", [(8, 2), (16, 4)])
def test_long_sessions_are_spread_over_blocks(spark, span, width):
    """Windows far too narrow for the drift, so several rounds are needed; the result is that of one walk."""
    rnd = random.Random(span)
    vocab = [f"w{k}" for k in range(30)]
    spoken, asked, want = [], [], {}
    for s, n in enumerate((150, 40, 3, 1)):
        questions = [(frozenset(rnd.sample(vocab, 4)), frozenset(rnd.sample(vocab, 3) if k % 2 else [])) for k in range(max(1, n * 2 // 3))]
        utterances = [(rnd.sample(vocab, rnd.randint(1, 4)), rnd.choice((3, 10, 14, 40)), rnd.random() < 0.5) for _ in range(n)]
        asked += [(s, k + 1, sorted(q), sorted(e)) for k, (q, e) in enumerate(questions)]
        spoken += [(s, k + 1, w, c, "yes" if r else None) for k, (w, c, r) in enumerate(utterances)]
        want[s] = plain_cursors(utterances, questions)
    sdf = spark.createDataFrame(spoken, "session_id int, slot bigint, words array<string>, chars int, reply string")
    qdf = spark.createDataFrame(asked, "session_id int, pos bigint, words array<string>, expected array<string>")
    got = {}
    for r in alignment.cursors(sdf, qdf, span, width).orderBy("session_id", "slot").collect():
        got.setdefault(r.session_id, []).append(r.pos)
    assert got == want
