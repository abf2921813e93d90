"""Transcript operators against small independent models and literal cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convqa.functions import similarity as sim
from convqa.functions import text as tx
from convqa.operators import capture, latency, quality, transcripts


def turn_table(spark, calls):
    return spark.createDataFrame([(c, n, s, t) for c, turns in calls.items() for n, (s, t) in enumerate(turns)], "conv_id int, ord bigint, speaker string, text string")


def random_calls(n=60, words=("loan", "rate", "yes", "", "salary transfer", "ok then", "the limit is 5")):
    rnd = random.Random(11)
    return {c: [(rnd.choice(("agent", "customer")), rnd.choice(words)) for _ in range(rnd.randint(1, 14))] for c in range(n)}


def model_pairs(turns):
    kept = [t for t in turns if t[1] or t[0] == "agent"]
    merged = []
    for speaker, text in kept:
        if merged and speaker == "customer" == merged[-1][0]:
            if len(text) > len(merged[-1][1]):
                merged[-1] = (speaker, text)
        else:
            merged.append((speaker, text))
    return [(t, next((a for s, a in merged[k + 1:] if s == "agent"), None) or None) for k, (s, t) in enumerate(merged) if s == "customer"]


def model_exchanges(turns):
    out = []
    for speaker, text in turns:
        if speaker == "agent":
            if not out:
                out.append([None, []])
            out[-1][1].append(text)
        elif not out or out[-1][1] or out[-1][0] is None:
            out.append([[text], []])
        else:
            out[-1][0].append(text)
    return [(None if c is None else " ".join(c), " ".join(r)) for c, r in out]


@pytest.mark.parametrize("block", [1, 3, None])
def test_pairs_and_exchanges(spark, block):
    calls = random_calls()
    df = turn_table(spark, calls)
    got = {}
    for r in transcripts.pair(df, block).orderBy("conv_id", "pair").collect():
        got.setdefault(r["conv_id"], []).append((r["question"], r["answer"]))
    assert got == {c: p for c, t in calls.items() if (p := model_pairs(t))}
    got = {}
    for r in transcripts.exchanges(df, block).orderBy("conv_id", "exch").collect():
        got.setdefault(r["conv_id"], []).append((r["caller"], r["reply"]))
    assert got == {c: model_exchanges(t) for c, t in calls.items()}


def test_body(spark):
    df = turn_table(spark, {
        1: [("agent", "welcome greeting"), ("customer", "track my order"), ("agent", "sure")],
        2: [("agent", "greeting"), ("agent", "anything else")]})
    got = {(r["conv_id"], r["text"]) for r in transcripts.body(df).collect()}
    assert got == {(1, "track my order"), (1, "sure"), (2, "anything else")}


def test_compare_verdicts(spark):
    live = turn_table(spark, {1: [("customer", "good morning"), ("agent", "welcome, how can I help")], 2: [("agent", "hello world")], 4: [("agent", "a")]})
    stored = turn_table(spark, {1: [("customer", "Good morning."), ("agent", "Welcome — how can I help?")], 2: [("agent", "totally unrelated different content here")], 3: [("agent", "x")]})
    got = {r["conv_id"]: (r["result"], r["similarity"]) for r in transcripts.compare(live, stored).collect()}
    assert got == {1: ("PASS", 1.0), 2: ("FAIL", 0.0), 3: ("SKIPPED", None), 4: ("SKIPPED", None)}


def test_transcript_and_artifact_checks(spark):
    df = turn_table(spark, {1: [("customer", "hello"), ("agent", "welcome")], 2: [("customer", "hello")], 3: [("agent", "a"), ("assistant", "b")]})
    checks = quality.validate_transcripts(df)
    got = {r["conv_id"]: (r["saved"], r["reason"]) for r in checks.collect()}
    assert got[1] == (True, "ok") and got[2] == (False, "persisted transcript has 1/2 non-empty turn(s)")
    assert got[3] == (False, "persisted transcript does not contain both customer and agent turns")
    rec = spark.createDataFrame([(1, "https://x.test/r.wav"), (2, None)], "conv_id int, recording_url string")
    got = {r["conv_id"]: (r["saved"], r["reason"]) for r in quality.validate_artifacts(checks, rec).collect()}
    assert got[1] == (True, "ok") and got[2][1].count(";") == 1


def test_review_prefers_stored(spark):
    df = spark.createDataFrame([
        ("c1", [("customer", "hi"), ("assistant", "welcome")], [("agent", "live only")], "https://app.test", "a1"),
        ("c2", [], [("agent", "x")], None, "a1"), ("c3", None, None, None, None)],
        "conv_id string, stored array<struct<speaker:string,text:string>>, live array<struct<speaker:string,text:string>>, app_url string, agent_id string")
    rows = transcripts.review(df)
    got = {r["conv_id"]: (r["source"], r["url"]) for r in rows.collect()}
    assert got == {"c1": ("stored", "https://app.test/en/agents/a1/conversations/c1"), "c2": ("live", ""), "c3": ("none", "")}
    ex = transcripts.exchanges(rows.where("ord is not null")).where("conv_id = 'c1'").collect()
    assert [(e["caller"], e["reply"]) for e in ex] == [("hi", "welcome")]


def test_stored_latency(spark):
    turns = spark.createDataFrame([
        (1, 0, "agent", 0.0, 2.0), (1, 1, "customer", 2.0, 5.5), (1, 2, "agent", 5.5, 8.0), (1, 3, "customer", 8.0, 12.0), (1, 4, "agent", 12.0, 14.0), (1, 5, "customer", 14.0, 17.0)],
        "session_id int, ord bigint, speaker string, start_s double, end_s double")
    checks = spark.createDataFrame([(1, 1, True, "opening-greeting", 2000.0), (1, 2, True, "message-count", 1000.0), (1, 3, False, "none", 1500.0)],
                                   "session_id int, ord bigint, responded boolean, response_signal string, clip_ms double")
    assert [r["latency_ms"] for r in latency.backend(turns, checks).collect()] == [3000]
    v = latency.verdict(spark.createDataFrame([(1, "a", True, 1000.0), (1, "b", True, 3000.0), (1, "c", False, None), (2, "a", True, 6001.0)], "session_id int, clip string, responded boolean, latency_ms double"))
    got = {r["session_id"]: (r["max_ms"], r["avg_ms"], r["warn"]) for r in v.collect()}
    assert got == {1: (3000, 2000, False), 2: (6001, 6001, True)}


def test_dice_matches_counter(spark):
    rnd = random.Random(1)
    rows = [(n, " ".join(rnd.choices("a b c d".split(), k=rnd.randint(0, 8))), " ".join(rnd.choices("a b c e".split(), k=rnd.randint(0, 8)))) for n in range(80)]
    df = spark.createDataFrame(rows, "n int, a string, b string").select("n", sim.dice("a", "b").alias("d"), sim.word_overlap("a", "b").alias("w"))
    for (_, a, b), r in zip(rows, df.orderBy("n").collect()):
        x, y = Counter(a.split()), Counter(b.split())
        total = sum(x.values()) + sum(y.values())
        assert r["d"] == pytest.approx(1.0 if not total else 2 * sum((x & y).values()) / total)
        assert r["w"] == pytest.approx(len(set(x) & set(y)) / min(len(x), len(y)) if x and y else 0.0)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(tx.normalize_text(F.lit("  Héllo, «مَرْحَباً»  ٤ـ!"))) == "héllo مرحبا"
    assert one(F.length(tx.norm_text_loose(F.lit("a, b")))) == 4
    assert [one(tx.canonical_speaker(F.lit(s))) for s in ("AI bot", "User", "", "said", "ops")] == ["agent", "customer", "unknown", "agent", "ops"]
    assert [one(tx.turn_type(F.lit(s))) for s in ("نعم!", " ok. ", "", "ok then")] == ["ack", "ack", "ack", "question"]
    assert one(tx.slugify(F.lit("Open Account (v2) - new.form"))) == "OPEN_ACCOUNT_NEW_FORM"
    assert one(tx.question_id_from_clip(F.lit("012_Q7.WAV"))) == "Q7" and one(tx.question_id_from_clip_strict(F.lit("Q7.wav"))) == ""
    assert one(tx.judge_slug(F.lit("org/model:free"))) == "org_model" and one(tx.padded_id("chunk_", F.lit(1234))) == "chunk_1234"
    assert one(tx.round_half_up(F.lit(-2.5))) == -2 and one(tx.parse_iso_utc(F.lit("nope"))) is None
    assert one(tx.fmt_mmss(F.lit(125.9))) == "2:05"


def test_label_parsers(spark):
    df = spark.createDataFrame([(1, "1. AGENT: hello\n\ncaller : yes"), (2, "AGENT: a\nno label"), (3, None)], "id int, reply string")
    got = [(r["id"], r["ord"], r["speaker"], r["text"]) for r in transcripts.parse_labelled(df).orderBy("id", "ord").collect()]
    assert got == [(1, 0, "AGENT", "hello"), (1, 1, "CUSTOMER", "yes")]
    df = spark.createDataFrame([('```json\n["Agent","caller","x"]\n```', 3), ('["AGENT"]', 2), ("none", 1)], "r string, n int")
    assert [r[0] for r in df.select(transcripts.parse_label_array("r", "n")).collect()] == [["AGENT", "CUSTOMER", "UNKNOWN"], None, None]


def model_align(turns, order, meta):
    """Literal reading of the rule over whole lists."""
    words = lambda s: set(w for w in "".join(c if c.isalnum() else " " for c in (s or "").lower()).split())
    def score(t, q):
        best = 0.0
        for other in meta[q]:
            a, b = words(t), words(other)
            if a and b:
                best = max(best, len(a & b) / min(len(a), len(b)))
        return best
    groups = [{"open": False, "text": "", "answer": None} for _ in order]
    at = 0
    for speaker, text in turns:
        if not text:
            continue
        g = groups[at]
        if speaker != "customer":
            if g["open"] and g["answer"] is None:
                g["answer"] = text
            continue
        if not g["open"]:
            g.update(open=True, text=text)
            continue
        last = at + 1 >= len(order)
        here, there = score(text, order[at]), -1 if last else score(text, order[at + 1])
        if last:
            fragment = True
        elif g["answer"] is not None:
            fragment = len(text) <= 12 and here >= there - 0.15
        elif here < 0.1 and there < 0.1:
            fragment = len(text) <= 8
        else:
            fragment = there <= here
        if fragment:
            g["text"] = text if len(text) > len(g["text"]) else g["text"]
        else:
            at += 1
            groups[at].update(open=True, text=text)
    return [(g["text"], g["answer"]) for g in groups]


@pytest.mark.parametrize("block", [2, 1000])
def test_alignment(spark, block):
    rnd = random.Random(8)
    vocab = "loan rate salary car house limit age card".split()
    meta = {f"q{n}": (" ".join(rnd.sample(vocab, 3)), " ".join(rnd.sample(vocab, 2)) if n % 2 else "") for n in range(20)}
    turns, orders = {}, {}
    for s in range(40):
        orders[s] = rnd.sample(sorted(meta), rnd.randint(1, 6))
        talk = []
        for _ in range(rnd.randint(1, 14)):
            q = meta[rnd.choice(orders[s])][0].split()
            talk.append(("customer", rnd.choice(["tyb", "hm ok", " ".join(rnd.sample(q, rnd.randint(1, 3))), "something else entirely"])) if rnd.random() < 0.6 else (rnd.choice(("agent", "system")), rnd.choice(("", "answer one", "answer two"))))
        turns[s] = talk
    tdf = spark.createDataFrame([(s, n, sp, tx_) for s, t in turns.items() for n, (sp, tx_) in enumerate(t)], "session_id int, ord bigint, speaker string, text string")
    odf = spark.createDataFrame([(s, n + 1, q) for s, qs in orders.items() for n, q in enumerate(qs)], "session_id int, pos bigint, question_id string")
    qdf = spark.createDataFrame([(q, a, b) for q, (a, b) in meta.items()], "id string, question string, expected_answer string")
    got = {}
    for r in capture.align(tdf, odf, qdf, block).orderBy("session_id", "pos").collect():
        got.setdefault(r["session_id"], []).append((r["question"], r["answer"]))
    assert got == {s: model_align(turns[s], orders[s], meta) for s in turns}
