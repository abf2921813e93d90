"""Frame-log operators. Every function takes a batch or a streaming DataFrame with event time ``ts``.

Frames: ``session_id, ts, send_no, kind, sentence, ...``; ``send_no`` is the number of the question a frame
follows (0 before the first question). Streams need ``with_lateness`` first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convqa.config import CallConfig
from convqa.operators import ordered as o
from convqa.operators.capture import Aligner
from convqa.streaming.reorder import in_order

KEY = ["session_id", "send_no"]


@dataclass(frozen=True)
class FrameKinds:
    """What the kind of a frame means for an answer.

    ``speech`` frames carry it and set the time of its first frame. ``activity`` frames (speech among them) restart its silence. Other
    kinds, such as frames that only name sources, do neither. ``frame`` is the kind of logs that do not tell more.
    """

    speech: tuple[str, ...] = ("sentence", "chunk", "frame")
    activity: tuple[str, ...] = ("sentence", "chunk", "error", "detection", "frame")


def of_kinds(frames: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Frames of these kinds; a table without a ``kind`` holds frames of any."""
    return frames.where(F.col("kind").isin(list(kinds))) if "kind" in frames.columns else frames


def read_frames(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """File stream of JSON frames; another source with the same columns (Kafka, ...) serves as well."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def with_lateness(frames: DataFrame, delay: str = "1 minute") -> DataFrame:
    return frames.withWatermark("ts", delay)


def after_first_send(frames: DataFrame) -> DataFrame:
    """Drop the greeting: everything before the first question."""
    return frames.where(F.col("send_no") >= 1)


def _speech(frames: DataFrame, kinds: FrameKinds):
    return F.col("kind").isin(list(kinds.speech)) if "kind" in frames.columns else F.lit(True)


def _text(speech):
    said = F.collect_list(F.when(speech & F.col("sentence").isNotNull(), F.struct("ts", "seq", "sentence")))
    return F.trim(F.array_join(F.transform(F.array_sort(said), lambda s: s["sentence"]), " "))


def assemble(frames: DataFrame, config: CallConfig = CallConfig(), kinds: FrameKinds = FrameKinds()) -> DataFrame:
    """Answers by silence: frames of one question belong together until nothing comes for settle plus confirm.

    One row per stretch of frames; a late stretch of the same question is a row of its own (``window`` tells). Only speech sets the
    time of the first frame, any active frame that of the last one.
    """
    gap = f"{config.settle_ms + config.confirm_ms} milliseconds"
    return after_first_send(of_kinds(frames, kinds.activity)).groupBy(*KEY, F.session_window("ts", gap).alias("window")).agg(
        _text(_speech(frames, kinds)).alias("answer"), F.min(F.when(_speech(frames, kinds), F.col("ts"))).alias("first_frame"), F.max("ts").alias("last_frame"), F.count(F.lit(1)).alias("frames"))


def answers(frames: DataFrame, kinds: FrameKinds = FrameKinds()) -> DataFrame:
    """Per question: the whole answer, its first speech frame, sources (last writer wins), source keys and the seen flag."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "seq")))
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_keys"))))  # a frame's keys are few, and so are their combinations
    return after_first_send(frames).groupBy(*KEY).agg(
        _text(_speech(frames, kinds)).alias("answer"), F.min(F.when(_speech(frames, kinds), F.col("ts"))).alias("first_frame"), latest("file_ids").alias("file_ids"), latest("loaded_files").alias("loaded_files"),
        latest("play_id").alias("play_id"), keys.alias("source_keys"), F.coalesce(F.bool_or("saw_source_frame"), F.lit(False)).alias("saw_source_frame"))


def latency(sends: DataFrame, frames: DataFrame, config: CallConfig = CallConfig(), kinds: FrameKinds = FrameKinds()) -> DataFrame:
    """Time from each question to its first speech frame within the turn limit; null when nothing came.

    As a stream this is a left join of two watermarked streams bounded in time, so state is dropped
    once the limit has passed.
    """
    s, f = sends.alias("s"), of_kinds(frames, kinds.speech).select("session_id", "send_no", F.col("ts").alias("frame_ts")).alias("f")
    within = (
        (F.col("s.session_id") == F.col("f.session_id")) & (F.col("s.send_no") == F.col("f.send_no")) & (F.col("frame_ts") >= F.col("s.sent_at"))
        & (F.col("frame_ts") <= F.col("s.sent_at") + F.expr(f"INTERVAL {config.turn_timeout_ms} MILLISECONDS")))
    return s.join(f, within, "left_outer").select("s.session_id", "s.send_no", "s.sent_at", "frame_ts")


def first_latency(joined: DataFrame) -> DataFrame:
    """Batch end of ``latency``: one row per question."""
    waited = F.unix_millis(F.min("frame_ts").cast("timestamp")) - F.unix_millis(F.col("sent_at").cast("timestamp"))
    return joined.groupBy("session_id", "send_no", "sent_at").agg(waited.alias("latency_ms"), F.min("frame_ts").isNotNull().alias("replied"))


def server_session(frames: DataFrame) -> DataFrame:
    """Server-side session id: the first one seen."""
    return frames.groupBy("session_id").agg(F.min_by("server_id", F.when(F.col("server_id").isNotNull(), F.struct("ts", "seq"))).alias("conversation_id"))


def never_started(outcomes: DataFrame) -> DataFrame:
    """Sessions without any reply and without a server id."""
    return outcomes.groupBy("session_id").agg((~F.bool_or("responded") & (F.count("server_id") == 0)).alias("never_started"))


def rebuild_transcript(outcomes: DataFrame) -> DataFrame:
    """Two turns per question: what was asked, and the answer or an empty marker."""
    reply = F.when(F.col("responded"), F.col("answer")).otherwise("")
    two = F.array(F.struct(F.lit("customer").alias("speaker"), F.col("question").alias("text")), F.struct(F.lit("agent").alias("speaker"), reply.alias("text")))
    return outcomes.select("session_id", "send_no", F.posexplode(two).alias("side", "t")).select(
        "session_id", (F.col("send_no") * 2 - 2 + F.col("side")).cast("bigint").alias("ord"), "t.speaker", "t.text")


def split_late(frames: DataFrame, closes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames inside their answer and frames that came after it closed (``closes``: ``session_id, send_no, closed_at``)."""
    joined = frames.join(closes, KEY, "left")
    late = F.coalesce(F.col("ts") > F.col("closed_at"), F.lit(False))
    return joined.where(~late).drop("closed_at"), joined.where(late)


TURN_SCHEMA = "session_id {id}, send_no bigint, answer string, latency_ms bigint, closed_by string"
PART_MS = 3_600_000  # frames of an hour are numbered together
TURN_STATE = "send_no bigint, sent_ms bigint, phase string, deadline bigint, settle_end bigint, snapshot bigint, sentences array<string>, first_ms bigint"


class TurnClock:
    """Exact closing rule of one question: settle silence, then a confirm window, with a hard limit per waiting phase.

    Any active frame ends a confirm window early, but only a new sentence sends the turn back to waiting.
    Time comes from the frames, so replays give the same answers.
    """

    def __init__(self, config: CallConfig, values=None):
        self.c = config
        (self.send_no, self.sent, self.phase, self.hard, self.settle, self.snapshot, self.sentences, self.first) = (
            values or (0, 0, "idle", None, None, 0, [], None))
        self.sentences = list(self.sentences)

    def values(self):
        return (self.send_no, self.sent, self.phase, self.hard, self.settle, self.snapshot, self.sentences, self.first)

    def send(self, send_no: int, at: int):
        """Start the next question; an answer still open at that moment is returned as it stands."""
        cut = None if self.phase == "idle" else self._close("next-send")
        self.send_no, self.sent, self.phase, self.hard, self.settle = send_no, at, "wait", at + self.c.turn_timeout_ms, None
        self.snapshot, self.sentences, self.first = 0, [], None
        return cut

    def _close(self, how: str):
        self.phase = "idle"
        return (self.send_no, " ".join(self.sentences).strip(), None if self.first is None else self.first - self.sent, how)

    def next_due(self) -> int | None:
        if self.phase == "wait":
            return self.hard if self.settle is None else min(self.hard, self.settle)
        return self.hard if self.phase == "confirm" else None

    def advance(self, now: int):
        """Fire everything due before ``now``; returns the closed answer, if any."""
        while self.next_due() is not None and self.next_due() < now:
            due = self.next_due()
            if self.phase == "wait":
                self._confirm(due)
            else:
                return self._after_confirm(due) or self.advance(now)
        return None

    def _confirm(self, at: int):
        self.phase, self.hard, self.snapshot = "confirm", at + self.c.confirm_ms, len(self.sentences)

    def _after_confirm(self, at: int):
        if len(self.sentences) == self.snapshot:
            return self._close("silence" if self.first is not None else "timeout")
        self.phase, self.hard = "wait", at + self.c.turn_timeout_ms
        self.settle = at + self.c.settle_ms if self.settle is None else self.settle
        return None

    def frame(self, at: int, sentence: str | None, speech: bool = True):
        """Take an active frame, speech or not; returns the closed answer when it ends a confirm window without news."""
        if self.phase == "idle":
            return None
        if speech and self.first is None:
            self.first = at
        if speech and sentence is not None:
            self.sentences.append(sentence)
        self.settle = at + self.c.settle_ms
        return self._after_confirm(at) if self.phase == "confirm" else None

    def flush(self):
        done = self.advance(1 << 62)
        return done


def _run_clock(clock: TurnClock, rows, out: list, kinds: FrameKinds = FrameKinds()) -> None:
    for row in rows:
        done = clock.advance(row.at)
        if done:
            out.append(done)
        if row.kind == "send":
            done = clock.send(int(row.send_no), int(row.at))
        else:
            done = clock.frame(int(row.at), row.sentence if isinstance(row.sentence, str) else None, row.kind in kinds.speech)
        if done:
            out.append(done)


def close_turns_batch(frames: DataFrame, config: CallConfig = CallConfig(), kinds: FrameKinds = FrameKinds()) -> DataFrame:
    """Exact answer closing over a recorded log.

    A question's clock starts anew, so what closes its answer are the frames up to the next question and that question's
    time. Rows are dealt by question, not by session, and streamed through the clock in order.
    """
    ident = dict(frames.dtypes)["session_id"]
    fields = [f.split()[0] for f in TURN_SCHEMA.format(id=ident).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, clock = None, TurnClock(config)
        for batch in batches:
            found: list = []
            for row in batch.itertuples(index=False):
                if (row.session_id, row.part) != now:
                    last = clock.flush()
                    if last:
                        found.append((now[0], *last))
                    now, clock = (row.session_id, row.part), TurnClock(config)
                out: list = []
                if row.ends:
                    done = clock.advance(row.at) or (None if clock.phase == "idle" else clock._close("next-send"))
                    clock = TurnClock(config)
                    out += [done] if done else []
                else:
                    _run_clock(clock, [row], out, kinds)
                found += [(row.session_id, *x) for x in out]
            if found:
                yield pd.DataFrame(found, columns=fields).astype({"latency_ms": "Int64"})
        last = clock.flush()
        if last:
            yield pd.DataFrame([(now[0], *last)], columns=fields).astype({"latency_ms": "Int64"})

    log = of_kinds(frames, ("send", *kinds.activity)).select("session_id", "at", "seq", "kind", "send_no", "sentence")
    # the part of a frame is its question's place in the session; a question also ends the part before it
    sends = F.when(F.col("kind") == "send", 1).otherwise(0)
    parts = o.running_sum(log, ["session_id"], ["at", "seq"], sends, "part", o.blocks_of("at", PART_MS)).withColumn("ends", F.lit(False))
    ends = parts.where("kind = 'send' and part > 1").withColumn("part", F.col("part") - 1).withColumn("ends", F.lit(True))
    rows = parts.where("part > 0").unionByName(ends)
    ordered = rows.repartition("session_id", "part").sortWithinPartitions("session_id", "part", "ends", "at", "seq")
    return ordered.mapInPandas(run, TURN_SCHEMA.format(id=ident))


class ClockMachine:
    """The closing rule over rows in event order: frames and sends move it, and so does event time alone."""

    def __init__(self, config: CallConfig, kinds: FrameKinds, values=None):
        self.clock, self.kinds = TurnClock(config, values), kinds

    def take(self, row) -> list[tuple]:
        out: list = []
        _run_clock(self.clock, [row], out, self.kinds)
        return out

    def reach(self, ms: int) -> list[tuple]:
        done = self.clock.advance(ms + 1)
        return [done] if done else []

    def due(self) -> int | None:
        return self.clock.next_due()

    def values(self) -> tuple | None:
        return None if self.clock.phase == "idle" else self.clock.values()


def close_turns_stream(frames: DataFrame, config: CallConfig = CallConfig(), kinds: FrameKinds = FrameKinds()) -> DataFrame:
    """Stream form of the exact closing rule. Rows may come in any order within the watermark's delay; settle, confirm and
    the limit of a waiting phase are event-time timers, and a session between two questions has no state."""
    ident = dict(frames.dtypes)["session_id"]
    log = of_kinds(frames, ("send", *kinds.activity)).select("session_id", "at", "seq", "kind", "send_no", "sentence", "ts")
    return in_order(log, "session_id", ["at", "seq"], lambda values: ClockMachine(config, kinds, values), TURN_STATE, TURN_SCHEMA.format(id=ident))


class CarryMachine:
    """The last seen file set of a session, until its ``end`` row."""

    def __init__(self, values=None):
        self.files = list(values[0]) if values else []
        self.open = values is not None

    def take(self, row) -> list[tuple]:
        if row.ended:
            self.files, self.open = [], False
            return []
        if row.saw is None or row.saw:
            self.files = list(row.files) if row.files is not None else []
        self.open = True
        return [(row.turn, self.files)]

    def reach(self, ms: int) -> list[tuple]:
        return []

    def due(self) -> int | None:
        return None

    def values(self) -> tuple | None:
        return (self.files,) if self.open else None


def carry_sources_in_order(turn_sources: DataFrame) -> DataFrame:
    """Source carry-forward over ``session_id, turn, ts, files, saw, ended`` when files bring turns late or in another order.

    Turns wait until the watermark has passed their time. A row with ``ended`` closes its session, whose state then goes.
    """
    ident = dict(turn_sources.dtypes)["session_id"]
    rows = turn_sources.select("session_id", F.unix_millis("ts").alias("at"), "turn", "files", "saw", F.coalesce("ended", F.lit(False)).alias("ended"), "ts")
    return in_order(rows, "session_id", ["at", "turn"], CarryMachine, "files array<string>", f"session_id {ident}, turn bigint, source_file_ids array<string>")


def carry_sources_stream(turn_sources: DataFrame) -> DataFrame:
    """Source carry-forward of a stream that keeps the order of turns and has no event time: one small state per session (the last
    seen file set), for as long as the query runs. ``carry_sources_in_order`` reorders and forgets."""
    ident = dict(turn_sources.dtypes)["session_id"]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = list(state.get[0]) if state.exists else []
        rows = []
        for row in pd.concat(list(batches)).sort_values("turn").itertuples(index=False):
            if row.saw is None or pd.isna(row.saw) or row.saw:
                current = list(row.files) if row.files is not None else []
            rows.append((key[0], row.turn, current))
        state.update((current,))
        yield pd.DataFrame(rows, columns=["session_id", "turn", "source_file_ids"])

    return turn_sources.groupBy("session_id").applyInPandasWithState(
        step, f"session_id {ident}, turn bigint, source_file_ids array<string>", "files array<string>", "append", GroupStateTimeout.NoTimeout)


def align_stream(rows: DataFrame) -> DataFrame:
    """Stream form of the answer alignment. ``rows`` carry the columns of ``alignment_rows``; state is the open question
    and the questions still ahead. The last open question of a session is emitted when its ``end`` row arrives (kind 2)."""
    ident = dict(rows.dtypes)["session_id"]
    schema = "pos bigint, opened boolean, text string, answer string, ahead array<struct<q:array<string>,e:array<string>>>"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            pos, opened, text, answer, ahead = state.get
            aligner = Aligner([(frozenset(x["q"]), frozenset(x["e"])) for x in ahead], pos, opened, text, answer)
        else:
            aligner = Aligner()
        out = []
        for row in pd.concat(list(batches)).sort_values(["slot", "kind", "ord"]).itertuples(index=False):
            if row.kind == 0:
                aligner.question(row.words, row.expected_words)
            elif row.kind == 2:
                out.append(aligner.current())
            elif row.customer:
                out.append(aligner.customer(row.text, row.words, row.chars))
            else:
                aligner.reply(row.text)
        ahead = [(sorted(q), sorted(e)) for q, e in aligner.ahead]
        state.update((aligner.pos, aligner.opened, aligner.text, aligner.answer, ahead))
        found = [(key[0], *x) for x in out if x]
        if found:
            yield pd.DataFrame(found, columns=["session_id", "pos", "question", "answer"])

    return rows.groupBy("session_id").applyInPandasWithState(
        step, f"session_id {ident}, pos bigint, question string, answer string", schema, "append", GroupStateTimeout.NoTimeout)
