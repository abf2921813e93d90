"""Turn run artifacts into one answer row per asked question."""

from __future__ import annotations

import functools
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convqa.functions import text as tx
from convqa.operators import ordered as o
from convqa.operators import provenance
from convqa.operators.alignment import align, overlap, stays
from convqa.session import materialize

__all__ = ["Aligner", "align", "alignment_rows", "capture_answers", "choose_answers", "known_sessions", "played_order", "totals"]

class Aligner:
    """Moves through one session's questions as its turns arrive, for streams; holds only the questions still ahead."""

    def __init__(self, ahead=(), pos: int = 0, opened: bool = False, text: str = "", answer: str | None = None):
        self.ahead = deque(ahead)  # (question words, expected words), current question first
        self.pos, self.opened, self.text, self.answer = pos, opened, text, answer

    def question(self, question_words, expected_words) -> None:
        self.ahead.append((frozenset(question_words), frozenset(expected_words)))

    def reply(self, text: str) -> None:
        if self.opened and self.answer is None:
            self.answer = text

    def customer(self, text: str, words, chars: int):
        """Take an utterance; returns the finished question when it starts the next one."""
        if not self.ahead:
            return None
        if not self.opened:
            self.opened, self.text = True, text
            return None
        words = frozenset(words)
        if len(self.ahead) == 1 or stays(overlap(words, self.ahead[0]), overlap(words, self.ahead[1]), self.answer is not None, chars):
            if len(text) > len(self.text):
                self.text = text
            return None
        done = self.current()
        self.ahead.popleft()
        self.pos += 1
        self.text, self.answer = text, None
        return done

    def current(self):
        return (self.pos + 1, self.text, self.answer) if self.opened else None


def alignment_rows(turns: DataFrame, order: DataFrame, questions: DataFrame, block_rows: int = o.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Questions and turns of each session in one sequence, for streams.

    After k customer utterances at most k questions are open, so question k is placed right before the
    k-th utterance and never has to wait in memory from the start of the session.
    """
    spoken = turns.withColumn("speaker", F.lower(F.coalesce("speaker", F.lit("")))).withColumn(
        "text", tx.strip(F.coalesce("text", F.lit("")))).where(F.col("text") != "")
    customer = (F.col("speaker") == "customer").cast("int")
    numbered = o.running_sum(spoken, ["session_id"], ["ord"], customer, "slot", o.blocks_of("ord", block_rows))
    no_words = F.array().cast("array<string>")
    turn_rows = numbered.select(
        "session_id", F.col("slot").cast("bigint").alias("slot"), F.lit(1).alias("kind"), F.col("ord").cast("bigint").alias("ord"),
        (F.col("speaker") == "customer").alias("customer"), "text", tx.words_loose("text").alias("words"),
        no_words.alias("expected_words"), F.length(tx.norm_text_loose("text")).alias("chars"),
    )
    question_rows = order.join(questions.select(F.col("id").alias("question_id"), "question", "expected_answer"), "question_id", "left").select(
        "session_id", F.col("pos").cast("bigint").alias("slot"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("ord"),
        F.lit(False).alias("customer"), F.lit("").alias("text"), tx.words_loose("question").alias("words"),
        tx.words_loose("expected_answer").alias("expected_words"), F.lit(0).alias("chars"),
    )
    return question_rows.unionByName(turn_rows)


def played_order(session_turns: DataFrame, checks: DataFrame, clips: DataFrame) -> DataFrame:
    """Question at each position of a run: from the checks if there is one per message, else from the
    staged clips if there is one per message, else as built. Adds ``order_source``.

    ``session_turns``: ``session_id, turn, question_id``; ``checks``/``clips``: ``session_id, ord, clip``.
    """
    key = ["session_id"]
    named = checks.withColumn("qid", tx.question_id_from_clip(F.coalesce("clip", F.lit("")))).where(F.col("qid") != "")
    staged = clips.withColumn("qid", tx.question_id_from_clip_strict("clip")).where(F.col("qid") != "")
    built = session_turns.select("session_id", F.col("turn").cast("bigint").alias("pos"), F.col("question_id").alias("__built"))

    place = F.col("ord").cast("bigint").alias("ord")
    # written, so that each list is worked out once and its length is known
    lists = [materialize(df, "list") for df in (built, named.select(*key, place, F.col("qid").alias("__check")), staged.select(*key, place, F.col("qid").alias("__clip")))]
    rows = max(df.count() for df in lists)
    by_place, by_block = [*key, "pos"], [*key, o.BLOCK]
    block = lambda c: F.coalesce(o.blocks_of(c), F.lit(-1).cast("bigint"))

    def numbered(df: DataFrame) -> DataFrame:
        cut = o.in_tasks(o.with_block(df, o.blocks_of("ord")), rows, *by_block)
        return o.in_tasks(o.ordinal(cut, key, ["ord"], "pos").drop("ord", o.BLOCK), rows, *by_place)

    # how long a session's lists are meets its rows block by block, so that a long session is many tasks
    marks = [df.select(*key, block(c).alias(o.BLOCK), *[F.lit(int(k == at)).alias(mark) for at, mark in enumerate("mcs")]) for k, (df, c) in enumerate(zip(lists, ("pos", "ord", "ord")))]
    per_block = o.in_tasks(functools.reduce(DataFrame.unionByName, marks), rows, *by_block).groupBy(*by_block).agg(*[F.sum(mark).alias(mark) for mark in "mcs"])
    lengths = o.in_tasks(per_block, rows, *key).select(
        *by_block, F.col("m").alias("__here"), *[F.sum(mark).over(Window.partitionBy(*key)).alias(mark) for mark in "mcs"]).where("__here > 0").drop("__here")
    paired = o.in_tasks(lists[0], rows, *by_place).join(numbered(lists[1]), by_place, "left").join(numbered(lists[2]), by_place, "left")
    joined = o.in_tasks(o.with_block(paired, block("pos")), rows, *by_block).join(o.in_tasks(lengths, rows, *by_block), by_block)
    use_checks, use_clips = F.col("c") == F.col("m"), F.col("s") == F.col("m")
    return joined.select(
        "session_id", "pos",
        F.when(use_checks, F.col("__check")).when(use_clips, F.col("__clip")).otherwise(F.col("__built")).alias("question_id"),
        F.when(use_checks, "checks").when(use_clips, "clips").otherwise("built").alias("order_source"),
    )


def choose_answers(rows: DataFrame) -> DataFrame:
    """Answer and answered flag: the response extract if the turn has one, else the check, else the alignment.

    Needs ``has_response, reply_text, reply_responded, check_text, check_responded, aligned_answer``.
    """
    reply, check = tx.blank_to_null("reply_text"), tx.blank_to_null("check_text")
    trusted = F.coalesce("check_responded", F.lit(False)) & (check.isNotNull() | F.col("aligned_answer").isNull())
    return rows.select(
        *[c for c in rows.columns if c not in ("reply_text", "check_text")],
        F.when(F.col("has_response"), reply).otherwise(F.coalesce(check, "aligned_answer")).alias("answer"),
        F.when(F.col("has_response"), F.coalesce("reply_responded", F.lit(False)) | reply.isNotNull())
        .otherwise(trusted | F.col("aligned_answer").isNotNull()).alias("answered"),
    )


def known_sessions(results: DataFrame, session_turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split run results by whether their base session (without ``#n``) exists: (known, unknown)."""
    based = results.withColumn("base_id", tx.strip_run_suffix("session_id"))
    ids = session_turns.select(F.col("session_id").alias("base_id")).distinct()
    return based.join(ids, "base_id", "left_semi"), based.join(ids, "base_id", "left_anti")


def capture_answers(results: DataFrame, session_turns: DataFrame, questions: DataFrame, *, checks: DataFrame, exchanges: DataFrame,
                    replies: DataFrame, turn_sources: DataFrame, aligned: DataFrame, order: DataFrame,
                    strict_reference: bool = False) -> DataFrame:
    """One row per asked question of every known run result.

    Artifact tables are keyed by the run's ``session_id`` (already matched to the run):
    ``checks(ord, responded, latency_ms, first_audio_ms, answer_text)``, ``exchanges(exch, caller, reply)``,
    ``replies(ord, responded, latency_ms, first_audio_ms)``, ``turn_sources(turn, files, saw)``,
    ``aligned(pos, answer)``, ``order(pos, question_id)``; positions start at 1.
    ``results``: ``session_id, agent_id, app_url, conversation_id``.

    The reply to question i is the i-th exchange after the greeting. When a call has no greeting the
    offset is dropped, unless ``strict_reference`` keeps it.
    """
    known, _ = known_sessions(results, session_turns)
    base = session_turns.select(
        F.col("session_id").alias("base_id"), F.col("turn").cast("bigint").alias("turn"), "language",
        F.col("question_id").alias("built_id"), F.col("question").alias("built_question"), F.col("expected_answer").alias("built_expected"),
        F.col("agent_id").alias("session_agent"),
    )
    turns = known.join(base, "base_id")
    key = ["session_id", "turn"]

    spoken = exchanges.withColumn("__first", F.when(F.col("exch") == 0, F.col("caller").isNull()))
    shift = spoken.groupBy("session_id").agg(F.coalesce(F.max("__first"), F.lit(False)).alias("__greeting"))
    offset = F.lit(1) if strict_reference else F.when(F.col("__greeting"), 1).otherwise(0)
    # exchanges are numbered from 0 with the greeting, from 1 without one
    start = exchanges.groupBy("session_id").agg(F.min("exch").alias("__min"))
    paired = exchanges.join(shift, "session_id").join(start, "session_id").select(
        "session_id", (F.col("exch") - F.col("__min") - offset + 1).alias("turn"), F.col("reply").alias("reply_text"),
        F.lit(True).alias("__has_exchange"),
    )
    replied = replies.select(
        "session_id", F.col("ord").alias("turn"), F.col("responded").alias("reply_responded"), F.col("latency_ms").alias("__reply_latency"),
        F.col("first_audio_ms").alias("__reply_audio"), F.lit(True).alias("__has_reply"),
    )
    checked = checks.select(
        "session_id", F.col("ord").alias("turn"), F.col("responded").alias("check_responded"), F.col("answer_text").alias("check_text"),
        F.col("latency_ms").alias("__check_latency"), F.col("first_audio_ms").alias("__check_audio"),
    )
    # Every turn takes part in the scan, so turns without a frame inherit from the turns before them.
    framed = turns.select(*key).join(turn_sources.withColumn("__known", F.lit(True)), key, "left").select(
        *key, "files", F.when(F.col("__known"), F.coalesce("saw", F.lit(True))).otherwise(False).alias("saw")
    )
    sources = provenance.carry_forward(framed).select(*key, "source_file_ids")
    meta = questions.select(F.col("id").alias("question_id"), "question", "expected_answer", "source_chunks")
    rows = (
        turns.join(order.select("session_id", F.col("pos").alias("turn"), "question_id"), key, "left")
        .withColumn("question_id", F.coalesce("question_id", "built_id"))
        .join(meta, "question_id", "left").join(paired, key, "left").join(replied, key, "left").join(checked, key, "left")
        .join(aligned.select("session_id", F.col("pos").alias("turn"), F.col("answer").alias("aligned_answer")), key, "left")
        .join(sources, key, "left")
        .withColumn("has_response", F.coalesce("__has_exchange", "__has_reply", F.lit(False)))
    )
    agent = F.coalesce(tx.blank_to_null("session_agent"), tx.blank_to_null("agent_id"), F.lit(""))
    chosen = choose_answers(rows.withColumn("__agent", agent))
    return chosen.select(
        "session_id", "language", F.col("__agent").alias("agent_id"), F.coalesce("conversation_id", F.lit("")).alias("conversation_id"),
        tx.call_url("app_url", "__agent", "conversation_id").alias("call_url"), "turn", "question_id",
        F.coalesce("question", "built_question").alias("question"), F.coalesce("expected_answer", "built_expected").alias("expected_answer"),
        "answer", "answered", F.coalesce("source_chunks", provenance.empty()).alias("source_chunks"),
        F.coalesce("source_file_ids", provenance.empty()).alias("source_file_ids"),
        F.coalesce("__reply_latency", "__check_latency").alias("latency_ms"),
        F.coalesce("__reply_audio", "__check_audio").alias("first_audio_ms"),
    )


def totals(captured: DataFrame, by: list[str] | None = None) -> DataFrame:
    grouped = captured.groupBy(*by) if by else captured.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("total_turns"), F.count_if("answered").alias("answered"), F.count_if(~F.col("answered")).alias("unanswered"),
        tx.round_half_up(F.avg("latency_ms")).alias("avg_latency_ms"), tx.round_half_up(F.avg("first_audio_ms")).alias("avg_first_audio_ms"),
    )
