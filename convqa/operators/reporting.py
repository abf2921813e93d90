"""Run reports, gates, counts and the call view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convqa.functions import text as tx
from convqa.operators import transcripts


def session_results(checks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Outcome per session: replies, pass rule, latencies and the first error as the reason.

    ``checks``: ``session_id, ord, responded, latency_ms, error``; ``sessions``: ``session_id, language, turns``.
    """
    per = checks.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("__checks"), F.count_if("responded").alias("replies"), F.max("latency_ms").alias("max_ms"),
        tx.round_half_up(F.avg("latency_ms")).alias("avg_ms"), F.min_by("error", F.when(tx.blank_to_null("error").isNotNull(), F.col("ord"))).alias("__error"))
    joined = sessions.join(per, "session_id", "left").withColumn("replies", F.coalesce("replies", F.lit(0)))
    passed = (F.coalesce("__checks", F.lit(0)) == F.col("turns")) & (F.col("replies") == F.coalesce("__checks", F.lit(0)))
    short = F.format_string("only %d/%d turns answered", "replies", "turns")
    return joined.withColumn("passed", passed).select(
        *sessions.columns, "replies", "passed", F.when(F.col("passed"), "ok").otherwise(F.coalesce("__error", short)).alias("reason"), "max_ms", "avg_ms")


def run_report(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    grouped = results.groupBy(*by) if by else results.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("sessions"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def transcript_replies(pairs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Answered questions by the transcript, capped at the session's turns; all answered or a passed gate passes.

    ``pairs``: ``session_id, answer``; ``sessions``: ``session_id, turns, gate_passed, check_replies``.
    Sessions without a transcript fall back to the checks.
    """
    counts = pairs.groupBy("session_id").agg(F.count_if(F.col("answer").isNotNull()).alias("__answered"))
    joined = sessions.join(counts, "session_id", "left")
    all_answered = F.coalesce(F.col("__answered") >= F.col("turns"), F.lit(False))
    return joined.select(
        "session_id", "turns", F.least(F.coalesce("__answered", "check_replies"), F.col("turns")).alias("replies"),
        (all_answered | F.col("gate_passed")).alias("passed"))


def gate_reason(replies: Column, latency: Column, transcript: Column, recording: Column) -> Column:
    """First failing cause in fixed order."""
    return (
        F.when(~replies, "silent-clip").when(~latency, "reply-too-slow").when(~transcript, "transcript-not-saved")
        .when(~recording, "recording-url-missing").otherwise("ok"))


def call_gate(evidence: DataFrame) -> DataFrame:
    """``clip_count, checks, responded, exceeded_max, transcript_saved, recording_saved`` to a verdict per call."""
    replies = (F.col("checks") == F.col("clip_count")) & (F.col("responded") == F.col("checks"))
    reason = gate_reason(replies, ~F.col("exceeded_max"), F.coalesce("transcript_saved", F.lit(False)), F.coalesce("recording_saved", F.lit(False)))
    out = evidence.withColumn("reason", reason)
    return out.withColumn("passed", F.col("reason") == "ok").withColumn("retryable", tx.is_retryable("reason"))


def _by_language(total: str, first: str = "ar") -> list[Column]:
    is_first = F.col("language") == first
    return [F.count_if(is_first).alias("ar"), F.count_if(~F.coalesce(is_first, F.lit(False))).alias("en"), F.count(F.lit(1)).alias(total)]


def manifest(questions: DataFrame, first: str = "ar") -> DataFrame:
    """Questions per topic and sub topic with language counts, and a total row per topic; ``scope`` tells it from a missing sub topic."""
    out = questions.groupingSets([["topic", "sub_topic"], ["topic"]], "topic", "sub_topic").agg(*_by_language("total", first), F.grouping("sub_topic").alias("__g"))
    return out.withColumn("scope", F.when(F.col("__g") == 1, "topic").otherwise("sub_topic")).drop("__g")


def session_counts(sessions: DataFrame) -> DataFrame:
    is_ = lambda l: F.count_if(F.col("language") == l)
    return sessions.groupBy("topic", "file").agg(
        is_("ar").alias("ar_sessions"), is_("en").alias("en_sessions"), F.count(F.lit(1)).alias("total_sessions"),
        F.coalesce(F.sum("turns"), F.lit(0)).cast("bigint").alias("total_questions"))


def question_counts(questions: DataFrame) -> DataFrame:
    is_ = lambda l: F.count_if(F.col("language") == l)
    return questions.groupBy("topic", "file").agg(
        is_("ar").alias("ar_questions"), is_("en").alias("en_questions"), F.count(F.lit(1)).alias("total_questions"))


def status(questions: DataFrame, sessions: DataFrame, runs: DataFrame, captures: DataFrame, evals: DataFrame) -> DataFrame:
    """One long table: rows by language of questions and sessions, and the totals of the newest run, capture and evaluation."""
    def counted(df: DataFrame, what: str) -> DataFrame:
        return df.groupBy("language").agg(F.count(F.lit(1)).alias("value")).select(F.lit(what).alias("what"), F.col("language").alias("item"), "value")

    def newest(df: DataFrame, what: str, fields: list[str]) -> DataFrame:
        top = df.agg(F.max_by(F.struct(*fields), "stamp").alias("r"))
        return top.select(F.lit(what).alias("what"), F.explode(F.array(*[
            F.struct(F.lit(f).alias("item"), F.col(f"r.{f}").cast("bigint").alias("value")) for f in fields])).alias("x")).select("what", "x.*")

    return (
        counted(questions, "questions").unionByName(counted(sessions, "sessions"))
        .unionByName(newest(runs, "run", ["sessions", "passed", "failed"]))
        .unionByName(newest(captures, "captured", ["total_turns", "answered", "unanswered"]))
        .unionByName(newest(evals, "eval", ["records", "errors", "deflections"])))


def fallback_turns(checks: DataFrame, transcript: DataFrame, sources: DataFrame) -> DataFrame:
    """Turns of sessions that have no capture: checks zipped with the transcript pairs by position.

    ``checks``: ``session_id, ord, clip, latency_ms``; ``transcript``: ``session_id, ord, speaker, text``;
    ``sources``: carried-forward ``session_id, turn, source_file_ids``.
    """
    pairs = transcripts.pair(transcript.withColumnRenamed("session_id", "conv_id")).select(
        F.col("conv_id").alias("session_id"), F.col("pair").alias("ord"), F.col("question").alias("__q"), F.col("answer").alias("__a"))
    rows = checks.join(pairs, ["session_id", "ord"], "left").join(
        sources.select("session_id", F.col("turn").alias("ord"), "source_file_ids"), ["session_id", "ord"], "left")
    return rows.select(
        "session_id", F.col("ord").alias("turn"), tx.question_id_from_clip_strict("clip").alias("question_id"),
        F.coalesce("__q", F.lit("")).alias("question"), F.lit("").alias("expected_answer"), tx.blank_to_null("__a").alias("answer"),
        F.coalesce("source_file_ids", F.array().cast("array<string>")).alias("source_file_ids"), "latency_ms", tx.blank_to_null("__a").isNotNull().alias("responded"))


def call_view(run: DataFrame, captured: DataFrame, evals: DataFrame, fallback: DataFrame, *, capture_matches_run: bool = True) -> DataFrame:
    """Turn-level view of a run: captured turns if the capture belongs to the run, else the fallback turns; scores attached.

    ``evals``: ``session_id, turn, <scores>`` with at most one row per key needed; the last by ``ord`` wins.
    """
    columns = ["session_id", "turn", "question_id", "question", "expected_answer", "answer", "source_file_ids", "latency_ms", "responded"]
    own = captured.select(*columns).where(F.lit(capture_matches_run))
    scores = evals.groupBy("session_id", "turn").agg(F.max_by(F.struct(*[c for c in evals.columns if c not in ("session_id", "turn", "ord")]), "ord").alias("e"))
    scored = own.join(scores, ["session_id", "turn"], "left").withColumn("origin", F.lit("capture"))
    missing = fallback.join(own.select("session_id").distinct(), "session_id", "left_anti").select(*columns).withColumn("origin", F.lit("transcript"))
    turns = scored.unionByName(missing, allowMissingColumns=True)
    return run.join(turns, "session_id", "left").select(*run.columns, *[c for c in columns if c != "session_id"], "origin", "e.*")
