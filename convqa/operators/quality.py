"""Data-quality rules: table in, one row per problem out (``id, issue``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convqa.config import CallConfig
from convqa.functions import text as tx
from convqa.operators import ordered as o
from convqa.operators import transcripts

LANGUAGES = ("ar", "en")
# Fields a dataset import needs (the pair id is optional).
REQUIRED = ("id", "language", "topic", "sub_topic", "question", "expected_answer", "source_chunks")


def _issue(test: Column, message: str | Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(test, F.lit(True)), text)


def _issues(df: DataFrame, ident: str, tests: Sequence[Column]) -> DataFrame:
    return df.select(F.col(ident).alias("id"), F.explode(F.array_compact(F.array(*tests))).alias("issue"))


def duplicates(df: DataFrame, ident: str = "id") -> DataFrame:
    """One row per repetition of an id after its first use."""
    counted = df.where(F.coalesce(F.col(ident), F.lit("")) != "").groupBy(F.col(ident).alias("id")).agg((F.count(F.lit(1)) - 1).alias("__extra"))
    return o.repeated(counted.where("__extra > 0"), F.col("__extra")).select("id", F.lit("duplicate id").alias("issue"))


def unknown_chunks(questions: DataFrame, chunks: DataFrame, ids: str = "source_chunks", only_id_like: bool = False) -> DataFrame:
    """References to chunks that do not exist. ``only_id_like`` lets free-text excerpts pass."""
    refs = questions.select("id", F.explode(ids).alias("ref"))
    if only_id_like:
        refs = refs.withColumn("ref", tx.strip("ref")).where(F.col("ref").rlike("^chunk_\\d+$"))
    missing = refs.join(chunks.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti")
    return missing.select("id", F.concat(F.lit('unknown source chunk "'), "ref", F.lit('"')).alias("issue"))


def _question_tests() -> list[Column]:
    blank = lambda c: tx.blank_to_null(c).isNull()
    return [
        _issue(~F.coalesce("id", F.lit("")).rlike("^Q\\d+$"), "invalid id"),
        _issue(F.coalesce("pair_id", F.lit("")) == "", "missing pair_id"),
        _issue(~F.coalesce("language", F.lit("")).isin(*LANGUAGES), "language must be en/ar"),
        _issue(blank("question"), "question is empty"),
        _issue(blank("expected_answer"), "expected_answer is empty"),
        _issue(F.coalesce(F.size("source_chunks"), F.lit(0)) <= 0, "source_chunks must be a non-empty array"),
    ]


def validate_questions(questions: DataFrame, chunks: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Question rules. Standalone form: entries that look like chunk ids must exist, free text passes.
    ``strict`` (generator form): every entry must be a known chunk."""
    found = _issues(questions, "id", _question_tests()).unionByName(duplicates(questions))
    if not strict:
        blank = F.exists("source_chunks", lambda c: c.isNull() | (tx.strip(c) == ""))
        found = found.unionByName(questions.where(blank).select("id", F.lit("source_chunks entries must be non-empty strings").alias("issue")))
    if chunks is not None:
        found = found.unionByName(unknown_chunks(questions, chunks, only_id_like=not strict))
    return found


def validate_import(questions: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Dataset import: required fields, duplicate ids, broken chunk references. Any row means: reject the set."""
    types = dict(questions.dtypes)
    def empty(c: str) -> Column:
        if types[c].startswith("array"):
            return F.col(c).isNull() | (F.size(c) == 0)
        return F.col(c).isNull() | (F.col(c).cast("string") == "")
    found = _issues(questions.withColumn("__id", F.coalesce(F.col("id").cast("string"), F.lit("?"))), "__id", [
        F.when(empty(c), F.lit(f'missing/empty "{c}"')) for c in REQUIRED])
    found = found.unionByName(duplicates(questions))
    if chunks is not None and "chunk_ids" in questions.columns:
        broken = unknown_chunks(questions, chunks, "chunk_ids")
        found = found.unionByName(broken)
    return found


def accepted(issues: DataFrame) -> DataFrame:
    """All or nothing: one row, true when no issue was found."""
    return issues.agg((F.count(F.lit(1)) == 0).alias("accepted"), F.count(F.lit(1)).alias("issues"))


def validate_flows(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Flow entries: id, language, mode and question; a full dump needs its answer, the step form needs complete steps.
    All issues are reported, or at most ``limit`` per entry; texts with lost encoding are reported on top."""
    blank = lambda c: tx.blank_to_null(c).isNull()
    ident = F.coalesce(tx.blank_to_null("flow_id"), tx.blank_to_null("id"), F.lit("?"))
    steps = F.coalesce("steps", F.array().cast(entries.schema["steps"].dataType))
    numbered = lambda f: F.flatten(F.transform(steps, f))
    step_issues = numbered(lambda s, i: F.array(
        F.when(F.coalesce(s["expected_answer"], F.lit("")) == "", F.concat(F.lit("step"), (i + 1).cast("string"), F.lit(": missing expected_answer"))),
        F.when(F.coalesce(s["stimulus"], F.lit("")) == "", F.concat(F.lit("step"), (i + 1).cast("string"), F.lit(": missing stimulus")))))
    own = F.array(
        F.when(blank("flow_id") & blank("id"), "missing flow_id/id"), F.when(blank("language"), "missing language"),
        F.when(blank("mode"), "missing mode"), F.when(blank("question"), "missing question"),
        F.when((F.col("mode") == "full_dump") & blank("expected_answer"), "full_dump missing expected_answer"),
        F.when((F.col("mode") == "incremental") & F.col("steps").isNull(), "incremental missing steps[]"))
    rules = F.array_compact(F.concat(own, step_issues))
    rules = rules if limit is None else F.slice(rules, 1, limit)
    lost = lambda c, name: F.when(tx.looks_garbled(c), F.lit(f"{name} has ??? pattern"))
    garbled = F.array_compact(F.concat(
        F.array(*[lost(c, c) for c in ("sub_topic", "question", "expected_answer")]),
        numbered(lambda s, i: F.array(lost(s["stimulus"], "step stimulus"), lost(s["expected_answer"], "step expected_answer")))))
    return entries.select(ident.alias("id"), F.explode(F.concat(rules, garbled)).alias("issue"))


def summary(issues: DataFrame, keep: int = 15) -> DataFrame:
    """Number of problems per kind with a short list of example ids (a top-k, pruned map-side)."""
    kind = F.regexp_replace("issue", '"[^"]*"$', "")
    named = issues.withColumn("kind", F.trim(kind))
    counts = named.groupBy("kind").agg(F.count(F.lit(1)).alias("problems"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("id", "issue"))
    first = named.withColumn("__k", rank).where(F.col("__k") <= keep).groupBy("kind").agg(F.sort_array(F.collect_list(F.col("id").cast("string"))).alias("examples"))
    return counts.join(first, "kind")


def validate_transcripts(turns: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Stored transcript check per call: enough filled turns, and both sides present."""
    return transcripts.profile(turns, config)


def validate_artifacts(transcript_checks: DataFrame, recordings: DataFrame) -> DataFrame:
    """Transcript and recording verdict of a call with all failing reasons joined.

    ``transcript_checks``: ``conv_id, saved, reason``; ``recordings``: ``conv_id, recording_url``.
    """
    url = tx.blank_to_null("recording_url")
    rec = F.when(url.isNull(), "persisted conversation has no recording_url")
    joined = recordings.join(transcript_checks.select("conv_id", F.col("saved").alias("__t"), F.col("reason").alias("__r")), "conv_id", "left")
    text = F.when(~F.coalesce("__t", F.lit(False)), F.coalesce("__r", F.lit("persisted transcript missing")))
    reason = F.concat_ws("; ", text, rec)
    return joined.select(
        "conv_id", F.coalesce("__t", F.lit(False)).alias("transcript_saved"), url.isNotNull().alias("recording_saved"),
        F.when(reason == "", "ok").otherwise(reason).alias("reason")).withColumn("saved", F.col("reason") == "ok")


NUMBER = "\\d[\\d,.]*"


def grounding_issues(records: DataFrame) -> DataFrame:
    """Generated records against their sources: numbers missing from the sources, excerpts that are no quotes,
    and questions that occur more than once. ``records``: ``id, question, expected_answer, sources ARRAY<STRING>, document``."""
    numbers = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, "[,.]+$", "")))
    unsupported = F.array_except(numbers(F.col("expected_answer")), numbers(F.array_join("sources", "\n")))
    by_number = records.select("id", F.explode(unsupported).alias("n")).select("id", F.concat(F.lit("number not in sources: "), "n").alias("issue"))
    quotes = records.where(F.exists("sources", lambda s: ~F.col("document").contains(s))).select("id", F.lit("excerpt is not verbatim").alias("issue"))
    key = tx.normalize_text("question")
    repeated = records.groupBy(key.alias("__k")).agg(F.min("id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    twice = records.withColumn("__k", key).join(repeated, "__k").where(F.col("id") != F.col("__first")).select("id", F.lit("question is not distinct").alias("issue"))
    return by_number.unionByName(quotes).unionByName(twice)
