"""Scoring: the gate before the judge, judge payloads, verdicts, summaries and judge comparison."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from convqa.functions import deflection
from convqa.functions import text as tx

DEFLECTED = "deflection_detected"
UNANSWERED = "unanswered"
METRICS = ("relevancy", "faithfulness")
THRESHOLD = 0.5
RECORD_KEY = ("session_id", "turn")
# Scores of other runs or other judges are other records; tables that have these columns are matched on them too.
FULL_KEY = ("run_stamp", "judge", *RECORD_KEY)
OVERALL, BY_LANGUAGE = "overall", "language"
METRIC = "struct<metric:string,score:double,pass:boolean,reason:string>"
RESULT_TAIL = f"metrics array<{METRIC}>, error string, calls bigint, prompt_tokens bigint, completion_tokens bigint, judge_ms bigint"
RESULT_COLUMNS = ("metrics", "error", "calls", "prompt_tokens", "completion_tokens", "judge_ms")


def answered(answer: str = "answer") -> Column:
    return F.coalesce(F.col(answer), F.lit("")) != ""


def answer_stats(df: DataFrame, by: Sequence[str] = (), patterns=deflection.DEFAULT_PATTERNS, default_language: str = "en") -> DataFrame:
    """Turns, answered, unanswered, deflections among the answered, answer rate and mean latency.

    With ``by`` the overall row comes along; ``scope`` tells it from a group whose key is null.
    """
    lang = F.lower(F.coalesce("language", F.lit(default_language)))
    flagged = df.withColumn("__a", answered()).withColumn("__d", answered() & deflection.is_deflection("answer", lang, patterns))
    grouped = flagged.groupingSets([[], list(by)], *by) if by else flagged.groupBy()
    out = grouped.agg(
        F.count(F.lit(1)).alias("total_turns"), F.count_if("__a").alias("answered"), F.count_if(~F.col("__a")).alias("unanswered"),
        F.count_if("__d").alias("deflections"), F.avg(F.when(F.col("__a"), F.col("latency_ms"))).alias("__lat"),
        *([F.grouping_id().alias("__g")] if by else []),
    )
    if by:
        out = out.withColumn("scope", F.when(F.col("__g") > 0, OVERALL).otherwise("_".join(by))).drop("__g")
    return out.withColumn("answer_rate", tx.percent1(F.col("answered"), F.col("total_turns"))).withColumn(
        "avg_latency_ms", F.bround("__lat").cast("bigint")).drop("__lat")


def judge_inputs(captured: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return captured.select(
        *RECORD_KEY, F.coalesce("question", F.lit("")).alias("input"), F.coalesce("answer", F.lit("")).alias("actual_output"),
        F.coalesce("expected_answer", F.lit("")).alias("expected_output"), F.coalesce("source_chunks", none).alias("retrieval_context"))


def export_payload(captured: DataFrame, patterns=deflection.DEFAULT_PATTERNS, default_language: str = "en") -> DataFrame:
    """Every record as a judge would get it, with its turn type and the deflection flag."""
    lang = F.lower(F.coalesce("language", F.lit(default_language)))
    none = F.array().cast("array<string>")
    return captured.select(
        "session_id", "question_id", lang.alias("language"), "turn", tx.turn_type("question").alias("turn_type"), "conversation_id", "latency_ms",
        "first_audio_ms", "question", "expected_answer", "answer", F.coalesce("source_chunks", none).alias("source_chunks"),
        F.coalesce("source_file_ids", none).alias("source_file_ids"), deflection.is_deflection("answer", lang, patterns).alias("deflection_detected"))


def gate(captured: DataFrame, patterns=deflection.DEFAULT_PATTERNS, default_language: str = "en") -> DataFrame:
    """Adds ``error``: unanswered and deflected records never reach the judge."""
    lang = F.lower(F.coalesce("language", F.lit(default_language)))
    return captured.withColumn("error", F.when(~answered(), UNANSWERED).when(deflection.is_deflection("answer", lang, patterns), DEFLECTED))


def record_key(*tables: DataFrame) -> list[str]:
    """Columns of the full record key that all tables have."""
    return [c for c in FULL_KEY if all(c in t.columns for t in tables)]


def pending(records: DataFrame, done: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Records not scored yet; null keys are keys like others."""
    key = list(key or record_key(records, done))
    known = done.select(*[F.col(c).alias(f"__{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return records.join(known, same, "left_anti")


def sample(records: DataFrame, n: int) -> DataFrame:
    """First ``n`` records in (session, turn) order; 0 keeps all."""
    return records.orderBy(*RECORD_KEY).limit(n) if n > 0 else records


Judge = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


JUDGE_INPUT = ("session_id", "turn", "language", "input", "actual_output", "expected_output", "retrieval_context")


def score(captured: DataFrame, judge: Judge, patterns=deflection.DEFAULT_PATTERNS) -> DataFrame:
    """Run a judge over the records that pass the gate; the others keep their gate error. Every input row comes out once.

    ``judge`` maps batches with the columns ``JUDGE_INPUT`` to batches of the result columns, one row for each row and in
    the same order; the record itself travels beside it. The gate comes first on purpose: filters are not pushed below a
    Python step.
    """
    record = [c for c in captured.columns if c not in RESULT_COLUMNS]
    gated = gate(captured.select(*record), patterns)
    inputs = gated.where(F.col("error").isNull()).select(
        *record, *[F.col(c).alias(f"__{c}") for c in ("session_id", "turn", "language")], F.coalesce("question", F.lit("")).alias("__input"), F.col("answer").alias("__actual_output"),
        F.coalesce("expected_answer", F.lit("")).alias("__expected_output"), F.coalesce("source_chunks", F.array().cast("array<string>")).alias("__retrieval_context"))
    schema = StructType(gated.select(*record).schema.fields + StructType.fromDDL(RESULT_TAIL).fields)
    tail = to_arrow_schema(StructType.fromDDL(RESULT_TAIL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def feed() -> Iterator[pd.DataFrame]:
            for batch in batches:
                waiting.append(batch)
                yield pa.Table.from_batches([batch]).select([f"__{c}" for c in JUDGE_INPUT]).rename_columns(list(JUDGE_INPUT)).to_pandas()

        for result in judge(feed()):
            batch = waiting.popleft()
            if len(result) != batch.num_rows:
                raise ValueError(f"the judge gave {len(result)} results for {batch.num_rows} records")
            if batch.num_rows:
                made = pa.Table.from_pandas(result[list(RESULT_COLUMNS)], schema=tail, preserve_index=False).combine_chunks()
                columns = [batch.column(i) for i in range(len(record))] + [c.chunk(0) for c in made.columns]
                yield pa.RecordBatch.from_arrays(columns, names=record + list(RESULT_COLUMNS))

    closed = gated.where(F.col("error").isNotNull()).select(
        *record, F.array().cast(f"array<{METRIC}>").alias("metrics"), "error", *[F.lit(0).cast("bigint").alias(c) for c in RESULT_COLUMNS[2:]])
    return inputs.mapInArrow(run, schema).unionByName(closed)


def overlap_judge(threshold: float = THRESHOLD) -> Judge:
    """Deterministic stand-in for a model: word overlap with the question and with the sources."""
    def words(text) -> set:
        return {w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()}

    def share(part: set, whole: set) -> float:
        return len(part & whole) / len(part) if part else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                said = words(r.actual_output)
                scores = {"relevancy": share(words(r.input), said | words(r.expected_output)), "faithfulness": share(said, words(" ".join(r.retrieval_context)))}
                rows.append({
                    "error": None, "calls": len(scores), "prompt_tokens": len(said), "completion_tokens": 0, "judge_ms": 0,
                    "metrics": [{"metric": m, "score": s, "pass": s >= threshold, "reason": "word overlap"} for m, s in scores.items()]})
            yield pd.DataFrame(rows, columns=list(RESULT_COLUMNS))

    return run


def score_verdicts(verdicts: DataFrame, threshold: float = THRESHOLD, key: Sequence[str] = ("record_id", "metric")) -> DataFrame:
    """Metric score from per-statement verdicts: everything but ``no`` is accepted, ``idk`` counts as ambiguous."""
    v = F.lower(tx.strip(F.coalesce("verdict", F.lit(""))))
    out = verdicts.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v != "no").alias("accepted"), F.count_if(v == "idk").alias("ambiguous"))
    return out.withColumn("score", F.col("accepted") / F.col("total")).withColumn("pass", F.col("score") >= threshold)


def verdict_reason(verdicts: DataFrame, key: Sequence[str] = ("record_id", "metric"), statement_chars: int | None = None) -> DataFrame:
    """Readable reason per metric: accepted share, rejected statements with their reasons.

    Statements are whole unless ``statement_chars`` says where to cut them.
    """
    shown = F.col("item") if statement_chars is None else F.substring("item", 1, statement_chars)
    v = F.lower(tx.strip(F.coalesce("verdict", F.lit(""))))
    said = F.when(F.col("item").isNotNull(), F.concat(F.lit('"'), shown, F.lit('" '))).otherwise("")
    line = F.concat(said, F.lit("- "), F.coalesce(tx.blank_to_null("reason"), F.lit("no explanation given")))
    grouped = verdicts.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v != "no").alias("accepted"), F.count_if(v == "idk").alias("ambiguous"),
        F.array_sort(F.collect_list(F.when(v == "no", F.struct(F.col("ord").alias("o"), line.alias("l"))))).alias("__r"))
    noun = F.when(F.col("metric") == "relevancy", "statement").otherwise("claim")
    rejected = F.array_join(F.transform("__r", lambda x: x["l"]), " | ")
    text = F.concat(
        "metric", F.lit(": "), F.col("accepted").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" "), noun, F.lit("s accepted"),
        F.when(F.size("__r") > 0, F.concat(F.lit(". Rejected: "), rejected)).otherwise(""),
        F.when(F.col("ambiguous") > 0, F.concat(F.lit(". ("), F.col("ambiguous").cast("string"), F.lit(" ambiguous)"))).otherwise(""))
    return grouped.select(*key, text.alias("reason"))


def summary(results: DataFrame, default_language: str = "en") -> DataFrame:
    """Records, errors, deflections, and per metric mean and pass rate; ``scope`` is overall (language null) or language.

    ``results``: ``language, error, metrics ARRAY<STRUCT<metric,score,pass,...>>``. One row per scope and metric; a missing
    language counts as the default one.
    """
    results = results.withColumn("language", F.coalesce("language", F.lit(default_language)))
    deflected = F.coalesce(F.col("error") == DEFLECTED, F.lit(False))
    heads = results.groupBy("language").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("error").isNotNull() & ~deflected).alias("errors"), F.count_if(deflected).alias("deflections"))
    scored = results.select("language", F.explode("metrics").alias("m")).select("language", "m.*")
    means = scored.groupBy("language", "metric").agg(
        F.sum("score").alias("sum"), F.count("score").alias("n"), F.sum(F.col("pass").cast("int")).alias("passed"), F.count("pass").alias("tested"))

    def rolled(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
        """The few rows per language, and their totals."""
        per = rows.withColumn("scope", F.lit(BY_LANGUAGE))
        total = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("language", F.lit(None).cast("string")).withColumn("scope", F.lit(OVERALL))
        return per.unionByName(total)

    heads = rolled(heads, [], ["records", "errors", "deflections"]).where("records is not null")
    means = rolled(means, ["metric"], ["sum", "n", "passed", "tested"]).select(
        F.col("scope").alias("__s"), F.col("language").alias("__l"), "metric", F.bround(F.col("sum") / F.col("n"), 3).alias("avg"), F.bround(100.0 * F.col("passed") / F.col("tested"), 1).alias("pass_rate"))
    return heads.join(means, (F.col("scope") == F.col("__s")) & F.col("language").eqNullSafe(F.col("__l")), "left").drop("__l", "__s")


def usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and, where measured, milliseconds spent in the judge."""
    return calls.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in RESULT_COLUMNS[2:] if c in calls.columns])


def bakeoff(results: DataFrame, judges: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Question by judge matrix: ``first / second`` score, ``ERR / ERR`` on error, ``-`` if not judged; then a mean row per metric.

    ``results``: ``question_id, judge, error, <metric columns>``.
    """
    two = lambda c: F.format_string("%.2f", c)
    cell = F.when(F.col("error").isNotNull(), "ERR / ERR").otherwise(F.concat_ws(" / ", *[two(F.col(m)) for m in metrics]))
    rows = results.groupBy("question_id").agg(*[
        F.coalesce(F.max(F.when(F.col("judge") == j, cell)), F.lit("-")).alias(j) for j in judges])
    ok = F.col("error").isNull()
    mean = lambda m, j: F.format_string("%.3f", F.avg(F.when(ok & (F.col("judge") == j), F.col(m)))).alias(j)
    means = [results.agg(*[mean(m, j) for j in judges]).select(F.lit(f"{m} avg").alias("question_id"), *judges) for m in metrics]
    for m in means:
        rows = rows.unionByName(m)
    return rows


def control_matrix(results: DataFrame, controls: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Was each corrupted answer failed by exactly the metric it attacks (``expected_fail`` null = clean control)?"""
    long = results.select("case_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS])).alias("x")).select("case_id", "x.*")
    joined = controls.join(long, "case_id").withColumn("failed", F.col("score") < threshold)
    return joined.select("case_id", "metric", "score", "failed", (F.col("metric").eqNullSafe(F.col("expected_fail"))).alias("should_fail")).withColumn(
        "caught", F.col("failed") & F.col("should_fail")).withColumn("as_expected", F.col("failed") == F.col("should_fail"))


@F.pandas_udf(StringType())
def _first_object(replies: pd.Series) -> pd.Series:
    """The JSON value that a decoder reads at the first brace of each text, or null."""
    decoder = json.JSONDecoder()

    def read(reply: str) -> str | None:
        _, brace, rest = reply.partition("{")
        try:
            return brace and brace + rest[:decoder.raw_decode(brace + rest)[1] - 1] or None
        except ValueError:
            return None

    return replies.map(read)


def parse_replies(df: DataFrame, reply: str = "reply", schema: str = "map<string,string>") -> DataFrame:
    """JSON out of model replies. Replies that are plain JSON stay in the engine; only the rest is searched in Python.

    Adds ``parsed`` and ``parse_error``.
    """
    plain = df.withColumn("__plain", F.coalesce(tx.is_json(reply), F.lit(False)))
    fast = plain.where("__plain").withColumn("__json", F.col(reply))
    slow = plain.where("not __plain").withColumn("__json", _first_object(F.coalesce(reply, F.lit(""))))
    text = F.coalesce(reply, F.lit(""))
    problem = (
        F.when(text == "", "empty completion").when(F.col("__json").isNotNull(), None)
        .when(~text.contains("{"), "no JSON object").otherwise("unbalanced JSON"))
    return fast.unionByName(slow).withColumn("parsed", F.from_json("__json", schema)).withColumn("parse_error", problem).drop("__plain", "__json")
