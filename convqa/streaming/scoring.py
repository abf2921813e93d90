"""Incremental scoring of captured answers: every record once, whatever is run again."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from convqa.functions.deflection import DEFAULT_PATTERNS
from convqa.operators import evaluation
from convqa.session import discard, materialize

BUCKETS = 64
PLACE = ("judge", "writer", "batch", "bucket")


def _stored(spark: SparkSession, out: str) -> DataFrame | None:
    """Results written so far; null before the first batch. Any other failure to read them is raised."""
    try:
        return spark.read.parquet(out)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def others_done(stored: DataFrame, judge_name: str, writer: str, buckets: list[int], key: list[str]) -> DataFrame:
    """Keys that other streams of this judge have scored, out of the buckets of a batch. Files of this stream's own batches are not read."""
    return stored.where((F.col("judge") == judge_name) & (F.col("writer") != writer) & F.col("bucket").isin(buckets)).select(*key)


def write_batch(batch: DataFrame, batch_id: int, judge: evaluation.Judge, out: str, writer: str, patterns=DEFAULT_PATTERNS, judge_name: str = "judge") -> None:
    """Score a batch of distinct records into its own folder, which a second run of the batch replaces."""
    spark = batch.sparkSession
    key = evaluation.record_key(batch)
    placed = materialize(batch.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")), "batch")
    stored, fresh = _stored(spark, out), placed
    if stored is not None:
        buckets = [r[0] for r in placed.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        fresh = evaluation.pending(placed, others_done(stored, judge_name, writer, buckets, key), key)
    scored = evaluation.score(fresh, judge, patterns)
    scored = scored.withColumns({"judge": F.lit(judge_name), "writer": F.lit(writer), "batch": F.lit(batch_id)})
    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(out)
    discard(spark, placed)


def score_stream(
    captured: DataFrame, judge: evaluation.Judge, out: str, checkpoint: str, patterns=DEFAULT_PATTERNS, judge_name: str = "judge",
) -> StreamingQuery:
    """Score every new record once per judge; results lie below ``judge``, then ``writer`` (this stream), ``batch`` and a bucket of sessions.

    A record is known by its run (``run_stamp``, where the input has it), session and turn. Repeats within the stream are kept
    out by its state, repeats of a batch replace what they wrote, and records that another stream of this judge has scored are
    looked up in that stream's buckets. So what a batch reads does not grow with the batches before it.
    """
    writer = "w" + hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    distinct = captured.dropDuplicates(evaluation.record_key(captured))

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, judge, out, writer, patterns, judge_name)

    return distinct.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
