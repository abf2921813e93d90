"""Sinks. Layouts are partition folders, so a later scan prunes by topic, language or judge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convqa import schemas
from convqa.operators import flows
from convqa.operators import sessions as ses


def _dynamic(df: DataFrame, mode: str):
    """Overwrite replaces only the partitions that are written."""
    return df.write.mode(mode).option("partitionOverwriteMode", "dynamic")


def _file_name(column: str):
    """A flow id without the characters that file names must not have; ids that lose some get a mark, so no two share a file.

    Never null, so that the writer takes the rows in the order they come in.
    """
    plain = F.regexp_replace(column, "[\\\\/:*?\"<>|]", "_")
    marked = F.when(plain == F.col(column), plain).otherwise(F.concat(plain, F.lit("-"), F.substring(F.md5(column), 1, 8)))
    return F.coalesce(marked, F.lit("_"))


def write_sessions(turns: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Nested sessions by topic and sub topic (``subtopic`` is ``topic/name``)."""
    nested = ses.nest(turns)
    parts = F.split("subtopic", "/")
    placed = nested.withColumn("topic", parts[0]).withColumn("sub_topic", F.element_at(parts, -1))
    _dynamic(placed, mode).partitionBy("topic", "sub_topic").json(root)


def write_questions(questions: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Questions by topic, sub topic, mode and language; the partition fields also stay in the rows."""
    step = F.when(F.col("id").contains("-INC-"), "Incremental").otherwise("FullDump")
    placed = questions.select("*", F.col("topic").alias("p_topic"), F.col("sub_topic").alias("p_sub_topic"), step.alias("p_mode"), F.col("language").alias("p_language"))
    _dynamic(placed, mode).partitionBy("p_topic", "p_sub_topic", "p_mode", "p_language").json(root)


def write_flow_steps(steps: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Flat steps by flow, as ``readers.read_flow_steps`` takes them; a hot flow is many files."""
    placed = steps.withColumn("p_flow", _file_name("flow_id"))
    _dynamic(placed, mode).partitionBy("p_flow").json(root)


def write_flows(steps: DataFrame, root: str, mode: str = "overwrite") -> None:
    """One nested JSON document per flow, as other tools read it, from the flat steps of ``operators.flows``.

    Rows are sorted by flow and place and appended to the flow's file piece by piece; a document is one file, so one task
    writes it, but no task holds more of it than a row. Pieces are divided by a blank, which JSON allows between them.
    """
    lines = flows.spec_lines(steps).withColumn("p_flow", _file_name("flow_id"))
    # dealt by a hash of the name, because the planner leaves out a dealing that a join seems to have done
    ordered = lines.repartition(F.xxhash64("p_flow")).sortWithinPartitions("p_flow", "flow_id", "at")
    _dynamic(ordered.select("value", "p_flow"), mode).partitionBy("p_flow").option("lineSep", " ").text(root)


def write_captured(captured: DataFrame, root: str, stamp: str) -> None:
    """Records and their header totals of one capture."""
    from convqa.operators.capture import totals

    captured.write.mode("overwrite").json(f"{root}/captured-answers-{stamp}")
    head = totals(captured.sparkSession.read.schema(captured.schema).json(f"{root}/captured-answers-{stamp}"))
    head.select(F.lit(stamp).alias("stamp"), "*").write.mode("overwrite").json(f"{root}/captured-totals-{stamp}")


def write_results(results: DataFrame, root: str, source_stamp: str, judge: str) -> None:
    """Append scores below their source and judge, so judges never overwrite each other."""
    from convqa.functions.text import judge_slug

    placed = results.withColumn("source_stamp", F.lit(source_stamp)).withColumn("judge", judge_slug(F.lit(judge)))
    placed.write.mode("append").partitionBy("source_stamp", "judge").parquet(root)


def write_stats(stats: DataFrame, path: str, source: str) -> None:
    stats.select(F.lit(source).alias("source"), F.struct(*stats.columns).alias("stats")).write.mode("overwrite").json(path)


def write_interruption_csv(results: DataFrame, path: str) -> None:
    results.select(*schemas.INTERRUPTION_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_payload(payload: DataFrame, path: str, source: str, instructions: str, metrics=("relevancy", "faithfulness")) -> None:
    """Judge payload records plus a one-row header with source, metrics and instructions."""
    payload.write.mode("overwrite").json(f"{path}/records")
    head = payload.sparkSession.range(1).select(
        F.lit(source).alias("source"), F.current_timestamp().alias("exported_at"), F.array(*[F.lit(m) for m in metrics]).alias("metrics_targets"),
        F.lit(instructions).alias("instructions"))
    head.write.mode("overwrite").json(f"{path}/header")


def write_prompts(prompts: DataFrame, root: str) -> None:
    """Prompt texts by batch file and the manifest of flows per batch."""
    prompts.select(F.col("file").alias("batch"), F.col("prompt").alias("value")).write.mode("overwrite").partitionBy("batch").text(f"{root}/prompts")
    prompts.select("file", F.split("flows", ", ").alias("flows")).write.mode("overwrite").json(f"{root}/manifest")
