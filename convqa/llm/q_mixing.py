"""Query of the source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convqa.llm import mixing
from convqa.llm.registry import query, table


@query("op6_mixing")
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
