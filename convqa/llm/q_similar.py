"""Queries of the similarity searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convqa.llm import hash_forest, jaccard_join
from convqa.llm.registry import query, table


@query("op7_jaccard_join")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


@query("op3_hash_forest")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
