"""A number for every row of a table that has none."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convqa.session import materialize


def numbered(docs: DataFrame, columns: Sequence[str], name: str = "__row") -> DataFrame:
    """``columns`` of ``docs`` and a number that tells rows apart and comes out alike at every reading.

    Rows of Parquet files are named by their file and place, so nothing is written; should two of them share a hash, another
    seed is taken. Rows that come from elsewhere are written once with a running number.
    """
    kept = [F.col(f"`{c}`") for c in columns]
    try:
        placed = docs.select(*kept, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return materialize(docs.select(*kept, F.monotonically_increasing_id().alias(name)), "rows")
    for seed in itertools.count():
        keyed = placed.select(*kept, F.xxhash64("__file", "__at", F.lit(seed)).alias(name))
        if keyed.groupBy(name).count().where("count > 1").isEmpty():
            return keyed
