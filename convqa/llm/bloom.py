"""Bloom filters of fixed size, put together by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20
SALTS = (1, 2, 3)


def of_ids(ids: DataFrame, key: str) -> np.ndarray:
    """64 bits in each of ``WORDS`` numbers; no more than these reach the driver, whatever the number of ids."""
    hashes = F.explode(F.array(*[F.xxhash64(F.col(key), F.lit(s)) for s in SALTS]))
    bits = ids.select(hashes.alias("h")).select(
        F.col("h").bitwiseAND(WORDS - 1).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 32) & 63 as int))").alias("bit"))
    got = bits.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(WORDS, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def hashed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns that :func:`hits` reads, at the end."""
    return rows.select("*", *[F.xxhash64(F.col(key), F.lit(s)).alias(f"__h{s}") for s in SALTS])


def hits(batch: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
    """Rows of a batch from :func:`hashed` whose ids may be in the filter, without the added columns."""
    own = batch.num_columns - len(SALTS)
    hit = np.ones(batch.num_rows, bool)
    for k in range(own, batch.num_columns):
        h = batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64)
        word = table[(h & np.uint64(WORDS - 1)).astype(np.int64)]
        hit &= (word >> ((h >> np.uint64(32)) & np.uint64(63)).astype(np.int64)) & 1 == 1
    return batch.select(list(range(own))).filter(pa.array(hit))


def maybe(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id may be among ``ids``: all that are, and a few others. An exact join of far fewer rows may follow."""
    table = rows.sparkSession.sparkContext.broadcast(of_ids(ids, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield hits(batch, table.value)

    return hashed(rows, key).mapInArrow(run, rows.schema)
