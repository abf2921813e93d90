"""Nearest neighbours by inner product through forests of hash prefixes.

Rows are dealt into shards of bounded size by a hash of their id. In a shard each tree is a sorted array of 32-bit hash strings (signs of
random projections of the vectors, lengthened by one component so that a larger inner product means a smaller angle). A query goes
down to its longest matching prefix in every tree and then up in all trees together, one bit at a time, until the prefix ranges hold
the share of the shard that the fitted budget asks for; the ranges' rows are scored exactly and the best per shard are merged.

The budget is fitted on ``sample`` queries: their true neighbours are found by comparing them with all rows in blocks, and the budget is
the share of a shard that must be visited to meet ``aim`` of them. So the data decide how much is visited: little for
clustered vectors, a large part for vectors without any structure. Every row is indexed.

Queries and shards meet block by block (``block`` queries with one shard at a time), so a task holds two bounded blocks
whatever the data; copies of one vector spread over the shards.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part; with fewer candidates than ``top`` all are returned; ties go to the smaller id; a query never finds rows of its own id;
an empty table, and one without queries, gives no rows; equal rows are found once, rows of one id with other vectors are candidates of
their own and as queries are answered together; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convqa.session import materialize

BITS = 32


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` (array of double) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    got = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("v", lambda x: x != 0))
    common = got.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return got.where(F.size("v") == (common["n"] if common else 0))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def packed(rows: DataFrame, block: str, width: int) -> DataFrame:
    """One row per block: ids and vectors end to end."""

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids, v = table.column("id").to_numpy()[order], matrix(table.column("v"), width)[order]
        return pa.table({block: table.column(block).slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary())})

    return rows.select(block, "id", "v").groupBy(block).applyInArrow(pack, f"{block} long, ids binary, vectors binary")


class Forest:
    """The trees of one shard."""

    def __init__(self, vectors: np.ndarray, planes: np.ndarray, largest: float):
        self.planes, self.trees = planes, planes.shape[1] // BITS
        spare = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0))
        self.own = self.strings(np.hstack([vectors, spare[:, None]]))
        self.order = np.argsort(self.own, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.own, self.order, axis=0)

    def strings(self, long: np.ndarray) -> np.ndarray:
        bits = (long @ self.planes > 0).reshape(len(long), self.trees, BITS)
        return bits @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        return self.strings(np.hstack([queries, np.zeros((len(queries), 1))]))

    def ranges(self, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end, in every tree, of the rows that share ``level`` leading bits with each query."""
        shift = np.uint64(BITS - level)
        low = (strings >> shift) << shift
        high = low + (np.uint64(1) << shift)
        lo, hi = (np.stack([np.searchsorted(self.sorted[:, t], x[:, t]) for t in range(self.trees)], axis=1) for x in (low, high))
        return lo, hi

    def search(self, queries: np.ndarray, budget: float) -> Iterator[np.ndarray]:
        """Rows visited for each query, in query order."""
        strings, goal = self.of_queries(queries), max(1.0, budget * len(self.own))
        level = np.full(len(queries), -1)
        begin, end = (np.zeros((len(queries), self.trees), np.int64) for _ in range(2))
        for up in range(BITS, -1, -1):
            still = np.flatnonzero(level < 0)
            if not len(still):
                break
            lo, hi = self.ranges(strings[still], up)
            enough = ((hi - lo).sum(axis=1) >= goal) | (up == 0)
            level[still[enough]] = up
            begin[still[enough]], end[still[enough]] = lo[enough], hi[enough]
        for q in range(len(queries)):
            seen = np.zeros(len(self.own), bool)
            for t in range(self.trees):
                seen[self.order[begin[q, t]:end[q, t], t]] = True
            yield np.flatnonzero(seen)

    def needed(self, queries: np.ndarray, rows: list[np.ndarray]) -> list[float]:
        """Share of the shard (rows counted once per tree) to visit before each of the given rows is met."""
        strings = self.of_queries(queries)
        sizes = np.stack([(hi - lo).sum(axis=1) for lo, hi in (self.ranges(strings, up) for up in range(BITS + 1))]) / len(self.own)
        out: list[float] = []
        for q, at in enumerate(rows):
            for r in at:
                differ = int((strings[q] ^ self.own[r]).min())
                out.append(float(sizes[BITS - differ.bit_length(), q]))
        return out


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * top:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top])
        return near[np.lexsort((ids[near], -scores[near]))[:top]]
    return np.lexsort((ids, -scores))[:top]


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, so that a score never depends on its block."""
    return np.einsum("ij,j->i", vectors, query)


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = 20, trees: int = 32, aim: float = 0.95, sample: int = 60,
           shard_rows: int = 4096, block: int = 1024, seed: int = 1) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found of each row for which ``is_query`` holds."""
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score double"
    base = usable(rows, key, vector)
    asked_ids = rows.where(is_query).select(F.col(key).cast("long").alias("id")).distinct()
    facts = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("largest")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not facts["n"]:
        return empty
    width, largest = facts["width"], facts["largest"]
    planes = np.random.default_rng(seed).normal(size=(width + 1, trees * BITS))
    shards = -(-facts["n"] // shard_rows)
    dealt = packed(base.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))), "shard", width)
    dealt = materialize(dealt, "shards")
    asked = base.join(asked_ids, "id", "left_semi")
    asked = materialize(asked, "queries")
    n_asked = asked.count()
    if not n_asked:
        return empty
    blocks = -(-n_asked // block)

    def unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, width)

    # The bounded sample of queries: true neighbours from all rows, then what the forests must visit to meet them.
    probe = asked.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).toArrow()
    probe_ids, probe_v = probe.column("id").to_numpy(), matrix(probe.column("v"), width)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids, vectors = unpack(ids, vectors)
                for own, q in zip(probe_ids, probe_v):
                    s = np.where(ids == own, -np.inf, products(vectors, q))
                    at = best(s, ids, top + 1)
                    at = at[np.isfinite(s[at])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), own)), pa.array(ids[at]), pa.array(s[at])], names=["query_id", "vec_id", "score"])

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    truth = dealt.mapInArrow(exact, schema).withColumn("r", place).where(F.col("r") <= top).select("query_id", "vec_id").toArrow()
    wanted: dict[int, np.ndarray] = {}
    for own in probe_ids.tolist():
        wanted[own] = np.sort(truth.column(1).to_numpy()[truth.column(0).to_numpy() == own])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids, vectors = unpack(ids, vectors)
                found = [np.flatnonzero(np.isin(ids, wanted[q])) for q in probe_ids.tolist()]
                shares = Forest(vectors, planes, largest).needed(probe_v, found)
                yield pa.RecordBatch.from_arrays([pa.array(shares, pa.float64())], names=["share"])

    shares = dealt.mapInArrow(visits, "share double").toArrow().column(0).to_numpy()
    budget = float(np.quantile(shares, aim)) if len(shares) else 1.0

    def local(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            ids, vectors = unpack(left.column("ids")[0].as_py(), left.column("vectors")[0].as_py())
            q_ids, q = unpack(right.column("ids")[0].as_py(), right.column("vectors")[0].as_py())
            for k, seen in enumerate(Forest(vectors, planes, largest).search(q, budget)):
                seen = seen[ids[seen] != q_ids[k]]
                s = products(vectors[seen], q[k])
                at = best(s, ids[seen], top)
                out.append((np.full(len(at), q_ids[k]), ids[seen][at], s[at]))
        made = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(made[0]), "vec_id": pa.array(made[1]), "score": pa.array(made[2])})

    questions = packed(asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks))), "block", width)
    left = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = questions.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(local, schema)
    ranked = met.distinct().withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
