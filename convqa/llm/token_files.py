"""Token counts of the documents in flat token files that have no index.

A file is a stream of fixed-width token ids in which an end id closes each document. It is cut into blocks without regard to
documents; each block is searched for the end id with one vectorised comparison; a prefix scan over the block
summaries of a file (tokens, ends, last end) carries what lies before a block into it, so a document may begin many blocks before
it ends. One block summary stands for a million tokens, so the scan sees few rows even for a very large file.

Defined results: an empty document counts 0, and so does a null text, which is written as an end id alone; tokens after the last
end id are a document with ``closed`` false; a file without tokens has no documents and an empty table no files; repeated rows
are documents of their own; a very long document lies in as many blocks as it needs; columns beside key and text are not read, so
their names cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convqa.llm.arrow import small_batches
from convqa.session import materialize

BLOCK_TOKENS = 1 << 20
Encode = Callable[[str], list[int]]
FLAT = "file string, block long, tokens binary, place long, key long"
SCANNED = "file string, block long, n long, ends array<int>, place long, key long"


def byte_bpe(path: str, pattern: str) -> Callable[[], Encode]:
    """Maker of an encoder from a file of ranks; text that looks like a special token is ordinary text."""

    def make() -> Encode:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    return make


def flatten(docs: DataFrame, make: Callable[[], Encode], end_id: int, key: str = "doc_id", text: str = "text", width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The flat stream of each input partition in blocks, as rows (file, block, tokens), and one row (file, place, key) per document that says which it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = make(), f"part-{TaskContext.get().partitionId():06d}"
        kind = np.dtype(f"<u{width}")
        held: list[np.ndarray] = []
        size = block = place = 0

        def rows(blocks: list[bytes], keys: pa.Array) -> pa.RecordBatch:
            nonlocal block, place
            b, k = len(blocks), len(keys)
            made = [pa.array([file] * (b + k)), pa.array([*range(block, block + b), *[None] * k], pa.int64()), pa.array([*blocks, *[None] * k], pa.binary()),
                    pa.array([*[None] * b, *range(place, place + k)], pa.int64()), pa.concat_arrays([pa.nulls(b, pa.int64()), keys.cast(pa.int64())])]
            block, place = block + b, place + k
            return pa.RecordBatch.from_arrays(made, names=["file", "block", "tokens", "place", "key"])

        for batch in small_batches(batches, 1):
            for t in batch.column(1).to_pylist():
                ids = np.array([*(encode(t) if t else ()), end_id], dtype=kind)
                held.append(ids)
                size += len(ids)
            blocks = []
            if size >= block_tokens:
                flat = np.concatenate(held)
                whole = size // block_tokens
                blocks = [flat[k * block_tokens:(k + 1) * block_tokens].tobytes() for k in range(whole)]
                held, size = [flat[whole * block_tokens:]], size - whole * block_tokens
            yield rows(blocks, batch.column(0))
        if size:
            yield rows([np.concatenate(held).tobytes()], pa.array([], pa.int64()))

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(run, FLAT)


def read_flat(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of existing flat files. Spark hands a file over whole, so files are to be at most about 1 GB each."""
    step = width * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = data.as_buffer()
                for block, at in enumerate(range(0, raw.size, step)):
                    part = raw.slice(at, min(step, raw.size - at)).to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([part], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())],
                                                     names=["file", "block", "tokens", "place", "key"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FLAT)


def scan(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """Tokens and places of end ids in each block; rows that name documents pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for data in batch.column(2):
                tokens = np.frombuffer(data.as_buffer(), dtype=f"<u{width}") if data.is_valid else None
                n.append(None if tokens is None else len(tokens))
                ends.append(None if tokens is None else np.flatnonzero(tokens == end_id).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int32())), batch.column(3), batch.column(4)],
                names=["file", "block", "n", "ends", "place", "key"])

    return blocks.mapInArrow(run, SCANNED)


def documents(scanned: DataFrame) -> DataFrame:
    """``file, place, n_tokens, closed`` of every document, from block scans."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.where("block is not null").select("file", "block", "n", "ends", F.size("ends").alias("found"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    placed = summary.withColumn("start", start).withColumn("first", F.coalesce(F.sum("found").over(before), F.lit(0)))
    opened = F.coalesce(F.last(F.col("start") + F.col("last"), ignorenulls=True).over(before) + 1, F.lit(0))
    placed = placed.withColumn("opened", opened)
    inside = placed.select("file", "start", "first", "opened", "ends", F.posexplode("ends").alias("k", "end"))
    begin = F.when(F.col("k") == 0, F.col("opened")).otherwise(F.col("start") + F.get("ends", F.col("k") - 1) + 1)
    closed = inside.select("file", (F.col("first") + F.col("k")).alias("place"), (F.col("start") + F.col("end") - begin).alias("n_tokens"), F.lit(True).alias("closed"))
    files = placed.groupBy("file").agg(F.sum("found").alias("place"), F.sum("n").alias("total"), F.coalesce(F.max(F.col("start") + F.col("last")) + 1, F.lit(0)).alias("opened"))
    rest = files.where("total > opened").select("file", "place", (F.col("total") - F.col("opened")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(rest)


def count(docs: DataFrame, make: Callable[[], Encode], end_id: int, key: str = "doc_id", text: str = "text", width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``key, n_tokens, file, place`` of each document by way of its flat stream: encode, cut into blocks, scan, stitch."""
    scanned = materialize(scan(flatten(docs, make, end_id, key, text, width, block_tokens), end_id, width), "scanned")
    names = scanned.where("place is not null").select("file", "place", "key")
    return names.join(documents(scanned), ["file", "place"]).select(F.col("key").alias(key), "n_tokens", "file", "place")
