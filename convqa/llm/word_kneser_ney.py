"""Perplexity of whole texts under an interpolated, modified Kneser-Ney model of words, by sharded joins of n-gram counts.

Words are the runs of anything but white space, A-Z in lower case, as hashes of 32 bits; the model is of order 2, and a text is read
as START, its words, END. A pair of words is one number, so is a single word (a pair with 0). :func:`train` counts the pairs of all
trusted texts and joins counts with the totals of their first word and the continuation counts of their second. Its result is a table that grows with the trusted text and is never gathered.

The probability of a word takes one of two forms: that of the pair if the pair was seen, else what the first word leaves to the unigram.
Its logarithm is hence a sum of weights, one for each seen pair and each seen word of a text, and a constant for each position.
:func:`perplexity` cuts terms and model into shards by hash, the terms of each batch of texts counted and sorted before they are
moved, joins them shard by shard, and sums the weights per document.

``perplexity_new`` scores a trusted text as if it were new: a term all of whose trusted occurrences lie in the text itself counts as
unseen, so it can be compared with the perplexity of other texts.

Defined results: a null text or one without words has no perplexity (null); without trusted text no text has one. A very long text is
scored whole, in a batch of its own; repeated rows score alike and count each in the model; an empty table gives no rows. Other
columns pass through, those named like the result's are replaced. Two words share a hash with a chance of 2^-32, a term is taken for
one of the model with a chance of the model's size by 2^48.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convqa.llm import hashing, rows
from convqa.llm.arrow import small_batches, text_bytes
from convqa.session import discard, materialize, scratch_path

START, END, FIRST = 1, 2, 3
HASH_BITS, DOC_BITS = 48, 16
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1 << DOC_BITS
STEP_BYTES = 1 << 20  # text hashed at once
SHARD_BYTES = 8 << 20  # text for each shard of terms
PAIRS_A_SHARD = 1 << 19
OUT_ROWS, PACK_ROWS = 1 << 18, 1 << 20
ROUNDS = 4
PACKED = "shard int, batch long, a binary, b binary, c binary"
SUMS = "batch long, shard int, places binary, sums binary, alone binary"
RESULT = ("perplexity", "perplexity_new")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def terms(column: pa.Array, single: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (and ``single`` words) of a batch of texts as numbers, the text of each, and the words of every text."""
    raw, offsets = text_bytes(column)
    raw = hashing.lowered(raw)
    starts, ends, doc = hashing.spans(hashing.word_mask(raw), offsets)
    word = np.maximum(hashing.span_hashes(hashing.prefix_sums(raw), starts, ends) >> np.uint64(32), np.uint64(FIRST))
    n = np.bincount(doc, minlength=len(column))
    if not len(word):
        return word, doc, n
    opens = np.ones(len(doc), bool)
    opens[1:] = doc[1:] != doc[:-1]
    before = np.where(opens, np.uint64(START), np.roll(word, 1))
    closes = np.roll(opens, -1)
    texts = doc[opens]
    high = np.uint64(32)
    made, at = [before << high | word, word[closes] << high | np.uint64(END)], [doc, texts]
    if single:
        edges = [np.full(len(texts), mark << 32, np.uint64) for mark in (START, END)]
        made, at = [*made, word << high, *edges], [*at, doc, texts, texts]
    return np.concatenate(made), np.concatenate(at), n


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def pack(values: np.ndarray) -> bytes:
    """Bytes of numbers, place by place, so that equal leading bytes lie together for the compression of shuffles."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> np.uint64(HASH_BITS - 24)) * np.uint64(shards) >> np.uint64(24)


def counts(trusted: DataFrame, text: str = "text") -> DataFrame:
    """``pair, n`` over all trusted texts, summed for each batch before they are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0, BATCH_BYTES):
            pairs, n = counted(np.concatenate([terms(step.column(0), single=False)[0] for step in small_batches([batch], 0, STEP_BYTES)]))
            for k in range(0, len(pairs), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k:k + OUT_ROWS].view(np.int64)), pa.array(n[k:k + OUT_ROWS])], names=["pair", "n"])

    return trusted.select(text).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def discounts(table: DataFrame, n: str) -> tuple[Column, int, int]:
    """What a count of ``table`` gives up (estimated from the counts of counts), the sum of the counts and their number."""
    of = table.agg(*[F.count_if(F.col(n) == k).alias(f"c{k}") for k in (1, 2, 3, 4)], F.sum(n).alias("sum"), F.count("*").alias("rows")).first()
    c1, c2, c3, c4 = (float(of[f"c{k}"]) for k in (1, 2, 3, 4))
    y = c1 / (c1 + 2 * c2) if c1 + c2 else 0.5
    cut = [1 - 2 * y * c2 / c1 if c1 else 0.5, 2 - 3 * y * c3 / c2 if c2 else 1.0, 3 - 4 * y * c4 / c3 if c3 else 1.5]
    cut = [min(max(d, 0.05), k + 0.9) for k, d in enumerate(cut)]
    return F.when(F.col(n) == 1, cut[0]).when(F.col(n) == 2, cut[1]).otherwise(cut[2]), of["sum"] or 0, of["rows"]


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Files of a shuffle go as soon as the stage that it serves is written, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def shards_for(docs: DataFrame, text: str = "text") -> int:
    """Shards that texts of this size need."""
    return max(ROUNDS, -(-(docs.agg(F.sum(F.octet_length(f"`{text}`"))).first()[0] or 0) // SHARD_BYTES))


def train(trusted: DataFrame, text: str = "text", shards: int | None = None) -> tuple[DataFrame, float, int] | None:
    """Seen pairs and words with their counts and weights, packed by shard; the logarithm of an unseen word's probability; the number of shards.

    Null without trusted text. ``shards`` is to be that of the texts to score (:func:`shards_for`). Counts are kept in parts that
    go as soon as they are joined, so that neither all of them nor all shuffles lie on disk beside the model.
    """
    spark = trusted.sparkSession
    with shuffles_dropped(spark):
        path = scratch_path(spark, "pairs")
        counts(trusted, text).withColumn("part", F.expr(f"pmod(hash(pair), {ROUNDS})")).write.partitionBy("part").parquet(path)
        pairs = spark.read.schema("pair long, n long, part int").parquet(path)
        less, total, seen = discounts(pairs, "n")
        if not total:
            discard(spark, path)
            return None
        head, tail = F.shiftright("pair", 32).bitwiseAND(0xFFFFFFFF), F.col("pair").bitwiseAND(0xFFFFFFFF)
        heads = pairs.groupBy(head.alias("word")).agg(F.sum("n").alias("total"), (F.sum(less) / F.sum("n")).alias("left"))
        tails = materialize(pairs.groupBy(tail.alias("word")).agg(F.count("*").alias("n1"), F.sum("n").alias("n")), "tails")
        less1, total1, vocabulary = discounts(tails, "n1")
        free = tails.agg(F.sum(less1)).first()[0] / total1
        unseen = free / (vocabulary + 1)
        both = heads.join(tails, "word", "full").select(
            "word", "total", "left", ((F.col("n1") - less1) / total1 + unseen).alias("p"), F.coalesce("n", "total").alias("n"))
        words = materialize(both, "words")
        discard(spark, tails)
        shards = max(shards or shards_for(trusted, text), -(-seen // PAIRS_A_SHARD))
        alone = F.coalesce(F.log("left"), F.lit(0.0)) + F.coalesce(F.log(F.col("p") / unseen), F.lit(0.0))
        parts = [materialize(packed(words.select(F.shiftleft("word", 32).alias("term"), "n", alone.cast("float").alias("weight")), shards), "model")]
        for k in range(ROUNDS):
            joined = pairs.where(F.col("part") == k).join(words.select(F.col("word").alias("head"), "total", "left"), head == F.col("head")).join(
                words.select(F.col("word").alias("tail"), "p"), tail == F.col("tail"))
            weight = F.log1p((F.col("n") - less) / (F.col("total") * F.col("left") * F.col("p")))
            parts.append(materialize(packed(joined.select(F.col("pair").alias("term"), "n", weight.cast("float").alias("weight")), shards), "model"))
            discard(spark, f"{path}/part={k}")
        discard(spark, words, path)
    return functools.reduce(DataFrame.unionByName, parts), float(np.log(unseen)), shards


def packed(model: DataFrame, shards: int) -> DataFrame:
    """``term, n, weight``, sorted by hash and packed for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACK_ROWS:
                yield from cut(held)
                held, size = [], 0
        yield from cut(held)

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            term, n, weight = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
            key = hashing.mixed(term.view(np.uint64)) >> np.uint64(64 - HASH_BITS)
            order = np.argsort(key)
            key = key[order]
            yield from _cut(shard_of(key, shards), 0, [(key, True), (n[order].astype(np.uint32), False), (weight[order], False)])

    return model.mapInArrow(run, PACKED)


def _cut(shard: np.ndarray, batch: int, columns: list[tuple[np.ndarray, bool]]) -> Iterator[pa.RecordBatch]:
    """A row per shard of sorted numbers; those marked are kept as differences."""
    edges = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard)) if len(shard) else np.zeros(1, np.int64)
    made = [[pack(np.diff(c[i:j], prepend=c.dtype.type(0)) if steps else c[i:j]) for i, j in zip(edges[:-1], edges[1:])] for c, steps in columns]
    made += [[None] * (len(edges) - 1)] * (3 - len(made))
    yield pa.RecordBatch.from_arrays(
        [pa.array(shard[edges[:-1]].astype(np.int32)), pa.array(np.full(len(edges) - 1, batch, np.int64)), *[pa.array(m, pa.binary()) for m in made]],
        names=["shard", "batch", "a", "b", "c"])


def asked(docs: DataFrame, shards: int, some: tuple[int, int]) -> DataFrame:
    """Terms of every batch of ``__row, __text`` with their texts and counts, packed by shard; a batch is named by its first row.

    The first round also says, below zero in place of a shard, which rows are in a batch and how many words each has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in small_batches(batches, 1, BATCH_BYTES):
            for start in range(0, wide.num_rows, BATCH_ROWS):
                batch = wide.slice(start, BATCH_ROWS)
                name, made, words = batch.column(0)[0].as_py(), [], []
                for step in small_batches([batch], 1, STEP_BYTES):
                    term, doc, n = terms(step.column(1))
                    key = hashing.mixed(term) >> np.uint64(64 - HASH_BITS)
                    ours = shard_of(key, shards) % some[1] == some[0]
                    made.append(key[ours] << np.uint64(DOC_BITS) | (doc[ours] + sum(map(len, words))).astype(np.uint64))
                    words.append(n)
                key, n = counted(np.concatenate(made))
                yield from _cut(shard_of(key >> np.uint64(DOC_BITS), shards), name, [(key, True), (n.astype(np.uint32), False)])
                if not some[0]:
                    alike = np.full(len(batch), -1 - name % shards)
                    yield from _cut(alike, name, [(batch.column(0).to_numpy(), False), (np.concatenate(words).astype(np.int64), False)])

    return docs.mapInArrow(run, PACKED)


def _meet(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Sums of the weights of one shard's terms, for every batch the places of its texts and the sums: of all, of those seen nowhere else.

    What stands below zero is handed on.
    """
    if len(asked) and asked["shard"][0].as_py() < 0:
        return asked.select(["batch", "shard", "a", "b", "c"]).rename_columns(["batch", "shard", "places", "sums", "alone"])
    steps, n, weight = ([unpack(v, kind) for v in model[c].to_pylist()] for c, kind in (("a", np.uint64), ("b", np.uint32), ("c", np.float32)))
    out = {"batch": [], "shard": [], "places": [], "sums": [], "alone": []}
    if steps:
        key, n, weight = np.concatenate([np.cumsum(s) for s in steps]), np.concatenate(n), np.concatenate(weight)
        order = np.argsort(key)
        key, n, weight = key[order], n[order], weight[order]
        for shard, batch, a, b in zip(*(asked[c].to_pylist() for c in ("shard", "batch", "a", "b"))):
            pairs, m = np.cumsum(unpack(a, np.uint64)), unpack(b, np.uint32)
            want = pairs >> np.uint64(DOC_BITS)
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = np.flatnonzero(key[at] == want)
            at, times = at[hit], m[hit]
            place = (pairs[hit] & np.uint64(BATCH_ROWS - 1)).astype(np.int64)
            texts = np.flatnonzero(np.bincount(place))
            worth = weight[at].astype(np.float64) * times
            alone = np.bincount(place, weights=np.where(n[at] <= times, worth, 0))[texts]
            sums = np.bincount(place, weights=worth)[texts]
            for name, value in zip(out, (batch, shard, *map(pack, (texts.astype(np.uint16), sums, alone)))):
                out[name].append(value)
    kinds = {"batch": pa.int64(), "shard": pa.int32(), "places": pa.binary(), "sums": pa.binary(), "alone": pa.binary()}
    return pa.table({name: pa.array(out[name], kind) for name, kind in kinds.items()})


def _added(parts: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """What stands below zero in the rows of a batch, and the sums of the others by text."""
    table = sorted(zip(*(parts[c].to_pylist() for c in ("shard", "places", "sums", "alone"))))  # one order of summation
    below = [r for r in table if r[0] < 0]
    every, alone = np.zeros((2, BATCH_ROWS))
    for _, places, worth, lost in table[len(below):]:
        at = unpack(places, np.uint16)
        every[at] += unpack(worth, np.float64)
        alone[at] += unpack(lost, np.float64)
    return below, every, alone


def _together(parts: pa.Table) -> pa.Table:
    """The rows of one batch and round as one, which has the number of the first shard."""
    below, every, alone = _added(parts)
    made = [(r[0], *r[1:]) for r in below]
    if len(parts) > len(below):
        texts = np.flatnonzero(every != 0)
        first = min(s for s in parts["shard"].to_pylist() if s >= 0)
        made.append((first, *map(pack, (texts.astype(np.uint16), every[texts], alone[texts]))))
    shard, *blobs = zip(*made)
    return pa.Table.from_arrays(
        [pa.array([parts["batch"][0].as_py()] * len(made), pa.int64()), pa.array(shard, pa.int32()), *[pa.array(b, pa.binary()) for b in blobs]], names=["batch", "shard", "places", "sums", "alone"])


def _total(unseen: float):
    def run(parts: pa.Table) -> pa.Table:
        ((_, row, n, _),), every, alone = _added(parts)
        row, n = unpack(row, np.int64), unpack(n, np.int64)
        every, alone = every[:len(row)], alone[:len(row)]
        made = [pa.array(np.exp(-(logs / (n + 1) + unseen)), pa.float64(), mask=n == 0) for logs in (every, every - alone)]
        return pa.Table.from_arrays([pa.array(row), *made], names=["__row", *RESULT])

    return run


def perplexity(docs: DataFrame, model: tuple[DataFrame, float, int] | None, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Input columns and the perplexity per word of the whole text, ``perplexity`` as it is and ``perplexity_new`` for a trusted text.

    Shards are joined in ``rounds``, which each read the texts again, so that only a part of the terms lies in shuffles at a time.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in RESULT]
    if model is None:
        return docs.select(*[f"`{c}`" for c in kept], *[F.lit(None).cast("double").alias(c) for c in RESULT])
    table, unseen, shards = model
    marked = rows.numbered(docs, kept)
    texts = marked.select("__row", F.col(f"`{text}`").alias("__text"))
    with shuffles_dropped(spark):
        parts = []
        for k in range(rounds):
            met = asked(texts, shards, (k, rounds)).groupBy("shard").cogroup(table.where(F.col("shard") % rounds == k).groupBy("shard"))
            parts.append(materialize(met.applyInArrow(_meet, SUMS).groupBy("batch").applyInArrow(_together, SUMS), "sums"))
        together = functools.reduce(DataFrame.unionByName, parts)
        scored = together.groupBy("batch").applyInArrow(_total(unseen), f"__row long, {RESULT[0]} double, {RESULT[1]} double")
        found = materialize(scored, "perplexity")
        discard(spark, *parts)
    return marked.select("__row", *[f"`{c}`" for c in kept]).join(found, "__row", "left").drop("__row")
