"""Ranked lexical search that scores each distinct bag of words once.

Documents are cut down to the vocabulary of the items that ask: what is left of one is its bag (term numbers with counts)
and ``m``, a length normaliser. Documents with the same bag and the same ``m`` have the same score for every item, so they
form a class: rows are brought together by the hash of the bag and grouped by the bag itself, which verifies the hash. Each
class is scored once for all items that share a term with it, every task keeps the best classes per item, and the winning
classes are expanded to their documents by ascending id. The best ``top`` classes in the order of score and smallest id
hold the best ``top`` documents, because each class in front of another puts at least one document in front of its documents.

Scores are 64-bit integers. Sums are taken in doubles where no sum of a block of items can pass 2**53, else in integers.

Items are taken in blocks of about ``block_terms`` terms, each of which reads all documents; a block's vocabulary is what a
task holds. Document counts and lengths cover all documents.

Defined results: null and empty texts have no terms, are not counted and match nothing; a very long text is one bag, worked
out from its bytes in one piece; an empty table on either side gives no rows. Each row of either table is a document or
an item of its own: repeated items are answered again, repeated documents appear as often as they are stored, rows with
equal ids next to each other, those without an id behind all others of their score. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from convqa.llm import hashing
from convqa.llm.arrow import small_batches, text_bytes
from convqa.session import materialize

TEXT_BYTES = 1 << 21
PART = 256  # classes scored at a time
BROADCAST_BYTES = 1 << 26
LAST = np.iinfo(np.int64).max  # place of documents without an id
IN_TERM = np.arange(256) >= 0x80
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    IN_TERM[_first:_last + 1] = True


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes of a batch, starts and ends of its terms, the text each belongs to, and their hashes."""
    raw, offsets = text_bytes(column)
    low = hashing.lowered(raw)
    starts, ends, doc = hashing.spans(IN_TERM[low], offsets)
    return low, starts, ends, doc, hashing.span_hashes(hashing.prefix_sums(low), starts, ends)


def item_terms(items: DataFrame, text: str) -> DataFrame:
    """``item, term, count`` with the terms' bytes; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, TEXT_BYTES):
            low, starts, ends, doc, _ = terms_of(batch.column(1))
            item = batch.column(0).to_numpy()
            data, found = low.tobytes(), {}
            for s, e, d in zip(starts.tolist(), ends.tolist(), doc.tolist()):
                at = (int(item[d]), data[s:e])
                found[at] = found.get(at, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["item", "term", "count"])

    return items.select("item", F.col(f"`{text}`")).mapInArrow(run, "item long, term binary, count long")


class Vocabulary:
    """Distinct terms by hash; :meth:`numbers` finds them in a batch and compares their bytes."""

    def __init__(self, terms: list[bytes]):
        column = pa.array(terms, pa.binary()).cast(pa.large_binary())
        self.raw = np.frombuffer(b"".join(terms), np.uint8)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[:len(terms) + 1] if terms else np.zeros(1, np.int64)
        codes = hashing.span_hashes(hashing.prefix_sums(self.raw), offsets[:-1], offsets[1:])
        self.order = np.argsort(codes, kind="stable")
        self.codes, self.starts, self.lengths = codes[self.order], offsets[:-1], np.diff(offsets)
        self.alike = int(np.unique(codes, return_counts=True)[1].max()) if terms else 0

    def numbers(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 for those outside the vocabulary."""
        out = np.full(len(codes), -1, np.int64)
        first = np.searchsorted(self.codes, codes)
        for step in range(self.alike):  # more than one only where terms of the vocabulary share a hash
            at = np.minimum(first + step, len(self.codes) - 1)
            hit = np.flatnonzero((self.codes[at] == codes) & (out < 0))
            number = self.order[at[hit]]
            length = ends[hit] - starts[hit]
            fits = self.lengths[number] == length
            hit, number, length = hit[fits], number[fits], length[fits]
            if not len(hit):
                continue
            begins = np.concatenate([[0], np.cumsum(length)])
            inside = np.arange(begins[-1]) - np.repeat(begins[:-1], length)
            differs = low[np.repeat(starts[hit], length) + inside] != self.raw[np.repeat(self.starts[number], length) + inside]
            same = np.add.reduceat(differs.astype(np.int64), begins[:-1]) == 0
            out[hit[same]] = number[same]
        return out


def _bags(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``key, n, bag`` of documents with a term: all terms counted, and the vocabulary's as packed numbers and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    key = docs.columns[0]
    schema = StructType([docs.schema[0], StructField("n", LongType())]).add("bag", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(shared.value)
        size = max(1, len(shared.value))
        for batch in small_batches(batches, 1, TEXT_BYTES):
            low, starts, ends, doc, codes = terms_of(batch.column(1))
            n = np.bincount(doc, minlength=batch.num_rows)
            number = known.numbers(low, starts, ends, codes)
            inside = number >= 0
            pair, count = np.unique(doc[inside] * size + number[inside], return_counts=True)
            cut = np.searchsorted(pair, np.arange(batch.num_rows + 1) * size)
            number, count = (pair % size).astype("<u4"), count.astype("<u4")
            bags = [number[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(bags, pa.binary())], names=[key, "n", "bag"])
            yield made.filter(pa.array(n > 0))

    return docs.mapInArrow(run, schema)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers, counts and row of the entries of a batch of bags."""
    bags = [np.frombuffer(b, "<u4") for b in column.to_pylist()]
    half = [len(b) // 2 for b in bags]
    number = np.concatenate([b[:h] for b, h in zip(bags, half)] or [np.zeros(0, "<u4")]).astype(np.int64)
    count = np.concatenate([b[h:] for b, h in zip(bags, half)] or [np.zeros(0, "<u4")]).astype(np.int64)
    return number, count, np.repeat(np.arange(len(bags)), half)


def _document_counts(bags: DataFrame, size: int) -> DataFrame:
    """``number, df`` of the terms that a document holds; a task sends one row per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column(0))[0], minlength=size)
        number = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(total[number])], names=["number", "df"])

    return bags.select("bag").mapInArrow(run, "number long, df long").groupBy("number").agg(F.sum("df").alias("df"))


class _Postings:
    """Which items ask for a term, and how often; items by their number in the block."""

    def __init__(self, number: np.ndarray, item: np.ndarray, count: np.ndarray, weight: np.ndarray, items: int):
        order = np.argsort(number, kind="stable")
        self.item, self.value = item[order], count[order] * weight[number[order]]
        self.begin = np.searchsorted(number[order], np.arange(len(weight) + 1))
        most = np.zeros(items, object)
        np.add.at(most, item, [int(c) * int(w) * 1_000_000 for c, w in zip(count, weight[number])])
        self.items, self.doubles = items, bool(items) and max(most) < 1 << 53

    def scores(self, number: np.ndarray, count: np.ndarray, row: np.ndarray, m: np.ndarray, rows: int) -> np.ndarray:
        share = (1_000_000_000 * count) // (1_000 * count + 12 * m[row])
        asked = self.begin[number + 1] - self.begin[number]
        at = np.repeat(self.begin[number], asked) + np.arange(asked.sum()) - np.repeat(np.cumsum(asked) - asked, asked)
        value = self.value[at] * np.repeat(share, asked)
        cell = np.repeat(row * self.items, asked) + self.item[at]
        if self.doubles:
            return np.bincount(cell, value, rows * self.items).astype(np.int64).reshape(rows, self.items)
        out = np.zeros(rows * self.items, np.int64)
        np.add.at(out, cell, value)
        return out.reshape(rows, self.items)


def _best_classes(classes: DataFrame, postings: _Postings, top: int) -> DataFrame:
    """``item, score, first, class``: each task's best classes per item, by score and then by smallest document."""
    shared = classes.sparkSession.sparkContext.broadcast(postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held, new = np.zeros((0, 4), np.int64), []
        bar = np.zeros(known.items, np.int64)  # a lower score cannot enter

        def reduced() -> np.ndarray:
            rows = np.concatenate([held, *new])
            rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
            begin = np.searchsorted(rows[:, 0], rows[:, 0])
            place = np.arange(len(rows)) - begin
            full = rows[place == top - 1]
            bar[full[:, 0]] = full[:, 1]
            return rows[place < top]

        for whole in batches:
            for start in range(0, whole.num_rows, PART):
                batch = whole.slice(start, PART)
                number, count, row = _unpacked(batch.column(3))
                score = known.scores(number, count, row, batch.column(1).to_numpy(), batch.num_rows)
                at, item = np.nonzero((score > 0) & (score >= bar))
                first, ident = batch.column(2).to_numpy(), batch.column(0).to_numpy()
                new.append(np.stack([item, score[at, item], first[at], ident[at]], axis=1))
                if sum(map(len, new)) > 8 * top * known.items + 10_000:
                    held, new = reduced(), []
        held = reduced()
        yield pa.RecordBatch.from_arrays([pa.array(held[:, k]) for k in range(4)], names=["item", "score", "first", "class"])

    return classes.select("class", "m", "first", "bag").mapInArrow(run, "item long, score long, first long, class long")


def _rank_block(docs: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """``item, rank, key, score`` for the items whose terms are in ``asked``."""
    spark = docs.sparkSession
    key = docs.columns[0]
    got = asked.toArrow()  # about block_terms rows
    terms = sorted(set(got.column(1).to_pylist()))
    at = {t: k for k, t in enumerate(terms)}
    number = np.array([at[t] for t in got.column(1).to_pylist()], np.int64)
    idents, item = np.unique(got.column(0).to_numpy(), return_inverse=True)

    bags = materialize(_bags(docs, terms).withColumn("hash", F.xxhash64("bag")), "bags")
    documents, length = bags.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return spark.createDataFrame([], StructType([StructField("item", LongType()), StructField("rank", LongType()), docs.schema[0], StructField("score", LongType())]))
    found = _document_counts(bags, len(terms)).select("number", F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w")).toArrow()
    weight = np.zeros(len(terms), np.int64)
    weight[found.column(0).to_numpy()] = found.column(1).to_numpy()

    # no score without a term of the vocabulary; m keeps 64-bit values also where the product before the division does not
    measured = bags.where(F.octet_length("bag") > 0).withColumn("m", F.expr(f"75 + cast((25 * cast(n as decimal(18,0)) * {documents}) div {length} as long)"))
    grouped = measured.groupBy("hash", "m", "bag").agg(F.min(key).alias("first"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("class"), "hash", "m", "bag", F.coalesce("first", F.lit(LAST)).alias("first")), "classes")
    best = _best_classes(classes, _Postings(number, item, got.column(2).to_numpy(), weight, len(idents)), top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "first", "class")
    best = materialize(best.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= top).drop("__r"), "best")

    # winning classes are at most top times the block's items; they go to the documents where their bags are small enough
    won = materialize(classes.join(best.select("class").distinct(), "class", "left_semi").select("class", "hash", "m", "bag"), "won")
    if (won.agg(F.sum(F.octet_length("bag") + 100)).first()[0] or 0) <= BROADCAST_BYTES:
        won = F.broadcast(won)
    place = Window.partitionBy("class").orderBy(F.asc_nulls_last(key))
    members = measured.join(won, ["hash", "m", "bag"]).select("class", key).withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= top)
    final = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last(key), "class", "__r")
    ranked = best.join(members, "class").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top)
    names = spark.sparkContext.broadcast(idents)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(names.value[batch.column(0).to_numpy()]), *batch.columns[1:]], names=batch.schema.names)

    out = ranked.select("item", F.col("rank").cast("long").alias("rank"), key, "score")
    return out.mapInArrow(named, out.schema)


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = 20,
         block_terms: int = 200_000) -> DataFrame:
    """``item_key, rank, key, score``: the ``top`` best documents of every item, best first, equal scores by ascending key.

    Ids are whole numbers. A term's weight is ``floor(1000 ln((2N + 2) / (2df + 1)))``; a document adds, for every occurrence
    of a term in the item, the weight times ``10**9 tf div (1000 tf + 12 m)``.
    """
    numbered = materialize(items.select(F.col(f"`{item_key}`").alias("__id"), F.col(f"`{item_text}`").alias("__text"), F.monotonically_increasing_id().alias("item")), "items")
    asked = materialize(item_terms(numbered, "__text"), "asked")
    blocks = max(1, -(-asked.count() // block_terms))
    source = docs.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{text}`").alias("__text"))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    parts = [materialize(_rank_block(source, asked.where(block == b), top), "ranked") for b in range(blocks)]
    ranked = parts[0]
    for more in parts[1:]:
        ranked = ranked.union(more)
    return ranked.join(numbered.select("item", "__id"), "item").select(F.col("__id").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("__key").alias(key), "score")
