"""Exact n-gram Jaccard join by vertical partitioning, and the components of its links.

One global order of all shingles (rare ones by their number, frequent ones behind them by frequency) does two jobs. The first
shingles of a text in that order (its prefix) must meet the prefix of any text it links with, which gives candidates; the
order is cut by pivots into fragments (ranges of the rare shingles, and the frequent ones), the overlap of a candidate pair
is counted in each fragment on its own and the counts are summed. Texts with equal sets are one class from the start.

No group of texts is paired off. In a prefix list the ``leaders`` most central texts (fewest rarer shingles before the
common one) meet all others. What a list still holds in different components after that is settled in rounds: texts
outside the list's largest component meet all texts of other components, until every list lies in one component or is
used up. So each link
between different texts is either found or lies inside a component that is already joined.

Before sets are compared, bit sketches of the candidates (a bit per shingle, four to eight bits of room for each) rule out most
pairs that miss the threshold; they never rule out a link.

Frequencies steer the order only: shingles repeated within a chunk of a task's texts are summed over all texts, and the
most frequent, at most ``FREQUENT`` by construction, are sent to the tasks. The needed texts' ids go out as a Bloom filter of fixed size;
its false positives cost time, not results.

Defined results: null and empty texts have no shingles and are components of their own; rows with equal keys are one
node, linked to whatever one of their texts links with; rows with a null key get a null component and link nothing; an
empty table gives no rows; ties cannot arise, as a component is named by its smallest key; a very long text is one set,
held by one task at a time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convqa.llm import bloom, rows, shingles
from convqa.llm.arrow import small_batches
from convqa.llm.graph import components
from convqa.session import discard, materialize, scratch_path

FREQUENT = 1 << 20
CHUNK = 2_000_000
LATER_LEADERS = 1024
TEXT_BYTES = 1 << 20  # texts hashed at a time; the arrays made of them take some hundred times as much
FRAGMENTS = 4  # the last one holds the frequent shingles
ROW = "kind int, a long, b long, c long, d long"


def _batch(kind: int, a, b: np.ndarray, c: np.ndarray, d: np.ndarray | None = None) -> pa.RecordBatch:
    made = [a if isinstance(a, pa.Array) else pa.array(a), pa.array(b), pa.array(c), pa.nulls(len(c), pa.int64()) if d is None else pa.array(d)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), *made], names=["kind", "a", "b", "c", "d"])


def _by_kind(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    read = df.sparkSession.read.schema(ROW).option("basePath", path).parquet(path)
    return read.where("kind = 0").drop("kind"), read.where("kind = 1").drop("kind"), path


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _described(docs: DataFrame, words: int) -> DataFrame:
    """Kind 0: key, two signatures and size of each set; kind 1: shingles met more than once in a chunk, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()

        def repeated() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return _batch(1, code[n > 1].view(np.int64), n[n > 1], n[n > 1])

        for batch in small_batches(batches, 1, TEXT_BYTES, tidy=True):
            code, begins = shingles.sets_of(batch.column(1), words)
            one, two = shingles.signatures(code, begins)
            yield _batch(0, batch.column(0), one, two, np.diff(begins).astype(np.int64))
            fresh = []
            for k, sig in enumerate(zip(one.tolist(), two.tolist())):
                if sig not in seen:
                    seen.add(sig)
                    fresh.append(code[begins[k]:begins[k + 1]])
            held += fresh
            if sum(map(len, held)) > CHUNK:
                yield repeated()
                held, seen = [], set()
        if held:
            yield repeated()

    return docs.mapInArrow(run, ROW)


def _prefixes(docs: DataFrame, words: int, percent: int, frequent) -> DataFrame:
    """token, key, packed (size and place of the token in the text's order); a set met before in the same task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = frequent.value
        seen: set[tuple[int, int]] = set()
        for batch in small_batches(batches, 1, TEXT_BYTES, tidy=True):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            code, begins = shingles.sets_of(batch.column(1), words)
            one, two = shingles.signatures(code, begins)
            fresh = np.zeros(len(keys), bool)
            for k, sig in enumerate(zip(one.tolist(), two.tolist())):
                if sig not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(sig)
                    fresh[k] = True
            n = np.diff(begins)
            doc = np.repeat(np.arange(len(n)), n)
            weight = np.zeros(len(code), np.int64)
            if len(codes):
                at = np.searchsorted(codes, code)
                at[at == len(codes)] = 0
                weight = np.where(codes[at] == code, counts[at], 0)
            order = np.lexsort((code, weight, doc)) if weight.any() else np.arange(len(code))
            place = np.arange(len(code)) - begins[doc]
            take = (place < prefix_size(n, percent)[doc]) & fresh[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[order][take].view(np.int64)), pa.array(keys[doc[take]].astype(np.int64)), pa.array((n[doc[take]] << 32) | place[take])], names=["token", "key", "packed"])

    return docs.mapInArrow(run, "token long, key long, packed long")


def may_link(na: np.ndarray, ia: np.ndarray, nb: np.ndarray, ib: np.ndarray, percent: int) -> np.ndarray:
    """Whether two texts that share the shingles at places ``ia`` and ``ib`` of their orders can reach the threshold."""
    need = -(-percent * (na + nb) // (100 + percent))
    return (np.minimum(ia, ib) + 1 + np.minimum(na - ia - 1, nb - ib - 1) >= need) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _first_round(rows: DataFrame, percent: int, leaders: int) -> DataFrame:
    """Over rows sorted by token: kind 0 are candidate pairs with both sizes, kind 1 the rows of long lists that lead nothing yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, key, packed = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            old = len(token)
            token = np.concatenate([token, batch.column(0).to_numpy()])
            key = np.concatenate([key, batch.column(1).to_numpy()])
            packed = np.concatenate([packed, batch.column(2).to_numpy()])
            opens = np.ones(len(token), bool)
            opens[1:] = token[1:] != token[:-1]
            begin = np.flatnonzero(opens)
            group = np.cumsum(opens) - 1
            inside = np.arange(len(token)) - begin[group]
            n, i = packed >> 32, packed & 0xFFFFFFFF
            fresh = np.arange(len(token)) >= old
            left, right = [], []
            for lead in range(leaders):
                # the lead-th row of each list with every later new row
                r = np.flatnonzero(fresh & (inside > lead))
                lo = begin[group[r]] + lead
                ok = may_link(n[lo], i[lo], n[r], i[r], percent) & (key[lo] != key[r])
                left.append(lo[ok])
                right.append(r[ok])
            lo, r = np.concatenate(left), np.concatenate(right)
            if len(lo):
                swap = key[lo] > key[r]
                lo, r = np.where(swap, r, lo), np.where(swap, lo, r)
                made = np.unique(np.stack([key[lo], key[r], (n[lo] << 32) | n[r]], axis=1), axis=0)
                yield _batch(0, made[:, 0], made[:, 1], made[:, 2])
            more = np.flatnonzero(fresh & (inside >= leaders))
            if len(more):
                yield _batch(1, token[more], key[more], packed[more])
            kept = np.flatnonzero((group == group[-1]) & (inside < leaders)) if len(group) else slice(0, 0)
            token, key, packed = token[kept], key[kept], packed[kept]

    return rows.mapInArrow(run, ROW)


def _fragments(docs: DataFrame, words: int, ids: DataFrame, frequent) -> DataFrame:
    """key, fragment, codes (packed sorted numbers) of the texts whose ids may be among ``ids``.

    Pivots of the global order: rare shingles, whose numbers are evenly spread, by equal ranges; frequent ones behind them.
    """
    pivots = np.array([(k << 64) // (FRAGMENTS - 1) for k in range(1, FRAGMENTS - 1)], np.uint64)
    table = docs.sparkSession.sparkContext.broadcast(bloom.of_ids(ids, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value[0]
        for part in small_batches((bloom.hits(b, table.value) for b in batches), 1, TEXT_BYTES, tidy=True):
            code, begins = shingles.sets_of(part.column(1), words)
            keys, frags, blobs = [], [], []
            for k, key in enumerate(part.column(0).to_pylist()):
                own = code[begins[k]:begins[k + 1]]
                often = np.isin(own, common, assume_unique=True) if len(common) else np.zeros(len(own), bool)
                rare = own[~often]
                cuts = [0, *np.searchsorted(rare, pivots), len(rare)]
                for f in range(FRAGMENTS):
                    keys.append(key)
                    frags.append(f)
                    blobs.append((own[often] if f == FRAGMENTS - 1 else rare[cuts[f]:cuts[f + 1]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(frags, pa.int32()), pa.array(blobs, pa.binary())], names=["key", "frag", "codes"])

    return bloom.hashed(docs, "key").mapInArrow(run, "key long, frag int, codes binary").where(F.octet_length("codes") > 0)


def _sketches(docs: DataFrame, words: int, ids: DataFrame) -> DataFrame:
    """key, bits: four bits or more per shingle, one of them set by each, of the texts whose ids may be among ``ids``."""
    table = docs.sparkSession.sparkContext.broadcast(bloom.of_ids(ids, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches((bloom.hits(b, table.value) for b in batches), 1, TEXT_BYTES, tidy=True):
            code, begins = shingles.sets_of(part.column(1), words)
            blobs = []
            for k in range(part.num_rows):
                own = code[begins[k]:begins[k + 1]]
                size = 1 << max(6, int(4 * len(own) - 1).bit_length())
                bits = np.zeros(size, bool)
                bits[(own & np.uint64(size - 1)).astype(np.int64)] = True
                blobs.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["key", "bits"])

    return bloom.hashed(docs, "key").mapInArrow(run, "key long, bits binary")


_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch at a smaller size, as if it had been made there."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b, na, nb`` that their sketches do not rule out: a bit that only one text sets is a shingle that only it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = np.zeros(batch.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                x, y = _folded(x, size), _folded(y, size)
                most[k] = min(na[k] - int(_ONES[x & ~y].sum()), nb[k] - int(_ONES[y & ~x].sum()))
            keep = 100 * most >= percent * (na + nb - most)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    first = pairs.join(sketches.select(F.col("key").alias("a"), F.col("bits").alias("x")), "a")
    second = first.join(sketches.select(F.col("key").alias("b"), F.col("bits").alias("y")), "b")
    return second.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, na long, nb long")


def _links(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b, na, nb`` whose summed fragment overlaps reach the threshold, as ``a, b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) and len(y):
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    out[k] = np.count_nonzero(y[at] == x)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array(out)], names=["a", "b", "na", "nb", "frag", "part"])

    cut = pairs.withColumn("frag", F.explode(F.lit(list(range(FRAGMENTS)))))
    first = cut.join(fragments.select(F.col("key").alias("a"), "frag", F.col("codes").alias("x")), ["a", "frag"])
    second = first.join(fragments.select(F.col("key").alias("b"), "frag", F.col("codes").alias("y")), ["b", "frag"])
    parts = second.select("a", "b", "na", "nb", "frag", "x", "y").mapInArrow(run, "a long, b long, na long, nb long, frag int, part long")
    total = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return total.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _later_round(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b, na, nb`` that the sketches do not rule out, of each list's leaders with all its rows of other components.

    ``rows``: token, lead, key, n, i, component, bits, tokens (all open lists of the text), sorted by token with leaders
    first. A pair is looked at in the first list that both texts are in. One list's leaders are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, facts, bits, lists = None, np.zeros((0, 4), np.int64), [], []
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for t, lead, key, n, i, component, blob, tokens in zip(*[c.to_pylist() for c in batch.columns]):
                if t != token:
                    token, facts, bits, lists = t, np.zeros((0, 4), np.int64), [], []
                own = np.frombuffer(blob, np.uint8)
                near = np.flatnonzero((facts[:, 3] != component) & may_link(facts[:, 1], facts[:, 2], n, i, percent)) if len(facts) else ()
                for size in {len(bits[k]) for k in near}:
                    at = [k for k in near if len(bits[k]) == size]
                    least = min(size, len(own))
                    mine = _folded(own, least)
                    theirs = np.stack([_folded(bits[k], least) for k in at])
                    most = np.minimum(n - _ONES[mine & ~theirs].sum(axis=1, dtype=np.int64), facts[at, 1] - _ONES[theirs & ~mine].sum(axis=1, dtype=np.int64))
                    for k in np.asarray(at)[100 * most >= percent * (n + facts[at, 1] - most)]:
                        if min(lists[k].intersection(tokens)) == t:
                            other = (int(facts[k, 0]), int(facts[k, 1]))
                            (x, nx), (y, ny) = sorted([other, (key, n)])
                            out.append((x, y, nx, ny))
                if lead:
                    facts = np.vstack([facts, [[key, n, i, component]]])
                    bits.append(own)
                    lists.append(frozenset(tokens))
            made = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, k]) for k in range(4)], names=["a", "b", "na", "nb"])

    return rows.mapInArrow(run, "a long, b long, na long, nb long")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85, leaders: int = 8) -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``docs``.

    Two texts link when the Jaccard similarity of their sets of ``words``-word shingles is at least ``percent`` hundredths.
    """
    named = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    if named.where("key is not null").groupBy("key").count().where("count > 1").isEmpty():
        found = _linked(named, words, percent, leaders)
    else:
        found = _rows_of_equal_keys(docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")), words, percent, leaders)
    return found.select(F.col("key").alias(key), "n_shingles", "component_id")


def _rows_of_equal_keys(docs: DataFrame, words: int, percent: int, leaders: int) -> DataFrame:
    """The same when keys repeat: rows are linked one by one, and then rows of one key with each other."""
    each = rows.numbered(docs, ["key", "text"])
    apart = _linked(each.select(F.when(F.col("key").isNotNull(), F.col("__row")).alias("key"), "text"), words, percent, leaders)
    apart = apart.where("key is not null").select(F.col("key").alias("__row"), "n_shingles", F.col("component_id").alias("part"))
    found = materialize(each.where("key is not null").select("__row", "key").join(apart, "__row"), "rows")
    least = found.groupBy("key").agg(F.min("part").alias("least"))
    bridges = found.join(least, "key").where(F.col("part") != F.col("least")).select(F.col("part").alias("a"), F.col("least").alias("b")).distinct()
    labels = materialize(components(bridges), "labels")
    joined = materialize(found.join(labels.withColumnRenamed("node", "part"), "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component"), "rows")
    smallest = joined.groupBy("part").agg(F.min("key").alias("component_id"))
    with_key = joined.join(smallest, "part").select("key", "n_shingles", "component_id")
    nameless = docs.where("key is null")
    return with_key.unionByName(_described(nameless, words).where("kind = 0").select(F.col("a").alias("key"), F.col("d").alias("n_shingles"), F.col("a").alias("component_id")))


def _linked(docs: DataFrame, words: int, percent: int, leaders: int) -> DataFrame:
    """``key, n_shingles, component_id`` of ``key, text`` with distinct keys (null ones aside)."""
    spark = docs.sparkSession
    sizes, repeated, _ = _by_kind(_described(docs, words), "described")
    sizes = sizes.select(F.col("a").alias("key"), F.col("b").alias("s1"), F.col("c").alias("s2"), F.col("d").alias("n"))
    counted = materialize(repeated.groupBy(F.col("a").alias("code")).agg(F.sum("b").alias("n")), "repeated")
    total = counted.agg(F.sum("n")).first()[0] or 0
    # at most FREQUENT shingles can hold so large a share each
    got = counted.where(F.col("n") >= max(2, -(-total // FREQUENT))).toArrow().sort_by("code")
    codes = got.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(codes)
    frequent = spark.sparkContext.broadcast((codes[order], got.column(1).to_numpy()[order]))

    known = sizes.where(F.col("key").isNotNull() & (F.col("n") > 0))
    # classes of several texts, one row each; written, so that the rows of a very large class are not gathered to meet theirs
    classes = known.groupBy("s1", "s2", "n").agg(F.min("key").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    classes = materialize(classes.select("s1", "s2", "n", "rep"), "classes")
    copies = materialize(known.join(classes, ["s1", "s2", "n"]).where("key <> rep").select("key", "rep"), "copies")

    usable = docs.where(F.col("key").isNotNull() & F.col("text").isNotNull())
    place, size = F.col("packed").bitwiseAND(0xFFFFFFFF), F.shiftright("packed", 32)
    spread = _prefixes(usable, words, percent, frequent).repartition("token").sortWithinPartitions("token", place / size, "key")
    raw_pairs, raw_open, first_round = _by_kind(_first_round(spread, percent, leaders), "first")

    def as_classes(rows: DataFrame, name: str) -> DataFrame:
        mapped = rows.join(copies.select(F.col("key").alias(name), F.col("rep").alias("__rep")), name, "left")
        return mapped.withColumn(name, F.coalesce("__rep", name)).drop("__rep")

    def ordered_pairs(rows: DataFrame) -> DataFrame:
        """Each pair once, smaller key first."""
        swap = F.col("a") > F.col("b")
        flipped = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        return flipped.where("a <> b").distinct()

    pairs = raw_pairs.distinct().select("a", "b", F.shiftright("c", 32).alias("na"), F.col("c").bitwiseAND(0xFFFFFFFF).alias("nb"))
    pairs = materialize(ordered_pairs(as_classes(as_classes(pairs, "a"), "b")), "pairs")
    rest = as_classes(raw_open.select(F.col("a").alias("token"), F.col("b").alias("key"), F.col("c").alias("packed")), "key").distinct()
    rest = materialize(rest.select("token", "key", size.alias("n"), place.alias("i")), "open")
    discard(spark, first_round)
    def ids_of(some: DataFrame) -> DataFrame:
        return some.select(F.col("a").alias("key")).union(some.select(F.col("b").alias("key"))).distinct()

    sketches = materialize(_sketches(usable, words, ids_of(pairs).union(rest.select("key")).distinct()).join(copies, "key", "left_anti"), "sketches")
    possible = materialize(_possible(pairs, sketches, percent), "pairs")
    discard(spark, pairs)
    pairs = possible
    fragments = _fragments(usable, words, ids_of(pairs), frequent).join(copies, "key", "left_anti")
    links = materialize(_links(pairs, fragments, percent), "links")
    labels = materialize(components(links), "labels")

    while True:
        named = rest.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        split = named.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
        named = materialize(named.join(split, "token", "left_semi"), "open")
        discard(spark, rest)
        if named.isEmpty():
            break
        per = named.groupBy("token", "component").agg(F.count("*").alias("members"))
        largest = per.groupBy("token").agg(F.max_by("component", F.struct("members", "component")).alias("largest"))
        outside = named.join(largest, "token").where(F.col("component") != F.col("largest")).select("token", "key", "n", "i")
        first = F.row_number().over(Window.partitionBy("token").orderBy(F.col("i") / F.col("n"), "key"))
        lead = materialize(outside.withColumn("__r", first).where(F.col("__r") <= LATER_LEADERS).select("token", "key", F.lit(True).alias("lead")), "leaders")
        lists = named.groupBy("key").agg(F.sort_array(F.collect_set("token")).alias("tokens"))  # no longer than a text's prefix
        shown = named.join(lead, ["token", "key"], "left").join(sketches, "key").join(lists, "key")
        rows = shown.select("token", F.coalesce("lead", F.lit(False)).alias("lead"), "key", "n", "i", "component", "bits", "tokens")
        ordered = rows.repartition("token").sortWithinPartitions("token", F.desc("lead"), F.col("i") / F.col("n"), "key")
        more = materialize(_later_round(ordered, percent).distinct(), "pairs")
        rest = materialize(named.drop("component").join(lead.select("token", "key"), ["token", "key"], "left_anti"), "open")
        discard(spark, named, lead)
        if more.isEmpty():
            continue
        found = materialize(_links(more, _fragments(usable, words, ids_of(more), frequent).join(copies, "key", "left_anti"), percent), "links")
        if not found.isEmpty():
            links = links.union(found)
            labels = materialize(components(links), "labels")

    joined = sizes.join(classes, ["s1", "s2", "n"], "left").withColumn("rep", F.when(F.col("key").isNotNull(), F.coalesce("rep", "key")))
    joined = joined.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return joined.select("key", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
