"""Shards along a Hilbert curve, so that files can be skipped by several metadata dimensions at once.

Every dimension is quantised to ``2 ** bits`` steps that hold about equally many rows: numbers through a histogram of
``HISTOGRAM`` equal widths, other values through counts of their distinct values, both summed in Spark; of each dimension
only its ``2 ** bits - 1`` cuts reach the driver. The steps are turned into a place on the curve by a column expression. The
table is sorted by place in ranges of Spark's choosing, rows are numbered across them by the ranges' counts, and the
numbered sequence is cut into runs: of equal numbers of rows (law ``rows``, counts at most one apart) or of about equal
bytes (law ``bytes``, a row goes where its middle byte lies).

Everything is column expressions; no Python runs over rows.

Defined results: a null text has no bytes, size 8 and checksum 0; a null value of a dimension comes before all others; ties
on the curve come by key (null first), checksum and size, and rows equal in all of them by their place in the input, so a
group of copies or a hot source is cut like other rows; an empty table gives no rows; with fewer rows than shards some
shards stay empty. A very long text costs its bytes once (size and checksum), it is not moved unless it is carried. Other
columns are not read unless they are named in ``carry``; carried names must differ from the result's own, else an error
says so.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from convqa.session import materialize

HISTOGRAM = 4096
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def curve_place(steps: Sequence[Column], bits: int) -> Column:
    """Place on the Hilbert curve through a cube of ``len(steps)`` dimensions with ``2 ** bits`` cells each way.

    Each bit, from the highest, says in which half the point lies; the halves before it turn and mirror the axes. What is
    left of the axes is read as a Gray code with the bits of the dimensions in turn.
    """
    n = len(steps)
    low = lambda q: q - 1
    moves = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(axes: Column, move: Column) -> Column:
        q, i = move["q"], move["i"]
        first, own = F.get(axes, F.lit(0)), F.get(axes, i)
        far = own.bitwiseAND(q) != 0
        swapped = first.bitwiseXOR(own).bitwiseAND(low(q))
        return F.transform(axes, lambda v, k: F.when(k == 0, v.bitwiseXOR(F.when(far, low(q)).otherwise(swapped))).when(
            (k == i) & ~far, v.bitwiseXOR(swapped)).otherwise(v))

    def interleaved(axes: Column) -> Column:
        at = [F.get(axes, F.lit(i)) for i in range(n)]
        gray = [functools.reduce(lambda a, b: a.bitwiseXOR(b), at[:i + 1]) for i in range(n)]
        flips = [F.when(gray[-1].bitwiseAND(1 << b) != 0, (1 << b) - 1).otherwise(0) for b in range(bits - 1, 0, -1)]
        flip = functools.reduce(lambda a, b: a.bitwiseXOR(b), flips, F.lit(0))
        bound = F.array(F.struct(F.array(*gray).alias("g"), flip.alias("t")))
        index = lambda x: functools.reduce(operator.add, [
            F.shiftright(F.get(x["g"], F.lit(i)).bitwiseXOR(x["t"]), b).bitwiseAND(1).cast("long") * (1 << (b * n + n - 1 - i)) for b in range(bits) for i in range(n)])
        return F.transform(bound, index)[0]

    axes = F.array(*[s.cast("int") for s in steps])
    turned = F.aggregate(moves, axes, turn) if bits > 1 else axes
    return F.transform(F.array(turned), interleaved)[0]


def _running(counts: DataFrame, value: str) -> DataFrame:
    """``counts`` (``value, n``) with ``before``, the rows of smaller values; sorted in ranges, not in one task."""
    ranged = materialize(counts.repartitionByRange(value).withColumn("__part", F.spark_partition_id()), "counts")
    totals = ranged.groupBy("__part").agg(F.sum("n").alias("__n"))  # one row per range
    earlier = totals.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("n").over(Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("__in", F.coalesce(inside, F.lit(0))).join(earlier.select("__part", "__base"), "__part").select(
        value, "n", (F.col("__base") + F.col("__in")).alias("before"))


def level(df: DataFrame, column: str) -> Column:
    """The value that is counted: whole numbers by equal widths between the least and the largest, others as they are."""
    if not isinstance(df.schema[column].dataType, IntegralType):
        return F.col(column)
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return F.lit(None).cast("long")
    return F.expr(f"(cast(`{column}` as decimal(38,0)) - {low}) div {(high - low) // HISTOGRAM + 1}").cast("long")


def cuts(df: DataFrame, value: Column, bits: int) -> list:
    """For k = 1 .. 2**bits - 1 the smallest value such that k / 2**bits of the rows are at most as large; nulls do not count."""
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    placed = materialize(_running(counts, "v"), "placed")
    total, steps = placed.agg(F.sum("n")).first()[0] or 0, 1 << bits
    first, last = (F.floor(F.col("before") * steps / total) + 1, F.floor((F.col("before") + F.col("n")) * steps / total)) if total else (F.lit(1), F.lit(0))
    holds = placed.withColumn("first", first).withColumn("last", F.least(last, F.lit(steps - 1))).where("first <= last")
    found = holds.orderBy("first").select("v", "first", "last").collect()  # at most 2**bits - 1 rows
    return [r["v"] for r in found for _ in range(r["first"], r["last"] + 1)]


def step_of(value: Column, limits: Sequence) -> Column:
    """Number of cuts below the value; null is step 0."""
    return functools.reduce(operator.add, [F.coalesce(value > F.lit(c), F.lit(False)).cast("int") for c in limits], F.lit(0))


def assign(docs: DataFrame, dimensions: Sequence[str], shards: int, key: str = "doc_id", text: str = "text", law: str = "rows", bits: int = 4,
           carry: Sequence[str] = ()) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard, curve`` and the columns of ``carry``.

    ``dimensions`` names input columns; ``size`` is the text's size and ``key`` may be one of them. A slot counts a shard's
    rows along the curve, from 0. ``grown_shard`` is null: a run moves when the number of shards changes.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    clash = sorted({c.lower() for c in carry} & {c.lower() for c in (*OWN, key)})
    if clash:
        raise ValueError(f"columns to carry have names of the result: {clash}")
    if len(dimensions) * bits > 62:
        raise ValueError("a place on the curve has at most 62 bits")
    data = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = {f"__d{i}": c for i, c in enumerate(dimensions) if c != "size"}
    facts = materialize(docs.select(
        F.col(f"`{key}`"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        *[F.col(f"`{c}`").alias(n) for n, c in named.items()], *[F.col(f"`{c}`") for c in carry], F.monotonically_increasing_id().alias("__row")), "facts")
    steps = []
    for i, c in enumerate(dimensions):
        value = level(facts, f"__d{i}" if c != "size" else "size")
        steps.append(step_of(value, cuts(facts, value, bits)))
    placed = facts.withColumn("curve", curve_place(steps, bits)).drop(*named)
    ranged = placed.repartitionByRange("curve", key, "text_crc32", "size", "__row").sortWithinPartitions("curve", key, "text_crc32", "size", "__row")
    ordered = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sums = ordered.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"), F.sum("size").alias("__bytes"))  # one row per range
    over = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(sums.select(
        "__p", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__rows_before"), F.coalesce(F.sum("__bytes").over(over), F.lit(0)).alias("__bytes_before"), "__n", "__bytes"), "ranges")
    rows, size = base.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum("__bytes"), F.lit(0))).first()
    numbered = ordered.withColumn("__p", part).join(base, "__p").withColumn("__pos", F.col("__rows_before") + inside)
    if law == "rows":
        shard = F.expr(f"(__pos * {shards}) div {max(rows, 1)}")
        start = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
        cut = numbered.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__pos") - start)
    else:
        before = F.coalesce(F.sum("size").over(Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = numbered.withColumn("__b", F.col("__bytes_before") + before)
        cut = materialize(numbered.withColumn("shard", F.expr(f"least({shards - 1}, ((2 * __b + size) * {shards}) div {max(2 * size, 1)})").cast("int")), "cut")
        starts = cut.groupBy("shard").agg(F.min("__pos").alias("__start"))
        cut = cut.join(F.broadcast(starts), "shard").withColumn("slot", F.col("__pos") - F.col("__start"))  # one row per shard
    return cut.select(key, "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", *carry)


def write(docs: DataFrame, path: str, dimensions: Sequence[str], shards: int, **options) -> DataFrame:
    """Whole rows as Parquet, a folder per shard, sorted along the curve; returns each shard's least and largest values.

    That table (``shard, rows, bytes, min_..., max_...``) is what a reader prunes by; Parquet keeps the same limits in its footers.
    """
    kept = [c for c in docs.columns if c not in (options.get("key", "doc_id"), *OWN)]
    cut = assign(docs, dimensions, shards, carry=kept, **options)
    cut.drop("law", "grown_shard", "text_crc32").repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.parquet(path)
    limits = [f(c).alias(f"{n}_{c}") for c in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return written.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *limits)
