"""Ordered-sequence primitives that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(ord)`` puts a whole key into one task. Here every key is
cut into blocks of neighbouring rows (``block`` is a Column that never decreases along the order).
Each block is windowed on its own and receives one carried value from the blocks before (or after)
it. The carried values come from a map-side combinable aggregate, so the only single-task work per
key is a window over its block summaries. Results equal the plain window exactly.

Keys must not be null. ``order`` must be unique within a key for a deterministic result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convqa.session import materialize

BLOCK = "__block"
CARRY = "__carry"
SUMMARY = "__summary"
ALL_BEFORE = (Window.unboundedPreceding, -1)

DEFAULT_BLOCK_ROWS = 65_536


def blocks_of(ordinal: str, rows: int = DEFAULT_BLOCK_ROWS) -> Column:
    """Block for an integer ordinal; a unique ordinal gives at most ``rows`` rows per block."""
    return F.expr(f"`{ordinal}` div {int(rows)}")


TASK_ROWS = 262_144


def in_tasks(df: DataFrame, rows: int, *keys: str | Column, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by ``keys`` into tasks of about ``task_rows`` of its ``rows``.

    Adaptive planning joins partitions by their bytes, up to 64 MB, which are many millions of narrow rows that one task then sorts.
    A number of partitions that is asked for is kept, so what a task holds does not grow with the table.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows)), *keys)


def with_block(df: DataFrame, block: Column) -> DataFrame:
    """Fix the block once, so that several scans over the same key share one shuffle of the rows."""
    return df.withColumn(BLOCK, block)


def seeded_hash(seed: str | int, *ids: str | Column) -> Column:
    """Reproducible shuffle key: the same seed and data give the same order on any cluster."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") if isinstance(i, str) else i for i in ids]))


def hash_blocks(hash_col: str, hex_digits: int = 3) -> Column:
    """Blocks for md5-ordered rows: the leading digits split any group evenly."""
    return F.conv(F.substring(F.col(hash_col), 1, hex_digits), 16, 10).cast("bigint")


def _carried(df: DataFrame, keys: Sequence[str], block: Column | None, summary: Column, spread, forward: bool = False) -> DataFrame:
    """Attach, per block, ``spread(SUMMARY)`` taken over the blocks before it, or (``forward``) over those behind it from the last one on."""
    work = df if BLOCK in df.columns else df.withColumn(BLOCK, block)
    per_block = work.groupBy(*keys, BLOCK).agg(summary.alias(SUMMARY))
    over_blocks = Window.partitionBy(*keys).orderBy(*_direction([BLOCK], forward)).rowsBetween(*ALL_BEFORE)
    carried = (
        per_block.select(*keys, BLOCK, spread(F.col(SUMMARY)).over(over_blocks).alias(CARRY))
        .where(F.col(CARRY).isNotNull())
    )
    return work.join(carried, [*keys, BLOCK], "left")


def _direction(order: Sequence[str], forward: bool) -> list[Column]:
    """``order``, or its reverse for a look ahead.

    Spark reads a frame that reaches to the end anew for every row, in time quadratic in the rows. From the end on, the same rows
    are a frame that grows.
    """
    return [F.desc(c) if forward else F.asc(c) for c in order]


def _done(work: DataFrame, source: DataFrame, *temporary: str) -> DataFrame:
    """Remove helper columns, but keep a block the caller brought along."""
    return work.drop(CARRY, *temporary) if BLOCK in source.columns else work.drop(BLOCK, CARRY, *temporary)


def _local(keys: Sequence[str], order: Sequence[str], forward: bool = False):
    return Window.partitionBy(*keys, BLOCK).orderBy(*_direction(order, forward))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, block: Column | None = None) -> DataFrame:
    """Inclusive running sum of ``value``."""
    work = _carried(df, keys, block, F.sum(value), F.sum)
    local = F.sum(value).over(_local(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    zero = F.lit(0)
    return _done(work.withColumn(name, F.coalesce(local, zero) + F.coalesce(F.col(CARRY), zero)), df)


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, block: Column | None = None) -> DataFrame:
    """``row_number`` within ``keys``, starting at 1."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), name, block)


def hash_ordinal(df: DataFrame, keys: Sequence[str], hash_col: str, tie: str, name: str) -> DataFrame:
    """``row_number`` within ``keys`` in md5 order (``tie`` breaks equal hashes)."""
    return ordinal(df, keys, [hash_col, tie], name, hash_blocks(hash_col))


def _neighbour(df, keys, order, columns, block, prefix, forward: bool) -> DataFrame:
    packed = F.struct(*columns)
    position = F.struct(*order)
    edge, local = (F.min_by, F.lead) if forward else (F.max_by, F.lag)
    work = _carried(df, keys, block, edge(packed, position), F.last, forward)
    found = F.coalesce(local(packed).over(_local(keys, order)), F.col(CARRY))
    work = work.withColumn("__found", found)
    work = work.select("*", *[F.col(f"__found.{c}").alias(f"{prefix}{c}") for c in columns])
    return _done(work, df, "__found")


def previous(df, keys, order, columns, block=None, prefix="prev_") -> DataFrame:
    """``lag(1)`` of several columns."""
    return _neighbour(df, keys, order, columns, block, prefix, forward=False)


def following(df, keys, order, columns, block=None, prefix="next_") -> DataFrame:
    """``lead(1)`` of several columns."""
    return _neighbour(df, keys, order, columns, block, prefix, forward=True)


def _nearest_value(df, keys, order, value, name, block, forward: bool, inclusive: bool) -> DataFrame:
    known = F.when(value.isNotNull(), F.struct(*order))
    edge = F.min_by if forward else F.max_by
    work = _carried(df, keys, block, edge(value, known), lambda c: F.last(c, ignorenulls=True), forward)
    here = F.last(value, ignorenulls=True).over(_local(keys, order, forward).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return _done(work.withColumn(name, F.coalesce(here, F.col(CARRY))), df)


def stretches(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], starts: Callable[[Column, Column], Column],
              name: str, block: Column | None = None) -> DataFrame:
    """Number the stretches of neighbouring rows: ``starts(this, previous)`` says whether a row begins one.

    Both arguments are structs of ``columns``; ``previous`` is null for the first row of a key. One pass
    over the rows: a block counts its own starts as if nothing came before it, and the block summaries
    (first row, last row, count) correct that afterwards.
    """
    work = df if BLOCK in df.columns else df.withColumn(BLOCK, block)
    this, nothing = F.struct(*columns), F.lit(None).cast(df.select(F.struct(*columns)).schema[0].dataType)
    one = lambda test: F.coalesce(test, F.lit(False)).cast("bigint")
    local = _local(keys, order)
    work = work.withColumn("__start", one(starts(this, F.lag(this).over(local))))
    position = F.struct(*order)
    per_block = work.groupBy(*keys, BLOCK).agg(
        F.sum("__start").alias("__n"), F.min_by(this, position).alias("__first"), F.max_by(this, position).alias("__last"))
    over_blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    first, before = F.col("__first"), F.col("__before")
    settled = per_block.withColumn("__before", F.lag("__last").over(over_blocks)).withColumn("__fix", one(starts(first, before)) - one(starts(first, nothing)))
    carried = settled.select(
        *keys, BLOCK, (F.coalesce(F.sum(F.col("__n") + F.col("__fix")).over(over_blocks.rowsBetween(*ALL_BEFORE)), F.lit(0)) + F.col("__fix")).alias(CARRY)
    ).where(F.col(CARRY) != 0)
    joined = work.join(carried, [*keys, BLOCK], "left")
    count = F.sum("__start").over(local.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.col(CARRY), F.lit(0))
    return _done(joined.withColumn(name, count), df, "__start")


def nearest_both(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, before: str, after: str, block: Column | None = None) -> DataFrame:
    """``last_seen`` and ``next_seen`` in one pass."""
    known = F.when(value.isNotNull(), F.struct(*order))
    work = df if BLOCK in df.columns else df.withColumn(BLOCK, block)
    per_block = work.groupBy(*keys, BLOCK).agg(F.min_by(value, known).alias("__first"), F.max_by(value, known).alias("__last"))
    over_blocks = lambda forward: Window.partitionBy(*keys).orderBy(*_direction([BLOCK], forward)).rowsBetween(*ALL_BEFORE)
    carried = per_block.select(
        *keys, BLOCK, F.last("__last", ignorenulls=True).over(over_blocks(False)).alias("__cb"), F.last("__first", ignorenulls=True).over(over_blocks(True)).alias("__ca"))
    work = work.join(carried.where("__cb is not null or __ca is not null"), [*keys, BLOCK], "left")
    back, ahead = (F.last(value, ignorenulls=True).over(_local(keys, order, forward).rowsBetween(Window.unboundedPreceding, 0)) for forward in (False, True))
    return work.withColumn(before, F.coalesce(back, "__cb")).withColumn(after, F.coalesce(ahead, "__ca")).drop(BLOCK, "__cb", "__ca")


def last_seen(df, keys, order, value: Column, name: str, block: Column | None = None, inclusive: bool = True) -> DataFrame:
    """Most recent non-null ``value`` up to this row."""
    return _nearest_value(df, keys, order, value, name, block, forward=False, inclusive=inclusive)


def next_seen(df, keys, order, value: Column, name: str, block: Column | None = None, inclusive: bool = True) -> DataFrame:
    """First non-null ``value`` from this row on."""
    return _nearest_value(df, keys, order, value, name, block, forward=True, inclusive=inclusive)


def _unique_times(right: DataFrame, keys, at: str, at_type: str, payload: Sequence[str], tie: Sequence[str], prefix: str) -> DataFrame:
    """Right side of an as-of join with one row per key and time, the smallest in ``tie``."""
    pack = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in (at, *payload)])
    return right.where(F.col(at).isNotNull()).groupBy(*keys, F.col(at).cast(at_type).alias("__at")).agg(
        F.min_by(pack, F.struct(*(tie or payload or [at]))).alias("__right"))


def _with_left(r: DataFrame, left: DataFrame, keys, left_at: str, side: int) -> DataFrame:
    """Both sides in one sequence; ``__left`` or ``__right`` tells which one a row is."""
    l = left.select(*keys, F.col(left_at).alias("__at"), F.struct(*left.columns).alias("__left"))
    both = r.select("*", F.lit(None).cast(l.schema["__left"].dataType).alias("__left"))
    return both.unionByName(l.select("*", F.lit(None).cast(r.schema["__right"].dataType).alias("__right"), F.lit(side).alias("__side")))


BLOCK_LIMIT = 4 * DEFAULT_BLOCK_ROWS


def limited_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, limit: int = BLOCK_LIMIT) -> DataFrame:
    """``df`` with its block, no block of which has many more than ``limit`` rows.

    Blocks of equal width serve while none is too full. Where a burst fills one, the table is written in ranges of about
    equal numbers of rows, cut also between rows of equal ``order``, and the ranges are the blocks.
    """
    cut = with_block(df, block)
    filled = cut.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (filled[0] or 0) <= limit:
        return cut
    ranges = -(-2 * filled[1] // limit)
    spread = df.withColumn("__spread", F.xxhash64(*df.columns)).repartitionByRange(int(ranges), *keys, *order, "__spread")
    return materialize(spread.drop("__spread").withColumn(BLOCK, F.spark_partition_id().cast("bigint")), "ranges")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, payload: Sequence[str],
         block_width: int, forward: bool, prefix: str = "asof_", tie: Sequence[str] = (), limit: int = BLOCK_LIMIT) -> DataFrame:
    """Nearest right row at or after (``forward``) or at or before each left row, per key.

    One union and one block scan instead of a range join. Left columns are kept; matched time and
    ``payload`` get ``prefix``. Right rows of equal time are reduced to the one smallest in ``tie``.
    """
    r = _unique_times(right, keys, right_at, dict(left.dtypes)[left_at], payload, tie, prefix)
    # At equal times the left row has to see the right row in either direction.
    both = _with_left(r.withColumn("__side", F.lit(1 if forward else 0)), left, keys, left_at, 0 if forward else 1)
    both = limited_blocks(both, keys, ["__at", "__side"], blocks_of("__at", block_width), limit)
    scan = next_seen if forward else last_seen
    found = scan(both, keys, ["__at", "__side"], F.col("__right"), "__hit")
    return found.where(F.col("__left").isNotNull()).select(
        *[F.col(f"__left.{c}").alias(c) for c in left.columns], *[F.col(f"__hit.{prefix}{c}").alias(f"{prefix}{c}") for c in (right_at, *payload)])


def asof_both(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, payload: Sequence[str],
              block_width: int, tie: Sequence[str] = (), limit: int = BLOCK_LIMIT) -> DataFrame:
    """As-of in both directions in one pass; columns get the prefixes ``before_`` and ``after_``.

    Every right row is placed before and after left rows of its time, so an equal time counts both ways.
    """
    r = _unique_times(right, keys, right_at, dict(left.dtypes)[left_at], payload, tie, "")
    twice = r.withColumn("__side", F.explode(F.array(F.lit(0), F.lit(2))))
    both = _with_left(twice, left, keys, left_at, 1)
    both = limited_blocks(both, keys, ["__at", "__side"], blocks_of("__at", block_width), limit)
    found = nearest_both(both, keys, ["__at", "__side"], F.col("__right"), "__b", "__a")
    return found.where(F.col("__left").isNotNull()).select(
        *[F.col(f"__left.{c}").alias(c) for c in left.columns],
        *[F.col(f"__{p[0]}.{c}").alias(f"{p}_{c}") for p in ("before", "after") for c in (right_at, *payload)])


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, bucket: Column, name: str) -> DataFrame:
    """Linear-interpolated quantile per key without holding or moving a key's values.

    Rows are counted per ``bucket`` (a function of the value that never decreases), which combines before any shuffle. The
    totals show which buckets hold the two ranks needed; in a second pass only rows of those buckets are counted by value.
    The buckets wanted, two a key at most, are written, so that small ones go to the rows and not the rows to them.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, value, bucket.alias("__bucket"))
    by_bucket = Window.partitionBy(*keys).orderBy("__bucket")
    totals = known.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__in")).select(
        *keys, "__bucket", "__in", F.coalesce(F.sum("__in").over(by_bucket.rowsBetween(*ALL_BEFORE)), F.lit(0)).alias("__below"),
        F.sum("__in").over(Window.partitionBy(*keys)).alias("__total"))
    at = (F.col("__total") - 1) * F.lit(q)
    holds = lambda rank: (F.col("__below") <= rank) & (rank < F.col("__below") + F.col("__in"))
    wanted = materialize(totals.withColumn("__at", at).where(holds(F.floor("__at")) | holds(F.ceil("__at"))).drop("__in", "__total"), "wanted")
    counts = known.join(wanted, [*keys, "__bucket"]).groupBy(*keys, "__bucket", "__below", "__at", value).agg(F.count(F.lit(1)).alias("__n"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__upto", F.col("__below") + F.sum("__n").over(inside))
    return ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("__upto") > F.floor("__at"), F.col(value))).alias("__lo"), F.min(F.when(F.col("__upto") > F.ceil("__at"), F.col(value))).alias("__hi"),
        F.first(F.col("__at") - F.floor("__at")).alias("__frac"),
    ).select(*keys, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__frac")).alias(name))


def repeated(df: DataFrame, times: Column, number: str = "__copy", step: int = 10_000) -> DataFrame:
    """Every row ``times`` times with ``number`` counting from 0; no array is longer than ``step`` or ``times / step``."""
    whole = df.withColumn("__times", times.cast("bigint")).where("__times > 0")
    parts = whole.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__times") - 1) / step))))
    last = F.least(F.col("__times") - F.col("__part") * step, F.lit(step)) - 1
    start = F.col("__part") * step
    return parts.withColumn(number, F.explode(F.sequence(start, start + last))).drop("__times", "__part")
