"""Interval joins as equi joins on buckets along the axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convqa.session import materialize


def points_in(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Points with every closed span ``start..end`` of the same key that holds them; ends are whole numbers.

    Spans are met in buckets of their own size class: a span of a length up to ``2**k`` lies in at most two buckets that wide,
    and a point looks into one bucket per class that occurs (at most 64, few in practice). So what is formed before the test
    of the ends stays within a small factor of the matches, also where one key holds most rows, and each match appears once.
    """
    written = spans if "scratch" in vars(spans) else materialize(spans, "spans")
    sized = written.withColumn("__class", F.length(F.bin(F.col(end) - F.col(start))))
    classes = sorted(r[0] for r in sized.select("__class").distinct().collect() if r[0] is not None)
    bucket = lambda c: F.expr(f"shiftright(cast(`{c}` as bigint), __class)")
    s = sized.withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    p = points.withColumn("__class", F.explode(F.lit(classes).cast("array<int>"))).withColumn("__bucket", bucket(at))
    return p.join(s, [*keys, "__class", "__bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__class", "__bucket")


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open spans of the same key that share some of the axis, each pair once.

    Adds ``overlap_start`` and ``overlap_end``. Spans meet in every bucket they share; only the bucket
    in which the later one starts is kept.
    """
    (a0, a1), (b0, b1) = a_span, b_span
    def cut(df: DataFrame, s: str, e: str, name: str) -> DataFrame:
        return df.withColumn(name, F.expr(f"`{s}` div {width}")).withColumn(
            "__bucket", F.explode(F.sequence(F.col(name), F.expr(f"greatest(`{e}` - 1, `{s}`) div {width}")))
        )
    joined = cut(a, a0, a1, "__fa").join(cut(b, b0, b1, "__fb"), [*keys, "__bucket"])
    return (
        joined.where(F.col("__bucket") == F.greatest("__fa", "__fb"))
        .where((F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)))
        .withColumn("overlap_start", F.greatest(a0, b0)).withColumn("overlap_end", F.least(a1, b1))
        .drop("__bucket", "__fa", "__fb")
    )
