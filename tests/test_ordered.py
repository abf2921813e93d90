"""Block scans against the plain window, with blocks small enough to cut every key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from convqa.operators import intervals
from convqa.operators import ordered as o


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for key in range(6):
        n = 400 if key == 0 else rnd.randint(0, 30)  # one key holds most rows
        for ord_ in sorted(rnd.sample(range(600), n)):
            data.append((key, ord_, rnd.choice("abc"), rnd.choice([None, 1, 2, 3]), rnd.random()))
    return spark.createDataFrame(data, "key int, ord bigint, label string, val int, x double").cache()


def window():
    return Window.partitionBy("key").orderBy("ord")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_scans_equal_windows(rows, size):
    W = window()
    block = o.blocks_of("ord", size)
    got = o.running_sum(rows, ["key"], ["ord"], F.coalesce("val", F.lit(0)), "s", block)
    same(got.select("key", "ord", "s"), rows.select("key", "ord", F.sum(F.coalesce("val", F.lit(0))).over(W).alias("s")))
    got = o.ordinal(rows, ["key"], ["ord"], "n", block)
    same(got.select("key", "ord", "n"), rows.select("key", "ord", F.row_number().over(W).alias("n")))
    got = o.previous(rows, ["key"], ["ord"], ["label", "val"], block)
    same(got.select("key", "ord", "prev_label", "prev_val"), rows.select("key", "ord", F.lag("label").over(W).alias("prev_label"), F.lag("val").over(W).alias("prev_val")))
    got = o.following(rows, ["key"], ["ord"], ["label"], block)
    same(got.select("key", "ord", "next_label"), rows.select("key", "ord", F.lead("label").over(W).alias("next_label")))
    got = o.last_seen(rows, ["key"], ["ord"], F.col("val"), "v", block)
    same(got.select("key", "ord", "v"), rows.select("key", "ord", F.last("val", True).over(W).alias("v")))
    got = o.last_seen(rows, ["key"], ["ord"], F.col("val"), "v", block, inclusive=False)
    same(got.select("key", "ord", "v"), rows.select("key", "ord", F.last("val", True).over(W.rowsBetween(Window.unboundedPreceding, -1)).alias("v")))
    got = o.next_seen(rows, ["key"], ["ord"], F.col("val"), "v", block)
    same(got.select("key", "ord", "v"), rows.select("key", "ord", F.first("val", True).over(W.rowsBetween(0, Window.unboundedFollowing)).alias("v")))


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_stretches(rows, size):
    W = window()
    changed = lambda this, before: before.isNull() | (this["label"] != before["label"])
    got = o.stretches(rows, ["key"], ["ord"], ["label"], changed, "n", o.blocks_of("ord", size))
    prev = F.lag("label").over(W)
    want = rows.withColumn("c", F.when(prev.isNull() | (prev != F.col("label")), 1).otherwise(0)).withColumn("n", F.sum("c").over(W))
    same(got.select("key", "ord", "n"), want.select("key", "ord", "n"))
    opened = lambda this, before: (this["label"] == "a") & ~F.coalesce(before["label"] == "a", F.lit(False))
    got = o.stretches(rows, ["key"], ["ord"], ["label"], opened, "n", o.blocks_of("ord", size))
    want = rows.withColumn("c", F.when((F.col("label") == "a") & ~F.coalesce(prev == "a", F.lit(False)), 1).otherwise(0)).withColumn("n", F.sum("c").over(W))
    same(got.select("key", "ord", "n"), want.select("key", "ord", "n"))
    apart = lambda this, before: before.isNull() | (this["ord"] - before["ord"] > 2)
    got = o.stretches(rows, ["key"], ["ord"], ["ord"], apart, "n", o.blocks_of("ord", size))
    gap = F.col("ord") - F.lag("ord").over(W)
    want = rows.withColumn("c", F.when(gap.isNull() | (gap > 2), 1).otherwise(0)).withColumn("n", F.sum("c").over(W))
    same(got.select("key", "ord", "n"), want.select("key", "ord", "n"))


@pytest.mark.parametrize("width", [2, 40, 100_000])
def test_asof(spark, width):
    rnd = random.Random(2)
    left = [(rnd.randint(0, 2), rnd.randint(0, 300), n) for n in range(120)]
    right = [(rnd.randint(0, 1), rnd.randint(0, 300), n) for n in range(60)]
    ldf = spark.createDataFrame(left, "k int, t bigint, id int")
    rdf = spark.createDataFrame(right, "k int, u bigint, rid int")
    both = {r["id"]: r for r in o.asof_both(ldf, rdf, ["k"], "t", "u", ["rid"], width, ["rid"]).collect()}
    ahead = {r["id"]: r for r in o.asof(ldf, rdf, ["k"], "t", "u", ["rid"], width, True, "x_", ["rid"]).collect()}
    assert len(both) == len(ahead) == len(left)
    for k, t, n in left:
        after = min(((u, i) for kk, u, i in right if kk == k and u >= t), default=(None, None))
        before = min(((-u, i) for kk, u, i in right if kk == k and u <= t), default=(None, None))
        assert (both[n]["after_u"], both[n]["after_rid"]) == after == (ahead[n]["x_u"], ahead[n]["x_rid"])
        assert both[n]["before_rid"] == before[1]


def test_interval_joins(spark):
    rnd = random.Random(3)
    a = [(n, s, s + rnd.randint(1, 40)) for n, s in enumerate(rnd.sample(range(300), 60))]
    b = [(n, s, s + rnd.randint(1, 90)) for n, s in enumerate(rnd.sample(range(300), 60))]
    adf = spark.createDataFrame(a, "i int, s bigint, e bigint").withColumn("k", F.lit(1))
    bdf = spark.createDataFrame(b, "j int, bs bigint, be bigint").withColumn("k", F.lit(1))
    got = [(r["i"], r["j"], r["overlap_start"], r["overlap_end"]) for r in intervals.overlaps(adf, bdf, ["k"], ("s", "e"), ("bs", "be"), 16).collect()]
    want = [(i, j, max(s, x), min(e, y)) for i, s, e in a for j, x, y in b if s < y and x < e]
    assert sorted(got) == sorted(want)
    pts = intervals.points_in(adf.select("k", "i", "s"), bdf, ["k"], "s", "bs", "be").select("i", "j").collect()
    assert sorted(map(tuple, pts)) == sorted((i, j) for i, s, _ in a for j, x, y in b if x <= s <= y)


def test_exact_quantile(spark):
    import numpy as np

    rnd = random.Random(4)
    data = [(k, round(rnd.gauss(-50, 12), 3) if rnd.random() > 0.3 else -60.0) for k in range(4) for _ in range(rnd.randint(1, 300))]
    df = spark.createDataFrame(data, "k int, v double")
    got = {r["k"]: r["q"] for r in o.exact_quantile(df, ["k"], "v", 0.2, F.floor(F.col("v") * 10), "q").collect()}
    for k in range(4):
        assert got[k] == pytest.approx(np.percentile([v for kk, v in data if kk == k], 20))


def test_seeded_order_is_reproducible(spark):
    df = spark.range(500).withColumn("h", o.seeded_hash(9, "id"))
    first = o.hash_ordinal(df, [], "h", "id", "n").orderBy("n").select("id").collect()
    second = o.hash_ordinal(df.repartition(7), [], "h", "id", "n").orderBy("n").select("id").collect()
    assert first == second and [r["id"] for r in first] != list(range(500))


def test_points_in_forms_few_candidates(spark):
    """A hot key with spans of all lengths: candidates stay within a small factor of the matches."""
    rnd = random.Random(3)
    spans = [("hot", j, s, s + rnd.choice((0, 3, 50, 900, 20_000))) for j, s in enumerate(rnd.sample(range(0, 200_000), 400))] + [("cold", 900, -5_000, -100)]
    points = [("hot" if k % 50 else "cold", k, rnd.randrange(-6_000, 200_000)) for k in range(4000)]
    sdf, pdf = spark.createDataFrame(spans, "k string, j int, a bigint, b bigint"), spark.createDataFrame(points, "k string, i int, at bigint")
    got = intervals.points_in(pdf, sdf, ["k"], "at", "a", "b")
    want = sorted((i, j) for k, i, at in points for kk, j, a, b in spans if k == kk and a <= at <= b)
    assert sorted((r.i, r.j) for r in got.select("i", "j").collect()) == want
    sized = sdf.selectExpr("k", "a", "b", "length(bin(b - a)) AS c").collect()
    formed = sum(1 for k, _, at in points for s in sized if s.k == k and s.a >> s.c <= at >> s.c <= s.b >> s.c)
    assert formed <= 6 * len(want) and formed < len(points) * len(spans) / 20


def test_blocks_have_a_limit_in_a_burst(spark):
    """Nearly all rows of one key fall into one block of time, many at the same instant; the result is that of small blocks."""
    rnd = random.Random(5)
    left = [("hot" if k % 10 else "cold", k, 1_000 if k % 3 else rnd.randrange(3_000)) for k in range(6000)]
    right = [("hot" if k % 9 else "cold", f"r{k}", rnd.randrange(3_000)) for k in range(800)]
    ldf, rdf = spark.createDataFrame(left, "k string, i int, t bigint"), spark.createDataFrame(right, "k string, name string, u bigint")
    rows = lambda df: sorted(map(str, df.collect()))
    small = rows(o.asof_both(ldf, rdf, ["k"], "t", "u", ["name"], 50))
    assert rows(o.asof_both(ldf, rdf, ["k"], "t", "u", ["name"], 10**9, limit=500)) == small and len(small) == 6000
    for forward in (True, False):
        assert rows(o.asof(ldf, rdf, ["k"], "t", "u", ["name"], 10**9, forward, limit=300)) == rows(o.asof(ldf, rdf, ["k"], "t", "u", ["name"], 50, forward))
    cut = o.limited_blocks(ldf, ["k"], ["t"], o.blocks_of("t", 10**9), 500)
    assert cut.groupBy("k", o.BLOCK).count().agg(F.max("count")).first()[0] <= 700
    ordered = cut.groupBy("k", o.BLOCK).agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("k", o.BLOCK).collect()
    assert all(x.b <= y.a for x, y in zip(ordered, ordered[1:]) if x.k == y.k)
