"""Places on the curve, even runs, quantisation and pruning."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from convqa.llm import hilbert_shards as h

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2), (2, 1), (1, 4)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame([list(c) for c in cells], ", ".join(f"x{i} int" for i in range(dims)))
    rows = df.select("*", h.curve_place([F.col(f"x{i}") for i in range(dims)], bits).alias("p")).orderBy("p").collect()
    assert [r.p for r in rows] == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(x[:dims], y[:dims])) == 1 for x, y in zip(rows, rows[1:]))


def docs(n, seed=1):
    rng = random.Random(seed)
    return [(k, "é" * rng.randrange(200), "de" if k % 3 else rng.choice(["en", "fr", None]), f"s{rng.randrange(9)}", 1) for k in range(n)]


def test_rows_even_and_gapless(spark):
    data = docs(1000)
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = h.assign(df, ["lang", "source", "size", "doc_id"], 24).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        text = data[r.doc_id][1].encode()
        assert r.size == len(text) + 8 and r.text_crc32 == zlib.crc32(text) and r.law == "rows" and r.grown_shard is None
    assert sorted(by) == list(range(24)) and {len(v) for v in by.values()} == {41, 42}
    order = []
    for s in range(24):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        order += sorted(by[s], key=lambda r: r.slot)
    assert [(r.curve, r.doc_id) for r in order] == sorted((r.curve, r.doc_id) for r in got)
    again = h.assign(df.repartition(3), ["lang", "source", "size", "doc_id"], 24).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_bytes_near_equal(spark):
    df = spark.createDataFrame(docs(2000), SCHEMA)
    got = h.assign(df, ["source", "doc_id"], 7, law="bytes").collect()
    total = sum(r.size for r in got)
    for s in range(7):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 7) <= max(r.size for r in got)


def test_cuts_hold_equal_shares(spark):
    df = spark.createDataFrame([(k * k, "abc"[k % 3]) for k in range(4096)] + [(None, None)] * 10, "n long, s string")
    number = h.level(df, "n")
    limits = h.cuts(df, number, 3)
    share = df.where("n is not null").groupBy(h.step_of(number, limits).alias("s")).count().collect()
    assert len(share) == 8 and max(r["count"] for r in share) < 3 * 512
    assert h.cuts(df, h.level(df, "s"), 2) == ["a", "b", "c"]
    assert h.cuts(df.limit(0), F.col("s"), 2) == []


def test_files_can_be_skipped(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6), "t" * rng.randrange(1, 400), f"l{rng.randrange(16)}", f"s{rng.randrange(16)}", k) for k in range(8000)]
    limits = h.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"), ["lang", "source"], 16).collect()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 8000 and {"text", "n_chars", "lang", "source", "shard"} <= set(written.columns)
    for column, value in (("lang", "l7"), ("source", "s12")):
        hit = [r for r in limits if r[f"min_{column}"] <= value <= r[f"max_{column}"]]
        assert 1 <= len(hit) <= 8
        found = written.where((F.col(column) == value) & F.col("shard").isin([r.shard for r in hit])).count()
        assert found == sum(r[2 if column == "lang" else 3] == value for r in rows)


def test_edges(spark):
    dims = ["lang", "source", "size", "doc_id"]
    assert h.assign(spark.createDataFrame([], SCHEMA), dims, 24).count() == 0
    rows = [(None, None, None, None, None)] * 3 + [(1, "", "en", "", 0), (1, "", "en", "", 0), (2, "w " * 100_000, "en", "x", 5)]
    got = h.assign(spark.createDataFrame(rows, SCHEMA), dims, 4).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == [(0, 8, 0)] * 3 + [(1, 8, 0)] * 2 + [(2, 200_008, zlib.crc32(b"w " * 100_000))]
    sizes = [sum(r.shard == s for r in got) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    clash = spark.createDataFrame([(1, "a", "x", 2, "n")], "doc_id long, text string, shard string, slot int, lang string")
    assert h.assign(clash, ["lang"], 2).columns[-1] == "curve"
    with pytest.raises(ValueError, match="shard"):
        h.assign(clash, ["lang"], 2, carry=["shard"])


def test_no_python_in_the_plan(spark):
    plan = h.assign(spark.createDataFrame(docs(50), SCHEMA), ["lang", "source", "size", "doc_id"], 24)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
