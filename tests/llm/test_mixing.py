"""Targets and selection against a plain model."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from convqa import session
from convqa.llm import mixing


def plain_targets(sizes, cycle=(1, 2, 3), stop=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        if not free:
            break
        unit = (total - sum(stop * sizes[s] for s in full)) / sum(weight[s] for s in free)
        above = {s for s in free if unit * weight[s] > stop * sizes[s]}
        if not above:
            break
        full |= above
    return {s: stop * sizes[s] if s in full else unit * weight[s] for s in names}


def rows(n=3000):
    names = ["a", "b", "B", "é", None, "tiny", "z", "empty"]
    out = []
    for i in range(n):
        s = names[0] if i % 3 == 0 else names[i % 8]
        if s == "tiny" and i > 200:
            s = "z"
        text = None if i % 97 == 0 else "" if s == "empty" else "w " * (1 + i * 7 % 40)
        out.append((i, text, s, "x"))
    return out


def test_mix(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size string")
    got = mixing.mix(df, bucket_docs=50).collect()
    assert len(got) == 3000
    size = defaultdict(int)
    for _, t, s, _ in rows():
        size[s] += len((t or "").split())
    want = plain_targets(size)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(df.repartition(7), bucket_docs=50).collect()
    assert sorted(again) == sorted(got)


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    one = mixing.mix(spark.createDataFrame([(1, None, None), (1, None, None), (2, "a b " * 9000, None)], schema)).collect()
    assert sorted(r.taken for r in one) == [0, 0, 18000]
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, "s")], schema)).collect()] == [0]


def test_better_documents_come_first(spark):
    text = [(i, "good words here" if i % 2 else "#### $$$$ %%%%", "s" if i < 4000 else "t") for i in range(8000)]
    out = mixing.mix(spark.createDataFrame(text, "doc_id long, text string, source string"), cycle=(1.0, 3.0)).where("source = 's'").collect()
    good, bad = sum(r.copies for r in out if r.doc_id % 2), sum(r.copies for r in out if not r.doc_id % 2)
    assert good > 4 * bad


def plain_taken(rows, targets, stop=3):
    """Words taken of each row: whole epochs, then rows in draw order while their middle lies inside the budget."""
    size, taken = defaultdict(int), {}
    for _, _, n, source in rows:
        size[source] += n
    for s in size:
        epochs = int(targets[s] // size[s]) if size[s] else 0
        rest, sofar = targets[s] - epochs * size[s], 0
        for draw, key, n, _ in sorted(r for r in rows if r[3] == s):
            fits = n > 0 and epochs < stop and 2 * sofar + n <= 2 * rest
            taken[key] = n * (epochs + fits)
            sofar += n
    return taken


def test_selection_against_a_plain_model(spark):
    df = spark.createDataFrame([r for r in rows() if r[2] is not None], "doc_id long, text string, source string, size string")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 12).cast("double") + 0.5) / float(1 << 52)
    known = df.select((-F.log(u) / mixing.quality_weight(F.col("text"))).alias("draw"), "doc_id", mixing.word_count(F.col("text")).alias("n"), "source")
    got = mixing.mix(df, bucket_docs=40).collect()
    want = plain_taken([tuple(r) for r in known.collect()], {r.source: r.target for r in got})
    assert {r.doc_id: r.taken for r in got} == want


def test_ranges_stay_even_with_low_quality(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    df = spark.createDataFrame([(i, "#" * 40 + " word", "s") for i in range(20_000)], "doc_id long, text string, source string")
    mixing.mix(df, bucket_docs=200).count()
    ranges = spark.read.parquet(str(next(tmp_path.glob("ranges-*"))))
    assert ranges.groupBy("range").count().agg(F.max("count")).first()[0] < 1_000
