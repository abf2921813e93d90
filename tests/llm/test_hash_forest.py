"""Recall against brute force, and the defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convqa.llm import hash_forest
from convqa.llm.q_similar import neighbours


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(np.float64)
    got = neighbours(spark, sf).toPandas()
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]])
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, [s[ids == v][0] for v in own.vec_id], atol=1e-12)
        assert (np.diff(own.score) <= 0).all()
        hits, total = hits + len(want & set(own.vec_id)), total + 20
    print("recall", hits / total)
    assert hits >= 0.9 * total


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]),
            (9, [1.0, 2.0, 3.0]), (40, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    out = hash_forest.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [
        (0, 1, 3, 5.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 3, 10.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert hash_forest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hash_forest.search(df, F.lit(False)).count() == 0


def test_hot_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [1.0, 0.5, 0.25]) if k % 3 == 0 else (k, rng.normal(size=3).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = hash_forest.search(df, F.col("vec_id") == 300, shard_rows=100, top=5).orderBy("rank").collect()
    want = sorted(((-sum(a * b for a, b in zip(v, [1.0, 0.5, 0.25])), k) for k, v in rows if k != 300))[:5]
    assert [r.vec_id for r in out] == [k for _, k in want]
