"""Components, Bloom filters, hashes and batch cutting."""

import random

import numpy as np
import pyarrow as pa

from convqa.llm import bloom, hashing
from convqa.llm.arrow import small_batches, text_bytes
from convqa.llm.graph import components


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rng.randrange(2000, 2080), rng.randrange(2000, 2080)) for _ in range(45)] + [(7, 7), (None, 3), (5, 6), (6, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bloom_never_loses(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id as string) as text")
    ids = rows.where("id % 7 = 0").select("id")
    kept = {r.id for r in bloom.maybe(rows, ids, "id").collect()}
    assert {k for k in range(5000) if k % 7 == 0} <= kept and len(kept) < 800
    assert bloom.maybe(rows, ids.limit(0), "id").count() == 0


def test_hashes_follow_the_bytes():
    raw, offsets = text_bytes(pa.array(["ab cd", None, "cd", "", " ab  "]))
    assert offsets.tolist() == [0, 5, 5, 7, 7, 12]
    starts, ends, doc = hashing.spans(hashing.word_mask(raw), offsets)
    h = hashing.span_hashes(hashing.prefix_sums(raw), starts, ends)
    assert doc.tolist() == [0, 0, 2, 4] and h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
    assert hashing.lowered_latin(np.frombuffer("ÀÉ×Z".encode(), np.uint8)).tobytes().decode() == "àé×z"


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 10, "b" * 100, None, "c", "d" * 9])], names=["k", "t"])
    parts = list(small_batches(iter([batch]), 1, 12))
    assert [p.column(0).to_pylist() for p in parts] == [[0], [1], [2, 3, 4]]
