"""Ranks against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np

from convqa.llm import bag_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, top=20):
    terms = [(k, Counter(TERM.findall((t or "").translate(LOWER)))) for k, t in docs]
    terms = [(k, c) for k, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(w for _, c in terms for w in c)
    out = []
    for ident, text in items:
        asked = TERM.findall((text or "").translate(LOWER))
        scored = []
        for k, c in terms:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in asked if w in c)
            if s > 0:
                scored.append((-s, k is None, k or 0))
        out += [(ident, r + 1, None if none else k, -s) for r, (s, none, k) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def check(spark, docs, items, **options):
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, bag string, n int").repartition(5)
    i = spark.createDataFrame([(k, t, 2) for k, t in items], "item_id long, text string, score int")
    got = sorted(map(tuple, bag_search.rank(d, i, **options).collect()), key=str)
    assert got == plain(docs, items, options.get("top", 20))


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["Zoé", "ÉTÉ", "a1", "ñ", "the", "of", "x-ray", "漢字", "don't"] + [f"w{k}" for k in range(60)]
    docs = [(k, rng.choice([" ", "\n", "_", "; "]).join(rng.choices(words, k=rng.choice([1, 4, 30, 90])))) for k in range(n)]
    return docs, [(k, " ".join(rng.choices(words + ["nowhere"], k=rng.choice([1, 5, 40])))) for k in range(25)]


def test_against_all_documents(spark, monkeypatch):
    monkeypatch.setattr(bag_search, "PART", 17)
    docs, items = corpus(1, 400)
    check(spark, docs, items)
    check(spark, docs, items, top=3, block_terms=150)


def test_classes_of_copies(spark):
    """A third of the rows is one bag, in other orders and cases; ties go to smaller ids across classes."""
    docs, items = corpus(2, 300)
    hot = ["the Of w1 w2", "w2 W1 of THE", "of the w1, w2"]
    docs = [(k, hot[k % 3] if k % 3 == 0 else "of the w1 " + "w2 w9"[k % 2 * 3:] if k % 7 == 0 else t) for k, t in docs]
    check(spark, docs, items + [(100, "the of w1 w2"), (101, "the"), (102, "w9 the the")])


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " -!"), (None, "apple pie"), (None, "apple pie"), (4, "apple pie"), (4, "apple pie"), (5, "Apple " * 60_000 + "pie"), (6, "ápple")]
    items = [(1, None), (2, ""), (3, "APPLE apple"), (3, "pie"), (None, "ápple none"), (4, "none")]
    check(spark, docs, items)
    check(spark, [], items)
    check(spark, docs, [])
    check(spark, [(1, ""), (2, None)], items)


def test_vocabulary_compares_bytes():
    """Terms that share a hash are told apart by their bytes."""
    known = bag_search.Vocabulary([b"one", b"two", b"six", b"three"])
    known.codes, known.alike = np.full(4, 5, np.uint64), 4
    raw = np.frombuffer(b"sixtwoonethreeten", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 14]), np.array([3, 6, 9, 14, 17])
    assert known.numbers(raw, starts, ends, np.full(5, 5, np.uint64)).tolist() == [2, 1, 0, 3, -1]


def test_integer_sums_beyond_doubles():
    weight = np.array([10_000], np.int64)
    big = bag_search._Postings(np.array([0]), np.array([0]), np.array([10**6]), weight, 1)
    assert not big.doubles
    got = big.scores(np.array([0]), np.array([7]), np.array([0]), np.array([75]), 1)
    assert got.tolist() == [[10**10 * (7 * 10**9 // (7000 + 900))]]
