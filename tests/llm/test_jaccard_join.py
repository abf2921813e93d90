"""Components of the join against all pairs compared one by one."""

import random
import re

from convqa.llm import jaccard_join


def plain(rows, words=4, percent=85):
    sets = {}
    for key, text in rows:
        w = [x.encode().lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        s = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.setdefault(key, s)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def check(spark, rows, **options):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, key string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(df, **options).collect()}
    want = plain(rows, percent=options.get("percent", 85))
    assert got == want


def corpus(seed, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    passage = " ".join(word() for _ in range(60))
    rows, base = [], [" ".join(word() for _ in range(rng.choice([3, 30, 80, 200]))) for _ in range(12)]
    for k in range(copies):
        w = rng.choice(base[:3] if k % 3 else base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        if k % 11 == 0:
            w += passage.split()
        rows.append((rng.randrange(10**9), rng.choice([" ", "\n", "  "]).join(w).title() if k % 5 else " ".join(w)))
    odd = [None, "", " \n", "one", "One", "a b c", "A B  C", "a b c d", passage, passage + " x", "é É", "word " * 30_000]
    return rows + [(10**9 + k, t) for k, t in enumerate(odd)]


def test_against_all_pairs(spark):
    check(spark, corpus(1, 220), leaders=2)


def test_hot_group(spark):
    check(spark, corpus(2, 400), leaders=3, percent=80)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.linked(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None), (2, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (5, "A b c d e")]
    far = " ".join(f"w{i}" for i in range(60))
    near = far + "".join(f" x{i}" for i in range(14))
    rows += [(7, far), (7, far), (8, near), (8, near)]
    got = [r for r in jaccard_join.linked(spark.createDataFrame(rows, schema)).collect() if r.doc_id not in (7, 8) or r.component_id != r.doc_id]
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 2, None), (1, 0, 1), (2, 2, 2), (2, 2, 2), (5, 2, 2)]


def test_equal_ids_with_different_texts(spark):
    """A key links with whatever one of its texts links with, wherever its other texts stand."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b + " tail"), (9, None), (12, c), (12, c), (None, b), (None, None), (20, c + " more words"), (30, "alone"), (30, "")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(1, 57, 1), (5, 57, 1), (5, 57, 1), (9, 58, 1), (9, 0, 1), (12, 57, 12), (12, 57, 12), (-1, 57, -1), (-1, 0, -1), (20, 59, 12), (30, 1, 30), (30, 0, 30)]
    assert got == sorted(want)


def test_equal_ids_against_all_pairs(spark):
    rows = [(k % 90, t) for k, (_, t) in enumerate(corpus(5, 160))]
    per_row = plain(list(enumerate(t for _, t in rows)))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, (key, _) in enumerate(rows):
        x, y = find(("key", key)), find(("part", per_row[i][1]))
        root[x] = y
    least = {}
    for key, _ in rows:
        least[find(("key", key))] = min(key, least.get(find(("key", key)), key))
    want = sorted((key, per_row[i][0], least[find(("key", key))]) for i, (key, _) in enumerate(rows))
    got = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), leaders=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
