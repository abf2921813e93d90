"""The model of words against a plain one, word order, and the defined results."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from convqa.llm import word_kneser_ney as wk
from convqa.llm.q_models import quality_model

EDGES = ("<s>", "</s>")


def words(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def pairs(text):
    w = words(text)
    return list(zip([EDGES[0], *w], [*w, EDGES[1]])) if w else []


def plain(texts):
    """Function of a text and whether it is to be scored as new, by the textbook recursion."""
    n = Counter(p for t in texts for p in pairs(t))
    n1 = Counter(c for _, c in n)
    seen, seen1 = Counter(), Counter()
    for (b, c), k in n.items():
        seen[b] += k
        seen1[c] += k

    def cuts(table):
        c = Counter(table.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0.5
        cut = [1 - 2 * y * c[2] / c[1] if c[1] else 0.5, 2 - 3 * y * c[3] / c[2] if c[2] else 1.0, 3 - 4 * y * c[4] / c[3] if c[3] else 1.5]
        cut = [min(max(d, 0.05), k + 0.9) for k, d in enumerate(cut)]
        return lambda k: cut[min(k, 3) - 1]

    less, less1 = cuts(n), cuts(n1)
    total1 = sum(n1.values())
    unseen = sum(map(less1, n1.values())) / total1 / (len(n1) + 1)
    left = defaultdict(float)
    for (b, _), k in n.items():
        left[b] += less(k) / seen[b]

    def perplexity(text, new):
        own = pairs(text)
        m, first, second = Counter(own), Counter(b for b, _ in own), Counter(c for _, c in own)
        # how often a word is trusted: as a second word, START as a first one
        gone = lambda w: new and (seen[w] <= first[w] if w == EDGES[0] else seen1[w] <= second[w])
        logs = 0.0
        for b, c in own:
            p1 = unseen + (0 if gone(c) or c not in n1 else (n1[c] - less1(n1[c])) / total1)
            known = b in seen and not gone(b)
            here = (b, c) in n and not (new and n[b, c] <= m[b, c])
            logs += math.log(((n[b, c] - less(n[b, c])) / seen[b] if here else 0) + (left[b] if known else 1) * p1)
        return math.exp(-logs / len(own)) if own else None

    return perplexity


def test_query_against_plain_model(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    perplexity = plain([r.text for r in docs if r.doc_id in good])
    got = {r.doc_id: r.perplexity for r in quality_model(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        want = perplexity(r.text, r.doc_id in good)
        assert got[r.doc_id] is None if want is None else math.isclose(got[r.doc_id], want, rel_tol=1e-4), r.doc_id


def test_word_order_counts(spark):
    """Texts whose words were put in another order are less likely; classes of characters could not tell."""
    texts = [f"the {a} sat on the {b} and saw a {c} there" for a in ("cat", "dog") for b in ("mat", "hat", "bed") for c in ("bird", "mouse")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = wk.train(df)
    mixed = spark.createDataFrame([(" ".join(reversed(t.split())),) for t in texts], "text string")
    straight, other = (wk.perplexity(d, model).agg(F.min("perplexity"), F.max("perplexity")).first() for d in (df, mixed))
    assert straight[1] * 2 < other[0]


def test_edges(spark):
    rows = [(1, None, "x"), (2, " \n", "x"), (3, "plain text here", None), (3, "plain text here", None), (4, "zqx " * 30_000 + "plain text here", None), (5, "Plain TEXT here", None)]
    df = spark.createDataFrame(rows, "id long, text string, perplexity string").repartition(3)
    model = wk.train(df.where("id = 3"))
    out = wk.perplexity(df, model).orderBy("id").collect()
    want = plain(["plain text here"] * 2)
    assert [r.perplexity for r in out[:2]] == [None, None] and len(out) == 6
    assert all(math.isclose(r.perplexity, want(r.text, False), rel_tol=1e-4) and math.isclose(r.perplexity_new, want(r.text, True), rel_tol=1e-4) for r in out[2:])
    assert out[2] == out[3] and out[4].perplexity > out[5].perplexity == out[3].perplexity
    assert wk.train(df.limit(0)) is None and wk.perplexity(df.limit(0), model).count() == 0
    assert [r.perplexity for r in wk.perplexity(df, None).collect()] == [None] * 6


def test_rounds_and_shards_do_not_change_results(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    half = df.where("doc_id % 2 = 0")
    one = {r.doc_id: r.perplexity for r in wk.perplexity(df, wk.train(half), rounds=1).collect()}
    monkeypatch.setattr(wk, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(wk, "PACK_ROWS", 1_000)
    more = {r.doc_id: r.perplexity for r in wk.perplexity(df, wk.train(half), rounds=3).collect()}
    assert one.keys() == more.keys() and all(a is None and more[k] is None or math.isclose(a, more[k], rel_tol=1e-9) for k, a in one.items())


def test_pack():
    values = np.array([0, 1, 255, 1 << 47], np.uint64)
    assert wk.unpack(wk.pack(values), np.uint64).tolist() == values.tolist()
