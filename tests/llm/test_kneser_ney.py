"""The model against a plain one, and the defined results."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from convqa.llm import kneser_ney as kn
from convqa.llm.q_models import quality_model


def plain(texts):
    """Probabilities of the seen n-grams and of one unseen, by the textbook recursion."""
    seq = Counter()
    for t in texts:
        s = [kn.START] * 3 + [int(kn.CLASSES[ord(c)]) for c in t]
        s = [x for i, x in enumerate(s) if not (x == kn.SPACE and i and s[i - 1] == kn.SPACE)]
        seq.update(tuple(s[i - 3:i + 1]) for i in range(3, len(s)))
    orders = [seq]
    for k in (3, 2, 1):
        orders.insert(0, Counter(g[-k:] for g in orders[0]))

    def p(g):
        if not g:
            return 1 / kn.SYMBOLS
        table = orders[len(g) - 1]
        c = Counter(table.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0.5
        cut = [1 - 2 * y * c[2] / c[1] if c[1] else 0.5, 2 - 3 * y * c[3] / c[2] if c[2] else 1.0, 3 - 4 * y * c[4] / c[3] if c[3] else 1.5]
        cut = [min(max(d, 0.05), k + 0.9) for k, d in enumerate(cut)]
        same = {h: n for h, n in table.items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        less = lambda n: cut[min(n, 3) - 1]
        total = sum(same.values())
        own = max(same[g] - less(same[g]), 0) / total if g in same else 0
        return own + sum(map(less, same.values())) / total * p(g[1:])

    return seq, p


def test_model(spark):
    texts = ["the cat sat.", "the  hat is at the mat", "Éa, 12 das the", "a"]
    df = spark.createDataFrame([(t,) for t in texts * 2 + [None, ""]], "text string").repartition(3)
    got = kn.train(df)
    seq, p = plain(texts * 2)
    for g in [*seq, (6, 7, 8, 9), (63, 63, 63, 63)]:
        code = sum(x << kn.BITS * (3 - k) for k, x in enumerate(g))
        assert math.isclose(got[code], math.log(p(g)), rel_tol=1e-4), g
    assert np.allclose(np.exp(got.astype(float)).reshape(-1, kn.SYMBOLS).sum(axis=1), 1, atol=1e-3)


def test_grams():
    code, begins = kn.grams(pa.array(["ab", None, "", "a  b", "😀"]))
    assert begins.tolist() == [0, 2, 2, 2, 5, 6]
    assert code[0] == 6 and code[1] == (6 << 6 | 7)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, perplexity string"
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, "plain text here", "en", None), (3, "plain text here", "en", None), (4, "zqx" * 60_000, None, None)]
    df = spark.createDataFrame(rows, schema)
    model = kn.train(df.where("doc_id = 3"))
    out = kn.judge(kn.perplexity(df, model), F.col("doc_id") == 3, least=1).orderBy("doc_id").collect()
    assert [r.kept for r in out] == [False, False, True, True, False] and out[0].perplexity is None and out[4].perplexity > out[3].perplexity
    assert kn.train(df.limit(0)) is None
    assert [r.kept for r in kn.judge(kn.perplexity(df, None), F.lit(False)).collect()] == [True] * 5


def test_query_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = defaultdict(list)
    for r in quality_model(spark, sf).collect():
        kept[labels.get(r.doc_id)].append(r.kept)
    print({k: (sum(v), len(v)) for k, v in kept.items()})
    assert sum(kept[1]) >= 0.97 * len(kept[1])
    assert sum(kept[0]) <= 0.7 * len(kept[0])
