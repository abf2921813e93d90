"""Held-out quality on the driver's labels, a pair that only counts together, and the defined results."""

import random


from convqa.llm import toxicity
from convqa.llm.q_models import toxic


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxic(spark, sf).where("held_out").collect() if r.doc_id in truth]
    hit = sum(r.predicted and truth[r.doc_id] for r in rows)
    said, there = sum(r.predicted for r in rows), sum(truth[r.doc_id] for r in rows)
    print("precision", hit / said, "recall", hit / there, len(rows))
    assert hit >= 0.85 * said and hit >= 0.8 * there


def machine(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.train(df, toxicity.label_share(df))


def test_pairs_beyond_sums(spark):
    rng, rows = random.Random(1), []
    for i in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = ["plain"] * 5 + (["vermin"] if insult else []) + (["martians"] if group else [])
        rows.append((i, " ".join(words), int(insult and group)))
    odd = spark.createDataFrame([(1, "plain vermin"), (2, "plain martians"), (3, "Vermin, MARTIANS!"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.predict(odd, machine(spark, rows)).collect()}
    assert got[3] > 0.7 and max(got[k] for k in (1, 2, 4, 5)) < 0.3


def test_partner_as_common_in_both_classes(spark):
    rng, rows = random.Random(1), []
    for i in range(1200):
        strong, weak, group = (rng.random() < 0.5 for _ in range(3))
        words = ["plain"] * 5 + (["vermin"] if strong else []) + (["scum"] if weak else []) + (["martians"] if group else [])
        rows.append((i, " ".join(words), int(strong if group else weak)))
    share = [sum(y for _, t, y in rows if ("martians" in t) == g) / sum(("martians" in t) == g for _, t, _ in rows) for g in (True, False)]
    assert abs(share[0] - share[1]) < 0.06
    odd = spark.createDataFrame([(1, "plain vermin"), (2, "plain martians"), (3, "vermin martians"), (4, "plain scum"), (5, "scum martians")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.predict(odd, machine(spark, rows)).collect()}
    print(got)
    assert got[3] > 0.7 and max(got[1], got[2]) < 0.3 and got[4] > got[5] + 0.3


def test_edges(spark):
    schema = "doc_id long, text string, score string"
    odd = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (None, "word " * 40_000, None)], schema)
    assert {r.score for r in toxicity.predict(odd, None).collect()} == {0.0}
    assert machine(spark, [(1, "a", 0), (2, "b", 0)]) is None
    assert toxicity.predict(odd.limit(0), None).columns == ["doc_id", "text", "score"]
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted(toxicity.sample_ids(labels).collect()) == [(1, 1), (2, 0)]
