"""Accuracy on rows that training never saw, and the defined results."""

from convqa.llm import language_id
from convqa.llm.q_models import language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.1 * len(rows)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    base = [(i, ("the and of this with " if i % 2 else "der und die nicht mit ") * 5, "en" if i % 2 else "de", None) for i in range(60)]
    model = language_id.train(spark.createDataFrame(base, schema))
    odd = [(1, None, "en", "s"), (2, "", None, None), (3, "12 34 !?", None, None), (4, "the of this " * 30_000, None, None), (4, "é", None, None), (None, "the of", None, None)]
    out = language_id.predict(spark.createDataFrame(odd, schema), model).collect()
    assert [r.lang_pred for r in out[:4]] == ["und", "und", "und", "en"] and out[5].lang_pred == "en"
    assert out[0].lang == "en" and out[0].score == 0.0 and len(out) == 6
    nothing = spark.createDataFrame([], schema)
    assert language_id.train(nothing) is None
    assert {r.lang_pred for r in language_id.predict(spark.createDataFrame(odd, schema), None).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0
