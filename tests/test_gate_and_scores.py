import json

import pytest
from pyspark.sql import functions as F

from convqa.functions import deflection
from convqa.operators import evaluation as ev

LONG = "The branch needs your identity card, the registration card and a valid insurance paper for that."
CASES = [
    ("en", "Let me connect you to an agent.", True), ("en", LONG + " Shall I connect you with an agent?", False), ("en", LONG, False), ("en", "", False),
    ("en", "I'm sorry, but I don't have specific information regarding fees. " + LONG, True), ("en", "That's beyond my scope.", True),
    ("en", "I couldn't find a complete list of branches.", True), ("en", "I am UNABLE, yes. I'm unable to answer", True), ("fr", "I'm unable to answer", True),
    ("en", "You may\nreach out to our support team", True), ("en", LONG + " i cannot provide that, and transfer you to a specialist", False),
    ("ar", "ما عندي معلومات عن السعر", True), ("ar", "أوصلك على موظف مختص", True), ("ar", "الجواب الأكيد عند الفرع", True), ("ar", "المعلومات هون ما بتحدد السعر", True),
    ("ar", "للأسف هالشي مش متوفر", True), ("ar", "نسبة التمويل مية بالمية والحد الأدنى للراتب أربعمية دينار شهريا. أوصلك على موظف؟", False), ("ar", "أهلا وسهلا", False), ("ar", "I'm unable to answer", False),
]


def test_deflection_cases(spark):
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(CASES)], "n int, language string, text string, want boolean")
    got = df.select("n", "text", "want", deflection.is_deflection("text", "language").alias("got"), deflection.fired_pattern("text", "language").alias("p")).orderBy("n").collect()
    assert [(r["text"], r["got"]) for r in got] == [(r["text"], r["want"]) for r in got]
    assert all((r["p"] is not None) == r["got"] for r in got)


def test_scoring_respects_gate_and_resume(spark, tmp_path):
    rows = [("s1", 1, "ar", "q", "ما عندي معلومات", ["x"]), ("s1", 2, "en", "what is the rate", "the rate is five", ["the rate is five percent"]), ("s2", 1, "en", "q", None, ["x"])]
    df = spark.createDataFrame(rows, "session_id string, turn bigint, language string, question string, answer string, source_chunks array<string>").withColumn("expected_answer", F.lit("the rate is five"))
    out = {(r["session_id"], r["turn"]): r for r in ev.score(df, ev.overlap_judge()).collect()}
    assert out["s1", 1]["error"] == ev.DEFLECTED and out["s2", 1]["error"] == ev.UNANSWERED and out["s1", 1]["calls"] == 0
    assert [m["pass"] for m in out["s1", 2]["metrics"]] == [True, True]
    done = df.where("turn = 2")
    assert ev.pending(df, done).count() == 2


def test_score_stream_scores_once(spark, tmp_path):
    from convqa.streaming.scoring import score_stream

    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "session_id string, turn bigint, language string, question string, answer string, expected_answer string, source_chunks array<string>"
    def add(n):
        spark.createDataFrame([(f"s{n}", t, "en", "the rate", "the rate is five", "five", ["the rate is five"]) for t in (1, 2)], schema).write.mode("append").json(src)
    for n in (1, 1, 2):  # s1 arrives twice
        add(n)
        score_stream(spark.readStream.schema(schema).json(src), ev.overlap_judge(), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_parse_replies(spark):
    texts = ['{"a": "1"}', 'Sure: {"a": "x } {"} done', "none", '{"a": ', "", '```json\n{"a":"2"}\n```', 'say \\" {"a": "q\\"}"} end']
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, reply string")
    got = [(r["parsed"]["a"] if r["parsed"] else None, r["parse_error"]) for r in ev.parse_replies(df).orderBy("n").collect()]
    assert got == [("1", None), ("x } {", None), (None, "no JSON object"), (None, "unbalanced JSON"), (None, "empty completion"), ("2", None), ('q"}', None)]


def test_controls_and_bakeoff(spark):
    res = spark.createDataFrame([("cities", 1.0, 0.0), ("small talk", 0.0, 1.0), ("numbers", 1.0, 0.0), ("untouched", 1.0, 1.0)], "case_id string, relevancy double, faithfulness double")
    controls = spark.createDataFrame([("cities", "faithfulness"), ("small talk", "relevancy"), ("numbers", "faithfulness"), ("untouched", None)], "case_id string, expected_fail string")
    rows = ev.control_matrix(res, controls).collect()
    assert sum(r["caught"] for r in rows) == 3 and all(r["as_expected"] for r in rows)
    matrix = ev.bakeoff(spark.createDataFrame([("q1", "a", None, 0.75, 1.0), ("q2", "a", "quota", None, None), ("q1", "b", None, 1.0, 1.0)], "question_id string, judge string, error string, relevancy double, faithfulness double"), ["a", "b"])
    assert {r["question_id"]: (r["a"], r["b"]) for r in matrix.collect()} == {"q1": ("0.75 / 1.00", "1.00 / 1.00"), "q2": ("ERR / ERR", "-"), "relevancy avg": ("0.750", "1.000"), "faithfulness avg": ("1.000", "1.000")}


def test_verdict_reason(spark):
    v = spark.createDataFrame([(1, "relevancy", 0, "yes", "", "one"), (1, "relevancy", 1, "no", "off topic", "two"), (1, "relevancy", 2, "idk", "", "three")], "record_id int, metric string, ord int, verdict string, reason string, item string")
    assert ev.verdict_reason(v).first()["reason"] == 'relevancy: 2/3 statements accepted. Rejected: "two" - off topic. (1 ambiguous)'
    r = ev.score_verdicts(v).first()
    assert (r["score"], r["pass"]) == (pytest.approx(2 / 3), True)


def test_thresholds_from_file():
    from convqa.config import AudioConfig, load

    with pytest.warns(UserWarning, match="unknown config key"):
        cfg = load(AudioConfig, json.loads('{"interruption_seconds": 1.5, "note": "x", "voice_band_hz": [100, 200]}'))
    assert cfg.interruption_seconds == 1.5 and cfg.voice_band_hz == (100, 200) and cfg.hangover_frames == 7


def test_replayed_batches_and_other_streams(spark, tmp_path):
    """A batch run again replaces its rows; another stream of the judge scores only what is new; own batches are not read again."""
    from convqa.streaming import scoring

    out = str(tmp_path / "out")
    schema = "session_id string, turn bigint, language string, question string, answer string, expected_answer string, source_chunks array<string>"
    rows = [(f"s{k % 7}", k, "en", "what rate", "the rate is five", "five", ["rate five"]) for k in range(40)] + [(None, 1, "en", "q", None, "a", [])]
    df = spark.createDataFrame(rows, schema)
    part = lambda low, high: df.where(f"coalesce(turn, 0) between {low} and {high}")
    run = lambda batch, n, writer: scoring.write_batch(batch, n, ev.overlap_judge(), out, writer)
    stored = lambda: sorted((r.session_id or "", r.turn) for r in spark.read.parquet(out).collect())
    run(part(0, 19), 0, "w1"), run(part(0, 19), 0, "w1"), run(part(20, 29), 1, "w1")
    assert len(stored()) == 31 and len(set(stored())) == 31
    run(part(10, 39), 0, "w2"), run(part(10, 39), 0, "w2")
    assert len(stored()) == 41 and len(set(stored())) == 41
    seen = scoring.others_done(spark.read.parquet(out), "judge", "w1", list(range(scoring.BUCKETS)), ["session_id", "turn"])
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert seen.count() == 10 and "NOT (writer" in plan.split("PartitionFilters", 1)[1]
