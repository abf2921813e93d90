from convqa.operators import latency


def test_a_verdict_names_its_slow_replies(spark):
    rows = [(1, "b", True, 7000.0), (1, "a", True, 9000.0), (1, "c", True, 5.0), (1, "d", False, 8000.0), (1, "e", True, float("nan")), (2, "a", True, 1.0)]
    v = latency.verdict(spark.createDataFrame(rows, "session_id int, clip string, responded boolean, latency_ms double"))
    got = {r["session_id"]: ([tuple(s) for s in r["slow"]], r["slow_count"], r["warn"]) for r in v.collect()}
    assert got == {1: ([("a", 9000.0), ("b", 7000.0)], 2, True), 2: ([], 0, False)}
