from convqa.operators import transcripts


def test_tokens_are_shuffled_once(spark):
    """They were moved by speaker and side, then twice as many rows by scope, which one task held in memory."""
    turns = spark.createDataFrame([(1, 0, "agent", "a b"), (1, 1, None, "c")], "conv_id int, ord int, speaker string, text string")
    compared = transcripts.compare(turns, turns)
    assert [tuple(r) for r in compared.collect()] == [(1, 2, 2, 1.0, 1.0, 1.0, "PASS")]
    plan = compared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1
