from convqa.operators import flows
from convqa.plans import knowledge  # noqa: F401
from convqa.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_a_full_answer_is_one_text(spark):
    rows = [("d", 2, None, "b"), ("d", 10, None, "c"), ("d", 1, "q", "a"), ("d", 3, None, None), ("i", 1, "p", "x")]
    got = flows.whole_answers(spark.createDataFrame(rows, "id string, part bigint, question string, expected_answer string"), ["id"]).collect()
    assert sorted(map(tuple, got)) == [("d", "q", "a b  c"), ("i", "p", "x")]


def test_flow_queries_have_a_row_per_question(spark):
    """They handed on the parts of a full answer and never joined them."""
    flat = QUERIES["h6_flatten_flows"](spark, SF)
    assert flat.count() == flat.select("id").distinct().count() and "part" not in flat.columns
    turns = QUERIES["f11_compose_flows"](spark, SF)
    assert turns.count() == turns.select("session_id", "turn").distinct().count() and "part" not in turns.columns
