from convqa.functions import text as tx
from convqa.operators import evaluation as ev


def test_only_a_whole_text_is_json(spark):
    texts = {'{"a": 1}': True, ' [1, 2]\n': True, "12": True, '"x"': True, "12 apples": False, '{"a": 1} and more': False, "1, 2": False, "1], [2": False, '1}, {"v": 2': False, "": False, "{": False, None: None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.is_json("t").alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in got} == texts


def test_a_reply_that_begins_with_a_number_is_searched(spark):
    """The parser takes the number alone for the whole reply, and the object behind it was lost."""
    texts = ['4703443633947811 is the card {"a": "1"} and more', '[1] {"a": "2"}', '"so" {"a": "3"}', '7 sorry', '8 {"a": ']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, reply string")
    got = [(r["parsed"]["a"] if r["parsed"] else None, r["parse_error"]) for r in ev.parse_replies(df).orderBy("n").collect()]
    assert got == [("1", None), ("2", None), ("3", None), (None, "no JSON object"), (None, "unbalanced JSON")]
