import random

from convqa.operators import matching


def test_contents_are_named_by_short_ids(spark, monkeypatch):
    """Long signatures in every row of every shuffle took most of the disk."""
    seen, whole = [], matching.similar_contents

    def noted(left, right, *rest):
        seen.extend(dict(df.dtypes)["sig"] for df in (left, right))
        return whole(left, right, *rest)

    monkeypatch.setattr(matching, "similar_contents", noted)
    turns = spark.createDataFrame([(c, n, s, t) for c in range(6) for n, (s, t) in enumerate((("agent", "hello"), ("customer", f"same words {c // 3}")))], "conv_id bigint, ord bigint, speaker string, text string")
    calls = spark.createDataFrame([(c, c % 2, 1000 * c) for c in range(6)], "call_id bigint, agent_id int, started_ms bigint")
    convs = spark.createDataFrame([(c, c % 2, 1000 * c + 500) for c in range(6)], "conv_id bigint, agent_id int, created_ms bigint")
    got = {r["call_id"]: (r["conv_id"], r["sim"]) for r in matching.match_by_content(calls, turns, convs, turns).collect()}
    assert got == {c: (c, 1.0) for c in range(6)}
    assert seen == ["bigint", "bigint"]


def test_large_contents_are_cut_in_the_order_of_their_tokens(spark):
    rnd = random.Random(3)
    bags = [{f"w{rnd.randrange(60)}": rnd.randint(1, 9_000) for _ in range(40)} for _ in range(12)]
    other = [{t: max(1, n + rnd.randint(-3_000, 3_000)) for t, n in b.items() if rnd.random() < 0.9} for b in bags]
    frame = lambda bs: spark.createDataFrame([(1, i, sum(b.values()), t, n) for i, b in enumerate(bs) for t, n in b.items()], "agent_id int, sig bigint, size bigint, token string, n bigint")
    dice = {(i, j): 2 * sum(min(n, b.get(t, 0)) for t, n in a.items()) / (sum(a.values()) + sum(b.values())) for i, a in enumerate(bags) for j, b in enumerate(other)}
    got = {(r["sig"], r["other"]): round(r["sim"], 9) for r in matching.similar_contents(frame(bags), frame(other), 0.6).collect()}
    assert got == {k: round(v, 9) for k, v in dice.items() if v >= 0.6} and got
