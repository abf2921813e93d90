import os
import random
from collections import Counter

from pyspark.sql import functions as F

from convqa.operators import content_pairs, matching
from convqa.session import materialize


def frame(spark, bags):
    return spark.createDataFrame([(1, i, sum(b.values()), t, n) for i, b in enumerate(bags) for t, n in b.items()], "agent_id int, sig bigint, size bigint, token string, n bigint")


def dice(a, b):
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def nodes(plan):
    yield plan
    kind = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    below = [inner] if inner is not None else [plan.children().apply(k) for k in range(plan.children().size())]
    for one in below:
        yield from nodes(one)


def test_only_contents_are_shuffled(spark):
    """Contents that share common words were joined to candidate pairs, and those were shuffled: rows that grow with the square of the contents."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(48)]
    left, right = ([Counter(rnd.sample(words, 12)) for _ in range(400)] for _ in range(2))
    found = matching.similar_contents(frame(spark, left), frame(spark, right), 0.75)
    got = {(r["sig"], r["other"]): r["sim"] for r in found.collect()}
    assert got == {(i, j): dice(a, b) for i, a in enumerate(left) for j, b in enumerate(right) if dice(a, b) >= 0.75}
    metrics = [p.metrics().get("shuffleRecordsWritten") for p in nodes(found._jdf.queryExecution().executedPlan())]
    assert 0 < sum(m.get().value() for m in metrics if m.isDefined()) < 3 * 2 * 400 * 12


def test_sketches_and_blocks_lose_no_pair(spark):
    """More words than buckets, sizes from one to hundreds, parts and blocks of a few contents: all pairs are found, each once."""
    rnd = random.Random(5)
    vocab = [f"{'é' if k % 7 == 0 else ''}w{k}" for k in range(3 * content_pairs.BUCKETS)]
    left = [Counter({rnd.choice(vocab if rnd.random() < 0.7 else vocab[:9]): rnd.choice((1, 1, 2, 300)) for _ in range(rnd.randint(1, 60))}) for _ in range(70)]
    right = [Counter({t: max(1, n - rnd.randint(0, 1)) for t, n in b.items() if rnd.random() < rnd.choice((0.7, 0.9, 1))} or {"w1": 1}) for b in left * 2]
    want = {(i, j): round(dice(a, b), 12) for i, a in enumerate(left) for j, b in enumerate(right) if dice(a, b) >= 0.75}
    for limit in (600, matching.HELD):
        rows = matching.similar_contents(frame(spark, left), frame(spark, right), 0.75, limit).collect()
        assert {(r["sig"], r["other"]): round(r["sim"], 12) for r in rows} == want and len(rows) == len(want) > 70


def test_parts_of_a_block_give_the_pairs_of_the_whole(spark, monkeypatch):
    rnd = random.Random(6)
    bags = [Counter(rnd.choices([f"w{k}" for k in range(30)], k=rnd.randint(5, 40))) for _ in range(60)]
    rows = content_pairs.squeezed(spark.createDataFrame(
        [(7, side, "a", i, sum(b.values()), " ".join(b), " ".join(map(str, b.values()))) for side in (0, 1) for i, b in enumerate(bags)],
        "group bigint, side int, agent_id string, sig int, size bigint, words string, counts string")).orderBy("side", "size").toArrow()
    def pairs(batch):
        return sorted((r["sig"], r["other"], r["sim"]) for b in content_pairs.similar_pairs(0.6)(iter(rows.to_batches(max_chunksize=batch))) for r in b.to_pylist())
    whole = pairs(1000)
    assert len(whole) > 60 and pairs(7) == whole
    for name, value in (("LEFT_PART", 3), ("RIGHT_PART", 5), ("ROWS_AT_ONCE", 4), ("TOKENS_AT_ONCE", 9)):
        monkeypatch.setattr(content_pairs, name, value)
    assert pairs(1000) == whole


def test_shuffles_of_a_tidy_stage_are_freed(spark):
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    rows = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    before = files()
    assert len(materialize(rows, "tidy", tidy=True).collect()) == 7
    assert not files() - before
    materialize(rows, "kept")
    assert files() - before
