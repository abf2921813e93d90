import pytest
from pyspark.sql import functions as F

from convqa.operators import ordered as o

SCANS = {
    "next": lambda df: o.next_seen(df, ["k"], ["n"], F.col("v"), "hit", o.blocks_of("n", 1000)),
    "behind": lambda df: o.next_seen(df, ["k"], ["n"], F.col("v"), "hit", o.blocks_of("n", 1000), inclusive=False),
    "both": lambda df: o.nearest_both(df, ["k"], ["n"], F.col("v"), "before", "hit", o.blocks_of("n", 1000)),
    "following": lambda df: o.following(df, ["k"], ["n"], ["v"], o.blocks_of("n", 1000)).withColumnRenamed("next_v", "hit"),
}


@pytest.mark.parametrize("name", SCANS)
def test_a_look_ahead_does_not_read_the_rest_of_a_block_for_every_row(spark, name):
    """Frames to the end are read anew for every row; the same values come from frames that grow from the end on."""
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("n"), F.when(F.col("id") % 700 == 3, F.col("id")).alias("v"))
    out = SCANS[name](df)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    hits = [n for n in range(5000) if n % 700 == 3]
    after = {"next": lambda n: min((h for h in hits if h >= n), default=None), "behind": lambda n: min((h for h in hits if h > n), default=None)}
    want = after.get({"both": "next"}.get(name, name), lambda n: n + 1 if n + 1 in hits else None)
    assert {r["n"]: r["hit"] for r in out.collect()} == {n: want(n) for n in range(5000)}
