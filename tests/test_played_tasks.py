"""Played order of many lines: no task holds more rows than it is dealt, however the partitions' bytes look."""

from pyspark.sql import functions as F

from convqa.operators import capture
from convqa.operators import ordered as o


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    dealt = o.in_tasks
    monkeypatch.setattr(o, "in_tasks", lambda df, rows, *keys: dealt(df, rows, *keys, task_rows=500))
    session = F.when(F.col("id") < 70_000, 0).otherwise(F.col("id") % 5_000 + 1).cast("bigint").alias("session_id")  # session 0 spans two blocks
    lines = spark.range(100_000).select(session, F.col("id").alias("ord"))
    place = F.expr("CASE WHEN session_id = 0 THEN ord + 1 ELSE (ord - 70000) div 5000 + 1 END")
    turns = lines.select("session_id", place.alias("turn"), F.concat(F.lit("b"), place).alias("question_id"))
    clip = F.format_string("%03d_Q%d.wav", F.lit(1), place)
    checks = lines.where("session_id % 2 = 0").select("session_id", "ord", clip.alias("clip"))
    clips = lines.where("session_id % 2 = 1 and session_id % 7 > 0").select("session_id", "ord", clip.alias("clip"))
    got = capture.played_order(turns, checks, clips).withColumn("task", F.spark_partition_id()).cache()
    block = F.when(F.col("session_id") == 0, 0).otherwise(1)
    assert got.where(block == 1).groupBy("task").count().agg(F.max("count")).first()[0] <= 2_000
    assert got.where(block == 0).select("task").distinct().count() == 2
    want = turns.select("session_id", F.col("turn").alias("pos"), F.expr("CASE WHEN session_id % 2 = 0 OR session_id % 7 > 0 THEN concat('Q', turn) ELSE question_id END").alias("question_id"))
    rows = got.select("session_id", "pos", "question_id")
    assert rows.count() == 100_000 and rows.exceptAll(want).isEmpty()
    got.unpersist()
