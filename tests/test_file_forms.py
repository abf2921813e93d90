import json

import pytest
from pyspark.sql import functions as F

from convqa.plans import files
from convqa.session import scratch_path

SMALL = {"spark.sql.autoBroadcastJoinThreshold": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16"}


def test_an_array_is_one_file_when_its_rows_were_joined_by_file(spark):
    """The rows are too many to be broadcast by their estimate and few enough when counted, so the join is planned anew."""
    rows = spark.range(100_000).select("id", F.to_json(F.struct("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))).alias("value"))
    path = scratch_path(spark, "joined-rows")
    rows.repartition(6).write.parquet(path)
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        named = spark.read.parquet(path).withColumn("f", F.concat(F.lit("kb/"), F.coalesce((F.col("id") % 9).cast("string"), F.lit("none"))))
        root = files.named_files(files.as_array(named, "f", "id"), scratch_path(spark, "arrays"), ".json")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    assert sorted(r["id"] for one in read.collect() for r in json.loads(one["value"])) == list(range(100_000))


def test_a_piece_that_cannot_be_placed_is_no_silent_loss(spark):
    lines = spark.createDataFrame([("a", 1, "x")], "file string, at int, value string")
    root = files.named_files(lines, scratch_path(spark, "named"), ".json")
    with pytest.raises(OSError, match="several pieces"):
        files.named_files(lines, root, ".json")


def test_small_files_are_not_written_by_partition_folders(spark):
    """A folder a file and its move took tens of milliseconds each; rows of a file stay in order, and names may hold any folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x")).getParent()
    parts = lambda: {n for n in (s.getPath().getName() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)) if n.startswith("parts-")}
    before = parts() if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else set()
    lines = spark.range(3000).select(F.concat(F.lit("S%/"), F.col("id") % 1000, F.lit(" é")).alias("file"), F.col("id").alias("at"), F.col("id").cast("string").alias("value"))
    root = files.named_files(lines, scratch_path(spark, "small"), ".txt")
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select("value", F.regexp_extract("_metadata.file_path", "([^/]*)$", 1).alias("name"))
    assert {(r["name"], r["value"]) for r in read.collect()} == {(f"{n}%20é.txt", f"{n}\n{n + 1000}\n{n + 2000}\n") for n in range(1000)}
    assert parts() == before
