"""Session helpers: a tuned local builder and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; on a cluster they belong in spark-defaults or --conf.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "convqa") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one that the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine gets a fresh local folder when the setting is missing; elsewhere that would leave stages on
    disks that other executors cannot read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="convqa-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffles are deleted when the job that made them has ended, else when the driver next collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "stage", tidy: bool = False) -> DataFrame:
    """Cut lineage through a written table, so a lost executor costs a re-read and not a re-run.

    ``tidy``: the disk that the shuffles of this job took is free as soon as the table is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, str(tidy or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch = path
    return made


def discard(spark: SparkSession, *made: DataFrame | str) -> None:
    """Delete written stages (tables of :func:`materialize`, or paths) that nothing reads any more; other tables are left alone."""
    for one in made:
        path = one if isinstance(one, str) else getattr(one, "scratch", None) if "scratch" in vars(one) else None
        if path and path.startswith(shared_dir(spark)):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
