from pyspark.sql import functions as F

from convqa.plans import talkover as t

SF = "/root/testdata/sf0.01"


def test_recordings_and_frames_are_made_on_all_cores(spark):
    """Shuffles joined by size put the small rows, each of which becomes hundreds of frames, into one task."""
    for df in (t.recordings(spark, SF).select("call"), t.frame_table(spark, SF)):
        assert df.groupBy(F.spark_partition_id().alias("p")).count().count() > 8
