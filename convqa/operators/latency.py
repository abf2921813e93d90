"""Reply timing per turn and per call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convqa.config import CallConfig
from convqa.functions import text as tx
from convqa.operators import ordered as o


def verdict(checks: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Slowest and mean reply per session, its slow replies and their number, and whether the hard limit was passed.

    Only clips with a reply and a finite latency count. ``checks``: ``session_id, clip, responded, latency_ms``. ``slow`` holds
    the slow replies as ``clip, latency_ms`` by clip; :func:`slow_replies` has them a row each.
    """
    lat = F.when(F.col("responded"), tx.finite("latency_ms"))
    slow = lat > config.reply_latency_warn_ms
    out = checks.groupBy("session_id").agg(
        F.max(lat).cast("bigint").alias("max_ms"), tx.round_half_up(F.avg(lat)).alias("avg_ms"),
        F.count_if(F.coalesce(slow, F.lit(False))).alias("slow_count"),
        F.array_sort(F.collect_list(F.when(slow, F.struct("clip", "latency_ms")))).alias("slow"),
    )
    exceeded = F.coalesce(F.col("max_ms") > config.reply_latency_max_ms, F.lit(False)) if config.reply_latency_max_ms > 0 else F.lit(False)
    return out.withColumn("warn", F.col("slow_count") > 0).withColumn("exceeded_max", exceeded)


def slow_replies(checks: DataFrame, threshold_ms: int = CallConfig.reply_latency_warn_ms) -> DataFrame:
    """Replies above the threshold, one row each."""
    return checks.where(F.col("responded") & (tx.finite("latency_ms") > threshold_ms))


def first_audio(checks: DataFrame, frames: DataFrame, block_width: int = 3_600_000) -> DataFrame:
    """Time from the end of a clip to the first audio frame at or after it.

    Clip end = reply time minus latency; null without latency or without a later frame.
    ``checks``: ``session_id, ord, reply_at, latency_ms``; ``frames``: ``session_id, at`` (milliseconds).
    """
    ends = checks.withColumn("clip_end", F.col("reply_at") - F.col("latency_ms"))
    timed = ends.where(F.col("clip_end").isNotNull())
    hit = o.asof(timed, frames, ["session_id"], "clip_end", "at", [], block_width, forward=True, tie=["at"])
    measured = hit.withColumn("first_audio_ms", tx.round_half_up(F.col("asof_at") - F.col("clip_end"))).drop("asof_at")
    untimed = ends.where(F.col("clip_end").isNull()).withColumn("first_audio_ms", F.lit(None).cast("bigint"))
    return measured.unionByName(untimed).drop("clip_end")


def backend(turns: DataFrame, checks: DataFrame) -> DataFrame:
    """Reply latency from stored timings: length of the i-th customer turn minus the length of the i-th clip.

    Opening greetings, unanswered clips and negative results are left out.
    ``turns``: ``session_id, ord, speaker, start_s, end_s``; ``checks``: ``session_id, ord, responded, response_signal, clip_ms``.
    """
    customers = turns.where(tx.canonical_speaker("speaker") == "customer")
    spoken = o.ordinal(customers, ["session_id"], ["ord"], "pos", o.blocks_of("ord")).drop("ord", "speaker")
    played = o.ordinal(checks, ["session_id"], ["ord"], "pos", o.blocks_of("ord")).drop("ord")
    usable = F.col("responded") & ~F.coalesce(F.col("response_signal") == "opening-greeting", F.lit(False))
    value = tx.round_half_up((F.col("end_s") - F.col("start_s")) * 1000 - F.col("clip_ms"))
    return (
        spoken.join(played, ["session_id", "pos"]).where(usable)
        .select("session_id", "pos", value.alias("latency_ms")).where(F.col("latency_ms") >= 0)
    )
