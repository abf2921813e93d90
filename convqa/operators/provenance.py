"""Which knowledge files stood behind which answer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convqa.config import CallConfig
from convqa.operators import intervals
from convqa.operators import ordered as o

# Canonical source fields, and the event that carries files in a field of its own.
BUCKETS = ("file_ids", "loaded_files", "play_id")
EVENT_KEYS = {"knowledge_files": "files"}
EMPTY = "array<string>"


def empty() -> Column:
    return F.array().cast(EMPTY)


def source_bucket(frame: str, bucket: str, aliases: Mapping[str, Sequence[str]] = {}) -> Column:
    """Value of a canonical source field from a ``MAP<STRING,STRING>`` frame, else of its first present alias."""
    names = [bucket, *aliases.get(bucket, ())]
    return F.coalesce(*[F.col(frame)[n] for n in names])


def source_keys(frame: str, aliases: Mapping[str, Sequence[str]] = {}, events: Mapping[str, str] = EVENT_KEYS) -> Column:
    """Names of the fields that carried source data in a frame."""
    found = []
    for bucket in BUCKETS:
        first = F.lit(None).cast("string")
        for name in reversed([bucket, *aliases.get(bucket, ())]):
            first = F.when(F.col(frame)[name].isNotNull(), F.lit(name)).otherwise(first)
        value = source_bucket(frame, bucket, aliases)
        usable = value.isNotNull() if bucket == "play_id" else F.from_json(value, EMPTY).isNotNull()
        found.append(F.when(usable, first))
    for event, field in events.items():
        carried = (F.col(frame)["event"] == event) & F.from_json(F.col(frame)[field], EMPTY).isNotNull()
        found.append(F.when(carried, F.lit(f"{event}.{field}")))
    return F.array_compact(F.array(*found))


def parse_frames(frames: DataFrame, raw: str = "raw", aliases: Mapping[str, Sequence[str]] = {},
                 events: Mapping[str, str] = EVENT_KEYS) -> DataFrame:
    """JSON frame text to typed source columns; a configured event overrides the inline file ids."""
    parsed = frames.withColumn("__m", F.from_json(raw, "map<string,string>"))
    inline = F.from_json(source_bucket("__m", "file_ids", aliases), EMPTY)
    for event, field in events.items():
        listed = F.from_json(F.col("__m")[field], EMPTY)
        inline = F.when((F.col("__m")["event"] == event) & listed.isNotNull(), listed).otherwise(inline)
    keys = source_keys("__m", aliases, events)
    return parsed.select(
        *[c for c in frames.columns if c != raw], inline.alias("file_ids"),
        F.from_json(source_bucket("__m", "loaded_files", aliases), EMPTY).alias("loaded_files"),
        source_bucket("__m", "play_id", aliases).alias("play_id"), keys.alias("source_keys"),
        (F.size(keys) > 0).alias("saw_source_frame"),
    )


def turn_windows(turns: DataFrame, settle_ms: int, block_rows: int = o.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Window of every turn: from the reply before it (or ``call_start``) to its own reply plus ``settle_ms``."""
    seen = o.previous(turns, ["session_id"], ["turn"], ["reply_at"], o.blocks_of("turn", block_rows))
    return seen.select(
        "session_id", "turn", F.coalesce("prev_reply_at", "call_start").alias("win_start"),
        (F.col("reply_at") + settle_ms).alias("win_end"),
    )


def bucket_frames(frames: DataFrame, turns: DataFrame, settle_ms: int = CallConfig.settle_ms) -> DataFrame:
    """Distinct files per turn from the frames inside its window, and the play id of the last frame.

    Windows overlap on purpose, so a frame can serve two turns. ``frames``: ``session_id, at, seq,
    file_ids, loaded_files, play_id``; ``turns``: ``session_id, turn, call_start, reply_at`` (milliseconds).
    """
    windows = turn_windows(turns, settle_ms)
    hits = intervals.points_in(frames, windows.where(F.col("win_end") >= F.col("win_start")), ["session_id"], "at", "win_start", "win_end")
    play = hits.groupBy("session_id", "turn").agg(F.max_by(F.struct("play_id"), F.struct("at", "seq")).alias("__p"))
    ids = hits.select("session_id", "turn", F.explode(F.concat(
        F.transform(F.coalesce("file_ids", empty()), lambda f: F.struct(F.lit("file").alias("k"), f.alias("f"))),
        F.transform(F.coalesce("loaded_files", empty()), lambda f: F.struct(F.lit("loaded").alias("k"), f.alias("f"))),
    )).alias("x")).select("session_id", "turn", "x.*")
    sets = ids.groupBy("session_id", "turn").agg(
        F.sort_array(F.collect_set(F.when(F.col("k") == "file", F.col("f")))).alias("file_ids"),
        F.sort_array(F.collect_set(F.when(F.col("k") == "loaded", F.col("f")))).alias("loaded_files"),
    )
    return windows.select("session_id", "turn").join(play, ["session_id", "turn"], "left").join(
        sets, ["session_id", "turn"], "left"
    ).select(
        "session_id", "turn", F.coalesce("file_ids", empty()).alias("file_ids"),
        F.coalesce("loaded_files", empty()).alias("loaded_files"), F.col("__p.play_id").alias("play_id"),
    )


def union_ids(a: str, b: str) -> Column:
    return F.array_union(F.coalesce(F.col(a), empty()), F.coalesce(F.col(b), empty()))


def carry_forward(turn_sources: DataFrame, block_rows: int = o.DEFAULT_BLOCK_ROWS, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """A turn takes the files of the latest turn that saw a source frame; an empty set seen is final.

    ``saw`` null (the flag is missing) counts as seen.
    """
    baseline = F.when(F.coalesce("saw", F.lit(True)), F.coalesce("files", empty()))
    scanned = o.last_seen(turn_sources, list(keys), ["turn"], baseline, "source_file_ids", o.blocks_of("turn", block_rows))
    return scanned.withColumn("source_file_ids", F.coalesce("source_file_ids", empty()))


def sources_used(turn_sources: DataFrame, files: str = "files") -> DataFrame:
    """Sorted distinct files of a whole session."""
    each = turn_sources.select("session_id", F.explode(files).alias("f")).distinct()
    return each.groupBy("session_id").agg(F.sort_array(F.collect_set("f")).alias("source_files_used"))
