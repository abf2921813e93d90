"""Queries over audio frames. The frame table is derived from the conversations by a fixed formula:
each turn voices its side's channel, and neighbouring turns run into each other."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from convqa.config import AudioConfig
from convqa.operators import audio
from convqa.plans import inputs as i
from convqa.plans.registry import query
from convqa.session import materialize, scratch_path
from convqa.sources import writers

FRAME_S = 0.02
PER_TURN = 200
CFG = AudioConfig(interruption_seconds=0.5)


def _spread(rows, *keys):
    """Rows over all cores with a fixed number of parts: joined by their size, small rows that become large ones are a task or two."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def frame_table(spark, d):
    """200 frames per turn and channel; loud while the turn's own side speaks, and sometimes the other side cuts in."""
    # a small file is one partition; spread the turns before each becomes 400 frames
    t = _spread(i.turns(spark, d).where(F.col("speaker").isin("agent", "customer")).select("conv_id", "ord", "speaker"), "conv_id", "ord")
    own = F.when(F.col("speaker") == "customer", 0).otherwise(1)
    f = t.select("conv_id", "ord", own.alias("own"), F.explode(F.array(F.lit(0), F.lit(1))).alias("channel")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(PER_TURN - 1))).alias("f"))
    noise = (F.col("conv_id") * 31 + F.col("ord") * 17 + F.col("f") * 7 + F.col("channel") * 5) % 23
    start, length = (F.col("conv_id") + F.col("ord") * 3) % 40, (F.col("conv_id") * 7 + F.col("ord") * 11) % 150
    talks = ((F.col("channel") == F.col("own")) & (F.col("f") >= 20) & (F.col("f") < 185)) | (
        (F.col("channel") != F.col("own")) & (F.col("f") >= 150 - length) & (F.col("f") < 160 - start)) 
    pause = F.pmod(F.col("f") * 13 + F.col("conv_id"), F.lit(37)) < 3
    db = F.when(talks & ~pause, -20 - noise / 10).otherwise(-60 - noise / 2)
    return f.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("call"), F.col("channel"), (F.col("ord") * PER_TURN + F.col("f")).alias("frame"), db.alias("db"),
                    ((F.col("f") + F.col("conv_id") + F.col("ord") * 2) % 10 < F.when((F.col("conv_id") + F.col("ord")) % 4 == 0, 2).otherwise(6)).alias("voiced"))


FT = f"""{i.TURNS}, ft AS (SELECT 'c' || conv_id AS call, channel, ord * 200 + f AS frame,
  CASE WHEN ((channel = own AND f >= 20 AND f < 185) OR (channel <> own AND f >= 150 - (conv_id * 7 + ord * 11) % 150 AND f < 160 - (conv_id + ord * 3) % 40)) AND NOT ((f * 13 + conv_id) % 37 < 3)
    THEN -20.0::DOUBLE - ((conv_id * 31 + ord * 17 + f * 7 + channel * 5) % 23) / 10.0::DOUBLE ELSE -60.0::DOUBLE - ((conv_id * 31 + ord * 17 + f * 7 + channel * 5) % 23) / 2.0::DOUBLE END AS db,
  (f + conv_id + ord * 2) % 10 < CASE WHEN (conv_id + ord) % 4 = 0 THEN 2 ELSE 6 END AS voiced
  FROM (SELECT conv_id, ord, CASE WHEN speaker = 'customer' THEN 0 ELSE 1 END AS own FROM turns WHERE speaker IN ('agent', 'customer')) t, (SELECT unnest([0, 1]) AS channel) ch, (SELECT unnest(range(200)) AS f) fr)"""
SPEECH = f"""{FT}, nz AS (SELECT call, channel, quantile_cont(db, 0.2) AS noise FROM ft GROUP BY 1, 2), ld AS (SELECT ft.*, db > greatest(noise + 8.0, -42.0) AS loud FROM ft JOIN nz USING (call, channel)),
nb AS (SELECT *, max(CASE WHEN loud THEN frame END) OVER (PARTITION BY call, channel ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bf, min(CASE WHEN loud THEN frame END) OVER (PARTITION BY call, channel ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS af FROM ld),
sp AS (SELECT call, channel, frame, voiced FROM nb WHERE loud OR af - bf - 1 <= 7), isl AS (SELECT *, frame - row_number() OVER (PARTITION BY call, channel ORDER BY frame) AS g FROM sp),
runs AS (SELECT call, channel, min(frame) AS s, max(frame) + 1 AS e, avg(CASE WHEN voiced THEN 1.0 ELSE 0.0 END) AS share FROM isl GROUP BY call, channel, g HAVING count(*) >= 5)"""
OVER = f"""{SPEECH}, pick AS (SELECT *, 'energy' AS net FROM runs UNION ALL SELECT *, 'voiced' FROM runs WHERE share >= 0.35),
ov AS (SELECT h.call, h.net, greatest(h.s, a.s) AS s, least(h.e, a.e) AS e FROM pick h JOIN pick a ON a.call = h.call AND a.net = h.net AND h.channel = 0 AND a.channel = 1 AND h.s < a.e AND a.s < h.e),
br AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY call, net ORDER BY s) <= 6 THEN 0 ELSE 1 END AS b FROM ov), sg AS (SELECT *, CAST(sum(b) OVER (PARTITION BY call, net ORDER BY s) AS BIGINT) AS segment FROM br),
seg AS (SELECT call, net, segment, min(s) AS s, max(e) AS e FROM sg GROUP BY 1, 2, 3),
stt AS (SELECT call, net, max(e - s) AS longest, arg_min(s, -(e - s) * 1000000 + s) AS start_f, CAST(sum(e - s) AS BIGINT) AS total, count(*) AS n FROM seg GROUP BY 1, 2)"""


@query("m3_noise_threshold", f"WITH {FT} SELECT call, channel, round(quantile_cont(db, 0.2), 9) AS noise FROM ft GROUP BY 1, 2")
def _(spark, d):
    from convqa.operators.ordered import exact_quantile

    q = exact_quantile(frame_table(spark, d), audio.SPEECH_KEY, "db", 0.2, F.floor(F.col("db") * 10), "noise")
    return q.withColumn("noise", F.round("noise", 9))


@query("m4_hangover", f"WITH {SPEECH} SELECT call, channel, min(frame) AS start, max(frame) + 1 AS \"end\", count(*) FILTER (WHERE voiced) AS voiced_frames FROM isl GROUP BY call, channel, g")
def _(spark, d):
    return audio.bridged_runs(frame_table(spark, d), CFG).select("call", "channel", "start", "end", "voiced_frames")


@query("m5_m6_speech_runs", f"WITH {SPEECH} SELECT call, channel, s AS start, e AS \"end\", share >= 0.35 AS mostly_voiced FROM runs")
def _(spark, d):
    r = audio.speech_runs(frame_table(spark, d), CFG)
    return r.select("call", "channel", "start", "end", (F.col("voiced_share") >= CFG.min_voiced_ratio).alias("mostly_voiced"))


@query("m7_overlap_segments", f"WITH {OVER} SELECT call, net, segment, s AS start, e AS \"end\" FROM seg")
def _(spark, d):
    return audio.overlap_segments(audio.speech_runs(frame_table(spark, d), CFG), CFG)


@query("g6_longest_overlap", f"WITH {OVER} SELECT call, net, longest AS longest_frames, start_f AS start_frame, total AS total_frames, n AS segments FROM stt")
def _(spark, d):
    return audio.overlap_stats(audio.overlap_segments(audio.speech_runs(frame_table(spark, d), CFG), CFG))


CLASSIFIED = f"""{OVER}, cl AS (SELECT call, count(*) AS frames FROM ft WHERE channel = 0 GROUP BY 1),
j AS (SELECT cl.call, frames, v.longest AS vl, v.start_f AS vs, v.total AS vt, v.n AS vn, e.longest AS el, e.start_f AS es, e.total AS et, e.n AS en, coalesce(v.longest >= 25, false) AS high FROM cl LEFT JOIN stt v ON v.call = cl.call AND v.net = 'voiced' LEFT JOIN stt e ON e.call = cl.call AND e.net = 'energy'),
res AS (SELECT call AS file, high OR coalesce(el >= 25, false) AS is_bug, CASE WHEN high THEN 'high' WHEN coalesce(el >= 25, false) THEN 'low' ELSE '' END AS confidence, coalesce(CASE WHEN high THEN vl ELSE el END, 0) AS longest, coalesce(CASE WHEN high THEN vt ELSE et END, 0) AS total,
  coalesce(CASE WHEN high THEN vn ELSE en END, 0) AS n, coalesce(CASE WHEN high THEN vs ELSE es END, 0) AS start_f FROM j)"""


def _results(spark, d):
    ft = frame_table(spark, d)
    stats = audio.overlap_stats(audio.overlap_segments(audio.speech_runs(ft, CFG), CFG))
    calls = ft.where(F.col("channel") == 0).groupBy("call").agg((F.count(F.lit(1)) * FRAME_S).alias("duration_s")).select("call", F.lit(FRAME_S).alias("frame_s"), "duration_s", F.lit(None).cast("string").alias("error"))
    return audio.classify_calls(calls, stats, CFG)


@query("m8_two_nets", f"WITH {CLASSIFIED} SELECT file, is_bug, confidence, round(longest * 0.02::DOUBLE, 2) AS longest_overlap_s, round(total * 0.02::DOUBLE, 2) AS total_overlap_s, n AS overlap_segment_count, round(start_f * 0.02::DOUBLE, 2) AS longest_overlap_start_s FROM res")
def _(spark, d):
    return _results(spark, d).select("file", "is_bug", "confidence", "longest_overlap_s", "total_overlap_s", "overlap_segment_count", "longest_overlap_start_s")


def _phoned(spark, d):
    r = _results(spark, d)
    n = F.substring("file", 2, 20).cast("bigint")
    return r.withColumn("phone_number", F.when(n % 4 != 0, F.concat(F.lit("05"), n.cast("string"))))


RATES = f"""{CLASSIFIED}, ph AS (SELECT *, CAST(substr(file, 2) AS BIGINT) % 4 <> 0 AS phone FROM res),
c AS (SELECT count(*) FILTER (WHERE NOT phone) AS web_excluded, count(*) FILTER (WHERE phone) AS calls, count(*) FILTER (WHERE phone AND confidence = 'high') AS high, count(*) FILTER (WHERE phone AND confidence = 'low') AS low, CAST(0 AS BIGINT) AS errors FROM ph)"""


@query("e16_call_rates", f"WITH {RATES} SELECT *, calls - high - low - errors AS clean, round_even(100.0 * high / calls, 1) AS high_pct, round_even(100.0 * low / calls, 1) AS low_pct, round_even(100.0 * (calls - high - low - errors) / calls, 1) AS clean_pct, round_even(100.0 * (high + low) / calls, 1) AS interruption_pct FROM c")
def _(spark, d):
    return audio.call_rates(_phoned(spark, d))


@query("c5_exclude_web_calls", f"WITH {RATES} SELECT file, confidence FROM ph WHERE phone")
def _(spark, d):
    return audio.exclude_web_calls(_phoned(spark, d)).select("file", "confidence")


EXCH = """tm AS (SELECT *, CASE WHEN speaker = 'customer' AND coalesce(lag(speaker) OVER (PARTITION BY session_id ORDER BY start_s, ord), '') <> 'customer' THEN 1 ELSE 0 END AS tk FROM timed),
nx AS (SELECT *, CAST(sum(tk) OVER (PARTITION BY session_id ORDER BY start_s, ord) AS BIGINT) AS exch FROM tm),
ex AS (SELECT session_id AS conv_id, exch, min(start_s) AS start_s, max(end_s) AS end_s, bool_or(is_interrupted) AS barged FROM nx GROUP BY 1, 2)"""
TIMED = f"timed AS (SELECT conv_id AS session_id, ord, speaker, ord * 4.0 + (length(text) % 8) / 8.0 AS start_s, (ord + 1) * 4.0 + (conv_id % 7) * 0.25 AS end_s, (conv_id + ord) % 3 = 0 AS is_interrupted FROM turns)"


def _timed(spark, d):
    t = i.turns(spark, d)
    return t.select("conv_id", "ord", "speaker", (F.col("ord") * 4.0 + (F.length("text") % 8) / 8.0).alias("start_s"), ((F.col("ord") + 1) * 4.0 + (F.col("conv_id") % 7) * 0.25).alias("end_s"),
                    ((F.col("conv_id") + F.col("ord")) % 3 == 0).alias("is_interrupted"))


@query("f4_timed_exchanges", f"WITH {i.TURNS}, {TIMED}, {EXCH} SELECT conv_id, exch, CAST(start_s AS DOUBLE) AS start_s, CAST(end_s AS DOUBLE) AS end_s, barged FROM ex")
def _(spark, d):
    return audio.exchanges(_timed(spark, d))


@query("c8_timed_turns", f"WITH {i.TURNS} SELECT conv_id, count(*) FILTER (WHERE (conv_id + ord) % 5 <> 0) AS timed_turns, count(*) AS turns FROM turns GROUP BY 1")
def _(spark, d):
    t = _timed(spark, d).withColumn("end_s", F.when((F.col("conv_id") + F.col("ord")) % 5 != 0, F.col("end_s")))
    return t.groupBy("conv_id").agg(F.count_if(F.col("start_s").isNotNull() & F.col("end_s").isNotNull()).alias("timed_turns"), F.count(F.lit(1)).alias("turns"))


def _segments_ms(spark, d):
    seg = audio.overlap_segments(audio.speech_runs(frame_table(spark, d), CFG), CFG)
    return seg.select(F.substring("call", 2, 20).cast("bigint").alias("conv_id"), F.concat_ws("-", "net", "segment").alias("seg"), "net", (F.col("start") * 20).alias("seg_start_ms"), (F.col("end") * 20).alias("seg_end_ms"))


def _exchange_ms(spark, d):
    return audio.exchanges(_timed(spark, d)).withColumn("ex_start_ms", F.floor(F.col("start_s") * 1000)).withColumn("ex_end_ms", F.floor(F.col("end_s") * 1000 - 2500))


ASSIGN = f"""{OVER}, {TIMED}, {EXCH}, sm AS (SELECT CAST(substr(call, 2) AS BIGINT) AS conv_id, net || '-' || segment AS seg, net, s * 20 AS s0, e * 20 AS s1 FROM seg),
xm AS (SELECT conv_id, exch, barged, CAST(floor(start_s * 1000) AS BIGINT) AS x0, CAST(floor(end_s * 1000 - 2500) AS BIGINT) AS x1 FROM ex),
asg AS (SELECT sm.conv_id, seg, net, s0, s1, exch, row_number() OVER (PARTITION BY sm.conv_id, seg ORDER BY CASE WHEN least(s1, x1) > greatest(s0, x0) THEN 0 ELSE 1 END, CASE WHEN least(s1, x1) > greatest(s0, x0) THEN -(least(s1, x1) - greatest(s0, x0)) ELSE abs(x0 + x1 - s0 - s1) END, exch) AS k FROM sm JOIN xm USING (conv_id)),
best AS (SELECT * FROM asg WHERE k = 1)"""


@query("d10_assign_exchange", f"WITH {ASSIGN} SELECT conv_id, seg, exch FROM best")
def _(spark, d):
    return audio.assign_exchange(_segments_ms(spark, d), _exchange_ms(spark, d).select("conv_id", "exch", "ex_start_ms", "ex_end_ms"), 5_000)


def _sustained(spark, d):
    seg = materialize(_segments_ms(spark, d), "segments")
    return seg.where(F.col("seg_end_ms") - F.col("seg_start_ms") >= CFG.interruption_seconds * 1000)


@query("c10_sustained_overlap", f"WITH {OVER} SELECT call, net, segment, e - s AS frames FROM seg WHERE (e - s) * 0.02 >= 0.5")
def _(spark, d):
    seg = audio.overlap_segments(audio.speech_runs(frame_table(spark, d), CFG), CFG)
    return audio.sustained(seg, FRAME_S, CFG).select("call", "net", "segment", (F.col("end") - F.col("start")).alias("frames"))


OUTCOME = f"""{ASSIGN}, wr AS (SELECT conv_id, exch, bool_or(net = 'voiced') AS hi FROM best WHERE s1 - s0 >= 500 GROUP BY 1, 2),
oc AS (SELECT xm.conv_id, xm.exch, CASE WHEN hi THEN 'high' WHEN hi IS NOT NULL THEN 'low' WHEN barged THEN 'handled' ELSE 'clean' END AS status FROM xm LEFT JOIN wr USING (conv_id, exch))"""


def _classified(spark, d):
    ex = materialize(_exchange_ms(spark, d), "exchanges")
    seg = _sustained(spark, d)
    assigned = audio.assign_exchange(seg, ex.select("conv_id", "exch", "ex_start_ms", "ex_end_ms"), 5_000).join(seg.select("conv_id", "seg", "net"), ["conv_id", "seg"])
    return audio.classify_exchanges(ex, assigned)


@query("m9_exchange_outcome", f"WITH {OUTCOME} SELECT conv_id, exch, status FROM oc")
def _(spark, d):
    return _classified(spark, d).select("conv_id", "exch", "status")


@query("e17_exchange_rates", f"""WITH {OUTCOME}, s AS (SELECT count(*) AS exchange_count, count(*) FILTER (WHERE status = 'high') AS failed_high, count(*) FILTER (WHERE status = 'low') AS failed_low, count(*) FILTER (WHERE status = 'handled') AS interruptions_handled FROM oc)
SELECT exchange_count, failed_high, failed_low, interruptions_handled, failed_high + failed_low AS failures, failed_high + failed_low + interruptions_handled AS attempts, round(100.0::DOUBLE * (failed_high + failed_low) / (failed_high + failed_low + interruptions_handled), 6) AS failure_rate,
  failed_high + failed_low > 0 AS gate_any_failure, 100.0 * (failed_high + failed_low) / (failed_high + failed_low + interruptions_handled) > 25 AS gate_rate FROM s""")
def _(spark, d):
    r = audio.exchange_rates(audio.exchange_counts(_classified(spark, d)), 25.0)
    return r.withColumn("failure_rate", F.round("failure_rate", 6))


@query("a20_interruption_csv", f"WITH {CLASSIFIED} SELECT file, confidence, n AS overlap_segment_count FROM res")
def _(spark, d):
    root = scratch_path(spark, "report")
    r = _phoned(spark, d).select("*", *[F.lit(0).alias(c) for c in ("exchange_count", "failed_high", "failed_low", "interruptions_handled")])
    writers.write_interruption_csv(r, root)
    stored = spark.read.option("header", True).csv(root)
    return stored.select("file", F.coalesce("confidence", F.lit("")).alias("confidence"), F.col("overlap_segment_count").cast("bigint").alias("overlap_segment_count"))


RATE = 8000


def recordings(spark, d):
    """A WAV per conversation, voiced by the turns: one tone per side, its length from the text."""
    turns = i.turns(spark, d).where(F.col("speaker").isin("agent", "customer"))
    spans = turns.select("conv_id", "ord", (F.col("speaker") == "customer").alias("human"), (F.length("text") % 40 + 10).alias("n"))
    calls = spans.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("ord", "human", "n"))).alias("spans"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for conv, parts in zip(batch["conv_id"], batch["spans"]):
                total = int(parts[-1]["ord"] + 2) * 60 * 160
                pcm = np.zeros((total, 2))
                for p in parts:
                    first, size = int(p["ord"]) * 60 * 160, (int(p["n"]) + 30) * 160
                    t = np.arange(size) / RATE
                    tone = sum(np.sin(2 * np.pi * h * (130 if p["human"] else 190) * t) / h ** 0.5 for h in range(1, 9))
                    pcm[first:first + size, 0 if p["human"] else 1] += 0.1 * tone
                out = io.BytesIO()
                with wave.open(out, "wb") as w:
                    w.setnchannels(2), w.setsampwidth(2), w.setframerate(RATE)
                    w.writeframes((np.clip(pcm, -1, 1) * 32000).astype("<i2").tobytes())
                yield pd.DataFrame({"call": [f"c{conv}"], "content": [out.getvalue()]})

    return _spread(calls, "conv_id").mapInPandas(render, "call string, content binary")


@query("m1_m2_recording_frames")
def _(spark, d):
    f = audio.frames(recordings(spark, d), CFG)
    return f.groupBy("call", "channel").agg(F.count("frame").alias("frames"), F.count_if("voiced").alias("voiced"), F.round(F.max("db"), 1).alias("loudest_db"))


LEVELS = f"""{i.TURNS}, sp AS (SELECT conv_id, ord, speaker = 'customer' AS human, length(text) % 40 + 40 AS n FROM turns WHERE speaker IN ('agent', 'customer')),
smp AS (SELECT human, f, 0.1::DOUBLE * list_sum([sin(2 * pi() * h * (CASE WHEN human THEN 130 ELSE 190 END) * ((f * 160 + s) / 8000.0::DOUBLE)) / sqrt(h::DOUBLE) FOR h IN [1, 2, 3, 4, 5, 6, 7, 8]]) AS x
  FROM (SELECT unnest([true, false]) AS human), (SELECT unnest(range(80)) AS f), (SELECT unnest(range(160)) AS s)),
lev AS (SELECT human, f, 20 * log10(sqrt(avg(pow(trunc(greatest(-1, least(1, x)) * 32000) / 32768.0::DOUBLE, 2))) + 1e-12) AS db FROM smp GROUP BY 1, 2),
top AS (SELECT conv_id, human, max(db) AS db FROM sp JOIN lev USING (human) WHERE f < n GROUP BY 1, 2),
len AS (SELECT conv_id, (max(ord) + 2) * 60 AS frames FROM sp GROUP BY 1)
SELECT 'c' || len.conv_id AS call, channel, frames, round(coalesce(db, 20 * log10(1e-12::DOUBLE)), 1) AS loudest_db
FROM len CROSS JOIN (SELECT unnest([0, 1]) AS channel) LEFT JOIN top ON top.conv_id = len.conv_id AND top.human = (channel = 0)"""  # channel 0 is the human's


@query("m1_frame_levels", f"WITH {LEVELS}")
def _(spark, d):
    """Number and levels of the frames, which follow from the formula that rendered the recordings."""
    f = audio.frames(recordings(spark, d), CFG)
    return f.groupBy("call", "channel").agg(F.count("frame").alias("frames"), F.round(F.max("db"), 1).alias("loudest_db"))


@query("a10_recording_report")
def _(spark, d):
    # the frame table is read several times; the written copy spares the second pass over the audio
    f = materialize(audio.frames(recordings(spark, d), CFG), "frames")
    calls = f.groupBy("call").agg(F.max("frame_s").alias("frame_s"), F.max("duration_s").alias("duration_s"), F.max("error").alias("error"))
    good = f.where(F.col("error").isNull())
    return audio.classify_calls(calls, audio.overlap_stats(audio.overlap_segments(audio.speech_runs(good, CFG), CFG)), CFG)
