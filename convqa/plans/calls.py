"""Queries over runs, frames, artifacts and stored calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from convqa.config import CallConfig
from convqa.functions import text as tx
from convqa.operators import capture, latency, matching, provenance, quality, reporting, transcripts
from convqa.plans import inputs as i
from convqa.plans.registry import query, table
from convqa.session import materialize, scratch_path
from convqa.streaming import frames as fr

BASE_MS = 1704067200000


# Provenance and latency on the frame log ------------------------------------------------------


def _source_frames(spark, d):
    f = i.frames(spark, d).where(F.col("kind").isin("view", "click"))
    file = F.array(F.concat(F.lit("f"), (F.col("k") % 20).cast("string")))
    none = provenance.empty()
    is_view = F.col("kind") == "view"
    return f.select("session_id", "at", "seq", F.when(is_view, file).otherwise(none).alias("file_ids"), F.when(~is_view, file).otherwise(none).alias("loaded_files"),
                    F.when(F.col("k") % 2 == 0, F.concat(F.lit("p"), "seq")).alias("play_id"))


WINDOWS = f"""{i.FRAMES}, {i.REPLIES}, win AS (SELECT session_id, turn, coalesce(lag(reply_at) OVER (PARTITION BY session_id ORDER BY turn), call_start) AS ws, reply_at + 600000 AS we FROM replies),
hit AS (SELECT w.session_id, w.turn, f.kind, 'f' || (f.k % 20) AS file, CASE WHEN f.k % 2 = 0 THEN 'p' || f.seq END AS play, f.tm, f.seq FROM win w JOIN frames f ON f.session_id = w.session_id AND f.tm BETWEEN w.ws AND w.we WHERE f.kind IN ('view', 'click'))"""


@query("d8_frame_turn_join", f"""WITH {WINDOWS}, s AS (SELECT session_id, turn, list_sort(list(DISTINCT file) FILTER (WHERE kind = 'view')) AS a, list_sort(list(DISTINCT file) FILTER (WHERE kind = 'click')) AS b FROM hit GROUP BY 1, 2),
lst AS (SELECT session_id, turn, play FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn ORDER BY tm DESC, seq DESC) AS k FROM hit) WHERE k = 1)
SELECT w.session_id, w.turn, coalesce(array_to_string(a, ','), '') AS file_ids, coalesce(array_to_string(b, ','), '') AS loaded_files, play AS play_id FROM win w LEFT JOIN s USING (session_id, turn) LEFT JOIN lst USING (session_id, turn)""")
def _(spark, d):
    r = provenance.bucket_frames(_source_frames(spark, d), i.replies(spark, d), settle_ms=600_000)
    return r.select("session_id", "turn", F.array_join("file_ids", ",").alias("file_ids"), F.array_join("loaded_files", ",").alias("loaded_files"), "play_id")


@query("d9_first_audio", f"""WITH {i.FRAMES}, {i.REPLIES}, a AS (SELECT session_id, tm FROM frames WHERE kind = 'view'),
e AS (SELECT *, reply_at - latency_ms AS clip_end FROM replies)
SELECT e.session_id, e.turn AS ord, e.latency_ms, (SELECT min(a.tm) FROM a WHERE a.session_id = e.session_id AND a.tm >= e.clip_end) - e.clip_end AS first_audio_ms FROM e""")
def _(spark, d):
    audio = i.frames(spark, d).where(F.col("kind") == "view").select("session_id", "at")
    checks = i.replies(spark, d).select("session_id", F.col("turn").alias("ord"), "reply_at", "latency_ms")
    return latency.first_audio(checks, audio, 43_200_000).select("session_id", "ord", "latency_ms", "first_audio_ms")


CARRY = f"""{i.FRAMES}, ts AS (SELECT session_id, seq AS turn, kind, CASE WHEN kind = 'view' THEN 'f' || (k % 20) WHEN kind = 'click' AND k % 3 = 0 THEN '' END AS files FROM frames)"""


def _turn_sources(spark, d):
    f = i.frames(spark, d)
    view, empty_set = F.col("kind") == "view", (F.col("kind") == "click") & (F.col("k") % 3 == 0)
    return f.select("session_id", F.col("seq").alias("turn"), F.when(view, F.array(F.concat(F.lit("f"), (F.col("k") % 20).cast("string")))).otherwise(provenance.empty()).alias("files"),
                    F.when(view, F.lit(None).cast("boolean")).otherwise(empty_set).alias("saw"))


@query("f6_source_carry_forward", f"WITH {CARRY} SELECT session_id, turn, coalesce(last_value(files IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn), '') AS source_file_ids FROM ts")
def _(spark, d):
    return provenance.carry_forward(_turn_sources(spark, d), 2_000).select("session_id", "turn", F.array_join("source_file_ids", ",").alias("source_file_ids"))


@query("j6_source_carry_stream", f"WITH {CARRY} SELECT session_id, turn, coalesce(last_value(files IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn), '') AS source_file_ids FROM ts")
def _(spark, d):
    """The same rule as a stream over the stored log."""
    src, out, checkpoint = (scratch_path(spark, n) for n in ("frames", "carried", "carry-state"))
    sources = _turn_sources(spark, d)
    sources.write.parquet(src)
    stream = fr.carry_sources_stream(spark.readStream.schema(sources.schema).parquet(src))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("session_id", "turn", F.array_join("source_file_ids", ",").alias("source_file_ids"))


@query("e18_sources_used", f"WITH {i.FRAMES} SELECT session_id, array_to_string(list_sort(list(DISTINCT 'f' || (k % 20))), ',') AS source_files_used FROM frames WHERE kind = 'view' GROUP BY 1")
def _(spark, d):
    return provenance.sources_used(_turn_sources(spark, d)).withColumn("source_files_used", F.array_join("source_files_used", ","))


@query("h3_union_ids", f"WITH {i.FRAMES} SELECT session_id, seq, CASE WHEN k % 20 = k % 7 THEN 'f' || (k % 20) ELSE 'f' || (k % 20) || ',f' || (k % 7) END AS ids FROM frames")
def _(spark, d):
    f = i.frames(spark, d)
    named = lambda n: F.array(F.concat(F.lit("f"), (F.col("k") % n).cast("string")))
    return f.select("session_id", "seq", named(20).alias("a"), named(7).alias("b")).select("session_id", "seq", F.array_join(provenance.union_ids("a", "b"), ",").alias("ids"))


@query("b24_source_keys", f"""WITH {i.FRAMES} SELECT session_id, seq, CASE k % 4 WHEN 0 THEN 'a' || k WHEN 1 THEN 'b' || k WHEN 2 THEN 'e' || k ELSE '' END AS file_ids,
  CASE k % 4 WHEN 0 THEN 'file_ids' WHEN 1 THEN 'doc_ids' WHEN 2 THEN 'knowledge_files.files' ELSE 'play_id' END AS source_keys, CASE WHEN k % 4 = 3 THEN 'p' || k END AS play_id FROM frames""")
def _(spark, d):
    k = F.col("k").cast("string")
    raw = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"file_ids":["a'), k, F.lit('"],"doc_ids":["z"]}'))).when(F.col("k") % 4 == 1, F.concat(F.lit('{"doc_ids":["b'), k, F.lit('"]}')))
        .when(F.col("k") % 4 == 2, F.concat(F.lit('{"event":"knowledge_files","files":["e'), k, F.lit('"]}'))).otherwise(F.concat(F.lit('{"play_id":"p'), k, F.lit('"}'))))
    parsed = provenance.parse_frames(i.frames(spark, d).select("session_id", "seq", raw.alias("raw")), aliases={"file_ids": ["doc_ids", "source_ids"]})
    return parsed.select("session_id", "seq", F.coalesce(F.array_join("file_ids", ","), F.lit("")).alias("file_ids"), F.array_join("source_keys", ",").alias("source_keys"), "play_id")


VERDICT = """lat AS (SELECT *, CASE WHEN responded THEN latency_ms END AS l FROM checks)"""


@query("e6_latency_verdict", f"""WITH {i.CHECKS}, {VERDICT} SELECT session_id, max(l) AS max_ms, CAST(floor(avg(l) + 0.5) AS BIGINT) AS avg_ms, count(*) FILTER (WHERE l > 6000) AS slow_count,
  coalesce(string_agg(clip || '=' || l, ',' ORDER BY clip, l) FILTER (WHERE l > 6000), '') AS slow, count(*) FILTER (WHERE l > 6000) > 0 AS warn, coalesce(max(l) > 9000, false) AS exceeded_max FROM lat GROUP BY 1""")
def _(spark, d):
    v = latency.verdict(i.checks(spark, d), CallConfig(reply_latency_max_ms=9000))
    return v.withColumn("slow", F.array_join(F.transform("slow", lambda s: F.concat_ws("=", s["clip"], s["latency_ms"].cast("string"))), ","))


@query("c11_slow_replies", f"WITH {i.CHECKS} SELECT session_id, ord, clip, latency_ms FROM checks WHERE responded AND latency_ms > 6000")
def _(spark, d):
    return latency.slow_replies(i.checks(spark, d)).select("session_id", "ord", "clip", "latency_ms")


@query("e4_session_results", f"""WITH {i.CHECKS}, {i.SESSIONS}, p AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE responded) AS replies, max(latency_ms) AS max_ms, CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_ms, arg_min(error, ord) FILTER (WHERE error IS NOT NULL) AS err FROM checks GROUP BY 1),
j AS (SELECT s.*, coalesce(replies, 0) AS replies, coalesce(n, 0) = s.turns AND coalesce(replies, 0) = coalesce(n, 0) AS passed, err, max_ms, avg_ms FROM sessions s LEFT JOIN p USING (session_id))
SELECT session_id, language, turns, run, replies, passed, CASE WHEN passed THEN 'ok' ELSE coalesce(err, 'only ' || replies || '/' || turns || ' turns answered') END AS reason, max_ms, avg_ms FROM j""")
def _(spark, d):
    return reporting.session_results(i.checks(spark, d), i.run_sessions(spark, d))


@query("e4_run_report", f"""WITH {i.CHECKS}, {i.SESSIONS}, p AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE responded) AS replies FROM checks GROUP BY 1),
j AS (SELECT s.run, coalesce(n, 0) = s.turns AND coalesce(replies, 0) = coalesce(n, 0) AS passed FROM sessions s LEFT JOIN p USING (session_id))
SELECT run, count(*) AS sessions, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM j GROUP BY 1""")
def _(spark, d):
    return reporting.run_report(reporting.session_results(i.checks(spark, d), i.run_sessions(spark, d)), ["run"])


@query("e5_transcript_replies", f"""WITH {i.PAIRS}, s AS (SELECT conv_id AS session_id, conv_id % 4 + 1 AS turns, conv_id % 5 = 0 AS gate_passed, CAST(2 AS BIGINT) AS check_replies FROM (SELECT DISTINCT conv_id FROM conversations)),
a AS (SELECT conv_id AS session_id, count(answer) AS answered FROM pairs GROUP BY 1)
SELECT session_id, turns, least(coalesce(answered, check_replies), turns) AS replies, coalesce(answered >= turns, false) OR gate_passed AS passed FROM s LEFT JOIN a USING (session_id)""")
def _(spark, d):
    ids = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    s = ids.select("session_id", (F.col("session_id") % 4 + 1).alias("turns"), (F.col("session_id") % 5 == 0).alias("gate_passed"), F.lit(2).cast("bigint").alias("check_replies"))
    return reporting.transcript_replies(i.pairs(spark, d).withColumnRenamed("conv_id", "session_id"), s)


EVIDENCE = """ev AS (SELECT session_id, session_id % 5 + 1 AS clip_count, count(*) AS checks, count(*) FILTER (WHERE responded) AS responded, coalesce(max(latency_ms) > 9000, false) AS exceeded_max, session_id % 7 <> 0 AS transcript_saved, session_id % 11 <> 0 AS recording_saved FROM checks GROUP BY 1),
gate AS (SELECT *, CASE WHEN NOT (checks = clip_count AND responded = checks) THEN 'silent-clip' WHEN exceeded_max THEN 'reply-too-slow' WHEN NOT transcript_saved THEN 'transcript-not-saved' WHEN NOT recording_saved THEN 'recording-url-missing' ELSE 'ok' END AS reason FROM ev)"""


def _evidence(spark, d):
    return i.checks(spark, d).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if("responded").alias("responded"), F.coalesce(F.max("latency_ms") > 9000, F.lit(False)).alias("exceeded_max"),
    ).select("*", (F.col("session_id") % 5 + 1).alias("clip_count"), (F.col("session_id") % 7 != 0).alias("transcript_saved"), (F.col("session_id") % 11 != 0).alias("recording_saved"))


@query("e7_call_gate", f"WITH {i.CHECKS}, {EVIDENCE} SELECT session_id, reason, reason = 'ok' AS passed FROM gate")
def _(spark, d):
    return reporting.call_gate(_evidence(spark, d)).select("session_id", "reason", "passed")


@query("b37_retryable", f"WITH {i.CHECKS}, {EVIDENCE} SELECT reason, reason <> 'ok' AS retryable, count(*) AS calls FROM gate GROUP BY 1, 2")
def _(spark, d):
    return reporting.call_gate(_evidence(spark, d)).groupBy("reason", "retryable").agg(F.count(F.lit(1)).alias("calls"))


@query("l6_artifact_verdict", f"""WITH {i.TURNS}, p AS (SELECT conv_id, count(*) FILTER (WHERE text <> '') AS n, count(*) FILTER (WHERE text <> '' AND speaker = 'customer') AS c, count(*) FILTER (WHERE text <> '' AND speaker = 'agent') AS g FROM turns GROUP BY 1),
v AS (SELECT conv_id, n >= 2 AND c > 0 AND g > 0 AS t, conv_id % 6 <> 0 AS r, CASE WHEN n < 2 THEN 'persisted transcript has ' || n || '/2 non-empty turn(s)' WHEN c = 0 OR g = 0 THEN 'persisted transcript does not contain both customer and agent turns' END AS tr FROM p)
SELECT conv_id, t AS transcript_saved, r AS recording_saved, CASE WHEN t AND r THEN 'ok' ELSE concat_ws('; ', tr, CASE WHEN NOT r THEN 'persisted conversation has no recording_url' END) END AS reason, t AND r AS saved FROM v""")
def _(spark, d):
    checks = quality.validate_transcripts(i.turns(spark, d))
    rec = checks.select("conv_id", F.when(F.col("conv_id") % 6 != 0, "https://r.test/x.wav").otherwise(" ").alias("recording_url"))
    return quality.validate_artifacts(checks, rec)


TIMED = f"""{i.TURNS}, timed AS (SELECT conv_id AS session_id, ord, speaker, ord * 10.0 + length(text) / 400.0 AS start_s, (ord + 1) * 10.0 + (conv_id % 7) * 0.25 AS end_s, (conv_id + ord) % 3 = 0 AS is_interrupted FROM turns)"""


def timed_turns(spark, d):
    t = i.turns(spark, d)
    return t.select(F.col("conv_id").alias("session_id"), "ord", "speaker", (F.col("ord") * 10.0 + F.length("text") / 400.0).alias("start_s"),
                    ((F.col("ord") + 1) * 10.0 + (F.col("conv_id") % 7) * 0.25).alias("end_s"), ((F.col("conv_id") + F.col("ord")) % 3 == 0).alias("is_interrupted"))


@query("f8_backend_latency", f"""WITH {TIMED}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS pos FROM timed WHERE speaker = 'customer'),
x AS (SELECT session_id, pos, CAST(floor((end_s - start_s) * 1000 - 2000 - pos * 500 + 0.5) AS BIGINT) AS latency_ms FROM c WHERE (session_id + pos) % 5 <> 0 AND pos <> 1)
SELECT * FROM x WHERE latency_ms >= 0""")
def _(spark, d):
    t = timed_turns(spark, d)
    base = transcripts.zip_ordinal(
        t.where(F.col("speaker") == "customer").select("session_id", F.col("ord").alias("a")), t.where(F.col("speaker") == "customer").select("session_id", F.col("ord").alias("b")), ["session_id"], "a", "b")
    checks = base.select(
        "session_id", F.col("pos").alias("ord"), ((F.col("session_id") + F.col("pos")) % 5 != 0).alias("responded"), F.when(F.col("pos") == 1, "opening-greeting").otherwise("message-count").alias("response_signal"),
        (2000 + F.col("pos") * 500).alias("clip_ms"))
    return latency.backend(t, checks)


# Matching -------------------------------------------------------------------------------------

CALLS = f"""{i.FRAMES}, calls AS (SELECT seq AS call_id, session_id % 7 AS agent_id, tm AS started_ms FROM frames WHERE kind = 'signup'),
convs AS (SELECT seq AS conv_id, session_id % 7 AS agent_id, tm AS created_ms FROM frames WHERE kind = 'view' AND session_id % 7 <> 6)"""


def _calls(spark, d):
    f = i.frames(spark, d)
    agent = (F.col("session_id") % 7).alias("agent_id")
    calls = f.where(F.col("kind") == "signup").select(F.col("seq").alias("call_id"), agent, F.col("at").alias("started_ms"))
    convs = f.where((F.col("kind") == "view") & (F.col("session_id") % 7 != 6)).select(F.col("seq").alias("conv_id"), agent, F.col("at").alias("created_ms"))
    return calls, convs


@query("d6_asof_conversation", f"""WITH {CALLS}, x AS (SELECT c.*, (SELECT arg_min(v.conv_id, v.created_ms * 1000000 + v.conv_id) FROM convs v WHERE v.agent_id = c.agent_id AND v.created_ms >= c.started_ms) AS aft,
  (SELECT arg_min(v.conv_id, -v.created_ms * 1000000 + v.conv_id) FROM convs v WHERE v.agent_id = c.agent_id AND v.created_ms <= c.started_ms) AS bef, (SELECT max(v.created_ms) FROM convs v WHERE v.agent_id = c.agent_id AND v.created_ms <= c.started_ms) AS bms FROM calls c)
SELECT call_id, agent_id, started_ms, coalesce(aft, bef) AS conv_id, CASE WHEN aft IS NOT NULL THEN 'after' WHEN bms >= started_ms - 3600000 THEN 'skew' WHEN bef IS NOT NULL THEN 'fallback' ELSE 'none' END AS match FROM x""")
def _(spark, d):
    calls, convs = _calls(spark, d)
    return matching.asof_conversation(calls, convs, 3_600_000)


CONTENT = f"""{i.TURNS}, two AS (SELECT * FROM turns WHERE speaker <> 'system'), st AS (SELECT conv_id, coalesce(min(ord) FILTER (WHERE speaker <> 'agent'), min(ord) + 1) AS s FROM two GROUP BY 1),
body AS (SELECT t.conv_id, t.ord, t.text FROM two t JOIN st USING (conv_id) WHERE t.ord >= st.s),
lt AS (SELECT conv_id, unnest({i.tokens_sql("CASE WHEN conv_id % 7 = 3 THEN '' WHEN conv_id % 3 = 0 AND ord % 2 = 1 THEN split_part(text, '.', 1) ELSE text END")}) AS token FROM body), ct AS (SELECT conv_id, unnest({i.tokens_sql('text')}) AS token FROM body),
lc AS (SELECT conv_id, token, count(*) AS n FROM lt GROUP BY 1, 2), cc AS (SELECT conv_id, token, count(*) AS n FROM ct GROUP BY 1, 2), ls AS (SELECT conv_id, sum(n) AS s FROM lc GROUP BY 1), cs AS (SELECT conv_id, sum(n) AS s FROM cc GROUP BY 1),
pr AS (SELECT l.conv_id AS call_id, c.conv_id, 2.0 * sum(least(l.n, c.n)) / (any_value(ls.s) + any_value(cs.s)) AS sim FROM lc l JOIN cc c USING (token) JOIN ls ON ls.conv_id = l.conv_id JOIN cs ON cs.conv_id = c.conv_id WHERE l.conv_id % 4 = c.conv_id % 4 AND c.conv_id % 11 <> 4 GROUP BY 1, 2),
cd AS (SELECT *, abs((conv_id * 1000 + (conv_id % 5) * 900) - call_id * 1000) AS away FROM pr WHERE sim >= 0.75 AND conv_id * 1000 + (conv_id % 5) * 900 >= call_id * 1000 - 15000),
rk AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY CASE WHEN sim >= 0.95 THEN 0 ELSE 1 END, CASE WHEN sim >= 0.95 THEN away ELSE 0 END, -sim, away, conv_id) AS k FROM cd),
ids AS (SELECT DISTINCT conv_id AS call_id FROM conversations)"""


def _content(spark, d):
    t = i.turns(spark, d).where(F.col("speaker") != "system")
    cut = (F.col("conv_id") % 3 == 0) & (F.col("ord") % 2 == 1)
    live = t.withColumn("text", F.when(F.col("conv_id") % 7 == 3, "").when(cut, F.split_part("text", F.lit("."), F.lit(1))).otherwise(F.col("text")))
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    agent = (F.col("conv_id") % 4).alias("agent_id")
    calls = ids.select(F.col("conv_id").alias("call_id"), agent, (F.col("conv_id") * 1000).alias("started_ms"))
    convs = ids.select("conv_id", agent, (F.col("conv_id") * 1000 + (F.col("conv_id") % 5) * 900).alias("created_ms"), (F.col("conv_id") % 11 != 4).alias("saved"))
    return calls, live, convs, t


# Every eleventh conversation is not stored completely; every seventh call has an empty body and goes by time.
@query("d7_match_by_content", f"""WITH {CONTENT}, sv AS (SELECT call_id AS conv_id, call_id * 1000 + (call_id % 5) * 900 AS made FROM ids WHERE call_id % 11 <> 4)
SELECT i.call_id, CASE WHEN i.call_id % 7 = 3 THEN coalesce((SELECT arg_min(conv_id, made * 1000000 + conv_id) FROM sv WHERE conv_id % 4 = i.call_id % 4 AND made >= i.call_id * 1000), (SELECT arg_max(conv_id, made * 1000000 - conv_id) FROM sv WHERE conv_id % 4 = i.call_id % 4 AND made <= i.call_id * 1000)) ELSE rk.conv_id END AS conv_id,
  CAST(round(rk.sim, 9) AS DOUBLE) AS sim FROM ids i LEFT JOIN rk ON rk.call_id = i.call_id WHERE k = 1 OR k IS NULL""")
def _(spark, d):
    m = matching.match_by_content(*_content(spark, d))
    return m.withColumn("sim", F.round("sim", 9))


STAMPS = """res AS (SELECT o_orderkey // 40 AS session_id, strftime(o_orderdate, '%Y-%m-%dT08-00-00') || '-' || (o_orderkey % 900 + 100) || 'Z' AS run_stamp, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || (o_orderkey % 50) ELSE '' END AS conversation_id, o_orderkey AS result_no FROM orders),
art AS (SELECT o_orderkey // 40 AS session_id, 'summary-' || strftime(o_orderdate, '%Y-%m-%dT08-00-00') || '-' || (o_orderkey % 900 + 100) || 'Z.json' AS file, strftime(o_orderdate, '%Y-%m-%dT08-00-00') || '-' || (o_orderkey % 900 + 100) || 'Z' AS stamp, CASE WHEN o_orderkey % 4 = 0 THEN 'c' || (o_orderkey % 50) END AS conversation_id FROM orders WHERE o_custkey % 3 <> 0),
m AS (SELECT r.*, (SELECT max(file) FROM art a WHERE a.session_id = r.session_id AND a.conversation_id = r.conversation_id) AS f1, (SELECT max(file) FROM art a WHERE a.session_id = r.session_id AND starts_with(a.stamp, r.run_stamp)) AS f2, (SELECT max(file) FROM art a WHERE a.session_id = r.session_id) AS f3 FROM res r)"""


def _artifacts(spark, d):
    o = table(spark, d, "orders")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'08-00-00"), F.lit("-"), (F.col("o_orderkey") % 900 + 100).cast("string"), F.lit("Z"))
    conv = F.concat(F.lit("c"), (F.col("o_orderkey") % 50).cast("string"))
    session = F.expr("o_orderkey div 40").alias("session_id")
    results = o.select(session, stamp.alias("run_stamp"), F.when(F.col("o_orderkey") % 3 == 0, conv).otherwise("").alias("conversation_id"), F.col("o_orderkey").alias("result_no"))
    arts = o.where(F.col("o_custkey") % 3 != 0).select(session, F.concat(F.lit("summary-"), stamp, F.lit(".json")).alias("file"), stamp.alias("stamp"), F.when(F.col("o_orderkey") % 4 == 0, conv).alias("conversation_id"))
    return results, arts


@query("d3_match_summaries", f"WITH {STAMPS} SELECT result_no, coalesce(f1, f2, f3) AS file, CASE WHEN f1 IS NOT NULL THEN 'conversation' WHEN f2 IS NOT NULL THEN 'stamp' WHEN f3 IS NOT NULL THEN 'newest' ELSE 'none' END AS match FROM m")
def _(spark, d):
    return matching.match_artifacts(*_artifacts(spark, d), allow_newest=True).select("result_no", "file", "match")


@query("d3_match_responses", f"WITH {STAMPS} SELECT result_no, coalesce(f1, f2) AS file, CASE WHEN f1 IS NOT NULL THEN 'conversation' WHEN f2 IS NOT NULL THEN 'stamp' ELSE 'none' END AS match FROM m")
def _(spark, d):
    return matching.match_artifacts(*_artifacts(spark, d), allow_newest=False).select("result_no", "file", "match")


@query("g9_newest_per_agent", f"WITH {CALLS} SELECT agent_id, arg_max(conv_id, created_ms * 1000000 + conv_id) AS conv_id FROM convs GROUP BY 1")
def _(spark, d):
    return matching.newest_per_agent(_calls(spark, d)[1])


@query("d15_resolve_agents", """WITH n AS (SELECT unnest(['SUPPLIER#000000003', '#00000000', 'nobody', '000007']) AS name)
SELECT name, count(s_suppkey) AS matches, CASE WHEN count(s_suppkey) = 1 THEN min(s_suppkey) END AS agent_id, CASE count(s_suppkey) WHEN 1 THEN 'resolved' WHEN 0 THEN 'none' ELSE 'ambiguous' END AS status FROM n LEFT JOIN supplier ON contains(lower(s_name), lower(name)) GROUP BY name""")
def _(spark, d):
    agents = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    return matching.resolve_agents(["SUPPLIER#000000003", "#00000000", "nobody", "000007"], agents)


@query("b32_agent_by_language", f"WITH {i.SESSIONS} SELECT session_id, CASE WHEN session_id % 10 = 0 THEN 'own' || session_id WHEN language = 'ar' THEN 'A1' ELSE '' END AS agent_id FROM sessions")
def _(spark, d):
    s = i.run_sessions(spark, d).withColumn("own", F.when(F.col("session_id") % 10 == 0, F.concat(F.lit("own"), "session_id")).otherwise(" "))
    return s.select("session_id", tx.agent_id_for("own", "language", {"ar": "A1"}).alias("agent_id"))


# Capture --------------------------------------------------------------------------------------

CAPTURE = f"""{i.CAPTURED},
st AS (SELECT session_id || CASE WHEN r.n = 1 THEN '' ELSE '#' || r.n END AS session_id, session_id AS base_id, turn, language, question_id, question, answer, expected_answer, latency_ms, first_audio_ms, CAST(substr(session_id, 2) AS BIGINT) AS c FROM captured, (SELECT unnest([1, 2]) AS n) r),
src AS (SELECT *, CASE WHEN (c + turn) % 3 = 0 THEN 'f' || (c % 9) || '-' || turn WHEN (c + turn) % 3 = 1 AND turn > 3 THEN '' END AS seen FROM st),
cf AS (SELECT *, coalesce(last_value(seen IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn), '') AS files FROM src),
ct AS (SELECT *, CASE WHEN c % 2 = 0 THEN answer WHEN c % 6 = 3 THEN NULL WHEN turn % 3 <> 0 THEN upper(session_id) ELSE answer END AS got,
  CASE WHEN c % 2 = 0 THEN answer IS NOT NULL OR turn % 5 = 1 WHEN c % 6 = 3 THEN turn % 2 = 0 ELSE turn % 3 <> 0 OR answer IS NOT NULL END AS ok,
  CASE WHEN c % 2 = 0 THEN latency_ms + 7 WHEN c % 6 = 3 THEN turn * 10 ELSE latency_ms END AS waited, CASE WHEN c % 2 = 0 THEN first_audio_ms + 3 ELSE first_audio_ms END AS heard FROM cf)"""


def _capture(spark, d):
    cap = materialize(i.captured(spark, d), "captured")
    c = F.substring("session_id", 2, 20).cast("bigint")
    turns = cap.select("session_id", "turn", "language", "question_id", "question", "expected_answer", F.lit(None).cast("string").alias("agent_id"))
    runs = cap.select("session_id", "conversation_id").distinct()
    results = runs.withColumn("session_id", F.explode(F.array(F.col("session_id"), F.concat("session_id", F.lit("#2"))))).select(
        "session_id", F.lit("a1").alias("agent_id"), F.lit("https://app.test").alias("app_url"), "conversation_id")
    unknown = runs.select(F.concat(F.lit("gone"), "session_id").alias("session_id"), F.lit("a1").alias("agent_id"), F.lit("").alias("app_url"), "conversation_id")
    both = cap.withColumn("c", c).withColumn("session_id", F.explode(F.array(F.col("session_id"), F.concat("session_id", F.lit("#2")))))
    responded = F.col("c") % 2 == 0
    exchanges = both.where(responded).select("session_id", F.col("turn").alias("exch"), F.col("question").alias("caller"), F.coalesce("answer", F.lit("")).alias("reply"))
    greeting = both.where(responded & (F.col("c") % 4 == 0)).select("session_id").distinct().select("session_id", F.lit(0).cast("bigint").alias("exch"), F.lit(None).cast("string").alias("caller"), F.lit("hello").alias("reply"))
    # checks run short: every third turn has no text of its own
    checks = both.select("session_id", F.col("turn").alias("ord"), (F.col("turn") % 3 != 0).alias("responded"), "latency_ms", "first_audio_ms", F.when(F.col("turn") % 3 != 0, F.upper("session_id")).alias("answer_text"))
    aligned = both.select("session_id", F.col("turn").alias("pos"), "answer")
    order = both.select("session_id", F.col("turn").alias("pos"), "question_id")
    sources = both.select("session_id", "turn", F.when((F.col("c") + F.col("turn")) % 3 == 0, F.array(F.concat(F.lit("f"), (F.col("c") % 9).cast("string"), F.lit("-"), "turn"))).otherwise(provenance.empty()).alias("files"),
                          ((F.col("c") + F.col("turn")) % 3 == 0) | (((F.col("c") + F.col("turn")) % 3 == 1) & (F.col("turn") > 3)))
    sources = sources.toDF("session_id", "turn", "files", "saw")
    # the extract's replies: beside the exchanges, and alone where a call has no exchanges
    alone = F.col("c") % 6 == 3
    replies = both.where(responded | alone).select(
        "session_id", F.col("turn").alias("ord"), F.when(responded, F.col("turn") % 5 == 1).otherwise(F.col("turn") % 2 == 0).alias("responded"),
        F.when(responded, F.col("latency_ms") + 7).otherwise(F.col("turn") * 10).alias("latency_ms"), F.when(responded, F.col("first_audio_ms") + 3).alias("first_audio_ms"))
    questions = cap.groupBy(F.col("question_id").alias("id")).agg(F.min("question").alias("question"), F.min("expected_answer").alias("expected_answer")).withColumn("source_chunks", F.array("question"))
    return capture.capture_answers(
        results.unionByName(unknown), turns, questions, checks=checks, exchanges=exchanges.unionByName(greeting), replies=replies, turn_sources=sources, aligned=aligned, order=order)


@query("d2_capture_answers", f"""WITH {CAPTURE}, q AS (SELECT question_id, min(question) AS question, min(expected_answer) AS expected_answer FROM captured GROUP BY 1)
SELECT ct.session_id, language, 'https://app.test/en/agents/a1/conversations/C' || c AS call_url, turn, ct.question_id, q.question, q.expected_answer,
  got AS answer, ok AS answered, files AS source_file_ids, waited AS latency_ms, heard AS first_audio_ms FROM ct JOIN q USING (question_id)""")
def _(spark, d):
    c = _capture(spark, d)
    return c.select("session_id", "language", "call_url", "turn", "question_id", "question", "expected_answer", "answer", "answered", F.array_join("source_file_ids", ",").alias("source_file_ids"), "latency_ms", "first_audio_ms")


@query("e3_capture_totals", f"""WITH {CAPTURE}
SELECT count(*) AS total_turns, count(*) FILTER (WHERE ok) AS answered, count(*) FILTER (WHERE NOT ok) AS unanswered, CAST(floor(avg(waited) + 0.5) AS BIGINT) AS avg_latency_ms, CAST(floor(avg(heard) + 0.5) AS BIGINT) AS avg_first_audio_ms FROM ct""")
def _(spark, d):
    return capture.totals(_capture(spark, d))


@query("b34_answer_precedence", f"""WITH {i.CAPTURED}, r AS (SELECT *, CAST(substr(session_id, 2) AS BIGINT) AS c FROM captured)
SELECT session_id, turn, CASE WHEN c % 3 = 0 THEN CASE WHEN turn % 2 = 0 THEN 'told' END ELSE CASE WHEN turn % 2 = 1 THEN 'checked' ELSE answer END END AS answer,
  CASE WHEN c % 3 = 0 THEN turn % 4 = 1 OR turn % 2 = 0 ELSE (turn % 5 <> 0 AND (turn % 2 = 1 OR answer IS NULL)) OR answer IS NOT NULL END AS answered FROM r""")
def _(spark, d):
    cap = i.captured(spark, d)
    c = F.substring("session_id", 2, 20).cast("bigint")
    rows = cap.select("session_id", "turn", (c % 3 == 0).alias("has_response"), F.when(F.col("turn") % 2 == 0, " told ").alias("reply_text"), (F.col("turn") % 4 == 1).alias("reply_responded"),
                      F.when(F.col("turn") % 2 == 1, "checked").otherwise(" ").alias("check_text"), (F.col("turn") % 5 != 0).alias("check_responded"), F.col("answer").alias("aligned_answer"))
    return capture.choose_answers(rows).select("session_id", "turn", "answer", "answered")


@query("f16_played_order", f"""WITH {i.CHECKS}, b AS (SELECT session_id, ord, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS pos, count(*) OVER (PARTITION BY session_id) AS n, part FROM raw_checks)
SELECT session_id, pos, CASE WHEN session_id % 3 = 0 THEN 'Q' || part WHEN session_id % 3 = 1 THEN 'K' || part ELSE 'built' || pos END AS question_id, CASE WHEN session_id % 3 = 0 THEN 'checks' WHEN session_id % 3 = 1 THEN 'clips' ELSE 'built' END AS order_source FROM b""")
def _(spark, d):
    c = materialize(i.checks(spark, d), "checks")
    built = transcripts.zip_ordinal(c.select("session_id", F.col("ord").alias("a"), "clip"), c.select("session_id", F.col("ord").alias("b")), ["session_id"], "a", "b", rows=c.count())
    turns = built.select("session_id", F.col("pos").alias("turn"), F.concat(F.lit("built"), "pos").alias("question_id"))
    checks = c.where(F.col("session_id") % 3 == 0).select("session_id", "ord", "clip")
    clips = c.where(F.col("session_id") % 3 == 1).select("session_id", "ord", F.regexp_replace("clip", "_Q", "_K").alias("clip"))
    return capture.played_order(turns, checks, clips)


@query("d4_call_view", f"""WITH {i.CAPTURED}, r AS (SELECT *, CAST(substr(session_id, 2) AS BIGINT) AS c FROM captured), run AS (SELECT DISTINCT session_id, c % 2 = 0 AS passed FROM r),
own AS (SELECT session_id, turn, question_id, question, answer, latency_ms, 'capture' AS origin, CASE WHEN (c + turn) % 3 = 0 THEN (turn % 10) / 10.0 END AS relevancy FROM r WHERE c % 5 <> 0),
fb AS (SELECT session_id, turn, 'X' || turn AS question_id, question, answer, latency_ms, 'transcript' AS origin, NULL AS relevancy FROM r WHERE c % 5 = 0)
SELECT run.session_id, passed, turn, question_id, question, answer, latency_ms, origin, CAST(relevancy AS DOUBLE) AS relevancy FROM run LEFT JOIN (SELECT * FROM own UNION ALL SELECT * FROM fb) USING (session_id)""")
def _(spark, d):
    cap = materialize(i.captured(spark, d), "captured").withColumn("c", F.substring("session_id", 2, 20).cast("bigint"))
    run = cap.select("session_id", (F.col("c") % 2 == 0).alias("passed")).distinct()
    own = cap.where(F.col("c") % 5 != 0).withColumn("responded", F.col("answer").isNotNull())
    scored = own.where((F.col("c") + F.col("turn")) % 3 == 0)
    evals = scored.select("session_id", "turn", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), F.col("turn").alias("t")).select(
        "session_id", "turn", "ord", F.when(F.col("ord") == 2, (F.col("t") % 10) / 10).otherwise(9.0).alias("relevancy"))
    raw = i.sub_turns(spark, d).withColumn("session_id", F.concat(F.lit("S"), F.col("conv_id").cast("string"))).drop("conv_id")
    checks = cap.select("session_id", F.col("turn").alias("ord"), F.format_string("%03d_X%d.wav", "turn", "turn").alias("clip"), "latency_ms")
    sources = cap.select("session_id", "turn", "source_file_ids")
    view = reporting.call_view(run, own, evals, reporting.fallback_turns(checks, raw, sources))
    return view.select("session_id", "passed", "turn", "question_id", "question", "answer", "latency_ms", "origin", "relevancy")


@query("e11_status", f"""WITH {i.SESSIONS}, {i.POOL}, runs AS (SELECT strftime(o_orderdate, '%Y-%m-%d') || o_orderkey AS stamp, o_orderkey AS sessions, o_orderkey % 7 AS passed, o_orderkey % 3 AS failed FROM orders), r AS (SELECT * FROM runs ORDER BY stamp DESC LIMIT 1)
SELECT 'questions' AS what, language AS item, count(*) AS value FROM pool GROUP BY 2 UNION ALL SELECT 'sessions', language, count(*) FROM sessions GROUP BY 2
UNION ALL SELECT 'run', 'sessions', sessions FROM r UNION ALL SELECT 'run', 'passed', passed FROM r UNION ALL SELECT 'run', 'failed', failed FROM r
UNION ALL SELECT 'captured', 'total_turns', sessions FROM r UNION ALL SELECT 'captured', 'answered', passed FROM r UNION ALL SELECT 'captured', 'unanswered', failed FROM r
UNION ALL SELECT 'eval', 'records', sessions FROM r UNION ALL SELECT 'eval', 'errors', passed FROM r UNION ALL SELECT 'eval', 'deflections', failed FROM r""")
def _(spark, d):
    o = table(spark, d, "orders")
    runs = o.select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderkey").alias("stamp"), F.col("o_orderkey").alias("sessions"), (F.col("o_orderkey") % 7).alias("passed"), (F.col("o_orderkey") % 3).alias("failed"))
    return reporting.status(i.pool(spark, d), i.run_sessions(spark, d), runs, runs.toDF("stamp", "total_turns", "answered", "unanswered"), runs.toDF("stamp", "records", "errors", "deflections"))


@query("a4_newest_report", "SELECT o_orderstatus AS status, o_orderkey AS result_no FROM orders ORDER BY strftime(o_orderdate, '%Y-%m-%d') || o_orderkey DESC LIMIT 1")
def _(spark, d):
    from convqa.sources.readers import newest

    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("result_no"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderkey").alias("stamp"))
    return newest(o).select("status", "result_no")


@query("a9_read_conversations", f"WITH {i.TURNS} SELECT conv_id, speaker, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM turns GROUP BY 1, 2")
def _(spark, d):
    from convqa.sources.readers import read_turn_table

    t = read_turn_table(spark, f"{d}/conversations.parquet")
    return t.groupBy("conv_id", "speaker").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


# Scalar functions on ids, stamps and times ----------------------------------------------------

def _events(spark, d):
    return table(spark, d, "events")


@query("b8_slugify", f"""WITH f AS (SELECT event_id, 'Open (v' || user_id || ') ' || event_type || '-acc.ount_' || event_id AS name FROM events UNION ALL SELECT -1 - event_id, '(' || event_type || ')' FROM events)
SELECT event_id, CASE WHEN s = '' THEN 'FLOW' ELSE s END AS slug FROM (SELECT event_id, upper(array_to_string([x FOR x IN string_split_regex({i.strip_sql("regexp_replace(name, '\\([^)]*\\)', '', 'g')")}, '[\\s\\-_.]+') IF x <> ''], '_')) AS s FROM f)""")
def _(spark, d):
    e = _events(spark, d)
    long = e.select("event_id", F.concat(F.lit("Open (v"), "user_id", F.lit(") "), "event_type", F.lit("-acc.ount_"), "event_id").alias("name"))
    both = long.unionByName(e.select((-1 - F.col("event_id")).alias("event_id"), F.concat(F.lit("("), "event_type", F.lit(")")).alias("name")))
    return both.select("event_id", tx.slugify("name").alias("slug"))


@query("b9_safe_file_name", """SELECT event_id, 'a' || event_type || 'b' || user_id || 'c' AS stripped, 'a_' || event_type || '_b_' || user_id || '__c' AS replaced FROM events""")
def _(spark, d):
    name = F.concat(F.lit("a/"), "event_type", F.lit(":b?"), "user_id", F.lit('"|c'))
    return _events(spark, d).select("event_id", tx.safe_file_name(name).alias("stripped"), tx.safe_file_name(name, "_").alias("replaced"))


@query("b10_strip_run_suffix", "SELECT event_id, 'S' || user_id || CASE WHEN event_id % 3 = 1 THEN '#x' ELSE '' END AS base_id FROM events")
def _(spark, d):
    e = _events(spark, d)
    run = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("#"), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, "#x").otherwise("")
    return e.select("event_id", tx.strip_run_suffix(F.concat(F.lit("S"), F.col("user_id").cast("string"), run)).alias("base_id"))


@query("b11_stamp_second", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%S') AS by_dot, strftime(ts, '%Y-%m-%dT%H-%M-%S') AS prefix FROM events")
def _(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss")
    return _events(spark, d).select("event_id", tx.stamp_second(F.concat(stamp, F.lit(".123Z"))).alias("by_dot"), tx.stamp_prefix(F.concat(stamp, F.lit("-123Z"))).alias("prefix"))


@query("b12_source_stamp", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '2026-' || event_id ELSE 'other-' || event_id END AS stamp, 'judge_' || event_type || '-v1.2_' AS judge FROM events")
def _(spark, d):
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("captured-answers-2026-"), "event_id", F.lit(".json"))).otherwise(F.concat(F.lit("other-"), "event_id", F.lit(".json")))
    return _events(spark, d).select("event_id", tx.source_stamp(name).alias("stamp"), tx.judge_slug(F.concat(F.lit("judge/"), "event_type", F.lit("-v1.2 :free!"))).alias("judge"))


@query("b13_question_id_from_clip", f"WITH {i.CHECKS} SELECT session_id, ord, regexp_replace(regexp_replace(clip, '^\\d+_', ''), '\\.wav$', '', 'i') AS loose, regexp_extract(clip, '^\\d+_(.+)\\.wav$', 1) AS strict FROM checks")
def _(spark, d):
    return i.checks(spark, d).select("session_id", "ord", tx.question_id_from_clip("clip").alias("loose"), tx.question_id_from_clip_strict("clip").alias("strict"))


@query("b14_call_url", "SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN '' ELSE 'https://app.test/en/agents/a' || user_id || '/conversations/c' || event_id END AS url FROM events")
def _(spark, d):
    e = _events(spark, d)
    agent = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("a"), "user_id"))
    conv = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("c"), "event_id"))
    return e.select("event_id", tx.call_url(F.lit("https://app.test"), agent, conv).alias("url"))


@query("b15_parse_iso", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN epoch_ms(date_trunc('second', ts)) - 7200000 ELSE epoch_ms(date_trunc('second', ts)) END AS created_ms FROM events""")
def _(spark, d):
    e = _events(spark, d)
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(F.col("event_id") % 4 == 0, F.concat(base, F.lit(".000Z"))).when(F.col("event_id") % 4 == 1, F.concat(base, F.lit("+02:00"))).when(F.col("event_id") % 4 == 2, base).otherwise("yesterday")
    return e.select("event_id", F.unix_millis(tx.parse_iso_utc(iso)).alias("created_ms"))


@query("b16_caller_phone", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '+966' || user_id WHEN 1 THEN '055' || user_id END AS phone, event_id % 3 = 2 AS web_call FROM events")
def _(spark, d):
    e = _events(spark, d)
    ani = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("tel:+966"), "user_id")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("055"), "user_id"))
    phone = tx.caller_phone(ani)
    return e.select("event_id", phone.alias("phone"), phone.isNull().alias("web_call"))


@query("b17_day_set", "SELECT CAST(ts AS DATE) AS day, count(*) AS calls FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY 1")
def _(spark, d):
    from convqa.operators.days import in_days, resolve_days

    days = resolve_days(since="2024-01-05", until="2024-01-12")
    return in_days(_events(spark, d), "ts", days).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"))


@query("b18_fmt_mmss", "SELECT event_id, format('{}:{:02d}', CAST(floor(value) AS BIGINT) // 60, CAST(floor(value) AS BIGINT) % 60) AS mmss FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", tx.fmt_mmss("value").alias("mmss"))


@query("b31_rounding", "SELECT event_id, CAST(floor(event_id / 2.0 - 7.5 + 0.5) AS BIGINT) AS half_up, floor(event_id / 8.0 * 100 + 0.5) / 100 AS two, CAST(round_even(100.0 * (event_id % 8) / 8.0, 0) AS DOUBLE) AS even FROM events")
def _(spark, d):
    e = _events(spark, d)
    return e.select("event_id", tx.round_half_up(F.col("event_id") / 2 - 7.5).alias("half_up"), tx.round2(F.col("event_id") / 8).alias("two"), F.bround(100.0 * (F.col("event_id") % 8) / 8.0, 0).cast("double").alias("even"))


ERR = "CASE event_id % 6 WHEN 0 THEN 'HTTP 429 slow down' WHEN 1 THEN 'Rate_Limit reached' WHEN 2 THEN 'bad JSON at 3' WHEN 3 THEN 'RESOURCE_EXHAUSTED' WHEN 4 THEN 'field missing' ELSE 'timeout' END"


@query("b36_error_class", "SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 3) THEN 'quota' WHEN event_id % 6 = 2 OR event_id % 6 = 4 THEN 'malformed-json' ELSE 'other' END AS class FROM events")
def _(spark, d):
    e = _events(spark, d).withColumn("err", F.expr(ERR)).withColumn("kind", F.when(F.col("event_id") % 6 == 4, "ValidationError").otherwise("RuntimeError"))
    return e.select("event_id", tx.error_class("err", "kind").alias("class"))


@query("c9_created_after_start", f"""WITH {CALLS} SELECT agent_id, count(*) AS convs FROM convs WHERE created_ms >= {BASE_MS + 864_000_000} - 15000 GROUP BY 1""")
def _(spark, d):
    convs = _calls(spark, d)[1]
    return matching.created_after(convs, BASE_MS + 864_000_000).groupBy("agent_id").agg(F.count(F.lit(1)).alias("convs"))


# Frame-log operators, batch form --------------------------------------------------------------

LOG = f"""{i.FRAMES}, lg AS (SELECT *, CAST(sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY tm, seq) AS BIGINT) AS send_no FROM frames)"""


def frame_log(spark, d):
    """Signups are questions sent; the other events are frames behind them, clicks and views carry sentences."""
    from convqa.operators import ordered as o

    f = i.frames(spark, d)
    numbered = o.running_sum(f, ["session_id"], ["at", "seq"], F.when(F.col("kind") == "signup", 1).otherwise(0), "send_no", o.blocks_of("at", 86_400_000))
    says = F.col("kind").isin("click", "view")
    return numbered.select(
        "session_id", "send_no", "at", "seq", "ts", "kind", F.when(says, F.concat(F.lit("w"), (F.col("k") % 13).cast("string"))).alias("sentence"),
        F.when(F.col("kind") == "view", F.array(F.concat(F.lit("f"), "k"))).alias("file_ids"), F.when(F.col("kind") == "click", F.array(F.concat(F.lit("l"), "k"))).alias("loaded_files"),
        F.when(F.col("kind") == "purchase", F.concat(F.lit("p"), "seq")).alias("play_id"),
        F.when(F.col("kind") == "view", F.array(F.lit("file_ids"))).when(F.col("kind") == "click", F.array(F.lit("loaded_files"))).when(F.col("kind") == "purchase", F.array(F.lit("play_id"))).alias("source_keys"),
        F.col("kind").isin("view", "click", "purchase").alias("saw_source_frame"), F.when(F.col("kind") == "error", F.concat(F.lit("srv"), "seq")).alias("server_id"))


def only_frames(log):
    return log.where(F.col("kind") != "signup")


# Clicks and views speak, errors only keep an answer open, purchases only name sources.
KINDS = fr.FrameKinds(("click", "view"), ("click", "view", "error"))
SLOW = CallConfig(settle_ms=7_200_000, confirm_ms=600_000, turn_timeout_ms=86_400_000)


@query("j1_answer_assembly", f"""WITH {LOG}, f AS (SELECT * FROM lg WHERE kind IN ('click', 'view', 'error') AND send_no >= 1), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id, send_no ORDER BY ts, seq) < INTERVAL 7800 SECOND THEN 0 ELSE 1 END AS brk FROM (SELECT f.*, e.ts FROM f JOIN events e ON e.event_id = f.seq)),
w AS (SELECT *, sum(brk) OVER (PARTITION BY session_id, send_no ORDER BY ts, seq) AS grp FROM g)
SELECT session_id, send_no, epoch_us(min(ts) FILTER (WHERE kind IN ('click', 'view'))) // 1000 AS first_frame, epoch_us(max(ts)) // 1000 AS last_frame, coalesce(string_agg('w' || (k % 13), ' ' ORDER BY ts, seq) FILTER (WHERE kind IN ('click', 'view')), '') AS answer, count(*) AS frames FROM w GROUP BY session_id, send_no, grp""")
def _(spark, d):
    a = fr.assemble(only_frames(frame_log(spark, d)), SLOW, KINDS)
    return a.select("session_id", "send_no", tx.epoch_ms("first_frame").alias("first_frame"), tx.epoch_ms("last_frame").alias("last_frame"), "answer", "frames")


# The clock as a recursion over the frames of a question: w waits, c confirms, x is closed; n counts the sentences so far.
CLOCK = f"""{LOG}, sends AS (SELECT session_id, send_no, tm AS sent, lead(tm) OVER (PARTITION BY session_id ORDER BY send_no) AS until FROM lg WHERE kind = 'signup'),
ev AS (SELECT session_id, send_no, tm, seq, kind <> 'error' AS speaks, row_number() OVER (PARTITION BY session_id, send_no ORDER BY tm, seq) AS i FROM lg WHERE kind IN ('click', 'view', 'error') AND send_no >= 1),
steps AS (SELECT session_id, send_no, i, tm, speaks FROM ev UNION ALL
  SELECT session_id, send_no, coalesce(m, 0) + 1, coalesce(until, 9000000000000000), NULL FROM sends LEFT JOIN (SELECT session_id, send_no, max(i) AS m FROM ev GROUP BY 1, 2) USING (session_id, send_no)),
clock(session_id, send_no, i, phase, hard, settle, snap, n, first, how) AS (
  SELECT session_id, send_no, CAST(0 AS BIGINT), 'w', sent + {SLOW.turn_timeout_ms}, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM sends
  UNION ALL
  SELECT session_id, send_no, i, CASE WHEN gone OR ends OR quiet THEN 'x' WHEN p = 'c' THEN 'w' ELSE p END,
    CASE WHEN p = 'c' AND NOT gone AND NOT quiet AND NOT ends THEN tm + {SLOW.turn_timeout_ms} ELSE h END, CASE WHEN gone OR ends THEN settle ELSE tm + {SLOW.settle_ms} END, k,
    CASE WHEN gone OR ends THEN n ELSE n + said END, CASE WHEN gone OR ends THEN first ELSE coalesce(first, CASE WHEN speaks THEN tm END) END,
    CASE WHEN phase = 'x' THEN how WHEN gone THEN CASE WHEN first IS NULL THEN 'timeout' ELSE 'silence' END WHEN ends THEN 'next-send'
      WHEN quiet THEN CASE WHEN first IS NULL AND NOT speaks THEN 'timeout' ELSE 'silence' END END
  FROM (SELECT *, p = 'c' AND NOT gone AND NOT ends AND n + said = k AS quiet FROM (
    SELECT *, phase = 'x' OR (p = 'c' AND h < tm) AS gone, speaks IS NULL AS ends, CASE WHEN speaks THEN 1 ELSE 0 END AS said FROM (
      SELECT c.session_id, c.send_no, e.i, c.phase, c.settle, c.n, c.first, c.how, e.tm, e.speaks, due,
        CASE WHEN c.phase = 'w' AND due < e.tm THEN 'c' ELSE c.phase END AS p, CASE WHEN c.phase = 'w' AND due < e.tm THEN due + {SLOW.confirm_ms} ELSE c.hard END AS h,
        CASE WHEN c.phase = 'w' AND due < e.tm THEN c.n ELSE c.snap END AS k
      FROM (SELECT *, least(hard, coalesce(settle, hard)) AS due FROM clock) c JOIN steps e ON e.session_id = c.session_id AND e.send_no = c.send_no AND e.i = c.i + 1)))),
closed AS (SELECT session_id, send_no, arg_max(n, i) AS n, arg_max(coalesce(first, -1), i) AS first, arg_max(how, i) AS how FROM clock GROUP BY 1, 2),
words AS (SELECT session_id, send_no, 'w' || (k % 13) AS w, row_number() OVER (PARTITION BY session_id, send_no ORDER BY tm, seq) AS r FROM lg WHERE kind IN ('click', 'view') AND send_no >= 1)
SELECT c.session_id, c.send_no, coalesce(string_agg(w, ' ' ORDER BY r), '') AS answer, CASE WHEN any_value(c.first) >= 0 THEN any_value(c.first) - any_value(sent) END AS latency_ms, any_value(how) AS closed_by
FROM closed c JOIN sends s ON s.session_id = c.session_id AND s.send_no = c.send_no LEFT JOIN words w ON w.session_id = c.session_id AND w.send_no = c.send_no AND w.r <= c.n GROUP BY 1, 2"""
CLOCK_SQL = "WITH RECURSIVE " + CLOCK


def _clock_log(spark, d):
    log = frame_log(spark, d)
    return log.withColumn("kind", F.when(F.col("kind") == "signup", "send").otherwise(F.col("kind")))


@query("j2_close_turns", CLOCK_SQL)
def _(spark, d):
    return fr.close_turns_batch(_clock_log(spark, d), SLOW, KINDS)


def _shuffled_files(rows, path, parts=4):
    """Rows as files of neighbouring event times, in no order inside, and one row far ahead that moves the watermark past them."""
    rows.repartitionByRange(parts, "ts").sortWithinPartitions(F.md5(F.col("at").cast("string"))).write.parquet(path)
    ahead = rows.limit(1).withColumn("ts", F.lit("2100-01-01").cast("timestamp")).withColumn("at", F.unix_millis("ts")).withColumn("session_id", F.lit(-1).cast("bigint"))
    ahead.coalesce(1).write.mode("append").parquet(path)


def _streamed(spark, name, rows, stream):
    """Run a streaming operator over the files of ``rows`` and return what it wrote."""
    src, out, checkpoint = (scratch_path(spark, f"{name}-{n}") for n in ("in", "out", "state"))
    _shuffled_files(rows, src)
    # files of a batch may come in any order, so lateness covers the whole log
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(src).withWatermark("ts", "400 days")
    stream(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).where("session_id >= 0")


@query("j3_close_turns_stream", CLOCK_SQL)
def _(spark, d):
    """The clock as a stream over the stored log in shuffled files: timers for silence, confirmation and the limit of a phase."""
    log = _clock_log(spark, d).select("session_id", "send_no", "at", "seq", "kind", "sentence", F.timestamp_millis("at").alias("ts"))
    # event time goes by the rows that the clock takes, so the row that ends the log has to be one of them
    log = fr.of_kinds(log, ("send", *KINDS.activity))
    return _streamed(spark, "clock", log, lambda s: fr.close_turns_stream(s, SLOW, KINDS))


@query("j6_source_carry_in_order", f"WITH {CARRY} SELECT session_id, turn, coalesce(last_value(files IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn), '') AS source_file_ids FROM ts")
def _(spark, d):
    """Carried sources over files that bring turns in any order; the last row of a session ends it."""
    f = i.frames(spark, d).select("session_id", F.col("seq").alias("turn"), "at")
    rows = _turn_sources(spark, d).join(f, ["session_id", "turn"]).withColumn("ended", F.lit(False))
    over = rows.groupBy("session_id").agg((F.max("turn") + 1).alias("turn"), (F.max("at") + 1).alias("at")).select(
        "session_id", "turn", provenance.empty().alias("files"), F.lit(None).cast("boolean").alias("saw"), "at", F.lit(True).alias("ended"))
    log = rows.unionByName(over).withColumn("ts", F.timestamp_millis("at"))
    out = _streamed(spark, "carry", log, fr.carry_sources_in_order)
    return out.select("session_id", "turn", F.array_join("source_file_ids", ",").alias("source_file_ids"))


@query("j4_first_frame_latency", f"""WITH {LOG}, s AS (SELECT session_id, send_no, min(tm) AS sent FROM lg WHERE kind = 'signup' GROUP BY 1, 2)
SELECT s.session_id, s.send_no, min(f.tm) - s.sent AS latency_ms, min(f.tm) IS NOT NULL AS replied FROM s LEFT JOIN lg f ON f.session_id = s.session_id AND f.send_no = s.send_no AND f.kind IN ('click', 'view') AND f.tm <= s.sent + 86400000 AND f.tm >= s.sent GROUP BY s.session_id, s.send_no, s.sent""")
def _(spark, d):
    log = frame_log(spark, d)
    sends = log.where(F.col("kind") == "signup").select("session_id", "send_no", F.timestamp_millis("at").alias("sent_at"))
    frames = only_frames(log).withColumn("ts", F.timestamp_millis("at"))
    return fr.first_latency(fr.latency(sends, frames, SLOW, KINDS)).drop("sent_at")


@query("j5_turn_sources", f"""WITH {LOG}, f AS (SELECT * FROM lg WHERE kind <> 'signup' AND send_no >= 1)
SELECT session_id, send_no, coalesce(string_agg('w' || (k % 13), ' ' ORDER BY tm, seq) FILTER (WHERE kind IN ('click', 'view')), '') AS answer, arg_max('f' || k, seq) FILTER (WHERE kind = 'view') AS file_ids, arg_max('l' || k, seq) FILTER (WHERE kind = 'click') AS loaded_files,
  arg_max('p' || seq, seq) FILTER (WHERE kind = 'purchase') AS play_id, concat_ws(',', CASE WHEN bool_or(kind = 'view') THEN 'file_ids' END, CASE WHEN bool_or(kind = 'click') THEN 'loaded_files' END, CASE WHEN bool_or(kind = 'purchase') THEN 'play_id' END) AS source_keys,
  bool_or(kind IN ('view', 'click', 'purchase')) AS saw_source_frame FROM f GROUP BY 1, 2""")
def _(spark, d):
    a = fr.answers(only_frames(frame_log(spark, d)), KINDS)
    join = lambda c: F.array_join(c, ",").alias(c)
    return a.select("session_id", "send_no", "answer", join("file_ids"), join("loaded_files"), "play_id", join("source_keys"), "saw_source_frame")


@query("j7_welcome_drain", f"WITH {LOG} SELECT session_id, count(*) AS frames FROM lg WHERE send_no >= 1 AND kind <> 'signup' GROUP BY 1")
def _(spark, d):
    return fr.after_first_send(only_frames(frame_log(spark, d))).groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"))


@query("j8_server_session", f"WITH {LOG} SELECT session_id, arg_min('srv' || seq, seq) FILTER (WHERE kind = 'error') AS conversation_id FROM lg GROUP BY 1")
def _(spark, d):
    return fr.server_session(frame_log(spark, d))


@query("j11_never_started", f"""WITH {LOG} SELECT session_id, NOT bool_or(kind IN ('click', 'view') AND k % 30 = 0) AND count(*) FILTER (WHERE kind = 'error' AND k % 20 = 0) = 0 AS never_started FROM lg GROUP BY 1""")
def _(spark, d):
    f = i.frames(spark, d)
    o = f.select("session_id", (F.col("kind").isin("click", "view") & (F.col("k") % 30 == 0)).alias("responded"), F.when((F.col("kind") == "error") & (F.col("k") % 20 == 0), "x").alias("server_id"))
    return fr.never_started(o)


@query("j9_late_frames", f"""WITH {LOG}, c AS (SELECT session_id, send_no, min(tm) + 86400000 AS closed FROM lg WHERE kind = 'signup' GROUP BY 1, 2)
SELECT session_id, send_no, count(*) FILTER (WHERE tm <= closed OR closed IS NULL) AS in_time, count(*) FILTER (WHERE tm > closed) AS late FROM lg LEFT JOIN c USING (session_id, send_no) WHERE kind <> 'signup' GROUP BY 1, 2""")
def _(spark, d):
    log = frame_log(spark, d).withColumn("ts", F.timestamp_millis("at"))
    closes = log.where(F.col("kind") == "signup").groupBy("session_id", "send_no").agg(F.timestamp_millis(F.min("at") + 86_400_000).alias("closed_at"))
    fine, late = fr.split_late(only_frames(log), closes)
    both = fine.select("session_id", "send_no", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(late.select("session_id", "send_no", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("session_id", "send_no").agg(F.sum("a").alias("in_time"), F.sum("b").alias("late"))
