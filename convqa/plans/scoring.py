"""Queries over judge verdicts and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from convqa.operators import evaluation as ev
from convqa.plans import inputs as i
from convqa.plans.registry import query, table
from convqa.session import scratch_path
from convqa.sources import writers

# Each labelled document is a scored record: quality and 1 - toxic are its two metrics, two judges by parity.
RESULTS = """results AS (SELECT d.doc_id, d.lang AS language, CASE WHEN d.doc_id % 17 = 0 THEN 'deflection_detected' WHEN d.doc_id % 19 = 0 THEN 'quota' END AS error,
  CAST(quality AS DOUBLE) * (d.doc_id % 4 + 1) / 4.0 AS relevancy, CAST(1 - toxic AS DOUBLE) AS faithfulness, CASE WHEN d.doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS judge FROM labels l JOIN documents d USING (doc_id))"""


def results(spark, d):
    doc = table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"))
    lab = table(spark, d, "labels")
    return lab.join(doc, "doc_id").select(
        "doc_id", "language", F.when(F.col("doc_id") % 17 == 0, ev.DEFLECTED).when(F.col("doc_id") % 19 == 0, "quota").alias("error"),
        (F.col("quality").cast("double") * (F.col("doc_id") % 4 + 1) / 4).alias("relevancy"), (1 - F.col("toxic")).cast("double").alias("faithfulness"),
        F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("judge"))


@query("e2_evaluation_summary", f"""WITH {RESULTS}, r2 AS (SELECT * REPLACE (coalesce(nullif(language, 'de'), 'en') AS language) FROM results), h AS (SELECT language, grouping(language) AS g, count(*) AS records, count(*) FILTER (WHERE error IS NOT NULL AND error <> 'deflection_detected') AS errors, count(*) FILTER (WHERE error = 'deflection_detected') AS deflections FROM r2 GROUP BY GROUPING SETS ((), (language))),
lg AS (SELECT language, 'relevancy' AS metric, relevancy AS score FROM r2 WHERE error IS NULL UNION ALL SELECT language, 'faithfulness', faithfulness FROM r2 WHERE error IS NULL),
m AS (SELECT language, grouping(language) AS g, metric, round_even(avg(score), 3) AS avg, round_even(100.0 * avg(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END), 1) AS pass_rate FROM lg GROUP BY GROUPING SETS ((metric), (language, metric)))
SELECT h.language, CASE WHEN h.g = 1 THEN 'overall' ELSE 'language' END AS scope, records, errors, deflections, metric, avg, pass_rate FROM h LEFT JOIN m ON h.g = m.g AND h.language IS NOT DISTINCT FROM m.language""")
def _(spark, d):
    r = results(spark, d)
    metric = lambda m: F.struct(F.lit(m).alias("metric"), F.col(m).alias("score"), (F.col(m) >= 0.5).alias("pass"))
    nested = r.select(F.nullif("language", F.lit("de")).alias("language"), "error", F.when(F.col("error").isNull(), F.array(metric("relevancy"), metric("faithfulness"))).alias("metrics"))
    return ev.summary(nested)


VERDICTS = """v AS (SELECT doc_id AS record_id, ord, item, CASE WHEN doc_id % 2 = 0 THEN 'relevancy' ELSE 'faithfulness' END AS metric, CASE length(item) % 5 WHEN 0 THEN ' No' WHEN 1 THEN 'idk' ELSE 'yes' END AS verdict,
  CASE WHEN length(item) % 10 = 0 THEN 'too vague' ELSE '' END AS reason FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS item, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents JOIN labels USING (doc_id)))"""


def _verdicts(spark, d):
    doc = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id")
    items = doc.select(F.col("doc_id").alias("record_id"), F.posexplode(F.split("text", "\n")).alias("ord", "item"))
    n = F.length("item")
    return items.select("record_id", "ord", "item", F.when(F.col("record_id") % 2 == 0, "relevancy").otherwise("faithfulness").alias("metric"),
                        F.when(n % 5 == 0, " No").when(n % 5 == 1, "idk").otherwise("yes").alias("verdict"), F.when(n % 10 == 0, "too vague").otherwise("").alias("reason"))


@query("e20_score_verdicts", f"""WITH {VERDICTS}, s AS (SELECT record_id, metric, count(*) AS total, count(*) FILTER (WHERE lower(trim(verdict)) <> 'no') AS accepted, count(*) FILTER (WHERE lower(trim(verdict)) = 'idk') AS ambiguous FROM v GROUP BY 1, 2)
SELECT *, accepted / CAST(total AS DOUBLE) AS score, accepted / CAST(total AS DOUBLE) >= 0.5 AS pass FROM s""")
def _(spark, d):
    return ev.score_verdicts(_verdicts(spark, d))


@query("b35_verdict_reason", f"""WITH {VERDICTS}, s AS (SELECT record_id, metric, count(*) AS total, count(*) FILTER (WHERE verdict <> ' No') AS accepted, count(*) FILTER (WHERE verdict = 'idk') AS ambiguous,
  string_agg('"' || substr(item, 1, 70) || '" - ' || CASE WHEN reason = '' THEN 'no explanation given' ELSE reason END, ' | ' ORDER BY ord) FILTER (WHERE verdict = ' No') AS rej FROM v GROUP BY 1, 2)
SELECT record_id, metric, metric || ': ' || accepted || '/' || total || ' ' || CASE WHEN metric = 'relevancy' THEN 'statement' ELSE 'claim' END || 's accepted' || coalesce('. Rejected: ' || rej, '') || CASE WHEN ambiguous > 0 THEN '. (' || ambiguous || ' ambiguous)' ELSE '' END AS reason FROM s""")
def _(spark, d):
    return ev.verdict_reason(_verdicts(spark, d), statement_chars=70)


@query("e21_bakeoff", f"""WITH {RESULTS}, r AS (SELECT *, 'Q' || (doc_id // 2) AS question_id FROM results), c AS (SELECT question_id, judge, max(CASE WHEN error IS NOT NULL THEN 'ERR / ERR' ELSE printf('%.2f', relevancy) || ' / ' || printf('%.2f', faithfulness) END) AS cell FROM r GROUP BY 1, 2)
SELECT question_id, coalesce(max(cell) FILTER (WHERE judge = 'a'), '-') AS a, coalesce(max(cell) FILTER (WHERE judge = 'b'), '-') AS b FROM c GROUP BY 1
UNION ALL SELECT 'relevancy avg', printf('%.3f', avg(relevancy) FILTER (WHERE judge = 'a')), printf('%.3f', avg(relevancy) FILTER (WHERE judge = 'b')) FROM r WHERE error IS NULL
UNION ALL SELECT 'faithfulness avg', printf('%.3f', avg(faithfulness) FILTER (WHERE judge = 'a')), printf('%.3f', avg(faithfulness) FILTER (WHERE judge = 'b')) FROM r WHERE error IS NULL""")
def _(spark, d):
    r = results(spark, d).withColumn("question_id", F.concat(F.lit("Q"), F.expr("doc_id div 2")))
    return ev.bakeoff(r, ["a", "b"])


@query("e22_control_matrix", f"""WITH {RESULTS}, c AS (SELECT doc_id AS case_id, CASE doc_id % 3 WHEN 0 THEN 'relevancy' WHEN 1 THEN 'faithfulness' END AS ef FROM results),
l AS (SELECT doc_id AS case_id, 'relevancy' AS metric, relevancy AS score FROM results UNION ALL SELECT doc_id, 'faithfulness', faithfulness FROM results),
j AS (SELECT case_id, metric, score, score < 0.5 AS failed, coalesce(metric = ef, false) AS should_fail FROM c JOIN l USING (case_id)) SELECT *, failed AND should_fail AS caught, failed = should_fail AS as_expected FROM j""")
def _(spark, d):
    r = results(spark, d).withColumnRenamed("doc_id", "case_id")
    controls = r.select("case_id", F.when(F.col("case_id") % 3 == 0, "relevancy").when(F.col("case_id") % 3 == 1, "faithfulness").alias("expected_fail"))
    return ev.control_matrix(r, controls)


@query("e19_judge_usage", "SELECT count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, CAST(sum(turn) AS BIGINT) AS completion_tokens FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations")
    return ev.usage(c.select(F.lit(1).alias("calls"), F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens")))


@query("a21_judge_payload", f"""WITH {i.CAPTURED} SELECT session_id, question_id, turn, 'question' AS turn_type, conversation_id, latency_ms, first_audio_ms, question, answer, {i.deflection_sql('answer')} AS deflection_detected, question AS sources FROM captured""")
def _(spark, d):
    p = ev.export_payload(i.captured(spark, d), i.CORPUS_PATTERNS)
    return p.select("session_id", "question_id", "turn", "turn_type", "conversation_id", "latency_ms", "first_audio_ms", "question", "answer", "deflection_detected", F.array_join("source_chunks", "|").alias("sources"))


@query("d17_judge_inputs", f"WITH {i.CAPTURED} SELECT session_id, turn, question AS input, coalesce(answer, '') AS actual_output, expected_answer AS expected_output, question AS retrieval_context FROM captured")
def _(spark, d):
    return ev.judge_inputs(i.captured(spark, d)).withColumn("retrieval_context", F.array_join("retrieval_context", "|"))


@query("c3_sample_records", f"WITH {i.CAPTURED} SELECT session_id, turn, question_id FROM captured ORDER BY session_id, turn LIMIT 50")
def _(spark, d):
    return ev.sample(i.captured(spark, d), 50).select("session_id", "turn", "question_id")


@query("d5_resume_scoring", f"WITH {i.CAPTURED} SELECT session_id, turn FROM captured WHERE (CAST(substr(session_id, 2) AS BIGINT) + turn) % 3 <> 0")
def _(spark, d):
    c = i.captured(spark, d)
    done = c.where((F.substring("session_id", 2, 20).cast("bigint") + F.col("turn")) % 3 == 0)
    return ev.pending(c, done).select("session_id", "turn")


_WORDS = "list_distinct([x FOR x IN string_split(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' ') IF x <> ''])"


@query("k1_pluggable_judge", f"""WITH {i.CAPTURED}, g AS (SELECT *, CASE WHEN coalesce(answer, '') = '' THEN 'unanswered' WHEN {i.deflection_sql('answer')} THEN 'deflection_detected' END AS error,
  {_WORDS.format(c='question')} AS q, {_WORDS.format(c='answer')} AS a, {_WORDS.format(c='expected_answer')} AS e FROM captured)
SELECT session_id, turn, language, error, CASE WHEN error IS NULL THEN 2 ELSE 0 END AS metrics,
  CASE WHEN error IS NULL THEN CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_intersect(q, list_concat(a, e))) / len(q), 6) END END AS relevancy,
  CAST(CASE WHEN error IS NULL THEN 2 ELSE 0 END AS BIGINT) AS calls, CAST(CASE WHEN error IS NULL THEN len(a) ELSE 0 END AS BIGINT) AS prompt_tokens FROM g""")
def _(spark, d):
    s = ev.score(i.captured(spark, d), ev.overlap_judge(), i.CORPUS_PATTERNS)
    return s.select("session_id", "turn", "language", "error", F.size("metrics").alias("metrics"), F.round(F.get("metrics", F.lit(0))["score"], 6).alias("relevancy"), "calls", "prompt_tokens")


@query("k1_gate_before_judge", f"""WITH {i.CAPTURED} SELECT CASE WHEN coalesce(answer, '') = '' THEN 'unanswered' WHEN {i.deflection_sql('answer')} THEN 'deflection_detected' END AS error, count(*) AS records FROM captured GROUP BY 1""")
def _(spark, d):
    return ev.gate(i.captured(spark, d), i.CORPUS_PATTERNS).groupBy("error").agg(F.count(F.lit(1)).alias("records"))


@query("j10_score_stream", f"""WITH {i.CAPTURED} SELECT CASE WHEN coalesce(answer, '') = '' THEN 'unanswered' WHEN {i.deflection_sql('answer')} THEN 'deflection_detected' END AS error, count(*) AS records FROM captured GROUP BY 1""")
def _(spark, d):
    """Scores appended batch by batch; a second run of the stream adds nothing."""
    from convqa.streaming.scoring import score_stream

    src, out, checkpoint = (scratch_path(spark, n) for n in ("captured", "scores", "score-state"))
    captured = i.captured(spark, d)
    captured.write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(captured.schema).parquet(src)
        score_stream(stream, ev.overlap_judge(), out, checkpoint, i.CORPUS_PATTERNS).awaitTermination()
    return spark.read.parquet(out).groupBy("error").agg(F.count(F.lit(1)).alias("records"))


@query("b28_parse_replies", """SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'S' || doc_id END AS verdict, CASE doc_id % 5 WHEN 3 THEN 'no JSON object' WHEN 4 THEN 'unbalanced JSON' END AS parse_error FROM documents""")
def _(spark, d):
    doc = table(spark, d, "documents")
    body = F.to_json(F.struct(F.concat(F.lit("S"), "doc_id").alias("verdict"), F.concat(F.lit('say "}{" '), F.translate("text", "{}", "()")).alias("note")))
    note = F.translate("text", "{}", "()")
    reply = F.when(F.col("doc_id") % 5 == 0, body).when(F.col("doc_id") % 5 == 1, F.concat(note, body, F.lit(" and more"))).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(
        F.col("doc_id") % 5 == 3, F.concat(F.lit("sorry "), note)).otherwise(F.concat(F.lit('{"verdict": '), note))
    p = ev.parse_replies(doc.select("doc_id", reply.alias("reply")))
    return p.select("doc_id", F.col("parsed")["verdict"].alias("verdict"), "parse_error")


@query("a18_write_results", f"""WITH {RESULTS} SELECT '2026' AS source_stamp, 'judge_' || judge AS judge, count(*) AS records, count(error) AS errors FROM results GROUP BY judge""")
def _(spark, d):
    root = scratch_path(spark, "results")
    r = results(spark, d)
    for judge in ("a", "b"):
        writers.write_results(r.where(F.col("judge") == judge).drop("judge"), root, "2026", f"judge/{judge}:free")
    stored = spark.read.schema("doc_id bigint, error string, source_stamp string, judge string").parquet(root)
    return stored.groupBy("source_stamp", "judge").agg(F.count(F.lit(1)).alias("records"), F.count("error").alias("errors"))


@query("a17_write_captured", f"WITH {i.CAPTURED} SELECT count(*) AS total_turns, count(answer) AS answered, count(*) FILTER (WHERE answer IS NULL) AS unanswered, CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_latency_ms FROM captured")
def _(spark, d):
    root = scratch_path(spark, "captured")
    writers.write_captured(i.captured(spark, d).withColumn("answered", F.col("answer").isNotNull()), root, "s1")
    return spark.read.schema("total_turns bigint, answered bigint, unanswered bigint, avg_latency_ms bigint").json(f"{root}/captured-totals-s1")


@query("a19_write_stats", f"WITH {i.CAPTURED} SELECT 'captured-s1' AS source, count(*) AS total_turns, count(*) FILTER (WHERE {i.deflection_sql('answer')}) AS deflections FROM captured")
def _(spark, d):
    root = scratch_path(spark, "stats")
    writers.write_stats(ev.answer_stats(i.captured(spark, d), patterns=i.CORPUS_PATTERNS), root, "captured-s1")
    stored = spark.read.schema("source string, stats struct<total_turns:bigint,deflections:bigint>").json(root)
    return stored.select("source", "stats.total_turns", "stats.deflections")
