"""Queries over chunks, question pools, sessions and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from convqa.functions import text as tx
from convqa.operators import flows, kb, quality, questions, reporting, sessions
from convqa.operators import ordered as o
from convqa.plans import inputs as i
from convqa.plans.registry import query, table
from convqa.session import scratch_path
from convqa.sources import readers, replies, writers


@query("b1_detect_language", f"""SELECT doc_id, {i.language_sql('text')} AS script, CASE WHEN text = '' THEN '?' WHEN regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'ar' ELSE 'en' END AS language FROM documents""")
def _(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", tx.detect_language("text", i.SCRIPT, "fr").alias("script"), tx.detect_language("text").alias("language"))


@query("c1_usable_chunks", "SELECT doc_id, source FROM documents WHERE length(text) >= 15")
def _(spark, d):
    return kb.usable(table(spark, d, "documents")).select("doc_id", "source")


@query("e12_chunk_counts", f"WITH {i.CHUNKS} SELECT language, grp AS type, count(*) AS chunks, CASE WHEN grouping(language) = 1 THEN 'type' ELSE 'language' END AS scope FROM (SELECT nullif(language, 'de') AS language, grp FROM chunks) GROUP BY GROUPING SETS ((language), (grp))")
def _(spark, d):
    return kb.chunk_counts(i.chunks(spark, d).withColumnRenamed("grp", "type").withColumn("language", F.nullif("language", F.lit("de"))))


CLEAN = "trim(regexp_replace(regexp_replace({c}, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"
BLOCKS = f"""p AS (SELECT page_id, unnest([x FOR x IN [{CLEAN.format(c='b')} FOR b IN regexp_extract_all(html, '<p(?:\\s[^>]*)?>(.*?)</p>', 1, 'is')] IF x <> '']) AS text,
  generate_subscripts([x FOR x IN [{CLEAN.format(c='b')} FOR b IN regexp_extract_all(html, '<p(?:\\s[^>]*)?>(.*?)</p>', 1, 'is')] IF x <> ''], 1) AS pos FROM pages),
li AS (SELECT page_id, li.g, {CLEAN.format(c='li.item')} AS text, li.g * 100000 + li.k AS pos FROM
  (SELECT page_id, l.g, unnest(regexp_extract_all(l.body, '<li(?:\\s[^>]*)?>(.*?)</li>', 1, 'is')) AS item, generate_subscripts(regexp_extract_all(l.body, '<li(?:\\s[^>]*)?>(.*?)</li>', 1, 'is'), 1) AS k FROM
    (SELECT page_id, unnest(regexp_extract_all(html, '<(?:ul|ol)(?:\\s[^>]*)?>(.*?)</(?:ul|ol)>', 1, 'is')) AS body, generate_subscripts(regexp_extract_all(html, '<(?:ul|ol)(?:\\s[^>]*)?>(.*?)</(?:ul|ol)>', 1, 'is'), 1) AS g FROM pages) l) li),
fli AS (SELECT page_id, text, min(pos) AS pos, arg_min(g, pos) AS g FROM li WHERE text <> '' GROUP BY 1, 2),
allb AS (SELECT page_id, 'paragraph' AS type, text, CAST(NULL AS VARCHAR) AS grp, 0 AS part, pos FROM p UNION ALL SELECT page_id, 'table_row', text, 'list_' || (g - 1), 1, pos FROM fli),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY part, pos) AS n FROM allb)"""


@query("a11_extract_chunks", f"""WITH {BLOCKS} SELECT page_id, format('chunk_{{:03d}}', n) AS id, type, text,
  CASE WHEN regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'ar' ELSE 'en' END AS language, grp FROM numbered""")
def _(spark, d):
    return kb.extract_chunks(table(spark, d, "pages"))


@query("f12_first_occurrence", """WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
f AS (SELECT coalesce(source, 'none') AS source, line, min({'doc_id': doc_id, 'pos': pos}) AS at_pos FROM l WHERE regexp_matches(line, '\\S') GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY at_pos) AS rn FROM f)
SELECT source, format('chunk_{:03d}', rn) AS id, at_pos.doc_id AS doc_id, CAST(at_pos.pos AS INTEGER) AS pos, line FROM n""")
def _(spark, d):
    doc = table(spark, d, "documents")
    lines = doc.select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike("\\S"))
    first = kb.first_occurrences(lines, ["source"], "line", ["doc_id", "pos"])
    numbered = o.ordinal(first, ["source"], ["doc_id", "pos"], "rn", o.blocks_of("doc_id", 1_000))
    return numbered.select("source", tx.padded_id("chunk_", "rn").alias("id"), "doc_id", "pos", "line")


@query("f15_candidates", f"""WITH {i.CHUNKS}, u AS (SELECT * FROM chunks WHERE length(text) >= 15),
s AS (SELECT row_number() OVER (ORDER BY ord) AS n, 0 AS k, 'standalone' AS kind, id AS first_id, CAST(NULL AS VARCHAR) AS second_id FROM u),
g AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ord) AS r, lead(id) OVER (PARTITION BY grp ORDER BY ord) AS nxt FROM u WHERE grp IS NOT NULL),
c AS (SELECT row_number() OVER (ORDER BY ord) AS n, 1 AS k, 'combined' AS kind, id AS first_id, nxt AS second_id FROM g WHERE r = 1 AND nxt IS NOT NULL)
SELECT row_number() OVER (ORDER BY n, k) AS pos, kind, first_id, second_id FROM (SELECT * FROM s UNION ALL SELECT * FROM c)""")
def _(spark, d):
    return kb.candidates(i.chunks(spark, d))


REFS = "refs AS (SELECT item_id AS id, unnest([item_id * 7 % 1300, item_id * 13 % 1300, item_id * 29 % 1300]) AS doc, generate_subscripts([1, 2, 3], 1) AS k FROM benchmark)"


def _refs(spark, d):
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.array(*[F.format_string("chunk_%03d", F.col("item_id") * k % 1300) for k in (7, 13, 29)]).alias("chunk_ids"))


@query("d1_resolve_chunks", f"""WITH {i.CHUNKS}, {REFS} SELECT b.item_id AS id, coalesce(x.n, 0) AS resolved, coalesce(x.t, '') AS source_text FROM benchmark b LEFT JOIN
  (SELECT refs.id, count(*) AS n, string_agg(text, '|' ORDER BY k) AS t FROM refs JOIN chunks ON chunks.ord = refs.doc AND text <> '' GROUP BY 1) x ON x.id = b.item_id""")
def _(spark, d):
    r = kb.resolve_chunks(_refs(spark, d), i.chunks(spark, d))
    return r.select("id", F.size("source_chunks").cast("bigint").alias("resolved"), F.array_join("source_chunks", "|").alias("source_text"))


@query("d12_broken_references", f"""WITH {i.CHUNKS}, {REFS} SELECT id, format('unknown source chunk "chunk_{{:03d}}"', doc) AS issue FROM refs WHERE doc NOT IN (SELECT ord FROM chunks)""")
def _(spark, d):
    return quality.unknown_chunks(_refs(spark, d), i.chunks(spark, d), "chunk_ids")


TASKS = f"""{i.CHUNKS}, ex AS (SELECT id AS key, CASE WHEN ord % 2 = 0 THEN 'ar' ELSE 'en' END AS language, format('P{{:03d}}', ord) AS pair_id FROM chunks WHERE ord % 3 = 0),
cand AS (SELECT ord AS pos, id AS key FROM chunks), w AS (SELECT pos, key, unnest(['ar', 'en']) AS language FROM cand),
t AS (SELECT w.*, k.pair_id AS known FROM w LEFT JOIN ex e ON e.key = w.key AND e.language = w.language LEFT JOIN (SELECT key, min(pair_id) AS pair_id FROM ex GROUP BY 1) k ON k.key = w.key WHERE e.key IS NULL),
f AS (SELECT key, dense_rank() OVER (ORDER BY pos) AS n FROM (SELECT DISTINCT key, pos FROM t WHERE known IS NULL)),
top AS (SELECT max(ord) AS m FROM chunks WHERE ord % 3 = 0)"""


@query("d5_plan_tasks", f"WITH {TASKS} SELECT t.pos, t.language, t.key, coalesce(known, format('P{{:03d}}', top.m + f.n)) AS pair_id FROM t LEFT JOIN f USING (key), top")
def _(spark, d):
    c = i.chunks(spark, d)
    cands = c.select(F.col("ord").alias("pos"), F.array("id").alias("chunk_ids"))
    existing = c.where(F.col("ord") % 3 == 0).select(
        F.when(F.col("ord") % 2 == 0, "ar").otherwise("en").alias("language"), tx.padded_id("P", "ord").alias("pair_id"), F.array("id").alias("source_chunks"))
    return questions.plan_tasks(cands, existing, ["ar", "en"])


@query("b20_max_suffix", "SELECT coalesce(max(doc_id), 0) AS max_suffix FROM documents WHERE doc_id % 3 = 0")
def _(spark, d):
    ids = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, tx.padded_id("P", "doc_id")).otherwise(F.concat(F.lit("P"), "doc_id", F.lit("x"))).alias("pair_id"))
    return questions.max_suffix(ids, "pair_id", "P")


@query("b19_padded_ids", "SELECT doc_id, format('chunk_{:03d}', doc_id) AS chunk, format('Q{:03d}', doc_id) AS q, replace(coalesce(source, ''), ' ', '') || '-' || lang || '-' || format('{:03d}', doc_id) AS session FROM documents")
def _(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", tx.padded_id("chunk_", "doc_id").alias("chunk"), tx.padded_id("Q", "doc_id").alias("q"), sessions.session_id(F.coalesce("source", F.lit("")), "lang", F.col("doc_id")).alias("session"))


_QUOTED = lambda title, c: f"'{title}:' || chr(10) || '\"\"\"' || chr(10) || {c} || chr(10) || '\"\"\"'"
_LEAD = "CASE lang WHEN 'fr' THEN 'Write the question and answer in Arabic.' ELSE 'Write the question and answer in English (translate the content''s meaning faithfully — do not fabricate).' END || chr(10) || chr(10)"
PROMPT_SQL = (f"CASE WHEN second IS NULL THEN {_LEAD} || {_QUOTED('Knowledge base content', 'text')} ELSE {_LEAD} || "
              "'The question must require BOTH pieces of content below to answer (a question answerable from only one of them is not acceptable).' || chr(10) || chr(10) || "
              f"{_QUOTED('Knowledge base content 1', 'text')} || chr(10) || chr(10) || {_QUOTED('Knowledge base content 2', 'second')} END")


@query("b33_prompt", f"SELECT doc_id, {PROMPT_SQL} AS prompt FROM (SELECT a.doc_id, a.lang, a.text, b.text AS second FROM documents a LEFT JOIN documents b ON a.doc_id % 2 = 0 AND b.doc_id = a.doc_id + 1)")
def _(spark, d):
    """Prompts out of one chunk, or out of two for every other document."""
    doc = table(spark, d, "documents")
    after = doc.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("second")).where("doc_id % 2 = 0")
    lang = F.when(F.col("lang") == "fr", "ar").otherwise("en")
    return doc.join(after, "doc_id", "left").select("doc_id", questions.prompt(lang, F.col("text"), F.col("second")).alias("prompt"))


# Sessions -------------------------------------------------------------------------------------

H = lambda seed, *ids: "md5(concat_ws('|', '{}', {}))".format(seed, ", ".join(ids))


@query("g1_seeded_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {H(7, 'doc_id')}, doc_id) AS pos FROM documents")
def _(spark, d):
    return sessions.shuffle(table(spark, d, "documents").select("doc_id"), "doc_id", 7)


BUILD = f"""{i.POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY topic, sub_topic, language ORDER BY {H(7, 'id')}, id) AS rn, count(*) OVER (PARTITION BY topic, sub_topic, language) AS n FROM pool),
own AS (SELECT topic, sub_topic, language, id, (rn - 1) // 10 + 1 AS session_no, (rn - 1) % 10 + 1 AS turn FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY topic, sub_topic, language ORDER BY {H('7-fill', 'id')}, id) AS k FROM r WHERE (rn - 1) // 10 < (n - 1) // 10),
fill AS (SELECT topic, sub_topic, language, id, (n - 1) // 10 + 1 AS session_no, k + (n - 1) % 10 + 1 AS turn FROM f WHERE (n - 1) % 10 + 1 < 10 AND k + (n - 1) % 10 + 1 <= 10),
built AS (SELECT * FROM own UNION ALL SELECT * FROM fill)"""


@query("f9_build_sessions", f"""WITH {BUILD} SELECT topic, sub_topic, language, id, session_no, turn, format('{{}}-{{}}-{{:03d}}', sub_topic, language, session_no) AS session_id FROM built WHERE language <> 'en' OR session_no <= 2""")
def _(spark, d):
    return sessions.build(i.pool(spark, d), 10, 7, {"en": 2})


def _quota_sql(reuse: bool) -> str:
    if reuse:
        copies = "p AS (SELECT *, count(*) OVER (PARTITION BY language) AS n FROM pool), c AS (SELECT *, unnest(range(1, CAST((400 + n - 1) // n AS BIGINT) + 1)) AS pass FROM p)"
        limit = "400"
    else:
        copies = "p AS (SELECT *, count(*) OVER (PARTITION BY language) AS n FROM pool), c AS (SELECT *, 1 AS pass FROM p)"
        limit = "least(400, n // 8 * 8)"
    return f"""{i.POOL}, {copies}, r AS (SELECT *, row_number() OVER (PARTITION BY language, pass ORDER BY {H('s', 'pass', 'id')}, id) AS rn FROM c),
q AS (SELECT language, id, CAST((pass - 1) * n + rn AS BIGINT) AS position, n FROM r), quota AS (SELECT language, id, position, (position - 1) // 8 + 1 AS session_no, (position - 1) % 8 + 1 AS turn FROM q WHERE position <= {limit})"""


@query("f10_quota_sessions", f"WITH {_quota_sql(False)} SELECT language, id, position, session_no, turn, format('S{{:03d}}_{{}}', session_no, language) AS session_id FROM quota")
def _(spark, d):
    return sessions.build_quota(i.pool(spark, d), 50, 8, "s").select("language", "id", "position", "session_no", "turn", "session_id")


@query("f10_quota_sessions_reuse", f"WITH {_quota_sql(True)} SELECT language, id, position, session_no, turn, format('S{{:03d}}_{{}}', session_no, language) AS session_id FROM quota")
def _(spark, d):
    return sessions.build_quota(i.pool(spark, d), 50, 8, "s", reuse=True).select("language", "id", "position", "session_no", "turn", "session_id")


@query("e23_repeat_check", f"""WITH {_quota_sql(True)}, q2 AS (SELECT *, row_number() OVER (PARTITION BY language, id ORDER BY position) AS k FROM quota),
u AS (SELECT language, count(DISTINCT id) AS seen, max(position) FILTER (WHERE k = 1) AS all_seen_at, min(position) FILTER (WHERE k = 2) AS first_repeat FROM q2 GROUP BY 1),
s AS (SELECT language, count(DISTINCT id) AS pool_size FROM pool GROUP BY 1)
SELECT language, pool_size, seen, first_repeat, first_repeat IS NULL OR (seen = pool_size AND first_repeat > all_seen_at) AS ok FROM s JOIN u USING (language)""")
def _(spark, d):
    pool = i.pool(spark, d)
    return sessions.repeat_check(sessions.build_quota(pool, 50, 8, "s", reuse=True), pool)


@query("d14_uncovered_questions", f"WITH {_quota_sql(False)} SELECT id, language FROM pool WHERE id NOT IN (SELECT id FROM quota)")
def _(spark, d):
    pool = i.pool(spark, d)
    return sessions.uncovered(pool, sessions.build_quota(pool, 50, 8, "s")).select("id", "language")


@query("g2_first_per_language", f"WITH {i.SESSIONS} SELECT session_id, language FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY session_id) AS k FROM sessions) WHERE k <= 25")
def _(spark, d):
    return sessions.first_sessions(i.run_sessions(spark, d), "session_id", 25, ["language"]).select("session_id", "language")


@query("g3_proportional_sample", f"""WITH {i.SESSIONS}, c AS (SELECT count(*) FILTER (WHERE language = 'ar') AS a, count(*) FILTER (WHERE language = 'en') AS b, count(*) AS n FROM sessions),
q AS (SELECT CAST(floor(500 * a / CAST(n AS DOUBLE) + 0.5) AS BIGINT) AS wa, a, b FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY {H(11, 'session_id')}, session_id) AS k FROM sessions)
SELECT session_id, language FROM r, q WHERE k <= CASE language WHEN 'ar' THEN least(least(wa, a) + greatest(500 - wa - b, 0), a) ELSE least(least(500 - wa, b) + greatest(wa - a, 0), b) END""")
def _(spark, d):
    return sessions.sample_proportional(i.run_sessions(spark, d), 500, 11).select("session_id", "language")


@query("g4_first_sessions", f"WITH {i.SESSIONS} SELECT session_id, language FROM sessions ORDER BY session_id LIMIT 40")
def _(spark, d):
    return sessions.first_sessions(i.run_sessions(spark, d), "session_id", 40).select("session_id", "language")


@query("g5_reshuffle_turns", f"""WITH {i.CAPTURED} SELECT session_id, question_id, row_number() OVER (PARTITION BY session_id ORDER BY {H('x', 'question_id')}, question_id) AS turn FROM captured""")
def _(spark, d):
    c = i.captured(spark, d).select("session_id", "question_id", "turn")
    return sessions.reshuffle_turns(c, "x")


@query("g7_order_by_session", f"WITH {i.SESSIONS} SELECT session_id, run FROM sessions ORDER BY session_id")
def _(spark, d):
    return i.run_sessions(spark, d).orderBy("session_id").select("session_id", "run")


@query("g8_fixed_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 + 1 AS batch, (row_number() OVER (ORDER BY doc_id) - 1) % 8 + 1 AS slot FROM documents")
def _(spark, d):
    return kb.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 8)


@query("a22_prompt_batches", f"""WITH {BLOCKS}, listed AS (SELECT page_id, 'TABLE 1:' || chr(10) || string_agg('  - ' || text, chr(10) ORDER BY pos) AS listed FROM allb WHERE part = 1 GROUP BY 1),
n AS (SELECT documents.*, (row_number() OVER (ORDER BY doc_id) - 1) // 8 + 1 AS batch, 'D' || doc_id AS slug, coalesce(chr(10) || listed, '') AS listed FROM documents LEFT JOIN listed ON page_id = doc_id)
SELECT format('batch-{{:03d}}', batch) AS file, count(*) AS docs, string_agg(slug, ', ' ORDER BY doc_id) AS flows,
  'Below are ' || count(*) || ' documents.' || chr(10) || chr(10) || 'BATCH: ' || string_agg(slug, ', ' ORDER BY doc_id) || chr(10) || chr(10) || string_agg(
  'FLOW: ' || slug || '  (' || upper(lang) || ', file: ' || slug || '.docx)' || chr(10) || text || listed || chr(10) || chr(10) || '---', chr(10) ORDER BY doc_id) AS prompt FROM n GROUP BY batch""")
def _(spark, d):
    """Every line of a document as a paragraph, and the list rows of the page of its number as table rows."""
    cut = kb.extract_chunks(table(spark, d, "pages")).where(F.col("type") == "table_row")
    place = F.struct(F.regexp_extract("id", "(\\d+)$", 1).cast("int").alias("at"), "text")
    rows = cut.groupBy(F.col("page_id").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["text"]).alias("rows"))
    doc = table(spark, d, "documents").select("doc_id", F.concat(F.lit("D"), "doc_id").alias("slug"), "lang", F.split("text", "\n").alias("paragraphs")).join(rows, "doc_id", "left")
    doc = doc.withColumn("file", F.concat("slug", F.lit(".docx"))).withColumn("doc_text", kb.document_text("slug", "lang", "file", "paragraphs", "rows"))
    return kb.prompt_batches(doc, "doc_id", "Below are {count} documents.", 8)


@query("h2_repeat_sessions", f"""WITH {i.SESSIONS} SELECT CASE WHEN c = 1 THEN CAST(session_id AS VARCHAR) ELSE session_id || '#' || c END AS session_id, language, CAST(c AS INTEGER) AS cycle FROM sessions, range(1, 4) t(c)""")
def _(spark, d):
    s = i.run_sessions(spark, d).withColumn("session_id", F.col("session_id").cast("string"))
    return sessions.repeat(s, 3).select("session_id", "language", "cycle")


@query("h7_recycle_sessions", f"""WITH {i.SESSIONS}, t AS (SELECT 'ar' AS language, CAST(20000 AS BIGINT) AS target UNION ALL SELECT 'en', 1000), r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY session_id) AS rn, count(*) OVER (PARTITION BY language) AS n FROM sessions JOIN t USING (language)),
c AS (SELECT *, unnest(range(1, greatest(CAST((target + n - 1) // n AS BIGINT), 1) + 1)) AS cyc FROM r)
SELECT session_id, language, CAST(cyc AS INTEGER) AS cycle, CAST((cyc - 1) * n + rn AS BIGINT) AS call_no FROM c WHERE (cyc - 1) * n + rn <= target""")
def _(spark, d):
    return sessions.recycle(i.run_sessions(spark, d), "session_id", {"ar": 20000, "en": 1000}).select("session_id", "language", "cycle", "call_no")


@query("h1_union_parts", f"WITH {i.SESSIONS} SELECT session_id, language, turns FROM sessions WHERE language = 'ar' UNION ALL SELECT session_id, language, turns FROM sessions WHERE language = 'en'")
def _(spark, d):
    s = i.run_sessions(spark, d)
    part = lambda l: sessions.select_sessions(s, [l])
    return part("ar").unionByName(part("en")).select("session_id", "language", "turns")


@query("h4_difference", f"WITH {BUILD} SELECT id FROM pool EXCEPT SELECT id FROM built WHERE session_no = 1")
def _(spark, d):
    pool = i.pool(spark, d)
    first = sessions.build(pool, 10, 7).where(F.col("session_no") == 1)
    return sessions.uncovered(pool, first).select("id")


@query("c2_select_sessions", f"WITH {i.SESSIONS} SELECT session_id, language, 'language' AS how FROM sessions WHERE language = 'ar' UNION ALL SELECT session_id, language, 'ids' FROM sessions WHERE session_id IN (3, 5, 8, 13)")
def _(spark, d):
    s = i.run_sessions(spark, d)
    by_language = sessions.select_sessions(s, ["AR"]).select("session_id", "language", F.lit("language").alias("how"))
    return by_language.unionByName(sessions.select_sessions(s, ["3", "5", "8", "13"]).select("session_id", "language", F.lit("ids").alias("how")))


@query("c6_with_audio", "SELECT coalesce(source, 'none') AS sub_topic, count(*) FILTER (WHERE doc_id % 4 <> 0) AS usable, count(*) FILTER (WHERE doc_id % 4 = 0) AS excluded FROM documents GROUP BY 1")
def _(spark, d):
    q = i.pool(spark, d).withColumn("audio_file", F.when(F.col("id") % 4 != 0, F.format_string("wav/%d.wav", "id")))
    usable = sessions.with_audio(q).groupBy("sub_topic").agg(F.count(F.lit(1)).alias("usable"))
    every = q.groupBy("sub_topic").agg(F.count(F.lit(1)).alias("every"))
    kept = F.coalesce("usable", F.lit(0).cast("long"))
    return every.join(usable, "sub_topic", "left").select("sub_topic", kept.alias("usable"), (F.col("every") - kept).alias("excluded"))


@query("c7_flow_selection", "SELECT doc_id, source FROM documents WHERE doc_id % 50 IN (1, 7, 40)")
def _(spark, d):
    doc = table(spark, d, "documents").withColumn("index", F.col("doc_id") % 50)
    return kb.select_flows(doc, (1, 7, 40)).select("doc_id", "source")


@query("e8_manifest", f"WITH {i.POOL} SELECT topic, sub_topic, count(*) FILTER (WHERE language = 'fr') AS ar, count(*) FILTER (WHERE language IS DISTINCT FROM 'fr') AS en, count(*) AS total, CASE WHEN grouping(sub_topic) = 1 THEN 'topic' ELSE 'sub_topic' END AS scope FROM (SELECT topic, nullif(sub_topic, 'src3') AS sub_topic, language FROM pool) GROUP BY GROUPING SETS ((topic, sub_topic), (topic))")
def _(spark, d):
    return reporting.manifest(i.pool(spark, d).withColumn("sub_topic", F.nullif("sub_topic", F.lit("src3"))), "fr")


@query("e9_session_counts", f"WITH {i.SESSIONS} SELECT 'KB' AS topic, run AS file, count(*) FILTER (WHERE language = 'ar') AS ar_sessions, count(*) FILTER (WHERE language = 'en') AS en_sessions, count(*) AS total_sessions, CAST(sum(turns) AS BIGINT) AS total_questions FROM sessions GROUP BY run")
def _(spark, d):
    return reporting.session_counts(i.run_sessions(spark, d).withColumn("topic", F.lit("KB")).withColumnRenamed("run", "file"))


@query("e10_question_counts", f"WITH {i.POOL} SELECT topic, sub_topic AS file, count(*) FILTER (WHERE language = 'ar') AS ar_questions, count(*) FILTER (WHERE language = 'en') AS en_questions, count(*) AS total_questions FROM pool GROUP BY 1, 2")
def _(spark, d):
    return reporting.question_counts(i.pool(spark, d).withColumnRenamed("sub_topic", "file"))


@query("d16_twins", """WITH q AS (SELECT doc_id AS id, 'P' || (doc_id // 2) AS pair_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 5 = 0 THEN 'ar' ELSE 'en' END AS language, n_chars FROM documents)
SELECT pair_id, min(id) FILTER (WHERE language = 'ar') AS ar_id, min(id) FILTER (WHERE language = 'en') AS en_id, arg_min(n_chars, id) FILTER (WHERE language = 'ar') AS ar_question, arg_min(n_chars, id) FILTER (WHERE language = 'en') AS en_question FROM q GROUP BY 1""")
def _(spark, d):
    doc = table(spark, d, "documents")
    q = doc.select(F.col("doc_id").alias("id"), F.concat(F.lit("P"), F.expr("doc_id div 2")).alias("pair_id"),
                   F.when((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 5 == 0), "ar").otherwise("en").alias("language"), F.col("n_chars").alias("question"))
    return questions.twins(q)


# Flows ----------------------------------------------------------------------------------------

RECORDS = """rec AS (SELECT doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN 'full_dump' ELSE 'incremental' END AS mode, CASE WHEN lang = 'en' THEN 'en' ELSE 'ar' END AS language, coalesce(source, 'none') AS flow_id,
  text AS question, text AS expected_answer FROM documents),
st AS (SELECT *, row_number() OVER (PARTITION BY flow_id, language, mode ORDER BY ord) AS step_n, CASE mode WHEN 'full_dump' THEN 'DUMP' ELSE 'INC' END AS short FROM rec),
g AS (SELECT flow_id, language, mode, count(*) AS n, arg_min(question, ord) AS question FROM rec GROUP BY 1, 2, 3)"""


def _steps(spark, d):
    """Every document as a question record with its whole text, numbered within its flow."""
    doc = table(spark, d, "documents")
    return flows.steps(doc.select(
        F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 3 == 0, "X-Dump").otherwise("X-1").alias("pair_id"), F.when(F.col("lang") == "en", "en").otherwise("ar").alias("language"),
        F.lit("KB").alias("topic"), F.coalesce("source", F.lit("none")).alias("sub_topic"), F.col("text").alias("question"),
        F.col("text").alias("expected_answer"), F.array(F.format_string("chunk_%03d", "doc_id")).alias("chunk_ids")))


@query("h5_regroup_records", f"""WITH {RECORDS} SELECT flow_id || '-' || short || '-' || upper(language) AS id, flow_id, mode, language, step_n, question, expected_answer FROM st""")
def _(spark, d):
    return _steps(spark, d).select(flows.scenario_id().alias("id"), "flow_id", "mode", "language", "step_n", "question", "expected_answer")


@query("h5_scenario_heads", f"""WITH {RECORDS} SELECT flow_id || '-' || CASE mode WHEN 'full_dump' THEN 'DUMP' ELSE 'INC' END || '-' || upper(language) AS id, flow_id, mode, language, question, n AS steps FROM g""")
def _(spark, d):
    return flows.heads(_steps(spark, d)).select("id", "flow_id", "mode", "language", "question", "steps")


@query("h5_merge_flows", f"WITH {RECORDS} SELECT flow_id, flow_id AS title, count(*) AS scenarios FROM g GROUP BY 1")
def _(spark, d):
    return questions.merge_flows(flows.heads(_steps(spark, d)))


FLAT = f"""{RECORDS},
flat AS (SELECT CASE mode WHEN 'full_dump' THEN format('{{}}-DUMP-{{}}-001', flow_id, upper(language)) ELSE format('{{}}-INC-{{}}-{{:03d}}', flow_id, upper(language), step_n) END AS id, upper(flow_id || '-' || short) AS pair_id, language,
  flow_id || CASE mode WHEN 'full_dump' THEN '-FullDump' ELSE '-Incremental' END AS sub_topic, flow_id AS base, CASE mode WHEN 'full_dump' THEN 'fulldump' ELSE mode END AS mode,
  CASE mode WHEN 'full_dump' THEN 1 ELSE step_n END AS step, CASE mode WHEN 'full_dump' THEN step_n ELSE 1 END AS part, CASE WHEN mode <> 'full_dump' OR step_n = 1 THEN question END AS question, expected_answer FROM st)"""


def _flat(spark, d):
    return flows.questions(_steps(spark, d))


@query("h6_flatten_flows", f"WITH {FLAT} SELECT id, pair_id, language, sub_topic, max(question) AS question, string_agg(coalesce(expected_answer, ''), ' ' ORDER BY part) AS expected_answer FROM flat GROUP BY 1, 2, 3, 4")
def _(spark, d):
    """A row per question; the parts of a full answer are one text."""
    return flows.whole_answers(_flat(spark, d), ["id", "pair_id", "language", "sub_topic"])


@query("b23_flow_ids", f"WITH {RECORDS} SELECT flow_id, language, mode, substr(flow_id, 1, 10) || CASE mode WHEN 'full_dump' THEN '-DUMP-' ELSE '-INC-' END || upper(language) || '-001' AS short_id, upper(flow_id || '-' || mode) AS pair_key FROM g")
def _(spark, d):
    s = flows.heads(_steps(spark, d))
    short = F.when(F.col("mode") == "full_dump", questions.flow_question_id(F.col("flow_id"), "DUMP", F.col("language"), F.lit(1), True)).otherwise(
        questions.flow_question_id(F.col("flow_id"), "INC", F.col("language"), F.lit(1), True))
    return s.select("flow_id", "language", "mode", short.alias("short_id"), F.upper(F.concat_ws("-", "flow_id", "mode")).alias("pair_key"))


def _flow_questions(spark, d):
    base = F.regexp_replace("sub_topic", "-(Incremental|FullDump)$", "")
    mode = F.when(F.col("id").contains("-INC-"), "incremental").otherwise("fulldump")
    return _flat(spark, d).select(base.alias("base"), mode.alias("mode"), "language", "step", "part", "id", "question", "expected_answer")


FLOWQ = FLAT.replace("flat AS (", "fq AS (")
AUTO = f"""{FLOWQ}, m AS (SELECT base, bool_or(mode = 'incremental') AS inc, bool_or(mode = 'fulldump') AS dump FROM fq GROUP BY 1),
s AS (SELECT base, row_number() OVER (ORDER BY {H(5, 'base')}, base) AS pos FROM m WHERE inc),
pr AS (SELECT (pos + 1) // 2 AS session_no, arg_min(base, pos) AS a, arg_max(base, pos) AS b FROM s GROUP BY 1 HAVING count(*) = 2),
dm AS (SELECT base, row_number() OVER (ORDER BY {H('5-third', 'base')}, base) AS slot, count(*) OVER () AS total FROM m WHERE dump),
rg AS (SELECT pr.*, t.t, dm.base AS c FROM pr, (SELECT unnest([0, 1, 2]) AS t) t JOIN dm ON dm.slot = (pr.session_no - 1 + t.t) % dm.total + 1 WHERE dm.base <> pr.a AND dm.base <> pr.b),
pl AS (SELECT session_no, a AS first, b AS second, arg_min(c, t) AS third FROM rg GROUP BY 1, 2, 3)"""


@query("f11_auto_flow_plan", f"WITH {AUTO} SELECT session_no, first, second, third FROM pl")
def _(spark, d):
    return sessions.auto_flow_plan(_flow_questions(spark, d), 5)


@query("f11_compose_flows", f"""WITH {AUTO}, parts AS (SELECT session_no, 0 AS slot, first AS base, 'incremental' AS mode FROM pl UNION ALL SELECT session_no, 1, second, 'incremental' FROM pl UNION ALL SELECT session_no, 2, third, 'fulldump' FROM pl),
rw AS (SELECT parts.session_no, slot, fq.* FROM parts JOIN fq USING (base, mode)), ok AS (SELECT session_no, language FROM rw GROUP BY 1, 2 HAVING count(DISTINCT slot) = 3),
nb AS (SELECT *, row_number() OVER (ORDER BY session_no, language) AS number FROM ok)
SELECT session_id, language, turn, question_id, max(question) AS question, string_agg(coalesce(expected_answer, ''), ' ' ORDER BY part) AS expected_answer
FROM (SELECT format('MultiFlow-{{}}-{{:03d}}', language, number) AS session_id, language, dense_rank() OVER (PARTITION BY session_no, language ORDER BY slot, step) AS turn, part, id AS question_id, question, expected_answer
  FROM rw JOIN nb USING (session_no, language)) GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    """Turns of the composed sessions, each with its whole answer."""
    q = _flow_questions(spark, d)
    return flows.whole_answers(sessions.compose_flows(q, "first", "second", "third", sessions.auto_flow_plan(q, 5)), ["session_id", "language", "turn", "question_id"])


@query("e13_flow_pools", f"""WITH {RECORDS}, f AS (SELECT flow_id AS base, CASE mode WHEN 'full_dump' THEN 'fulldump' ELSE mode END AS mode, language FROM g)
SELECT base, count(*) FILTER (WHERE mode = 'incremental' AND language = 'ar') AS incremental_ar, count(*) FILTER (WHERE mode = 'incremental' AND language = 'en') AS incremental_en,
  count(*) FILTER (WHERE mode = 'fulldump' AND language = 'ar') AS fulldump_ar, count(*) FILTER (WHERE mode = 'fulldump' AND language = 'en') AS fulldump_en FROM f GROUP BY 1""")
def _(spark, d):
    s = flows.heads(_steps(spark, d))
    mode = F.when(F.col("mode") == "full_dump", "FullDump").otherwise("Incremental")
    return questions.flow_pools(s.select(F.concat("flow_id", F.lit("-"), mode, F.lit("_"), F.upper("language"), F.lit(".json")).alias("file")))


@query("b22_flow_file_name", """WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'My-Flow' || doc_id || '-Incremental_AR.json' WHEN 1 THEN 'F' || doc_id || '-fulldump_en.json' ELSE 'notes' || doc_id || '.json' END AS file FROM documents)
SELECT doc_id, regexp_extract(file, '^(.+?)-(Incremental|FullDump)_(ar|en)\\.json$', 1, 'i') AS base, lower(regexp_extract(file, '^(.+?)-(Incremental|FullDump)_(ar|en)\\.json$', 2, 'i')) AS mode, lower(regexp_extract(file, '^(.+?)-(Incremental|FullDump)_(ar|en)\\.json$', 3, 'i')) AS language FROM f""")
def _(spark, d):
    doc = table(spark, d, "documents")
    file = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("My-Flow"), "doc_id", F.lit("-Incremental_AR.json"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("F"), "doc_id", F.lit("-fulldump_en.json"))).otherwise(F.concat(F.lit("notes"), "doc_id", F.lit(".json")))
    return doc.select("doc_id", *[tx.flow_file_part(file, p).alias(p) for p in ("base", "mode", "language")])


@query("d11_pair_documents", """WITH RECURSIVE docs AS (SELECT doc_id + 1 AS idx FROM documents), n AS (SELECT count(*) AS c FROM docs),
w AS (SELECT idx, CASE WHEN idx % 3 = 0 THEN (idx * 7) % 900 + 1 WHEN idx % 10 = 1 THEN 40 END AS m FROM docs, n),
en AS (SELECT idx AS j FROM docs WHERE idx <= (SELECT c FROM n) - 20),
v AS (SELECT w.idx, en.j AS m FROM w LEFT JOIN en ON en.j = w.m), fc AS (SELECT m, min(idx) AS f FROM v WHERE m IS NOT NULL GROUP BY 1),
b AS (SELECT v.idx, v.m, fc.f = v.idx AS first FROM v LEFT JOIN fc USING (m)),
got AS (SELECT idx, m, coalesce(first, false) AND m >= idx AS g, coalesce(first, false) AND m < idx AS open FROM b),
res(idx, m, cur, done, g) AS (SELECT idx, m, CASE WHEN open THEN m ELSE idx END, NOT open, g FROM got UNION ALL
  SELECT res.idx, res.m, CASE WHEN got.open THEN got.m ELSE res.cur END, NOT got.open, got.g FROM res JOIN got ON got.idx = res.cur WHERE NOT res.done),
fin AS (SELECT idx, m, g FROM res WHERE done), man AS (SELECT idx, m AS j FROM fin WHERE g),
pos AS (SELECT fin.idx, fin.idx AS j FROM fin JOIN en ON en.j = fin.idx LEFT JOIN man ON man.j = fin.idx WHERE NOT fin.g AND (man.idx IS NULL OR man.idx > fin.idx)),
pr AS (SELECT idx, j, 'manual' AS how FROM man UNION ALL SELECT idx, j, 'position' FROM pos)
SELECT d.idx, 'ar' || d.idx AS ar_file, 'en' || pr.j AS en_file, coalesce(pr.how, 'unpaired_ar') AS how FROM docs d LEFT JOIN pr USING (idx)
UNION ALL SELECT NULL, NULL, 'en' || en.j, 'unpaired_en' FROM en WHERE en.j NOT IN (SELECT j FROM pr)""")
def _(spark, d):
    doc = table(spark, d, "documents").select((F.col("doc_id") + 1).alias("idx"))
    total = doc.agg(F.count(F.lit(1)).alias("c"))
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    ar = doc.select("idx", name("ar", F.col("idx")).alias("file"))
    en = doc.join(F.broadcast(total)).where(F.col("idx") <= F.col("c") - 20).select("idx", name("en", F.col("idx")).alias("file"))
    target = F.when(F.col("idx") % 3 == 0, F.col("idx") * 7 % 900 + 1).when(F.col("idx") % 10 == 1, F.lit(40))
    manual = doc.select(name("AR", F.col("idx")).alias("ar"), name(" EN", target).alias("en")).where(F.col("en").isNotNull())
    return kb.pair_documents(ar, en, manual)


# File layouts: written with a sink and read back with the matching scan -----------------------

@query("a15_a1_question_files", f"""WITH {FLAT} SELECT sub_topic, language, count(*) AS questions, CAST(sum(length(question)) AS BIGINT) AS chars, CAST(sum(length(expected_answer)) AS BIGINT) AS answer_chars FROM flat GROUP BY 1, 2""")
def _(spark, d):
    root = scratch_path(spark, "questions")
    writers.write_questions(_flat(spark, d), root)
    asked = readers.read_questions(spark, root, lines=True)
    return asked.groupBy("sub_topic", "language").agg(F.count(F.lit(1)).alias("questions"), F.sum(F.length("question")).alias("chars"), F.sum(F.length("expected_answer")).alias("answer_chars"))


@query("a14_a3_session_files", f"WITH {BUILD} SELECT format('{{}}-{{}}-{{:03d}}', sub_topic, language, session_no) AS session_id, language, CAST(turn AS INTEGER) AS turn, CAST(id AS VARCHAR) AS question_id FROM built")
def _(spark, d):
    pool = i.pool(spark, d)
    built = sessions.build(pool, 10, 7).select("session_id", F.concat_ws("/", "topic", "sub_topic").alias("subtopic"), "language", F.col("turn").cast("int").alias("turn"), F.col("id").cast("string").alias("question_id"))
    texts = pool.select(F.col("id").cast("string").alias("question_id"), "question", "expected_answer", F.format_string("wav/%d.wav", "id").alias("audio_file"))
    root = scratch_path(spark, "sessions")
    writers.write_sessions(built.join(texts, "question_id"), root)
    return readers.session_turns(readers.read_sessions(spark, root)).select("session_id", "language", "turn", "question_id")


@query("a16_a7_flow_files", f"WITH {RECORDS} SELECT flow_id, mode, language, step_n, question, expected_answer FROM st")
def _(spark, d):
    """Flat steps written by flow and read back."""
    root = scratch_path(spark, "flow-steps")
    writers.write_flow_steps(_steps(spark, d), root)
    return readers.read_flow_steps(spark, root).select("flow_id", "mode", "language", "step_n", "question", "expected_answer")


SPECS = """per AS (SELECT flow_id, language, mode, count(*) AS n, md5(CASE mode WHEN 'full_dump' THEN string_agg(expected_answer, ' ' ORDER BY ord) ELSE string_agg(question || '|' || expected_answer, '#' ORDER BY ord) END) AS said,
  md5(arg_min(question, ord)) AS question FROM rec GROUP BY 1, 2, 3)"""


@query("a16_a7_flow_specs", f"""WITH {RECORDS}, {SPECS} SELECT flow_id, flow_id AS title, flow_id || '-' || CASE mode WHEN 'full_dump' THEN 'DUMP' ELSE 'INC' END || '-' || upper(language) AS id, language, mode, question, said,
  CASE mode WHEN 'full_dump' THEN -1 ELSE n END AS steps FROM per""")
def _(spark, d):
    """Nested documents, one per flow, written from sorted pieces and read with the scan of flow specifications."""
    root = scratch_path(spark, "flows")
    writers.write_flows(_steps(spark, d), root)
    s = readers.spec_scenarios(readers.read_flow_specs(spark, root, lines=False, glob="*.txt"))
    said = F.when(F.col("mode") == "full_dump", F.col("expected_answer")).otherwise(
        F.array_join(F.transform("steps", lambda x: F.concat(x["stimulus"], F.lit("|"), x["expected_answer"])), "#"))
    return s.select("flow_id", "title", "id", "language", "mode", F.md5("question").alias("question"), F.md5(said).alias("said"), F.coalesce(F.size("steps"), F.lit(-1)).cast("bigint").alias("steps"))


@query("a8_flow_replies", f"""WITH {RECORDS} SELECT '' AS bad_file, flow_id, count(*) AS scenarios, CAST(sum(CASE WHEN mode = 'incremental' THEN n ELSE 0 END) AS BIGINT) AS steps FROM g GROUP BY 2
UNION ALL SELECT DISTINCT 'bad-' || (doc_id % 3) || '.txt', '', 0, 0 FROM documents""")
def _(spark, d):
    """Reply files, an object per flow among files that are no JSON, read back with the tolerant import that cuts large files."""
    folder = scratch_path(spark, "replies")
    writers.write_flows(_steps(spark, d), folder)
    lost = table(spark, d, "documents").select(F.concat(F.lit("bad-"), F.col("doc_id") % 3, F.lit(".txt")).alias("file")).distinct()
    broken = lost.select(F.lit("{ no record").alias("value"), "file").repartition("file")
    broken.write.mode("append").partitionBy("file").text(folder)
    good, bad = replies.read_reply_scenarios(spark, folder, "*.txt")
    counted = good.groupBy("flow_id").agg(F.count(F.lit(1)).alias("scenarios"), F.sum(F.greatest(F.coalesce("n_steps", F.lit(0)), F.lit(0))).alias("steps"))
    none = F.lit(0).cast("bigint")
    return counted.select(F.lit("").alias("bad_file"), "flow_id", "scenarios", "steps").unionByName(
        bad.select(F.regexp_extract("path", "/file=([^/]*)/", 1).alias("bad_file"), F.lit("").alias("flow_id"), none.alias("scenarios"), none.alias("steps")).distinct())


@query("a5_newest_artifact", """WITH f AS (SELECT event_type AS kind, CASE WHEN event_id % 10 = 0 THEN 'eval-results-backup' || event_id || '.json' ELSE 'eval-results-' || strftime(ts, '%Y-%m-%dT%H-00-00') || '-000Z-j' || event_id || '.json' END AS name, event_id * 7 % 1000 AS mtime FROM events)
SELECT kind, name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY regexp_extract(name, '(\\d{4}-\\d{2}-\\d{2}T\\d{2}-\\d{2}-\\d{2}(?:-\\d+)?Z?)', 1) DESC, mtime DESC, name DESC) AS k FROM f) WHERE k = 1""")
def _(spark, d):
    from convqa.operators import matching

    e = table(spark, d, "events")
    stamped = F.concat(F.lit("eval-results-"), F.date_format("ts", "yyyy-MM-dd'T'HH-00-00"), F.lit("-000Z-j"), "event_id", F.lit(".json"))
    name = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("eval-results-backup"), "event_id", F.lit(".json"))).otherwise(stamped)
    return matching.newest_artifact(e.select(F.col("event_type").alias("kind"), name.alias("name"), (F.col("event_id") * 7 % 1000).alias("mtime")), ["kind"])


@query("l1_validate_questions", """WITH q AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'X' || doc_id ELSE 'Q' || (doc_id - CASE WHEN doc_id % 10 = 7 THEN 1 ELSE 0 END) END AS qid, CASE WHEN doc_id % 8 = 0 THEN '' ELSE 'P1' END AS pair,
  CASE WHEN lang = 'fr' THEN 'ar' ELSE lang END AS language, CASE WHEN doc_id % 6 = 0 THEN '  ' ELSE text END AS question FROM documents)
SELECT qid AS id, 'invalid id' AS issue FROM q WHERE NOT regexp_matches(qid, '^Q\\d+$') UNION ALL SELECT qid, 'missing pair_id' FROM q WHERE pair = ''
UNION ALL SELECT qid, 'language must be en/ar' FROM q WHERE language NOT IN ('ar', 'en') UNION ALL SELECT qid, 'question is empty' FROM q WHERE NOT regexp_matches(question, '\\S')
UNION ALL SELECT qid, 'source_chunks must be a non-empty array' FROM q WHERE doc_id % 5 = 0
UNION ALL SELECT qid, 'duplicate id' FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS k FROM q) WHERE k > 1
UNION ALL SELECT qid, format('unknown source chunk "chunk_{:03d}"', doc_id + 10) FROM q WHERE doc_id % 5 <> 0 AND doc_id + 10 NOT IN (SELECT doc_id FROM documents)""")
def _(spark, d):
    doc = table(spark, d, "documents")
    q = doc.select(
        F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("X"), "doc_id")).otherwise(F.concat(F.lit("Q"), F.col("doc_id") - F.when(F.col("doc_id") % 10 == 7, 1).otherwise(0))).alias("id"),
        F.when(F.col("doc_id") % 8 == 0, "").otherwise("P1").alias("pair_id"), F.when(F.col("lang") == "fr", "ar").otherwise(F.col("lang")).alias("language"),
        F.when(F.col("doc_id") % 6 == 0, "  ").otherwise(F.col("text")).alias("question"), F.lit("a").alias("expected_answer"),
        F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.format_string("chunk_%03d", F.col("doc_id") + 10), F.lit("some excerpt"))).alias("source_chunks"))
    return quality.validate_questions(q, i.chunks(spark, d))


@query("l2_validate_generated", """SELECT 'Q' || doc_id AS id, format('unknown source chunk "{}"', x) AS issue FROM (SELECT doc_id, unnest([format('chunk_{:03d}', doc_id + 10), 'some excerpt']) AS x FROM documents) WHERE x NOT IN (SELECT format('chunk_{:03d}', doc_id) FROM documents)""")
def _(spark, d):
    doc = table(spark, d, "documents")
    q = doc.select(F.concat(F.lit("Q"), "doc_id").alias("id"), F.lit("P1").alias("pair_id"), F.lit("en").alias("language"), F.lit("q").alias("question"), F.lit("a").alias("expected_answer"),
                   F.array(F.format_string("chunk_%03d", F.col("doc_id") + 10), F.lit("some excerpt")).alias("source_chunks"))
    return quality.validate_questions(q, i.chunks(spark, d), strict=True)


IMPORT = """q AS (SELECT 'Q' || (doc_id // 2) AS qid, doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS language, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS answer FROM documents),
iss AS (SELECT qid AS id, 'missing/empty "language"' AS issue FROM q WHERE language = '' UNION ALL SELECT qid, 'missing/empty "expected_answer"' FROM q WHERE answer IS NULL OR answer = ''
UNION ALL SELECT qid, 'duplicate id' FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS k FROM q) WHERE k > 1
UNION ALL SELECT qid, format('unknown source chunk "chunk_{:03d}"', doc_id + 5) FROM q WHERE doc_id + 5 NOT IN (SELECT doc_id FROM documents))"""


def _import_issues(spark, d):
    doc = table(spark, d, "documents")
    q = doc.select(F.concat(F.lit("Q"), F.expr("doc_id div 2")).alias("id"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("lang")).alias("language"), F.lit("t").alias("topic"), F.lit("s").alias("sub_topic"),
                   F.lit("q").alias("question"), F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("expected_answer"), F.array(F.lit("x")).alias("source_chunks"),
                   F.array(F.format_string("chunk_%03d", F.col("doc_id") + 5)).alias("chunk_ids"))
    return quality.validate_import(q, i.chunks(spark, d))


@query("l3_validate_import", f"WITH {IMPORT} SELECT id, issue FROM iss")
def _(spark, d):
    return _import_issues(spark, d)


@query("e24_issue_summary", f"""WITH {IMPORT}, k AS (SELECT id, issue, trim(regexp_replace(issue, '"[^"]*"$', '')) AS kind FROM iss), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id, issue) AS n FROM k)
SELECT kind, count(*) AS problems, string_agg(id, ',' ORDER BY id) FILTER (WHERE n <= 15) AS examples FROM r GROUP BY 1""")
def _(spark, d):
    return quality.summary(_import_issues(spark, d)).withColumn("examples", F.array_join("examples", ","))


@query("l4_validate_flows", """WITH q AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS language, CASE WHEN doc_id % 2 = 0 THEN 'incremental' ELSE 'full_dump' END AS mode, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS answer, CASE WHEN doc_id % 3 = 0 THEN 'what ???' ELSE text END AS question FROM documents)
SELECT 'F' || doc_id AS id, 'missing language' AS issue FROM q WHERE language = '' UNION ALL SELECT 'F' || doc_id, 'missing question' FROM q WHERE NOT regexp_matches(question, '\\S')
UNION ALL SELECT 'F' || doc_id, 'full_dump missing expected_answer' FROM q WHERE mode = 'full_dump' AND NOT regexp_matches(answer, '\\S')
UNION ALL SELECT 'F' || doc_id, 'step1: missing expected_answer' FROM q WHERE mode = 'incremental' AND answer = '' UNION ALL SELECT 'F' || doc_id, 'step1: missing stimulus' FROM q WHERE mode = 'incremental' AND question = '' UNION ALL SELECT 'F' || doc_id, 'step2: missing stimulus' FROM q WHERE mode = 'incremental'
UNION ALL SELECT 'F' || doc_id, 'question has ??? pattern' FROM q WHERE regexp_matches(question, '\\?{3,}') UNION ALL SELECT 'F' || doc_id, 'expected_answer has ??? pattern' FROM q WHERE regexp_matches(answer, '\\?{3,}')
UNION ALL SELECT 'F' || doc_id, 'step expected_answer has ??? pattern' FROM q WHERE mode = 'incremental' AND regexp_matches(answer, '\\?{3,}') UNION ALL SELECT 'F' || doc_id, 'step stimulus has ??? pattern' FROM q WHERE mode = 'incremental' AND regexp_matches(question, '\\?{3,}')""")
def _(spark, d):
    doc = table(spark, d, "documents")
    q = doc.select(
        F.concat(F.lit("F"), "doc_id").alias("flow_id"), F.lit("").alias("id"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("lang")).alias("language"), F.lit("t").alias("sub_topic"),
        F.when(F.col("doc_id") % 2 == 0, "incremental").otherwise("full_dump").alias("mode"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("expected_answer"),
        F.when(F.col("doc_id") % 3 == 0, "what ???").otherwise(F.col("text")).alias("question"))
    step = lambda n, s: F.struct(F.lit(n).alias("step_n"), s.alias("stimulus"), (F.col("expected_answer") if n == 1 else F.lit("x")).alias("expected_answer"), F.array(F.lit("c")).alias("chunk_ids"))
    q = q.withColumn("steps", F.when(F.col("mode") == "incremental", F.array(step(1, F.col("question")), step(2, F.lit("")))))
    return quality.validate_flows(q, limit=8)


@query("l7_grounding_rules", """WITH r AS (SELECT doc_id AS id, text AS question, text || ' 77' AS answer, text AS document, CASE WHEN doc_id % 4 = 0 THEN upper(text) || '#' ELSE text END AS src FROM documents),
nums AS (SELECT id, list_distinct([regexp_replace(n, '[,.]+$', '') FOR n IN regexp_extract_all(answer, '\\d[\\d,.]*')]) AS a, list_distinct([regexp_replace(n, '[,.]+$', '') FOR n IN regexp_extract_all(src, '\\d[\\d,.]*')]) AS s FROM r),
k AS (SELECT id, """ + i.normalize_sql("question") + """ AS k FROM r)
SELECT id, 'number not in sources: ' || n AS issue FROM (SELECT id, unnest([x FOR x IN a IF NOT list_contains(s, x)]) AS n FROM nums) UNION ALL SELECT id, 'excerpt is not verbatim' FROM r WHERE NOT contains(document, src)
UNION ALL SELECT id, 'question is not distinct' FROM (SELECT id, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM k) WHERE n > 1""")
def _(spark, d):
    doc = table(spark, d, "documents")
    src = F.when(F.col("doc_id") % 4 == 0, F.concat(F.upper("text"), F.lit("#"))).otherwise(F.col("text"))
    r = doc.select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.concat("text", F.lit(" 77")).alias("expected_answer"), F.array(src).alias("sources"), F.col("text").alias("document"))
    return quality.grounding_issues(r)


@query("b21_garbled_text", "SELECT doc_id, regexp_matches(text, '\\?{3,}') AS own, regexp_matches(text || CASE WHEN doc_id % 9 = 0 THEN ' ????' ELSE ' ??' END, '\\?{3,}') AS garbled FROM documents")
def _(spark, d):
    tail = F.when(F.col("doc_id") % 9 == 0, " ????").otherwise(" ??")
    return table(spark, d, "documents").select("doc_id", tx.looks_garbled("text").alias("own"), tx.looks_garbled(F.concat("text", tail)).alias("garbled"))
