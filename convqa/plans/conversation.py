"""Queries over transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from convqa.functions import similarity as sim
from convqa.functions import text as tx
from convqa.functions.deflection import fired_pattern, is_deflection
from convqa.operators import capture, evaluation, ordered, quality, transcripts
from convqa.plans import inputs as i
from convqa.plans.registry import query, table

W = "PARTITION BY conv_id ORDER BY ord"

ANSWER_STATS = f"""WITH {i.CAPTURED},
flagged AS (SELECT *, coalesce(answer, '') <> '' AS a, coalesce(answer, '') <> '' AND {i.deflection_sql('answer')} AS dfl FROM captured)
SELECT language, count(*) AS total_turns, count(*) FILTER (WHERE a) AS answered, count(*) FILTER (WHERE NOT a) AS unanswered,
  count(*) FILTER (WHERE dfl) AS deflections, round_even(100.0 * count(*) FILTER (WHERE a) / count(*), 1) AS answer_rate,
  CAST(round_even(avg(latency_ms) FILTER (WHERE a), 0) AS BIGINT) AS avg_latency_ms, CASE WHEN grouping(language) = 1 THEN 'overall' ELSE 'language' END AS scope
FROM flagged GROUP BY GROUPING SETS ((), (language))"""


@query("e1_answer_stats", ANSWER_STATS)
def answer_stats(spark, d):
    return evaluation.answer_stats(i.captured(spark, d), ["language"], i.CORPUS_PATTERNS)


@query("f1_pair_transcript", f"WITH {i.PAIRS} SELECT conv_id, pair, question, answer FROM pairs")
def _(spark, d):
    return i.pairs(spark, d)


@query("f2_pair_exchanges", f"""WITH {i.SUB},
t AS (SELECT * FROM sub WHERE regexp_matches(text, '\\S') AND speaker IN ('agent', 'customer')),
m AS (SELECT *, CASE WHEN speaker <> 'agent' AND coalesce(lag(speaker) OVER ({W}), 'agent') = 'agent' THEN 1 ELSE 0 END AS opens FROM t),
n AS (SELECT *, CAST(sum(opens) OVER ({W}) AS BIGINT) AS exch FROM m)
SELECT conv_id, exch, string_agg(text, ' ' ORDER BY ord) FILTER (WHERE speaker <> 'agent') AS caller,
  coalesce(string_agg(text, ' ' ORDER BY ord) FILTER (WHERE speaker = 'agent'), '') AS reply FROM n GROUP BY 1, 2""")
def _(spark, d):
    two_sided = i.sub_turns(spark, d).where(F.col("speaker").isin("agent", "customer"))
    return transcripts.exchanges(transcripts.drop_empty(two_sided))


@query("f3_review_extract", f"""WITH {i.TURNS},
s AS (SELECT *, conv_id % 3 AS mode FROM turns)
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'https://app.test/en/agents/a1/conversations/' || conv_id ELSE '' END AS url,
  CASE WHEN mode = 2 THEN 'live' ELSE 'stored' END AS source, row_number() OVER (PARTITION BY conv_id ORDER BY ord) - 1 AS ord, speaker,
  CASE WHEN mode = 2 THEN text || '!' ELSE text END AS text FROM s WHERE text <> ''""")
def _(spark, d):
    t = i.turns(spark, d)
    turn = F.struct("speaker", "text")
    nested = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", turn.alias("t"), F.struct("speaker", F.concat("text", F.lit("!")).alias("text")).alias("u")))).alias("x"))
    stored = F.when(F.col("conv_id") % 3 != 2, F.transform("x", lambda e: e["t"]))
    summaries = nested.select(
        "conv_id", stored.alias("stored"), F.transform("x", lambda e: e["u"]).alias("live"),
        F.when(F.col("conv_id") % 2 == 0, "https://app.test").alias("app_url"), F.lit("a1").alias("agent_id"))
    return transcripts.review(summaries)


@query("f7_body_tokens", f"""WITH {i.TURNS},
s AS (SELECT conv_id, coalesce(min(ord) FILTER (WHERE speaker <> 'agent'), min(ord) + 1) AS start FROM turns WHERE speaker <> 'system' GROUP BY 1),
b AS (SELECT t.conv_id, unnest({i.tokens_sql('t.text')}) AS token FROM turns t JOIN s USING (conv_id) WHERE t.speaker <> 'system' AND t.ord >= s.start)
SELECT conv_id, token, count(*) AS n FROM b GROUP BY 1, 2""")
def _(spark, d):
    two_sided = i.turns(spark, d).where(F.col("speaker") != "system")
    return transcripts.token_counts(transcripts.body(two_sided), ["conv_id"])


@query("f13_merge_labels", f"""WITH {i.SUB}, t AS (SELECT * FROM sub WHERE regexp_matches(text, '\\S')),
m AS (SELECT *, CASE WHEN lag(speaker) OVER ({W}) = speaker THEN 0 ELSE 1 END AS c FROM t),
n AS (SELECT *, CAST(sum(c) OVER ({W}) AS BIGINT) AS run FROM m)
SELECT conv_id, run, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY ord) AS text FROM n GROUP BY 1, 2""")
def _(spark, d):
    return transcripts.merge_labels(i.sub_turns(spark, d))


@query("e14_transcript_profile", f"""WITH {i.SUB},
p AS (SELECT conv_id, speaker, count(*) AS a, count(*) FILTER (WHERE regexp_matches(text, '\\S')) AS f FROM sub GROUP BY 1, 2)
SELECT conv_id, CAST(sum(a) AS BIGINT) AS turn_count, CAST(sum(f) AS BIGINT) AS non_empty,
  coalesce(string_agg(speaker || '=' || f, ',' ORDER BY speaker) FILTER (WHERE f > 0), '') AS speakers, coalesce(bool_or(f > 0 AND speaker = 'customer'), false) AS has_customer,
  coalesce(bool_or(f > 0 AND speaker = 'agent'), false) AS has_agent FROM p GROUP BY 1""")
def _(spark, d):
    p = transcripts.profile(i.sub_turns(spark, d))
    entries = F.transform(F.map_entries("speaker_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return p.select("conv_id", "turn_count", "non_empty", F.array_join(entries, ",").alias("speakers"), "has_customer", "has_agent")


@query("l5_stored_transcript", f"""WITH {i.TURNS}, p AS (SELECT conv_id, count(*) FILTER (WHERE text <> '') AS n,
  count(*) FILTER (WHERE text <> '' AND speaker = 'customer') AS c, count(*) FILTER (WHERE text <> '' AND speaker = 'agent') AS g FROM turns GROUP BY 1)
SELECT conv_id, n >= 2 AND c > 0 AND g > 0 AS saved, CASE WHEN n < 2 THEN 'persisted transcript has ' || n || '/2 non-empty turn(s)'
  WHEN c = 0 OR g = 0 THEN 'persisted transcript does not contain both customer and agent turns' ELSE 'ok' END AS reason FROM p""")
def _(spark, d):
    return quality.validate_transcripts(i.turns(spark, d)).select("conv_id", "saved", "reason")


LIVE = f"""{i.TURNS}, live AS (SELECT conv_id, speaker, CASE WHEN (conv_id + ord) % 4 = 0 THEN split_part(text, '.', 1) ELSE '- ' || text || '!' END AS text FROM turns WHERE conv_id % 11 <> 0)"""


def _live(spark, d):
    t = i.turns(spark, d).where(F.col("conv_id") % 11 != 0)
    short = F.split_part("text", F.lit("."), F.lit(1))
    return t.withColumn("text", F.when((F.col("conv_id") + F.col("ord")) % 4 == 0, short).otherwise(F.concat(F.lit("- "), "text", F.lit("!"))))


@query("e15_compare_transcripts", f"""WITH {LIVE},
both_sides AS (SELECT conv_id, speaker, text, 1 AS l FROM live UNION ALL SELECT conv_id, speaker, text, 0 FROM turns),
cnt AS (SELECT conv_id, CAST(sum(l) AS BIGINT) AS live_count, CAST(sum(1 - l) AS BIGINT) AS stored_count FROM both_sides GROUP BY 1),
tok AS (SELECT conv_id, speaker, l, unnest({i.tokens_sql('text')}) AS token FROM both_sides),
sc AS (SELECT conv_id, 'overall' AS scope, l, token FROM tok UNION ALL SELECT conv_id, speaker, l, token FROM tok WHERE speaker IN ('agent', 'customer')),
per AS (SELECT conv_id, scope, token, sum(l) AS a, sum(1 - l) AS b FROM sc GROUP BY 1, 2, 3),
s AS (SELECT conv_id, scope, sum(a) AS a, sum(b) AS b, sum(least(a, b)) AS both_n FROM per GROUP BY 1, 2),
sims AS (SELECT conv_id, scope, floor(CASE WHEN a = 0 OR b = 0 THEN 0.0 ELSE 2.0 * both_n / (a + b) END * 100 + 0.5) / 100 AS sim FROM s),
piv AS (SELECT conv_id, coalesce(max(sim) FILTER (WHERE scope = 'overall'), 1.0) AS o, coalesce(max(sim) FILTER (WHERE scope = 'agent'), 1.0) AS g,
  coalesce(max(sim) FILTER (WHERE scope = 'customer'), 1.0) AS c FROM sims GROUP BY 1)
SELECT conv_id, live_count, stored_count, CAST(CASE WHEN live_count > 0 AND stored_count > 0 THEN o END AS DOUBLE) AS similarity,
  CAST(CASE WHEN live_count > 0 AND stored_count > 0 THEN g END AS DOUBLE) AS agent_similarity, CAST(CASE WHEN live_count > 0 AND stored_count > 0 THEN c END AS DOUBLE) AS customer_similarity,
  CASE WHEN live_count = 0 OR stored_count = 0 THEN 'SKIPPED' WHEN o >= 0.95 THEN 'PASS' WHEN o >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS result
FROM cnt LEFT JOIN piv USING (conv_id)""")
def _(spark, d):
    return transcripts.compare(_live(spark, d), i.turns(spark, d))


@query("d13_ordinal_zip", f"""WITH {i.SUB},
c AS (SELECT conv_id, text AS said, row_number() OVER ({W}) AS pos FROM sub WHERE speaker = 'customer'),
a AS (SELECT conv_id, text AS heard, row_number() OVER ({W}) AS pos FROM sub WHERE speaker = 'agent')
SELECT conv_id, pos, said, heard FROM c LEFT JOIN a USING (conv_id, pos)""")
def _(spark, d):
    t = i.sub_turns(spark, d)
    side = lambda s, n: t.where(F.col("speaker") == s).select("conv_id", F.col("ord").alias(f"{n}_ord"), F.col("text").alias(n))
    return transcripts.zip_ordinal(side("customer", "said"), side("agent", "heard"), ["conv_id"], "said_ord", "heard_ord").select("conv_id", "pos", "said", "heard")


@query("c4_drop_empty_turns", f"""WITH {i.SUB} SELECT conv_id, count(*) FILTER (WHERE regexp_matches(text, '\\S')) AS strict_turns,
  count(*) FILTER (WHERE regexp_matches(text, '\\S') OR speaker = 'agent') AS with_markers FROM sub GROUP BY 1""")
def _(spark, d):
    t = i.sub_turns(spark, d)
    n = lambda df, name: df.groupBy("conv_id").agg(F.count(F.lit(1)).alias(name))
    kept = n(transcripts.drop_empty(t, keep_agent=True), "with_markers")
    return kept.join(n(transcripts.drop_empty(t), "strict_turns"), "conv_id", "left").select(
        "conv_id", F.coalesce("strict_turns", F.lit(0)).alias("strict_turns"), "with_markers")


@query("b7_deflection", f"""WITH {i.PAIRS} SELECT conv_id, pair, {i.deflection_sql('answer')} AS deflected FROM pairs WHERE answer IS NOT NULL""")
def _(spark, d):
    p = i.pairs(spark, d).where(F.col("answer").isNotNull())
    return p.select("conv_id", "pair", is_deflection("answer", F.lit("en"), i.CORPUS_PATTERNS).alias("deflected"))


@query("k2_fired_pattern", f"""WITH {i.TURNS}, f AS (SELECT *, CASE WHEN regexp_matches(text, '{i.NO_INFO[0]}', 'is') THEN '{i.NO_INFO[0]}'
  WHEN {i.deflection_sql('text')} THEN '{i.HAND_OFF[0]}' END AS pattern FROM turns WHERE speaker = 'agent')
SELECT pattern, count(*) AS replies FROM f WHERE pattern IS NOT NULL GROUP BY 1""")
def _(spark, d):
    t = i.turns(spark, d).where(F.col("speaker") == "agent")
    fired = t.select(fired_pattern("text", F.lit("en"), i.CORPUS_PATTERNS).alias("pattern")).where(F.col("pattern").isNotNull())
    return fired.groupBy("pattern").agg(F.count(F.lit(1)).alias("replies"))


@query("b4_canonical_speaker", f"SELECT role, {i.speaker_sql('role')} AS speaker, count(*) AS turns FROM conversations GROUP BY 1, 2")
def _(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("role", tx.canonical_speaker("role").alias("speaker")).agg(F.count(F.lit(1)).alias("turns"))


@query("b2_normalize_text", f"SELECT conv_id, turn, {i.normalize_sql('text')} AS normalized FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.normalize_text("text").alias("normalized"))


LOOSE = "regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[\\x{{064B}}-\\x{{065F}}\\x{{0640}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}]', ' ', 'g')"


@query("b3_norm_text_loose", f"SELECT conv_id, turn, length({LOOSE.format(c='text')}) AS chars, {LOOSE.format(c='text')} AS loose FROM conversations")
def _(spark, d):
    loose = tx.norm_text_loose("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(loose).cast("bigint").alias("chars"), loose.alias("loose"))


@query("b5_tolerant_fields", """SELECT conv_id, turn, coalesce(CASE WHEN turn % 3 = 0 THEN role END, CASE WHEN turn % 3 = 1 THEN upper(role) END, 'typed') AS speaker,
  coalesce(nullif(CASE WHEN turn % 2 = 0 THEN text ELSE '' END, ''), text || '!') AS body, CASE WHEN turn % 4 = 0 THEN NULL WHEN turn % 4 = 1 THEN turn * 1.5::DOUBLE ELSE CAST(turn AS DOUBLE) END AS start_s FROM conversations""")
def _(spark, d):
    c = table(spark, d, "conversations")
    raw = c.select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).alias("speaker"), F.when(F.col("turn") % 3 == 1, F.upper("role")).alias("role"), F.lit("typed").alias("type"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("text"), F.concat("text", F.lit("!")).alias("message"),
        F.when(F.col("turn") % 4 == 0, "NaN").when(F.col("turn") % 4 == 1, (F.col("turn") * 1.5).cast("string")).alias("start"), F.col("turn").cast("string").alias("start_time"))
    return raw.select("conv_id", "turn", tx.first_text("speaker", "role", "type").alias("speaker"), tx.first_text("text", "message").alias("body"),
                      tx.finite("start", "start_time").alias("start_s"))


ACKS = "|".join(tx.ACK_WORDS)


@query("b6_turn_type", f"""WITH w AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN split_part(text, ' ', 1) WHEN 1 THEN 'OK !' WHEN 2 THEN text ELSE ' تمام.' END AS said FROM conversations)
SELECT conv_id, turn, CASE WHEN {i.strip_sql('said')} = '' OR regexp_matches({i.strip_sql('said')}, '^\\s*({ACKS})\\s*[!.]*$', 'i') THEN 'ack' ELSE 'question' END AS turn_type FROM w""")
def _(spark, d):
    c = table(spark, d, "conversations")
    said = F.when(F.col("turn") % 4 == 0, F.split_part("text", F.lit(" "), F.lit(1))).when(F.col("turn") % 4 == 1, "OK !").when(F.col("turn") % 4 == 2, F.col("text")).otherwise(" تمام.")
    return c.select("conv_id", "turn", tx.turn_type(said).alias("turn_type"))


@query("b25_word_overlap", f"""WITH {i.PAIRS},
w AS (SELECT conv_id, pair, list_distinct([x FOR x IN string_split({LOOSE.format(c='question')}, ' ') IF x <> '']) AS q, list_distinct([x FOR x IN string_split({LOOSE.format(c='answer')}, ' ') IF x <> '']) AS a FROM pairs)
SELECT conv_id, pair, round(CASE WHEN least(len(q), len(a)) > 0 THEN len(list_intersect(q, a)) / CAST(least(len(q), len(a)) AS DOUBLE) ELSE 0.0 END, 9) AS overlap FROM w""")
def _(spark, d):
    return i.pairs(spark, d).select("conv_id", "pair", F.round(sim.word_overlap("question", "answer"), 9).alias("overlap"))


@query("b26_dice", f"""WITH {i.PAIRS},
t AS (SELECT conv_id, pair, 1 AS l, unnest({i.tokens_sql('question')}) AS token FROM pairs UNION ALL SELECT conv_id, pair, 0, unnest({i.tokens_sql('answer')}) FROM pairs),
p AS (SELECT conv_id, pair, token, sum(l) AS a, sum(1 - l) AS b FROM t GROUP BY 1, 2, 3),
s AS (SELECT conv_id, pair, CASE WHEN sum(a) = 0 OR sum(b) = 0 THEN 0.0 ELSE 2.0 * sum(least(a, b)) / (sum(a) + sum(b)) END AS dice FROM p GROUP BY 1, 2)
SELECT pairs.conv_id, pairs.pair, CAST(round(coalesce(dice, 1.0), 9) AS DOUBLE) AS dice FROM pairs LEFT JOIN s USING (conv_id, pair)""")
def _(spark, d):
    return i.pairs(spark, d).select("conv_id", "pair", F.round(sim.dice("question", "answer"), 9).alias("dice"))


@query("b27_verbatim_ratio")
def _(spark, d):
    t = i.turns(spark, d)
    rewritten = F.when(F.col("ord") % 3 == 0, F.upper("text")).when(F.col("ord") % 3 == 1, F.regexp_replace("text", "\\s+", "  ")).otherwise(F.split_part("text", F.lit("."), F.lit(1)))
    ratio = t.select("conv_id", "ord", sim.verbatim_ratio("text", rewritten).alias("ratio"))
    return ratio.withColumn("accepted", F.col("ratio") >= 0.85)


@query("b29_labelled_lines", f"""WITH {i.TURNS},
l AS (SELECT conv_id, ord, speaker, i.line, row_number() OVER (PARTITION BY conv_id, ord ORDER BY i.pos) - 1 AS pos FROM turns,
  LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) i WHERE regexp_matches(i.line, '\\S') AND (conv_id + ord) % 6 <> 0)
SELECT conv_id, ord AS reply_no, pos AS ord, CASE WHEN speaker = 'agent' THEN 'AGENT' ELSE 'CUSTOMER' END AS speaker, {i.strip_sql('line')} AS text FROM l""")
def _(spark, d):
    label = F.when(F.col("speaker") == "agent", F.lit("bank: ")).otherwise("3. Caller : ")
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike("\\S")), lambda x: F.concat(label, x))
    broken = F.concat(F.array(F.lit("no label here")), lines)
    reply = F.array_join(F.when((F.col("conv_id") + F.col("ord")) % 6 == 0, broken).otherwise(lines), "\n")
    replies = i.turns(spark, d).select("conv_id", F.col("ord").alias("reply_no"), reply.alias("reply"))
    return transcripts.parse_labelled(replies)


@query("b30_label_array", f"""WITH {i.TURNS}, g AS (SELECT conv_id, count(*) AS n, string_agg(CASE WHEN speaker = 'agent' THEN 'AGENT' WHEN speaker = 'customer' THEN 'CUSTOMER' ELSE 'UNKNOWN' END, ',' ORDER BY ord) AS labels FROM turns GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 4 <> 3 THEN labels END AS labels FROM g""")
def _(spark, d):
    t = i.turns(spark, d)
    word = F.when(F.col("speaker") == "agent", "bank rep").when(F.col("speaker") == "customer", "Customer").otherwise("noise")
    g = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", word.alias("w")))).alias("x"))
    listed = F.to_json(F.transform("x", lambda e: e["w"]))
    reply = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).otherwise(F.concat(F.lit("Labels: "), listed))
    wanted = F.when(F.col("conv_id") % 4 == 3, F.col("n") + 1).otherwise(F.col("n"))
    return g.select("conv_id", F.array_join(transcripts.parse_label_array(reply, wanted), ",").alias("labels"))


@query("f14_label_plan", f"""WITH {i.SUB},
n AS (SELECT *, (row_number() OVER ({W}) - 1) // 12 AS chunk FROM sub),
g AS (SELECT conv_id, chunk, count(*) AS segments, arg_max(speaker, ord) AS last, (conv_id + chunk) % 3 <> 0 AS ok FROM n GROUP BY 1, 2)
SELECT conv_id, chunk, segments, CASE WHEN ok THEN 'resegment' ELSE 'classify' END AS method, lag(last) OVER (PARTITION BY conv_id ORDER BY chunk) AS context_speaker FROM g""")
def _(spark, d):
    plan = transcripts.label_plan(i.sub_turns(spark, d))
    turn = F.struct("speaker", "text")
    chunks = plan.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("segments"), F.array_sort(F.collect_list(F.struct("ord", turn.alias("t")))).alias("x"))
    chunks = chunks.select("conv_id", "chunk", "segments", F.transform("x", lambda e: e["t"]).alias("turns"), F.transform("x", lambda e: e["t"]).alias("fallback"),
                           ((F.col("conv_id") + F.col("chunk")) % 3 != 0).alias("verbatim"))
    accepted = transcripts.accept_labels(chunks)
    return chunks.select("conv_id", "chunk", "segments").join(accepted, ["conv_id", "chunk"]).select("conv_id", "chunk", "segments", "method", "context_speaker")


@query("j12_rebuild_transcript", f"""WITH {i.PAIRS} SELECT conv_id AS session_id, pair * 2 - 2 AS ord, 'customer' AS speaker, question AS text FROM pairs
UNION ALL SELECT conv_id, pair * 2 - 1, 'agent', coalesce(answer, '') FROM pairs""")
def _(spark, d):
    from convqa.streaming.frames import rebuild_transcript

    p = i.pairs(spark, d)
    return rebuild_transcript(p.select(F.col("conv_id").alias("session_id"), F.col("pair").alias("send_no"), "question", "answer", F.col("answer").isNotNull().alias("responded")))


_LOOSE_WORDS = lambda c: f"list_distinct([x FOR x IN string_split({LOOSE.format(c=c)}, ' ') IF x <> ''])"
_BEST = lambda w, q: f"greatest(CASE WHEN len({w}) > 0 AND len({q}.qw) > 0 THEN CAST(len(list_intersect({w}, {q}.qw)) AS DOUBLE) / least(len({w}), len({q}.qw)) ELSE 0 END, CASE WHEN len({w}) > 0 AND len({q}.ew) > 0 THEN CAST(len(list_intersect({w}, {q}.ew)) AS DOUBLE) / least(len({w}), len({q}.ew)) ELSE 0 END)"

ALIGN_SQL = f"""WITH RECURSIVE {i.PAIRS},
said AS (SELECT conv_id, ord, speaker = 'customer' AS asks, text, sum(CASE WHEN speaker = 'customer' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY ord) AS slot FROM sub WHERE speaker <> 'system' AND text <> ''),
u AS (SELECT conv_id, slot, max(CASE WHEN asks THEN text END) AS text, arg_min(text, ord) FILTER (WHERE NOT asks) AS reply FROM said WHERE slot > 0 GROUP BY 1, 2),
uw AS (SELECT *, {_LOOSE_WORDS('text')} AS w, length({LOOSE.format(c='text')}) AS chars FROM u),
q AS (SELECT conv_id, pair AS pos, {_LOOSE_WORDS('question')} AS qw, {_LOOSE_WORDS("coalesce(answer, '')")} AS ew FROM pairs),
walk(conv_id, slot, pos, answered) AS (SELECT conv_id, slot, CAST(1 AS BIGINT), reply IS NOT NULL FROM uw WHERE slot = 1 AND conv_id IN (SELECT conv_id FROM q)
  UNION ALL SELECT conv_id, slot, CASE WHEN stay THEN pos ELSE pos + 1 END, CASE WHEN stay THEN answered OR replied ELSE replied END FROM (
    SELECT conv_id, slot, pos, answered, replied, CASE WHEN last THEN TRUE WHEN answered THEN chars <= 12 AND here >= there - CAST(0.15 AS DOUBLE)
      WHEN here < CAST(0.1 AS DOUBLE) AND there < CAST(0.1 AS DOUBLE) THEN chars <= 8 ELSE there <= here END AS stay FROM (
      SELECT walk.conv_id, uw.slot, walk.pos, walk.answered, uw.reply IS NOT NULL AS replied, uw.chars, b.pos IS NULL AS last, {_BEST('uw.w', 'a')} AS here, {_BEST('uw.w', 'b')} AS there
      FROM walk JOIN uw ON uw.conv_id = walk.conv_id AND uw.slot = walk.slot + 1 JOIN q a ON a.conv_id = walk.conv_id AND a.pos = walk.pos LEFT JOIN q b ON b.conv_id = walk.conv_id AND b.pos = walk.pos + 1))),
got AS (SELECT walk.conv_id, pos, arg_max(text, length(text) * 1000000000 - slot) AS question, arg_min(reply, slot) FILTER (WHERE reply IS NOT NULL) AS answer FROM walk JOIN uw USING (conv_id, slot) GROUP BY 1, 2)
SELECT q.conv_id AS session_id, q.pos, 'Q' || q.conv_id || '-' || q.pos AS question_id, coalesce(got.question, '') AS question, got.answer FROM q LEFT JOIN got USING (conv_id, pos)"""


@query("f5_align_answers", ALIGN_SQL)
def _(spark, d):
    turns, order, questions = alignment_inputs(spark, d)
    return capture.align(turns, order, questions)


def alignment_inputs(spark, d):
    """Split utterances as transcript; the pairs' questions as script."""
    p = i.pairs(spark, d)
    ident = F.concat(F.lit("Q"), "conv_id", F.lit("-"), "pair")
    order = p.select(F.col("conv_id").alias("session_id"), F.col("pair").alias("pos"), ident.alias("question_id"))
    questions = p.select(ident.alias("id"), "question", F.coalesce("answer", F.lit("")).alias("expected_answer"))
    turns = i.sub_turns(spark, d).where(F.col("speaker") != "system").withColumnRenamed("conv_id", "session_id")
    return turns, order, questions


@query("j9_late_attribution", f"""WITH {i.FRAMES}, s AS (SELECT *, sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY tm, seq) AS send_no FROM frames)
SELECT session_id, CAST(send_no AS BIGINT) AS send_no, count(*) AS frames, count(*) FILTER (WHERE kind = 'click') AS sentences FROM s WHERE send_no >= 1 AND kind <> 'signup' GROUP BY 1, 2""")
def _(spark, d):
    f = i.frames(spark, d)
    sends = ordered.running_sum(f, ["session_id"], ["at", "seq"], F.when(F.col("kind") == "signup", 1).otherwise(0), "send_no", ordered.blocks_of("at", 86_400_000))
    return sends.where((F.col("send_no") >= 1) & (F.col("kind") != "signup")).groupBy("session_id", "send_no").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("kind") == "click").alias("sentences"))
