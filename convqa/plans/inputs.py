"""Driver tables in the roles the operators expect, in Spark and as SQL with the same formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convqa.functions import text as tx
from convqa.functions.deflection import Patterns
from convqa.operators import ordered, transcripts
from convqa.plans.registry import table

# The driver texts are invented words, so these lists and this script range stand in for the real ones.
NO_INFO = ("ofthe|in thor",)
HAND_OFF = ("(thand|whthan|that of)",)
CORPUS_PATTERNS = {"en": Patterns(NO_INFO, HAND_OFF)}
SCRIPT = "[À-ɏ]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def speaker_sql(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower(coalesce({c}, '')), 'agent|assistant|ai|bot') THEN 'agent' "
        f"WHEN regexp_matches(lower(coalesce({c}, '')), 'customer|caller|user|human|client') THEN 'customer' "
        f"WHEN coalesce({c}, '') = '' THEN 'unknown' ELSE lower({c}) END"
    )


def normalize_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[\\x{{0640}}\\x{{064B}}-\\x{{0670}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    return f"[x FOR x IN string_split({normalize_sql(c)}, ' ') IF x <> '']"


def language_sql(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN '?' WHEN regexp_matches({c}, '{SCRIPT}') THEN 'fr' ELSE 'en' END"


def deflection_sql(c: str) -> str:
    text = strip_sql(f"coalesce({c}, '')")
    tests = [f"regexp_matches({text}, '{p}', 'is')" for p in NO_INFO]
    tests += [
        f"(regexp_matches({text}, '{p}', 'is') AND length({strip_sql(f'''regexp_extract({text}, '^(.*?)(?:{p})', 1, 'is')''')}) < 40)" for p in HAND_OFF
    ]
    return "(" + " OR ".join(tests) + ")"


def turns(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.from_conversations(table(spark, d, "conversations"))


TURNS = f"turns AS (SELECT conv_id, turn AS ord, {speaker_sql('role')} AS speaker, {strip_sql('coalesce(text, chr(32))')} AS text FROM conversations)"


def sub_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a turn as a turn of its own, and every seventh agent turn left without text."""
    raw = table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    silent = (tx.canonical_speaker("role") == "agent") & ((F.col("conv_id") * 3 + F.col("turn")) % 7 == 0)
    return raw.select(
        "conv_id", (F.col("turn") * 10000 + F.col("pos")).alias("ord"), tx.canonical_speaker("role").alias("speaker"),
        F.when(silent, "").otherwise(tx.strip("line")).alias("text"))


SUB = f"""sub AS (SELECT conv_id, turn * 10000 + pos AS ord, speaker,
  CASE WHEN speaker = 'agent' AND (conv_id * 3 + turn) % 7 = 0 THEN '' ELSE {strip_sql('line')} END AS text
  FROM (SELECT conv_id, turn, {speaker_sql('role')} AS speaker, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM conversations))"""

PAIRS = f"""{SUB},
two AS (SELECT * FROM sub WHERE speaker IN ('agent', 'customer') AND (regexp_matches(text, '\\S') OR speaker = 'agent')),
marked AS (SELECT *, CASE WHEN speaker = 'customer' AND coalesce(lag(speaker) OVER (PARTITION BY conv_id ORDER BY ord), '') <> 'customer' THEN 1 ELSE 0 END AS opens FROM two),
numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY conv_id ORDER BY ord) AS BIGINT) AS pair FROM marked),
pairs AS (SELECT conv_id, pair,
  arg_max(text, length(text) * 1000000000 - ord) FILTER (WHERE speaker = 'customer') AS question,
  nullif(arg_min(text, ord) FILTER (WHERE speaker = 'agent'), '') AS answer
  FROM numbered WHERE pair > 0 GROUP BY conv_id, pair)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.pair(sub_turns(spark, d))


def captured(spark: SparkSession, d: str) -> DataFrame:
    """Captured answers out of the conversation pairs; latencies follow a fixed formula."""
    p = pairs(spark, d)
    c, n = F.col("conv_id"), F.col("pair")
    latency = F.when(F.col("answer").isNotNull() & ((c + n) % 5 != 0), (c * 37 + n * 911) % 9000)
    return p.select(
        F.concat(F.lit("S"), c.cast("string")).alias("session_id"), n.alias("turn"), F.concat(F.lit("Q"), (c % 50).cast("string"), F.lit("-"), n.cast("string")).alias("question_id"),
        tx.detect_language("question", SCRIPT, "fr").alias("language"), "question", "answer", F.col("question").alias("expected_answer"),
        F.concat(F.lit("C"), c.cast("string")).alias("conversation_id"), latency.alias("latency_ms"), F.when(latency.isNotNull(), F.floor(latency / 2)).alias("first_audio_ms"),
        F.array("question").alias("source_chunks"), F.array(F.concat(F.lit("f"), (c % 9).cast("string"))).alias("source_file_ids"))


CAPTURED = f"""{PAIRS},
captured AS (SELECT 'S' || conv_id AS session_id, pair AS turn, 'Q' || (conv_id % 50) || '-' || pair AS question_id, {language_sql('question')} AS language,
  question, answer, question AS expected_answer, 'C' || conv_id AS conversation_id,
  CASE WHEN answer IS NOT NULL AND (conv_id + pair) % 5 <> 0 THEN (conv_id * 37 + pair * 911) % 9000 END AS latency_ms,
  CASE WHEN answer IS NOT NULL AND (conv_id + pair) % 5 <> 0 THEN CAST(floor(((conv_id * 37 + pair * 911) % 9000) / 2.0) AS BIGINT) END AS first_audio_ms
  FROM pairs)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"), F.format_string("chunk_%03d", "doc_id").alias("id"), "text", F.col("lang").alias("language"), F.col("source").alias("grp"))


CHUNKS = "chunks AS (SELECT doc_id AS ord, format('chunk_{:03d}', doc_id) AS id, text, lang AS language, source AS grp FROM documents)"


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Question pool: one question per document, source as topic and sub topic."""
    doc = table(spark, d, "documents")
    return doc.select(
        F.col("doc_id").alias("id"), F.lit("KB").alias("topic"), F.coalesce("source", F.lit("none")).alias("sub_topic"), F.col("lang").alias("language"),
        F.col("text").alias("question"), F.col("text").alias("expected_answer"))


POOL = "pool AS (SELECT doc_id AS id, 'KB' AS topic, coalesce(source, 'none') AS sub_topic, lang AS language, text AS question, text AS expected_answer FROM documents)"


def checks(spark: SparkSession, d: str) -> DataFrame:
    """Clip outcomes: order = session, line number = position."""
    li = table(spark, d, "lineitem")
    dealt = ordered.in_tasks(li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_partkey"), li.count(), "l_orderkey", F.col("l_linenumber").cast("bigint"))
    return dealt.groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("bigint").alias("ord")).agg(
        (F.max("l_returnflag") != "R").alias("responded"), F.floor(F.max("l_extendedprice") / 10).alias("__lat"),
        F.max("l_partkey").alias("__part"),
    ).select(
        "session_id", "ord", "responded", F.when(F.col("responded"), F.col("__lat")).alias("latency_ms"),
        F.when(~F.col("responded"), F.when(F.col("__part") % 3 == 0, "ws error: closed").otherwise("no reply")).alias("error"),
        F.format_string("%03d_Q%d.wav", F.col("ord"), F.col("__part")).alias("clip"))


CHECKS = """raw_checks AS (SELECT l_orderkey AS session_id, CAST(l_linenumber AS BIGINT) AS ord, max(l_returnflag) <> 'R' AS responded,
  CAST(floor(max(l_extendedprice) / 10) AS BIGINT) AS lat, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
checks AS (SELECT session_id, ord, responded, CASE WHEN responded THEN lat END AS latency_ms,
  CASE WHEN NOT responded THEN CASE WHEN part % 3 = 0 THEN 'ws error: closed' ELSE 'no reply' END END AS error,
  format('{:03d}_Q{}.wav', ord, part) AS clip FROM raw_checks)"""


def run_sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("session_id"), F.when(F.col("o_custkey") % 2 == 0, "ar").otherwise("en").alias("language"),
        (F.col("o_orderkey") % 5 + 1).alias("turns"), F.col("o_orderstatus").alias("run"))


SESSIONS = "sessions AS (SELECT o_orderkey AS session_id, CASE WHEN o_custkey % 2 = 0 THEN 'ar' ELSE 'en' END AS language, o_orderkey % 5 + 1 AS turns, o_orderstatus AS run FROM orders)"


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Event log as frame log: user = session, event id = sequence, ``k`` = file."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("user_id").alias("session_id"), tx.epoch_ms("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), "value", k.alias("k"), "ts")


FRAMES = "frames AS (SELECT user_id AS session_id, epoch_us(ts) // 1000 AS tm, event_id AS seq, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as replies: ``turn`` is the event id, which grows with time."""
    f = frames(spark, d).where(F.col("kind") == "purchase")
    return f.select("session_id", F.col("seq").alias("turn"), F.lit(1704067200000).cast("bigint").alias("call_start"), F.col("at").alias("reply_at"),
                    F.when(F.col("k") % 4 != 0, F.floor(F.col("value") * 100)).alias("latency_ms"))


REPLIES = """replies AS (SELECT session_id, seq AS turn, CAST(1704067200000 AS BIGINT) AS call_start, tm AS reply_at,
  CASE WHEN k % 4 <> 0 THEN CAST(floor(value * 100) AS BIGINT) END AS latency_ms FROM frames WHERE kind = 'purchase')"""
