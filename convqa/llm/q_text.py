"""Queries over texts that need no exchange of rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convqa.llm import pseudonyms, quality_rules, sentencepiece_bpe, token_files
from convqa.llm.registry import query, table


def _phrases_sql(phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, '{p}')" for p in phrases) + ")"


_R = quality_rules.LineRules()
_WS = "[\\x20\\x09-\\x0D]"
_QUOTED = {"terminal": _R.terminal.replace("'", "''"), "inner": _R.inner.replace("'", "''")}

QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, [x FOR x IN regexp_split_to_array(t, '{_WS}+') IF x <> ''] AS words FROM d),
lines AS (SELECT doc_id, line, regexp_replace(line, '{_WS}', '', 'g') AS vis, lower(line) AS low,
    len([x FOR x IN regexp_split_to_array(line, '{_WS}+') IF x <> '']) AS words
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
sized AS (SELECT *, length(vis) AS chars, length(regexp_replace(vis, '[^#*$%&|<>]', '', 'g')) AS syms,
    length(regexp_replace(vis, '[^!?]', '', 'g')) AS shouts, length(regexp_replace(vis, '[^|»›•·¦]', '', 'g')) AS seps FROM lines),
judged AS (SELECT doc_id, line, chars, CASE WHEN chars = 0 THEN FALSE
    WHEN syms > {_R.symbol_share} * chars THEN TRUE
    WHEN shouts > {_R.shout_share} * chars AND shouts > 3 THEN TRUE
    WHEN seps > {_R.separator_share} * words THEN TRUE
    WHEN words <= {_R.short_line_words} AND {_phrases_sql(_R.navigation)} THEN TRUE
    WHEN words <= {_R.short_line_words} AND {_phrases_sql(_R.boilerplate)} THEN TRUE
    WHEN NOT regexp_matches(line, '{_QUOTED["terminal"]}') AND NOT (words >= {_R.running_words} AND regexp_matches(line, '{_QUOTED["inner"]}')) THEN TRUE
    ELSE FALSE END AS failed FROM sized),
per_line AS (SELECT doc_id, sum(chars) FILTER (WHERE failed) AS lost,
    count(*) FILTER (WHERE chars > 0) - count(DISTINCT line) FILTER (WHERE chars > 0) AS dups FROM judged GROUP BY doc_id),
win AS (SELECT doc_id, p, array_to_string(words[p:p + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS p FROM w)),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM win JOIN twice USING (doc_id, g), (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
base AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(t, '{_WS}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, per_line.dups AS n_dup_lines,
    coalesce(inside.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w JOIN per_line USING (doc_id) LEFT JOIN inside USING (doc_id)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND lost <= {_R.lost_share} * word_chars AS kept FROM failed"""


@query("op5_quality_rules", QUALITY_SQL)
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.clean(table(spark, sf_dir, "documents"), made=counts).select("doc_id", *counts)


@query("op2_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


# A deployment passes its own key; this one makes the query repeatable.
QUERY_KEY = b"one key for the registered query"


@query("op4_pseudonyms")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, QUERY_KEY).withColumn("n_private", F.size("private").cast("long"))


@query("op8_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = token_files.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_files.count(table(spark, sf_dir, "documents"), encoder, end_id=50256).select("doc_id", "n_tokens")
