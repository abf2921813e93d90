"""Query of the trie of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convqa.llm import conversation_trie
from convqa.llm.registry import query, table

TRIE_SQL = """
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i))),
told AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(r)) || ':' || r || x)) AS p,
    md5(octet_length(encode(r)) || ':' || r || x) AS g, length(x) AS len
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, conv_id - ((conv_id % 100) + 100) % 100 AS base,
    xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM told), crc),
turns AS (SELECT ids.conv_id, p, g, len FROM ids JOIN told ON told.conv_id = ids.base WHERE p <= h
  UNION ALL SELECT ids.conv_id, p + 1000000, g, len FROM ids JOIN told USING (conv_id) WHERE p > h),
placed AS (SELECT conv_id, row_number() OVER w AS d, len, string_agg(g, '') OVER (w ROWS UNBOUNDED PRECEDING) AS k FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
members AS (SELECT conv_id, d, len, k FROM placed UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
lengths AS (SELECT conv_id, max(d) AS n FROM members GROUP BY conv_id),
nodes AS (SELECT k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(len) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends_sha256
  FROM members JOIN lengths USING (conv_id) GROUP BY k),
kids AS (SELECT p.k, count(c.k) AS n_children FROM nodes p LEFT JOIN nodes c ON c.depth = p.depth + 1 AND left(c.k, 32 * p.depth::INT) = p.k GROUP BY p.k),
below AS (SELECT p.k, count(*) FILTER (WHERE kids.n_children = 0) AS n_leaves, sum(c.own) AS saved
  FROM nodes p JOIN nodes c ON c.depth >= p.depth AND left(c.k, 32 * p.depth::INT) = p.k JOIN kids ON kids.k = c.k GROUP BY p.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN kids USING (k) JOIN below USING (k) LEFT JOIN nodes p ON n.depth > 0 AND p.k = left(n.k, 32 * (n.depth - 1)::INT)"""


@query("op11_conversation_trie", TRIE_SQL)
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.told(table(spark, sf_dir, "conversations"))))
