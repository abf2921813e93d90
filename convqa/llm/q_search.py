"""Query of the lexical search."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from convqa.llm import bag_search
from convqa.llm.registry import query, table

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT rid, doc_id, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM s),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(t) AS term FROM s) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, nn),
m AS (SELECT rid, doc_id, 100 - 25 + (25 * n * nn) // ll AS m FROM s, total),
b AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS t FROM benchmark),
i AS (SELECT item, item_id, term, count(*)::BIGINT AS c FROM (SELECT item, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
scored AS (SELECT item, item_id, rid, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20"""


@query("op12_bag_search", SEARCH_SQL)
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
