"""Query of the shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convqa.llm import hilbert_shards
from convqa.llm.registry import query, table

DIMENSIONS, SHARDS, BITS = ("lang", "source", "size", "doc_id"), 24, 4
BLOCK = 256  # bytes of a text whose checksum the SQL takes at once


def _cuts_sql(number: int, name: str, whole: bool) -> str:
    """CTEs that give the cuts of one dimension as ``c{number}`` and its steps per row as ``s{number}``."""
    level = f"({name} - (SELECT min({name}) FROM d)) // ((SELECT (max({name}) - min({name})) // {hilbert_shards.HISTOGRAM} + 1 FROM d))" if whole else name
    steps = 1 << BITS
    return f"""
v{number} AS (SELECT rid, {level} AS v FROM d),
n{number} AS (SELECT v, count(*) AS n, sum(count(*)) OVER (ORDER BY v) AS upto, sum(count(*)) OVER () AS total FROM v{number} WHERE v IS NOT NULL GROUP BY v),
c{number} AS (SELECT k, min(v) AS cut FROM n{number}, (SELECT unnest(range(1, {steps})) AS k) WHERE upto * {steps} >= k * total GROUP BY k),
s{number} AS (SELECT rid, count(cut)::INT AS s FROM v{number} LEFT JOIN c{number} ON v > cut GROUP BY rid)"""


def sharding_sql() -> str:
    n, last = len(DIMENSIONS), len(DIMENSIONS) - 1
    gray = [" ".join(["xor("] * i) + "x[1]" + "".join(f", x[{j + 1}])" for j in range(1, i + 1)) for i in range(n)]
    flips = "0"
    for b in range(BITS - 1, 0, -1):
        flips = f"xor({flips}, CASE WHEN g[{n}] & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    place = " + ".join(f"((xor(g[{i + 1}], t) >> {b}) & 1)::BIGINT * {1 << (b * n + last - i)}" for b in range(BITS) for i in range(n))
    dims = ",".join(_cuts_sql(i, c, c in ("size", "doc_id")) for i, c in enumerate(DIMENSIONS))
    turns, x = "", "a0"
    for step, (b, i) in enumerate((b, i) for b in range(BITS - 1, 0, -1) for i in range(n)):
        q, first, own = 1 << b, f"{x}.x[1]", f"{x}.x[{i + 1}]"
        d = f"(xor({first}, {own}) & {q - 1})"
        parts = [f"CASE WHEN {own} & {q} <> 0 THEN xor({first}, {q - 1}) ELSE xor({first}, {d}) END"]
        parts += [f"CASE WHEN {own} & {q} = 0 THEN xor({own}, {d}) ELSE {own} END" if j == i else f"{x}.x[{j + 1}]" for j in range(1, n)]
        turns += f",\na{step + 1} AS MATERIALIZED (SELECT rid, [{', '.join(parts)}] AS x FROM {x})"
        x = f"a{step + 1}"
    axes = ", ".join(f"s{i}.s" for i in range(n))
    joins = " ".join(f"JOIN s{i} USING (rid)" for i in range(1, n))
    return f"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i))),
-- what {BLOCK} zero bytes make of each byte of a register
zero AS (SELECT list(v ORDER BY i, k) AS z FROM (SELECT i, k, list_reduce([k << (8 * i)] || range({BLOCK}), lambda c, x: xor(c >> 8, t[(c & 255) + 1])) AS v
  FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(256)) AS k), crc)),
h AS (SELECT doc_id, lang, source, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS rid FROM documents),
-- a text's first block is the short one, so that all others have {BLOCK} bytes
blocks AS (SELECT rid, k, CASE WHEN k = 0 THEN h[1:2 * short] ELSE h[2 * (short + {BLOCK} * (k - 1)) + 1:2 * (short + {BLOCK} * k)] END AS b
  FROM (SELECT rid, h, (length(h) // 2) % {BLOCK} AS short, unnest(range(length(h) // 2 // {BLOCK} + 1)) AS k FROM h)),
part AS (SELECT rid, k, list_reduce([CASE WHEN k = 0 THEN 4294967295 ELSE 0 END] || list_transform(range(length(b) // 2), lambda i: ('0x' || b[2 * i + 1:2 * i + 2])::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])) AS c FROM blocks, crc),
whole AS (SELECT rid, xor(4294967295, list_reduce(list(c ORDER BY k),
    lambda c, x: xor(x, xor(xor(z[(c & 255) + 1], z[257 + ((c >> 8) & 255)]), xor(z[513 + ((c >> 16) & 255)], z[769 + (c >> 24)]))))) AS crc FROM part, zero GROUP BY rid, z),
d AS MATERIALIZED (SELECT doc_id, lang, source, rid, length(h) // 2 + 8 AS size, crc FROM h JOIN whole USING (rid)),{dims},
a0 AS (SELECT s0.rid, [{axes}] AS x FROM s0 {joins}){turns},
g AS (SELECT rid, [{", ".join(gray)}] AS g FROM {x}),
t AS (SELECT rid, g, {flips} AS t FROM g),
placed AS (SELECT rid, {place} AS curve FROM t),
ranked AS (SELECT d.*, curve, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, crc, size) - 1 AS pos, count(*) OVER () AS total FROM d JOIN placed USING (rid)),
cut AS (SELECT *, (pos * {SHARDS}) // total AS shard FROM ranked)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (pos - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot,
  NULL::INT AS grown_shard, curve::BIGINT AS curve FROM cut"""


@query("op13_hilbert_shards", sharding_sql())
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.assign(table(spark, sf_dir, "documents"), DIMENSIONS, SHARDS, bits=BITS)
