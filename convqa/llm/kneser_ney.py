"""Quality by perplexity under an interpolated, modified Kneser-Ney n-gram model.

Text is a sequence of ``SYMBOLS`` character classes: a-z, other letters folded into 32 classes, digits, spaces, kinds of
punctuation. The model is of order ``ORDER`` over them and is trained on trusted text only. Counts of n-grams are made per
task, summed in Spark, and split by context; continuation counts, counts of counts (for the three discounts of each
order) and context totals are joined to the counts shard by shard. The result is a table of at most SYMBOLS ** ORDER numbers, a bound
that does not depend on the input, which the scoring tasks look up for every character of every text.

A document is kept if its perplexity does not exceed a quantile of the trusted documents of its language; a language with
fewer than ``least`` trusted documents uses the quantile of all of them.

Defined results: a null text or one without characters has no perplexity (null) and is not kept; without trusted text nothing is scored
and everything that has text is kept; null is a language of its own. A very long text is scored whole, a batch of its own; repeated rows
score alike and count each in the model and the quantiles; a perplexity equal to the limit is kept; an empty table gives no rows.
Other columns pass through, those named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from convqa.llm.arrow import add_columns, small_batches
from convqa.session import materialize

ORDER, BITS = 4, 6
SYMBOLS = 1 << BITS
START, SPACE, DIGIT, STOP, PAUSE, SIGN = range(6)


def _classes() -> np.ndarray:
    """Class of each code point below 65 536; higher ones are signs."""
    out = np.full(65537, SIGN, np.uint8)
    for cp in range(65536):
        ch = chr(cp)
        low = ch.lower()[0]
        if "a" <= low <= "z":
            out[cp] = 6 + ord(low) - 97
        elif ch.isalpha():
            out[cp] = 32 + (ord(low) * 2654435761 >> 16) % 32
        elif ch.isdigit():
            out[cp] = DIGIT
        elif ch.isspace():
            out[cp] = SPACE
        elif ch in ".!?…。！？؟":
            out[cp] = STOP
        elif ch in ",;:'\"()-’‘“”«»–—、，،":
            out[cp] = PAUSE
    return out


CLASSES = _classes()


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of a batch (runs of white space count once), and where each text's begin."""
    texts = [("\x00" * (ORDER - 1) + t) if t else "" for t in column.to_pylist()]
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    sym = CLASSES[np.minimum(flat, 65536)].astype(np.uint32)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sym[inner < ORDER - 1] = START
    keep = np.ones(len(sym), bool)
    keep[1:] = ~((sym[1:] == SPACE) & (sym[:-1] == SPACE))
    sym, doc, inner = sym[keep], doc[keep], inner[keep]
    if not len(sym):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    code = sym.copy()
    for k in range(1, ORDER):
        code[k:] |= sym[:-k] << np.uint32(BITS * k)
    real = inner >= ORDER - 1
    return code[real], np.searchsorted(doc[real], np.arange(len(texts) + 1))


def counts(trusted: DataFrame, text: str = "text") -> DataFrame:
    """``gram, n`` over all trusted texts, summed in each task before they are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int32)
        for batch in small_batches(batches, 0, 1 << 20):
            code, _ = grams(batch.column(0))
            seen, n = np.unique(code, return_counts=True)
            total[seen] += n.astype(np.int32)
        seen = np.flatnonzero(total)
        for part in np.array_split(seen, max(1, len(seen) // 100_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], names=["gram", "n"])

    return trusted.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _order(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Discounted shares of one order's n-grams, and the weight that each context leaves to the order below."""
    of = table.agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"c{k}") for k in (1, 2, 3, 4)]).first()
    c1, c2, c3, c4 = (float(of[f"c{k}"] or 0) for k in (1, 2, 3, 4))
    y = c1 / (c1 + 2 * c2) if c1 + c2 else 0.5
    cut = [1 - 2 * y * c2 / c1 if c1 else 0.5, 2 - 3 * y * c3 / c2 if c2 else 1.0, 3 - 4 * y * c4 / c3 if c3 else 1.5]
    cut = [min(max(d, 0.05), k + 0.9) for k, d in enumerate(cut)]
    less = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
    by = table.withColumn("context", F.shiftright("gram", BITS)).withColumn("less", less)
    totals = by.groupBy("context").agg(F.sum("n").alias("total"), F.sum("less").alias("left"))
    shares = by.join(totals, "context").select("gram", ((F.col("n") - F.col("less")) / F.col("total")).alias("share")).toArrow()
    weights = totals.select("context", (F.col("left") / F.col("total")).alias("weight")).toArrow()
    return tuple(c.to_numpy() for t in (shares, weights) for c in t.columns)


def train(trusted: DataFrame, text: str = "text") -> np.ndarray | None:
    """Log probability of the last symbol of every n-gram given those before; null without trusted text."""
    table = materialize(counts(trusted, text), "grams")
    if table.isEmpty():
        return None
    orders = [table]
    for k in range(ORDER - 1, 0, -1):
        # how many different symbols come before each shorter n-gram
        table = table.groupBy(F.col("gram").bitwiseAND((1 << BITS * k) - 1).alias("gram")).agg(F.count("*").alias("n"))
        orders.append(table)
    p = np.full(1, 1.0 / SYMBOLS, np.float32)
    for k, table in enumerate(reversed(orders), 1):
        gram, share, context, weight = _order(table)
        leave = np.ones(SYMBOLS ** (k - 1), np.float32)
        leave[context] = weight
        # axes: first symbol of the context, rest of the context, last symbol
        below = np.full((1, 1, SYMBOLS), p[0]) if k == 1 else p.reshape(1, -1, SYMBOLS)
        p = (leave.reshape(1 if k == 1 else SYMBOLS, -1, 1) * below).reshape(-1)
        p[gram] += share
    return np.log(p, out=p)


def perplexity(docs: DataFrame, model: np.ndarray | None, text: str = "text", name: str = "perplexity") -> DataFrame:
    """Input columns and the perplexity per character class of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.Array], dict[str, pa.Array]]:
        table = shared.value

        def step(column: pa.Array) -> dict[str, pa.Array]:
            if table is None:
                return {name: pa.nulls(len(column), pa.float64())}
            code, begins = grams(column)
            sums = np.concatenate([[0.0], np.cumsum(table[code], dtype=np.float64)])
            n = np.diff(begins)
            mean = (sums[begins[1:]] - sums[begins[:-1]]) / np.maximum(n, 1)
            return {name: pa.array(np.exp(-mean), pa.float64(), mask=n == 0)}

        return step

    return add_columns(docs, text, [StructField(name, DoubleType())], make, limit=1 << 20)


def judge(scored: DataFrame, is_trusted: Column, language: str = "lang", quantile: float = 0.995, least: int = 20, accuracy: int = 20_000) -> DataFrame:
    """Rows of :func:`perplexity` with ``threshold`` and ``kept``."""
    own = scored.withColumn("__trusted", is_trusted)
    known = own.where(F.col("__trusted") & F.col("perplexity").isNotNull())
    per = known.groupBy(F.col(language).alias("__lang")).agg(F.percentile_approx("perplexity", quantile, accuracy).alias("__limit"), F.count("*").alias("__n")).where(F.col("__n") >= least)
    overall = known.agg(F.percentile_approx("perplexity", quantile, accuracy)).first()[0]
    joined = own.join(per.drop("__n"), F.col(language).eqNullSafe(F.col("__lang")), "left")
    limit = F.coalesce(F.col("__limit"), F.lit(overall).cast("double"))
    kept = F.when(F.lit(overall is None), F.lit(True)).otherwise(F.coalesce(F.col("perplexity") <= limit, F.lit(False)))
    return joined.withColumn("threshold", limit).withColumn("kept", kept).drop("__trusted", "__lang", "__limit")
