"""Mixing sources to target weights by exponential keys (Efraimidis-Spirakis).

A source whose target is k times its size and a bit is read k times in full; the rest of its budget is filled by a
weighted sample without replacement: each document draws the key -ln(u) / quality, documents are taken in key order
and sizes are summed up until the budget is met. ``u`` comes from a hash of the document's id and a seed, so that a rerun
takes the same documents.

No source is ever sorted in one task: the table is sorted over sources and keys into ranges of about ``bucket_docs``
documents whose limits Spark draws from the rows themselves, so neither a hot source nor low qualities, which crowd the
high keys, make a range long; range totals are summed per source, and only the ranges are ordered inside.

Defined results: a null text has size 0; documents of size 0 are never taken; null is a source of its own, the last one;
an empty table gives none; a very long text is one document of its size. Rows without an id draw by their text. Rows of
equal id share a draw and come in the order of size and text; those equal in all of it are documents of their own and
exchangeable, and only ``row`` lets a range end between them. Other columns of the input are not carried on,
so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convqa.session import discard, materialize

SPACE_RUN = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of a text that is not symbols or digits, between 0.05 and 1."""
    t = F.coalesce(text, F.lit(""))
    bad = F.length(F.regexp_replace(t, r"[^#*$%&|<>0-9]+", ""))
    return F.greatest(F.lit(0.05), 1.0 - 4.0 * bad / F.greatest(F.length(t), F.lit(1)))


def source_targets(sized: DataFrame, cycle: Sequence[float] = (1.0, 2.0, 3.0), share: float = 1.0, stop: float = 3.0) -> DataFrame:
    """One row per source: ``source, source_size, source_docs, weight, target``.

    Sources in code-point order, null last, get the weights of ``cycle`` in turn. Budgets above ``stop`` times a source's
    size are cut there and the excess is shared again by weight among the rest until no budget is above its limit.
    """
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    ordered = materialize(per.orderBy(F.col("source").asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("__at", 33)
    counts = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row per partition
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    first = F.lit(0).cast("long")
    for p, n in before.items():
        first = F.when(part == p, F.lit(n)).otherwise(first)
    place = (first + F.col("__at").bitwiseAND((1 << 33) - 1)) % len(cycle)
    weights = F.get(F.lit(list(map(float, cycle))), place.cast("int"))
    known = ordered.select("source", "source_size", "source_docs", weights.alias("weight"))

    def totals(limit: float | None) -> tuple[float, float]:
        """Size held by sources at their limit, and weight of the others, when a unit of weight is worth ``limit``."""
        full = F.lit(False) if limit is None else F.col("weight") * limit >= stop * F.col("source_size")
        row = known.agg(F.sum(F.when(full, stop * F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.sum("source_size")).first()
        return float(row[0] or 0.0), float(row[1] or 0.0), float(row[2] or 0.0)

    held, free, size = totals(None)
    unit = share * size / free if free else 0.0
    while free:
        held, free, size = totals(unit)
        new = (share * size - held) / free if free else unit
        if new <= unit:
            break
        unit = new
    target = F.least(F.col("weight") * F.lit(unit), stop * F.col("source_size"))
    return known.select("source", "source_size", "source_docs", "weight", target.cast("double").alias("target"))


ORDER = ("draw", "tie", "tie2", "size")


def _draws(key: str, seed: int, text: bool, quality: Column) -> list[Column]:
    """Exponential key of a row and what tells rows of equal keys apart; rows without an id draw by their text."""
    content = F.xxhash64("text") if text else F.lit(0).cast("long")
    number = F.when(F.col(key).isNull(), F.xxhash64(content, F.lit(seed))).otherwise(F.xxhash64(F.col(key), F.lit(seed)))
    # 52 bits of the hash give a number strictly between 0 and 1
    u = (F.shiftrightunsigned(number, 12).cast("double") + 0.5) / float(1 << 52)
    return [(-F.log(u) / quality).alias("draw"), F.col(key).cast("string").alias("tie"), content.alias("tie2")]


def _decided(docs: DataFrame, carried: Sequence[str], size: Column, draws: Sequence[Column], cycle: Sequence[float], share: float, stop: float, bucket_docs: int) -> DataFrame:
    """``carried, source, size, draw, tie, tie2, source_size, target, epochs, fits`` of every row."""
    spark = docs.sparkSession
    sized = materialize(docs.select(*[F.col(c) for c in carried], "source", size.alias("size"), *draws), "sized")
    targets = materialize(source_targets(sized, cycle, share, stop), "targets")
    rows = int(targets.agg(F.sum("source_docs")).first()[0] or 0)
    order = [*ORDER, *carried[1:]]
    # A range is one task's part of the sorted table, so neither a hot source nor a draw that many documents come near fills one.
    parts = max(1, -(-rows // bucket_docs), int(spark.conf.get("spark.sql.shuffle.partitions")) if rows > bucket_docs else 1)
    placed = materialize(sized.repartitionByRange(parts, "source", *order).withColumn("range", F.spark_partition_id()), "ranges")
    discard(spark, sized)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    facts = targets.select(
        F.col("source").alias("__source"), "source_size", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest"))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("source", F.col("range").alias("__r"), F.coalesce(earlier, F.lit(0)).alias("before"))
    known = starts.join(facts, F.col("source").eqNullSafe(F.col("__source"))).select(
        F.col("source").alias("__s"), "__r", "before", "source_size", "target", "epochs", "rest")
    # one row per source and range: small beside the documents, whose join with it is left to size-based planning and skew handling
    with_start = placed.join(known, F.col("source").eqNullSafe(F.col("__s")) & (F.col("range") == F.col("__r")))
    inside = F.sum("size").over(Window.partitionBy("source", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sofar = F.col("before") + F.coalesce(inside, F.lit(0))
    # whole documents: in while their middle lies below the rest of the budget
    fits = (F.col("size") > 0) & (F.col("epochs") < stop) & (2 * sofar + F.col("size") <= 2 * F.col("rest"))
    return with_start.select(*carried, "source", *ORDER, "source_size", "target", "epochs", fits.alias("fits"))


def mix(docs: DataFrame, key: str = "doc_id", size: Column | None = None, quality: Column | None = None, seed: int = 7,
        cycle: Sequence[float] = (1.0, 2.0, 3.0), share: float = 1.0, stop: float = 3.0, bucket_docs: int = 50_000, row: str | None = None) -> DataFrame:
    """One row per document: ``key, source, size, source_size, target, copies, taken``.

    ``copies`` is how often the whole document is read; ``taken = copies * size``. The document that crosses the budget is
    taken when that brings its source nearer to the target, and never more than ``stop`` times. ``row`` may name a column
    that tells rows of equal ``key`` apart; it is carried to the result.
    """
    carried = [key] if row is None else [key, row]
    size = word_count(F.col("text")) if size is None else size
    quality = quality_weight(F.col("text")) if quality is None else quality
    decided = _decided(docs, carried, size, _draws(key, seed, "text" in docs.columns, quality), cycle, share, stop, bucket_docs)
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.col("fits").cast("long")).otherwise(0)
    return decided.select(
        *carried, "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def repeat(docs: DataFrame, row: str, key: str = "doc_id", seed: int = 7, cycle: Sequence[float] = (1.0, 2.0, 3.0), share: float = 1.0, stop: float = 3.0,
           bucket_docs: int = 50_000) -> DataFrame:
    """``docs`` with every row as often as :func:`mix` reads it. ``row`` tells rows apart and must come out alike at every reading.

    Texts are not moved: within a source all rows up to some place in the order are in, the rest are out, but for a few that
    still fit behind the first that did not. A row meets its source's place and those few, both small tables.
    """
    spark = docs.sparkSession
    draws = _draws(key, seed, True, quality_weight(F.col("text")))
    place = F.struct("draw", "tie", "tie2", row)
    decided = _decided(docs, [key, row], word_count(F.col("text")), draws, cycle, share, stop, bucket_docs)
    decided = materialize(decided.select(row, "source", "size", "epochs", "fits", place.alias("place")), "decided")
    cuts = decided.groupBy("source").agg(F.max("epochs").alias("__epochs"), F.min(F.when((F.col("size") > 0) & ~F.col("fits"), F.col("place"))).alias("__out"))
    cuts = materialize(cuts.withColumnRenamed("source", "__source"), "cuts")
    late = decided.where("fits").join(cuts, F.col("source").eqNullSafe(F.col("__source"))).where(F.col("place") > F.col("__out")).select(F.col(row).alias("__late"))
    late = materialize(late, "late")
    discard(spark, decided)
    drawn = docs.select("*", *draws).join(cuts, F.col("source").eqNullSafe(F.col("__source"))).join(late, F.col(row) == F.col("__late"), "left")
    inside = F.col("__out").isNull() | (place < F.col("__out")) | F.col("__late").isNotNull()
    spoken = F.coalesce(F.rlike(F.col("text"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    copies = F.when(spoken, F.col("__epochs") + inside.cast("long")).otherwise(F.lit(0).cast("long"))
    counted = drawn.select(*docs.columns, copies.alias("__copies")).where("__copies > 0")
    return counted.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "__copies")).alias("__epoch")).select(*docs.columns)
