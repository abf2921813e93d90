"""A corpus pipeline over ``documents``: rules, one of each near-duplicate group, pseudonyms, mix, pieces.

Each stage works on whole texts of all rows that the stage before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convqa.llm import jaccard_join, mixing, pseudonyms, quality_rules, rows, sentencepiece_bpe
from convqa.session import discard, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_ROWS = 2_000_000  # of eight bytes each
# A deployment passes its own key.
KEY = b"one key for the whole corpus"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their failing lines taken out; rows that would be left without a word go.

    A null text has no word and goes; each of several equal rows is judged alike; an empty table stays one; columns beyond
    those of documents are not carried on.
    """
    judged = quality_rules.clean(docs, made=("cleaned", "kept")).where("kept")
    return judged.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, the one with the smallest id; of equal ids the one with the smallest text hash.

    Texts link from similarity 0.8 over 5-word shingles on. Rows are told apart by a number of their own, so rows without
    an id or with the same id are compared like all others; an id comes last only when it is null.
    """
    keyed = rows.numbered(docs, COLUMNS)
    groups = materialize(jaccard_join.linked(keyed, key="__row", words=5, percent=80).select("__row", "component_id"), "groups")
    alone = groups.groupBy("component_id").agg(F.count("*").alias("members")).where("members > 1").select("component_id")
    shared = groups.join(alone, "component_id", "left_semi")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "__row")
    placed = materialize(keyed.select("__row", place.alias("place")).join(shared, "__row"), "places")
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    lost = materialize(placed.join(first, "component_id").where(F.col("place.__row") != F.col("first.__row")).select("__row"), "lost")
    discard(spark, groups, placed)
    # up to this many numbers go to every task, so that texts stay where they are; beyond, the planner joins them
    few = lost.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(lost) if few else lost, "__row", "left_anti").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced within their format; a null text stays null with null characters, equal rows change alike."""
    hidden = pseudonyms.pseudonymize(docs, KEY)
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it. Rows are told apart by a number of their own, so rows without an id or
    with the same id are weighed and taken one by one."""
    return mixing.repeat(rows.numbered(docs, COLUMNS), "__row").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids closed by an end id, as training reads them, with their number and the digest of the decoded text.

    A null or empty text is the end id alone; every row is encoded, repeated ones too.
    """
    coded = sentencepiece_bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), batch_bytes=1 << 20)
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", rules), ("near copies", near_copies), ("pseudonyms", private), ("mix", mix), ("pieces", pieces)]

# Pseudonyms and pieces are not expressible in SQL; tests/llm/test_pipeline.py holds the run against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
