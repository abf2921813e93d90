"""Queries of the trained models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convqa.llm import bloom, kneser_ney, language_id, toxicity, word_kneser_ney
from convqa.llm.registry import query, table
from convqa.session import materialize

BROADCAST_ROWS = 2_000_000  # of eight bytes each


def fold(column: str, folds: int) -> Column:
    """crc32 of an id's text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


@query("op9_language_id")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(fold("doc_id", 5) != 0))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where((fold("doc_id", 4) != 2) & F.col("toxic").isNotNull())
    # the sample is bounded, so its ids are chosen before texts are read
    chosen = toxicity.sample_ids(labels)
    machine = toxicity.train(docs.join(F.broadcast(chosen), "doc_id"), prior=toxicity.label_share(labels))
    scored = toxicity.predict(docs, machine)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op1_kneser_ney")
def quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted: documents that ``labels`` marks with quality 1, judged as if they were new to the model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    good = table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    few = good.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text")
    # up to this many ids go to every task, so that texts stay where they are
    trusted = texts.join(F.broadcast(good), "doc_id") if few else bloom.maybe(texts, good, "doc_id").join(good, "doc_id")
    scored = word_kneser_ney.perplexity(docs, word_kneser_ney.train(trusted, shards=word_kneser_ney.shards_for(docs))).drop("text")
    marked = scored.join(good.withColumn("__good", F.lit(True)), "doc_id", "left").withColumn("__good", F.coalesce("__good", F.lit(False)))
    own = marked.withColumn("perplexity", F.when(F.col("__good"), F.col("perplexity_new")).otherwise(F.col("perplexity"))).drop("perplexity_new")
    return kneser_ney.judge(materialize(own, "perplexity"), F.col("__good")).select("doc_id", "lang", "perplexity", "threshold", "kept")
