"""Question sets: generation plan, prompts, twins, and flow specifications flattened to questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convqa.functions import text as tx
from convqa.operators import kb
from convqa.operators import ordered as o


def source_key(ids: str | Column) -> Column:
    return F.array_join(F.array_sort(tx.col(ids)), ",")


def max_suffix(df: DataFrame, ident: str, prefix: str) -> DataFrame:
    """Highest number used with ``prefix`` (0 if none), to go on numbering from."""
    return df.agg(F.coalesce(F.max(tx.numeric_suffix(ident, prefix)), F.lit(0)).alias("max_suffix"))


def plan_tasks(cands: DataFrame, existing: DataFrame, languages: Sequence[str], order: str = "pos") -> DataFrame:
    """Generation tasks: every (candidate, language) that has no question yet. A candidate known in another
    language keeps its pair id, a new one gets the next free number in candidate order.

    ``cands``: ``pos, chunk_ids``; ``existing``: ``language, pair_id, source_chunks``.
    """
    done = existing.select(source_key("source_chunks").alias("key"), "language", "pair_id")
    pair_of = done.groupBy("key").agg(F.min("pair_id").alias("known_pair"))
    wanted = cands.withColumn("key", source_key("chunk_ids"))
    tasks = wanted.withColumn("language", F.explode(F.array(*[F.lit(l) for l in languages]))).join(
        done.select("key", "language").distinct(), ["key", "language"], "left_anti"
    ).join(pair_of, "key", "left")
    fresh = tasks.where(F.col("known_pair").isNull()).select("key", order).groupBy("key").agg(F.min(order).alias(order))
    numbered = o.ordinal(fresh, [], [order], "__n", o.blocks_of(order)).select("key", "__n")
    top = max_suffix(existing, "pair_id", "P")
    # The numbering base is one row.
    based = numbered.join(F.broadcast(top)).select("key", tx.padded_id("P", F.col("max_suffix") + F.col("__n")).alias("new_pair"))
    return tasks.join(based, "key", "left").select(order, "language", "key", F.coalesce("known_pair", "new_pair").alias("pair_id"))


# Wording of the question prompts.
LEAD_AR = "Write the question and answer in Arabic."
LEAD_EN = "Write the question and answer in English (translate the content's meaning faithfully — do not fabricate)."
BOTH_NEEDED = "The question must require BOTH pieces of content below to answer (a question answerable from only one of them is not acceptable)."


def prompt(language: Column, first: Column, second: Column) -> Column:
    """Question prompt out of one or two chunks."""
    lead = F.when(language == "ar", LEAD_AR).otherwise(LEAD_EN)
    def part(title: str, text: Column) -> Column:
        return F.concat(F.lit(f'{title}:\n"""\n'), text, F.lit('\n"""'))
    one = F.concat_ws("\n\n", lead, part("Knowledge base content", first))
    two = F.concat_ws("\n\n", lead, F.lit(BOTH_NEEDED), part("Knowledge base content 1", first), part("Knowledge base content 2", second))
    return F.when(second.isNull(), one).otherwise(two)


def twins(questions: DataFrame) -> DataFrame:
    """One row per pair id with both language sides."""
    side = lambda lang: F.min_by(F.struct("id", "question"), F.when(F.col("language") == lang, F.col("id")))
    return questions.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(side("ar").alias("ar"), side("en").alias("en")).select(
        "pair_id", F.col("ar.id").alias("ar_id"), F.col("en.id").alias("en_id"), F.col("ar.question").alias("ar_question"), F.col("en.question").alias("en_question"))


def merge_flows(scenarios: DataFrame) -> DataFrame:
    """Scenarios of many reply files by flow; the title is the first sub topic or the flow id in words."""
    flow = F.coalesce(tx.blank_to_null("flow_id"), tx.blank_to_null("id"), F.lit("UNKNOWN"))
    keyed = scenarios.withColumn("__flow", flow)
    return keyed.groupBy("__flow").agg(
        F.count(F.lit(1)).alias("scenarios"), F.min_by("sub_topic", F.when(tx.blank_to_null("sub_topic").isNotNull(), F.col("id"))).alias("__title")
    ).select(F.col("__flow").alias("flow_id"), F.coalesce("__title", F.replace("__flow", F.lit("_"), F.lit(" "))).alias("title"), "scenarios")


def flow_question_id(flow_id: Column, mode: str, language: Column, n: Column, short_ids: bool = False) -> Column:
    """Full flow ids by default; ``short_ids`` cuts them to ten characters, which can collide."""
    head = F.substring(flow_id, 1, 10) if short_ids else flow_id
    return tx.padded_id(F.concat(head, F.lit(f"-{mode}-"), F.upper(language), F.lit("-")), n)


def flatten_flows(scenarios: DataFrame, topic: str = "KnowledgeHub", short_ids: bool = False) -> DataFrame:
    """One question per step of an incremental scenario and one per full answer.

    ``scenarios``: ``flow_id, title, pair_id, mode, language, question, expected_answer, steps, chunk_ids``.
    """
    flow = F.coalesce(tx.blank_to_null("flow_id"), F.lit("FLOW"))
    named = scenarios.withColumn("flow_id", flow).withColumn(
        "__title", tx.safe_file_name(F.coalesce(tx.blank_to_null("title"), flow))).withColumn("__mode", F.lower(F.coalesce("mode", F.lit(""))))
    pair = F.upper(F.coalesce(tx.blank_to_null("pair_id"), F.concat_ws("-", "flow_id", F.upper("__mode"))))
    none = F.array().cast("array<string>")

    def shaped(df: DataFrame, ident: Column, suffix: str, question: str, answer: Column, chunks: str) -> DataFrame:
        return df.select(
            ident.alias("id"), pair.alias("pair_id"), "language", F.lit(topic).alias("topic"), F.concat("__title", F.lit(f"-{suffix}")).alias("sub_topic"),
            F.col(question).alias("question"), answer.alias("expected_answer"), F.coalesce(chunks, none).alias("chunk_ids"))

    steps = named.where(F.col("__mode") == "incremental").select("*", F.posexplode("steps").alias("__i", "__s"))
    inc = shaped(steps, flow_question_id(F.col("flow_id"), "INC", F.col("language"), F.col("__i") + 1, short_ids), "Incremental",
                 "__s.stimulus", F.col("__s.expected_answer"), "__s.chunk_ids")
    full = named.where(F.col("__mode") != "incremental")
    dump = shaped(full, flow_question_id(F.col("flow_id"), "DUMP", F.col("language"), F.lit(1), short_ids), "FullDump", "question",
                  F.coalesce("expected_answer", F.lit("")), "chunk_ids")
    return inc.unionByName(dump)


def flows_to_questions(scenarios: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    return kb.resolve_chunks(flatten_flows(scenarios, **options), chunks)


def question_file_name(title: str, ident: str, language: str) -> Column:
    mode = F.when(F.col(ident).contains("-INC-"), "Incremental").otherwise("FullDump")
    return F.concat(tx.safe_file_name(title), F.lit("-"), mode, F.lit("_"), F.upper(language), F.lit(".json"))


def flow_pools(files: DataFrame, name: str = "file") -> DataFrame:
    """Number of question files per flow by mode and language, from the file names."""
    parts = files.select(*[tx.flow_file_part(name, p).alias(p) for p in ("base", "mode", "language")]).where(F.col("base") != "")
    n = lambda m, l: F.count_if((F.col("mode") == m) & (F.col("language") == l)).alias(f"{m}_{l}")
    return parts.groupBy("base").agg(*[n(m, l) for m in ("incremental", "fulldump") for l in ("ar", "en")])
