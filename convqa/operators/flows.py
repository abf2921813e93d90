"""Flow scenarios as flat steps: one row per step, however many records a flow has.

A scenario is a (flow, language, mode). Its steps are numbered by block scans, its head (id, first question, number of steps)
is a small aggregate, and the nested document that other tools read is written line by line from sorted rows, so no row, array
or state ever holds a flow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convqa.functions import text as tx
from convqa.operators import ordered as o
from convqa.operators import questions as q

SCENARIO = ["flow_id", "spoken", "mode"]
NONE = "cast(array() as array<string>)"


def steps(records: DataFrame, order: str = "ord", block_rows: int = o.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Question records as numbered steps of their scenario: ``flow_id, spoken, mode, step_n, language, question, expected_answer, chunk_ids``.

    ``records``: an integer ``order`` and ``pair_id, language, topic, sub_topic, question, expected_answer, chunk_ids``. The flow is the sub
    topic, else the topic; a pair id that speaks of a dump makes a full answer of which each record is a part. ``spoken`` is the
    language as stored (empty where missing), ``language`` what tools read: ``en`` or ``ar``.
    """
    flow = F.coalesce(tx.blank_to_null("sub_topic"), tx.blank_to_null("topic"), F.lit("FLOW"))
    mode = F.when(F.lower(F.coalesce("pair_id", F.lit(""))).contains("dump"), "full_dump").otherwise("incremental")
    keyed = records.select(
        flow.alias("flow_id"), F.coalesce("language", F.lit("")).alias("spoken"), mode.alias("mode"), F.col(order).alias("__ord"), "question", "expected_answer",
        F.coalesce("chunk_ids", F.expr(NONE)).alias("chunk_ids"))
    numbered = o.ordinal(keyed, SCENARIO, ["__ord"], "step_n", o.blocks_of("__ord", block_rows))
    return numbered.withColumn("language", F.when(F.col("spoken") == "en", "en").otherwise("ar")).select(
        *SCENARIO, "step_n", "language", "question", "expected_answer", "chunk_ids")


def short_mode() -> Column:
    return F.when(F.col("mode") == "full_dump", "DUMP").otherwise("INC")


def scenario_id() -> Column:
    return F.concat_ws("-", "flow_id", short_mode(), F.upper("spoken"))


def heads(numbered: DataFrame) -> DataFrame:
    """One row per scenario: ``id, flow_id, spoken, mode, pair_id, language, sub_topic, question, steps``."""
    first = F.max(F.when(F.col("step_n") == 1, F.col("question"))).alias("question")
    return numbered.groupBy(*SCENARIO, "language").agg(first, F.count(F.lit(1)).alias("steps")).select(
        scenario_id().alias("id"), *SCENARIO, F.concat_ws("-", "flow_id", short_mode()).alias("pair_id"), "language", F.col("flow_id").alias("sub_topic"), "question", "steps")


def questions(numbered: DataFrame, topic: str = "KnowledgeHub", short_ids: bool = False) -> DataFrame:
    """Questions of flat scenarios: one per step, and one per full answer whose parts are rows of their own.

    ``id, pair_id, language, topic, sub_topic, step, part, question, expected_answer, chunk_ids``: ``part`` counts the pieces of a full
    answer, whose text is the pieces in order with a blank between; its question stands in part 1. Steps have one part.
    """
    dump = F.col("mode") == "full_dump"
    title = tx.safe_file_name(F.col("flow_id"))
    ident = F.when(dump, q.flow_question_id(F.col("flow_id"), "DUMP", F.col("language"), F.lit(1), short_ids)).otherwise(
        q.flow_question_id(F.col("flow_id"), "INC", F.col("language"), F.col("step_n"), short_ids))
    one = F.lit(1).cast("bigint")
    return numbered.select(
        ident.alias("id"), F.upper(F.concat_ws("-", "flow_id", short_mode())).alias("pair_id"), "language", F.lit(topic).alias("topic"),
        F.concat(title, F.when(dump, "-FullDump").otherwise("-Incremental")).alias("sub_topic"), F.when(dump, one).otherwise(F.col("step_n")).alias("step"),
        F.when(dump, F.col("step_n")).otherwise(one).alias("part"), F.when(~dump | (F.col("step_n") == 1), F.col("question")).alias("question"), "expected_answer",
        F.when(dump, F.expr(NONE)).otherwise(F.col("chunk_ids")).alias("chunk_ids"))


def whole_answers(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per question (``keys``) out of rows per ``part``: ``question`` and the ``expected_answer`` of all parts in order, a blank between.

    A missing part is empty, as in the nested document. The row itself is the full answer, so it has to fit a row of the engine.
    """
    said = F.array_sort(F.collect_list(F.struct("part", F.coalesce("expected_answer", F.lit("")).alias("text"))))
    return parts.groupBy(*keys).agg(F.max("question").alias("question"), F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("expected_answer"))


def _inside(text: Column) -> Column:
    """A text as it stands between the quotes of a JSON string."""
    packed = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t")))
    return F.substr(packed, F.lit(7), F.length(packed) - 8)


def _members(**fields: Column) -> Column:
    """JSON members without the braces."""
    packed = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})
    return F.substr(packed, F.lit(2), F.length(packed) - 2)


def spec_lines(numbered: DataFrame, topic: str = "KnowledgeHub") -> DataFrame:
    """The nested document of every flow as pieces: ``flow_id, at, value``. Pieces in the order of ``at``, a blank between, are the document.

    A flow's document names its title and holds its scenarios by language and mode, each with its steps, or with the joined
    parts of its full answer: the blank between two pieces is the blank between two parts.
    """
    head = heads(numbered)
    nth = F.row_number().over(Window.partitionBy("flow_id").orderBy("spoken", "mode"))  # scenarios of a flow, not steps: languages times modes
    placed = head.withColumn("nth", nth.cast("bigint"))
    dump = F.col("mode") == "full_dump"

    def at(scenario: Column, kind: int, step: Column) -> Column:
        return F.struct(scenario.alias("scenario"), F.lit(kind).alias("kind"), step.cast("bigint").alias("step"))

    comma = lambda first: F.when(first, "").otherwise(",")
    opening = F.concat(F.lit("{"), _members(flow_id=F.col("flow_id"), title=F.col("flow_id"), topic=F.lit(topic)), F.lit(',"chunks":[],"flows":['))
    per_flow = placed.groupBy("flow_id").agg(F.max("nth").alias("last"))
    opens = per_flow.select("flow_id", at(F.lit(0).cast("bigint"), 0, F.lit(0)).alias("at"), opening.alias("value"))
    closes = per_flow.select("flow_id", at(F.col("last"), 3, F.lit(0)).alias("at"), F.lit("]}").alias("value"))
    scenario = _members(
        id=F.col("id"), flow_id=F.col("flow_id"), pair_id=F.col("pair_id"), mode=F.col("mode"), language=F.col("language"), sub_topic=F.col("flow_id"), question=F.col("question"))
    begun = placed.where(~dump).select("flow_id", at(F.col("nth"), 1, F.lit(0)).alias("at"), F.concat(comma(F.col("nth") == 1), F.lit("{"), scenario, F.lit(',"steps":[')).alias("value"))
    ended = placed.where(~dump).select("flow_id", at(F.col("nth"), 2, F.lit(1 << 62)).alias("at"), F.lit("]}").alias("value"))
    joined = numbered.select(*SCENARIO, "step_n", F.col("question").alias("__q"), "expected_answer", "chunk_ids").join(
        placed.select(*SCENARIO, "nth", "id", "pair_id", "language", "question", F.col("steps").alias("__n")), SCENARIO)
    step = F.to_json(F.struct(F.col("step_n"), F.col("__q").alias("stimulus"), "expected_answer", "chunk_ids"), {"ignoreNullFields": "false"})
    first, last = F.col("step_n") == 1, F.col("step_n") == F.col("__n")
    part = F.concat(
        F.when(first, F.concat(comma(F.col("nth") == 1), F.lit("{"), scenario, F.lit(',"chunk_ids":[],"expected_answer":"'))).otherwise(""),
        _inside(F.col("expected_answer")), F.when(last, '"}').otherwise(""))
    rows = joined.select("flow_id", at(F.col("nth"), 2, F.col("step_n")).alias("at"), F.when(dump, part).otherwise(F.concat(comma(first), step)).alias("value"))
    return opens.unionByName(begun).unionByName(rows).unionByName(ended).unionByName(closes)
