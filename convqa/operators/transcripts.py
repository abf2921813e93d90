"""Transcript operators over turns ``conv_id, ord, speaker, text``.

``ord`` is a unique integer position within a call. All ordered work runs through block scans,
and pairs come out of mergeable aggregates, so a call of any length stays spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convqa.config import CallConfig
from convqa.functions import text as tx
from convqa.operators import ordered as o

KEY = ["conv_id"]
ORD = ["ord"]


def _block(rows: int | None) -> Column:
    return o.blocks_of("ord", rows or o.DEFAULT_BLOCK_ROWS)


def from_conversations(df: DataFrame, agent_names: Sequence[str] = ()) -> DataFrame:
    """Turn table from raw ``conv_id, turn, role, text`` rows."""
    return df.select(
        "conv_id", F.col("turn").alias("ord"), tx.canonical_speaker("role", agent_names).alias("speaker"),
        tx.strip(F.coalesce("text", F.lit(""))).alias("text"),
    )


def drop_empty(turns: DataFrame, keep_agent: bool = False) -> DataFrame:
    """Drop blank turns; ``keep_agent`` keeps blank agent turns as no-reply markers."""
    kept = F.col("text").rlike("(?U)\\S")
    return turns.where(kept | (F.col("speaker") == "agent") if keep_agent else kept)


def with_takeovers(turns: DataFrame, opener: Column, name: str = "exch", block_rows: int | None = None,
                   order: Sequence[str] = ORD, block: Column | None = None) -> DataFrame:
    """Number the stretches that start each time ``opener`` turns take the floor; 0 = before the first."""
    opened = lambda this, before: this["__opens"] & ~F.coalesce(before["__opens"], F.lit(False))
    flagged = turns.withColumn("__opens", opener)
    return o.stretches(flagged, KEY, order, ["__opens"], opened, name, _block(block_rows) if block is None else block).drop("__opens")


def pair(turns: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Question/answer pairs: neighbouring customer turns merge into their longest text (earliest on a tie),
    the first agent turn after them answers, an empty agent turn means no answer.

    Only agent and customer turns take part.
    """
    two_sided = drop_empty(turns, keep_agent=True).where(F.col("speaker").isin("agent", "customer"))
    customer = F.col("speaker") == "customer"
    numbered = with_takeovers(two_sided, customer, "pair", block_rows).where(F.col("pair") > 0)
    reply = F.min_by(F.col("text"), F.when(~customer, F.col("ord")))
    return numbered.groupBy("conv_id", "pair").agg(
        F.max_by("text", F.when(customer, F.struct(F.length("text"), -F.col("ord")))).alias("question"),
        F.when(reply != "", reply).alias("answer"),
    )


def _joined(condition: Column) -> Column:
    """Texts of the matching turns in order, joined with a blank."""
    picked = F.collect_list(F.when(condition, F.struct("ord", "text")))
    return F.array_join(F.transform(F.array_sort(picked), lambda s: s["text"]), " ")


def exchanges(turns: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Review pairs: neighbouring turns of one side are joined, the caller opens and the agent closes.
    A leading agent stretch is the greeting and has no caller text; a missing reply is empty."""
    caller = F.col("speaker") != "agent"
    numbered = with_takeovers(turns, caller, "exch", block_rows)
    return numbered.groupBy("conv_id", "exch").agg(
        F.when(F.max(caller.cast("int")) == 1, _joined(caller)).alias("caller"), _joined(~caller).alias("reply")
    )


def merge_labels(segments: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Merge neighbouring segments of one speaker, skipping empty ones."""
    changed = lambda this, before: before.isNull() | ~this["speaker"].eqNullSafe(before["speaker"])
    runs = o.stretches(drop_empty(segments), KEY, ORD, ["speaker"], changed, "run", _block(block_rows))
    return runs.groupBy("conv_id", "run").agg(F.first("speaker").alias("speaker"), _joined(F.lit(True)).alias("text"))


def body(turns: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Drop the opening: agent turns before the first other turn; without any other turn only the first turn."""
    first_other = F.min(F.when(F.col("speaker") != "agent", F.col("ord"))).alias("__first_other")
    starts = turns.groupBy("conv_id").agg(first_other, F.min("ord").alias("__first"))
    starts = starts.select("conv_id", F.coalesce("__first_other", F.col("__first") + 1).alias("__start"))
    return turns.join(starts, "conv_id").where(F.col("ord") >= F.col("__start")).drop("__start")


def token_counts(turns: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """One row per key and token with its number of occurrences."""
    exploded = turns.select(*keys, F.explode(tx.tokens("text")).alias("token"))
    return exploded.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias(count))


def profile(turns: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Turn counts, turns per raw speaker and whether a stored transcript is complete."""
    per_speaker = turns.groupBy("conv_id", "speaker").agg(
        F.count(F.lit(1)).alias("__all"), F.count_if(tx.strip("text") != "").alias("__filled")
    )
    side = tx.canonical_speaker("speaker")
    filled = F.col("__filled") > 0
    summed = per_speaker.groupBy("conv_id").agg(
        F.sum("__all").alias("turn_count"),
        F.sum("__filled").alias("non_empty"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(filled, F.struct("speaker", "__filled"))))
        ).alias("speaker_counts"),
        F.coalesce(F.bool_or(filled & (side == "customer")), F.lit(False)).alias("has_customer"),
        F.coalesce(F.bool_or(filled & (side == "agent")), F.lit(False)).alias("has_agent"),
    )
    too_few = F.col("non_empty") < config.transcript_min_turns
    one_sided = ~(F.col("has_customer") & F.col("has_agent"))
    reason = (
        F.when(too_few, F.format_string(f"persisted transcript has %d/{config.transcript_min_turns} non-empty turn(s)", "non_empty"))
        .when(one_sided, "persisted transcript does not contain both customer and agent turns")
        .otherwise("ok")
    )
    return summed.withColumn("reason", reason).withColumn("saved", F.col("reason") == "ok")


def compare(live: DataFrame, stored: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Token overlap of two transcripts per call: overall, agent and customer, with a verdict.

    Tokens are counted for both sides and all scopes in one pass, so the only shuffle of tokens carries a row per call and distinct token.
    """
    sides = live.select(*KEY, "speaker", "text", F.lit(1).alias("__live")).unionByName(
        stored.select(*KEY, "speaker", "text", F.lit(0).alias("__live"))
    )
    turn_counts = sides.groupBy(*KEY).agg(
        F.sum("__live").alias("live_count"), F.sum(1 - F.col("__live")).alias("stored_count")
    )
    scopes = {"overall": F.lit(True), "agent": F.col("speaker") == "agent", "customer": F.col("speaker") == "customer"}
    side = {"a": F.col("__live") == 1, "b": F.col("__live") == 0}
    spoken = sides.select(*KEY, "speaker", "__live", F.explode(tx.tokens("text")).alias("token"))
    per_token = spoken.groupBy(*KEY, "token").agg(*[F.count_if(held & of).alias(f"{s}_{n}") for s, of in scopes.items() for n, held in side.items()])
    sums = per_token.groupBy(*KEY).agg(*[
        F.sum(v).alias(f"{s}_{n}") for s in scopes
        for n, v in (("both", F.least(f"{s}_a", f"{s}_b")), ("a", F.col(f"{s}_a")), ("b", F.col(f"{s}_b")))
    ])
    def similarity(s: str) -> Column:
        a, b, both = (F.coalesce(f"{s}_{n}", F.lit(0)) for n in ("a", "b", "both"))
        raw = F.when(a + b == 0, F.lit(1.0)).when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.lit(2.0) * both / (a + b))
        return tx.round2(raw)
    skipped = (F.col("live_count") == 0) | (F.col("stored_count") == 0)
    overall = F.col("similarity")
    verdict = (
        F.when(skipped, "SKIPPED").when(overall >= config.transcript_match_min, "PASS")
        .when(overall >= config.transcript_match_warn, "WARN").otherwise("FAIL")
    )
    joined = turn_counts.join(sums, KEY, "left")
    return joined.select(
        *KEY, "live_count", "stored_count",
        *[F.when(~skipped, similarity(s)).alias(n) for s, n in
          (("overall", "similarity"), ("agent", "agent_similarity"), ("customer", "customer_similarity"))],
    ).withColumn("result", verdict)


def zip_ordinal(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str,
                how: str = "left", block_rows: int = o.DEFAULT_BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """Pair the i-th row of one list with the i-th row of another within each key (``pos`` from 1).

    ``rows``, the length of the longer table if it is known, bounds what a task sorts.
    """
    def numbered(df: DataFrame, order: str) -> DataFrame:
        if rows is None:
            return o.ordinal(df, keys, [order], "pos", o.blocks_of(order, block_rows))
        cut = o.in_tasks(o.with_block(df, o.blocks_of(order, block_rows)), rows, *keys, o.BLOCK)
        return o.in_tasks(o.ordinal(cut, keys, [order], "pos").drop(o.BLOCK), rows, *keys, "pos")

    a, b = numbered(left, left_order), numbered(right, right_order)
    if right_order in a.columns:
        b = b.drop(right_order)
    return a.join(b, [*keys, "pos"], how)


def review(summaries: DataFrame, locale: str = "en", agent_names: Sequence[str] = ()) -> DataFrame:
    """Review turns from call summaries: stored transcript if it has text, else the live one.

    Input: ``conv_id, stored ARRAY<STRUCT<speaker,text>>, live ARRAY<STRUCT<speaker,text>>, app_url, agent_id``.
    """
    def filled(c: str) -> Column:
        return F.filter(F.coalesce(F.col(c), F.array().cast("array<struct<speaker:string,text:string>>")),
                        lambda t: t["text"].isNotNull() & (t["text"] != ""))
    picked = summaries.select(
        "*", filled("stored").alias("__stored"), filled("live").alias("__live")
    ).select(
        "conv_id", tx.call_url("app_url", "agent_id", "conv_id", locale).alias("url"),
        F.when(F.size("__stored") > 0, "stored").when(F.size("__live") > 0, "live").otherwise("none").alias("source"),
        F.when(F.size("__stored") > 0, F.col("__stored")).otherwise(F.col("__live")).alias("__turns"),
    )
    return picked.select(
        "conv_id", "url", "source", F.posexplode_outer("__turns").alias("ord", "__t")
    ).select(
        "conv_id", "url", "source", F.col("ord").cast("bigint").alias("ord"),
        tx.canonical_speaker("__t.speaker", agent_names).alias("speaker"), F.col("__t.text").alias("text"),
    )


def parse_labelled(df: DataFrame, text: str = "reply") -> DataFrame:
    """``LABEL: text`` lines to turns; one unlabelled line rejects the whole reply (no rows)."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\r\\n|\\r|\\n"), tx.strip), lambda l: l != "")
    bare = F.transform(lines, lambda l: F.regexp_replace(l, "^\\d+\\.\\s*", ""))
    label = "(?is)^(AGENT|CUSTOMER|BANK|CALLER)\\s*:\\s*(.*)$"
    ok = F.forall(bare, lambda l: l.rlike(label))
    parsed = F.transform(bare, lambda l: F.struct(
        F.when(F.upper(F.regexp_extract(l, label, 1)).isin("AGENT", "BANK"), "AGENT").otherwise("CUSTOMER").alias("speaker"),
        tx.strip(F.regexp_extract(l, label, 2)).alias("text"),
    ))
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.when(ok, parsed).alias("__t")).select(
        *rest, F.posexplode("__t").alias("ord", "__t")
    ).select(*rest, F.col("ord").cast("bigint").alias("ord"), "__t.speaker", "__t.text")


def parse_label_array(reply: str | Column, expected: str | Column) -> Column:
    """JSON label array out of a model reply; null when absent, malformed or of another length."""
    bare = F.regexp_replace(tx.strip(F.coalesce(tx.col(reply), F.lit(""))), "(?U)^```(?:json)?\\s*|\\s*```$", "")
    arr = F.from_json(F.regexp_extract(bare, "(?s)(\\[.*\\])", 1), "array<string>")
    labels = F.transform(arr, lambda x: F.upper(tx.strip(x)))
    mapped = F.transform(labels, lambda x: F.when(x.rlike("^(AGENT|BANK)"), "AGENT")
                         .when(x.rlike("^(CUSTOMER|CALLER)"), "CUSTOMER").otherwise("UNKNOWN"))
    return F.when(F.size(mapped) == tx.col(expected), mapped)


def label_plan(segments: DataFrame, size: int = 12) -> DataFrame:
    """Cut a call's segments into numbered chunks of ``size``."""
    numbered = o.ordinal(segments, KEY, ORD, "__rn", _block(None))
    return numbered.withColumn("chunk", F.floor((F.col("__rn") - 1) / size).cast("bigint")).drop("__rn")


def accept_labels(chunks: DataFrame) -> DataFrame:
    """Choose, per chunk, the verbatim re-segmentation or else the per-segment labels, and carry the last speaker.

    Input: ``conv_id, chunk, turns ARRAY<STRUCT<speaker,text>>, fallback ARRAY<STRUCT<speaker,text>>, verbatim BOOLEAN``.
    """
    accepted = F.coalesce("verbatim", F.lit(False)) & (F.size("turns") > 0)
    spoken = F.filter("fallback", lambda t: tx.strip(t["text"]) != "")
    chosen = chunks.select(
        "conv_id", "chunk", F.when(accepted, F.col("turns")).otherwise(spoken).alias("labelled"),
        F.when(accepted, "resegment").otherwise("classify").alias("method"),
        F.when(accepted, F.element_at("turns", -1)["speaker"])
        .when(F.size("fallback") > 0, F.element_at("fallback", -1)["speaker"]).alias("__last"),
    )
    carried = o.last_seen(chosen, KEY, ["chunk"], F.col("__last"), "context_speaker", o.blocks_of("chunk"), inclusive=False)
    return carried.drop("__last")
