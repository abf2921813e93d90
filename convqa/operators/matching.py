"""Match calls to stored conversations and runs to artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convqa.config import CallConfig
from convqa.functions import text as tx
from convqa.operators import content_pairs, transcripts
from convqa.operators import ordered as o
from convqa.session import discard, materialize

DAY_MS = 86_400_000
HELD = 8_000_000  # distinct tokens of the contents that a task holds
PASSING = 4  # times as many pass by
CONTENT = 16  # tokens that take as much as the rest of a content


def asof_conversation(calls: DataFrame, convs: DataFrame, skew_ms: int = CallConfig.call_match_skew_ms,
                      block_width: int = DAY_MS) -> DataFrame:
    """Stored conversation of each call: the first created at or after its start, else the nearest one
    within the skew before it, else the newest of the agent.

    ``calls``: ``call_id, agent_id, started_ms``; ``convs``: ``conv_id, agent_id, created_ms``.
    The as-of pass is a time-block scan, so an agent with very many calls stays spread.
    """
    both = o.asof_both(calls, convs, ["agent_id"], "started_ms", "created_ms", ["conv_id"], block_width, ["conv_id"])
    near = F.col("before_created_ms") >= F.col("started_ms") - skew_ms
    match = (
        F.when(F.col("after_conv_id").isNotNull(), "after").when(near, "skew")
        .when(F.col("before_conv_id").isNotNull(), "fallback").otherwise("none")
    )
    return both.select(
        *calls.columns, F.coalesce("after_conv_id", "before_conv_id").alias("conv_id"), match.alias("match")
    )


def _packed(counts: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """One row per content from its rows ``token, n``: the number of distinct tokens (``kinds``), and these with their counts compressed
    (``bag``). Tokens hold no blank."""
    bag = F.sort_array(F.collect_list(F.struct("token", "n"))).alias("__bag")
    rows = counts.groupBy(*keys).agg(*more, F.count(F.lit(1)).alias("kinds"), bag)
    n = F.col("__bag.n").cast("array<string>")
    joined = rows.withColumn("words", F.array_join("__bag.token", " ")).withColumn("counts", F.array_join(n, " "))
    return content_pairs.squeezed(joined.drop("__bag"))


def _bags(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed token counts per transcript body, and one content signature per transcript.

    The signature combines two order-free 64-bit sums, so equal bags share it and copies can be
    matched once instead of pair by pair. Turns are dealt by transcript before anything else: their text
    is shuffled once, and its tokens are counted and packed where it arrives. Both tables are read many times and written.
    """
    h = F.xxhash64("token", "n")
    g = F.xxhash64(F.lit("bag"), "n", "token").cast("decimal(38,0)")
    signature = F.concat_ws(":", F.bit_xor(h).cast("string"), F.sum(g).cast("string"), F.sum("n").cast("string")).alias("sig")
    counts = transcripts.token_counts(transcripts.body(turns.repartition("conv_id")), ["conv_id"])
    bags = materialize(_packed(counts, ["conv_id"], signature, F.sum("n").alias("size")), "bags", tidy=True)
    return bags, materialize(bags.select("conv_id", "sig", "size"), "signed")


def _distinct_bags(bags: DataFrame, signed: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed bags ``agent_id, sig, size, kinds, bag`` once per agent and distinct content, and ``conv_id, agent_id, sig`` of all
    (``owners``: ``conv_id, agent_id``).

    ``sig`` is the smallest conversation of the agent with that content: signatures are long texts that no shuffle can pack. The second
    table is written, for all that follows goes by it.
    """
    owned = signed.join(owners, "conv_id")
    one = owned.groupBy("agent_id", F.col("sig").alias("__sig"), "size").agg(F.min("conv_id").alias("sig"))
    members = owned.withColumnRenamed("sig", "__sig").join(one.drop("size"), ["agent_id", "__sig"])
    members = materialize(members.select("conv_id", "agent_id", "sig", "size"), "members")
    counted = bags.drop("sig", "size").join(members.where("conv_id = sig").drop("sig"), "conv_id")
    return counted.withColumnRenamed("conv_id", "sig"), members.drop("size")


def similar_contents(left: DataFrame, right: DataFrame, minimum: float, limit: int = HELD) -> DataFrame:
    """Content pairs ``agent_id, sig, other, sim`` of one agent whose multiset Dice reaches ``minimum``.

    Both sides have ``agent_id, sig, size`` and either a row per ``token, n`` or ``kinds, bag`` (see :func:`_packed`).
    Pairs are formed, ruled out and counted inside tasks (:func:`content_pairs.similar_pairs`), so contents and found pairs are
    all that reaches a disk. An agent's contents are cut, in the order of their sizes, into blocks that a task can hold
    (``limit`` distinct tokens); larger blocks of the left side are read past those of the right
    side whose sizes allow ``minimum``. A content is sent once to every block it can have a pair in.
    """
    left, right = (df if "bag" in df.columns else _packed(df, ["agent_id", "sig", "size"]) for df in (left, right))
    sided = lambda df, side: df.select("agent_id", "sig", "size", (F.col("kinds") + CONTENT).alias("weight"), F.lit(side).alias("side"))
    sizes = sided(right, content_pairs.RIGHT).unionByName(sided(left, content_pairs.LEFT))
    upto = o.running_sum(sizes, ["side", "agent_id"], ["size", "sig"], F.col("weight"), "upto", F.floor(16 * F.log2("size")).cast("bigint"))
    holds = F.when(F.col("side") == content_pairs.RIGHT, limit).otherwise(PASSING * limit)
    placed = materialize(upto.withColumn("block", F.floor((F.col("upto") - F.col("weight")) / holds).cast("bigint")).drop("upto"), "placed")
    blocks = placed.groupBy("side", "agent_id", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.sum("weight").alias("weight"))
    named = lambda side, tag: blocks.where(F.col("side") == side).select(
        "agent_id", *[F.col(c).alias(f"{tag}_{c}") for c in ("block", "low", "high", "weight")])
    # Of two contents that reach the minimum, the smaller one has at least minimum / (2 - minimum) of the tokens of the larger one.
    allows = lambda high, low: high * F.lit(2 - minimum) >= low * F.lit(minimum) - 1e-6
    met = named(content_pairs.RIGHT, "r").join(named(content_pairs.LEFT, "l"), "agent_id").where(
        allows(F.col("l_high"), F.col("r_low")) & allows(F.col("r_high"), F.col("l_low")))
    groups = materialize(met.withColumn("group", F.monotonically_increasing_id()), "groups")
    count, weight = groups.agg(F.count(F.lit(1)), F.sum(F.col("r_weight") + F.col("l_weight"))).first()
    tasks = max(1, min(count, max(left.sparkSession.sparkContext.defaultParallelism, -(-(weight or 0) // HELD))))

    def sent(df: DataFrame, side: int, own: str, other: str) -> DataFrame:
        """Rows of one side, once per group. Joined by ``sig`` alone, by which they are already dealt."""
        to = (
            placed.where(F.col("side") == side).join(groups.withColumnRenamed(f"{own}_block", "block"), ["agent_id", "block"])
            .where(allows(F.col("size"), F.col(f"{other}_low")) & allows(F.col(f"{other}_high"), F.col("size")))
            .groupBy("sig").agg(F.collect_list(F.struct("agent_id", "group")).alias("__to")))
        here = F.explode(F.filter("__to", lambda t: t["agent_id"] == F.col("agent_id")))
        return df.join(to, "sig").withColumn("__to", here).select(
            F.col("__to.group").alias("group"), F.lit(side).alias("side"), "agent_id", "sig", "size", "bag")

    rows = sent(right, content_pairs.RIGHT, "r", "l").unionByName(sent(left, content_pairs.LEFT, "l", "r"))
    dealt = rows.repartitionById(tasks, (F.col("group") % tasks).cast("int")).sortWithinPartitions("group", "side", "size")
    kinds, others = dict(left.dtypes), dict(right.dtypes)
    return dealt.mapInArrow(content_pairs.similar_pairs(minimum), f"agent_id {kinds['agent_id']}, sig {kinds['sig']}, other {others['sig']}, sim double")


def match_by_content(calls: DataFrame, live: DataFrame, convs: DataFrame, stored: DataFrame, config: CallConfig = CallConfig(),
                     block_width: int = DAY_MS) -> DataFrame:
    """Stored conversation whose body matches the live transcript of a call.

    Among the agent's conversations created after the start (less the skew), the nearest in time with a
    similarity of ``transcript_match_min`` wins, else the most similar one from ``conv_match_min`` on.
    ``calls``: ``call_id, agent_id, started_ms``; ``convs``: ``conv_id, agent_id, created_ms``;
    ``live``/``stored``: turns keyed by ``conv_id`` (call id on the live side). Unmatched calls keep nulls. Where ``convs`` has a
    column ``saved``, only conversations that are stored completely are candidates. A call without a word in its body is
    matched by time alone and has no ``sim``.

    Equal contents are compared once. For each call and each similar content the nearest conversation
    comes from one as-of scan, so a group of identical calls never forms its pairs.
    """
    if "saved" in convs.columns:
        convs = convs.where("saved").drop("saved")
    live_packed, live_sig = _bags(live)
    stored_packed, stored_sig = _bags(stored)
    live_bags, said = _distinct_bags(live_packed, live_sig, calls.select(F.col("call_id").alias("conv_id"), "agent_id"))
    stored_bags, kept = _distinct_bags(stored_packed, stored_sig, convs.select("conv_id", "agent_id"))
    # written, because the as-of scan reads its rows more than once
    pairs = materialize(similar_contents(live_bags, stored_bags, config.conv_match_min), "pairs", tidy=True)
    discard(calls.sparkSession, live_packed, stored_packed)
    wanted = (
        calls.join(said.select(F.col("conv_id").alias("call_id"), "agent_id", "sig"), ["call_id", "agent_id"])
        .join(pairs, ["agent_id", "sig"]).select("call_id", "agent_id", "started_ms", F.col("other").alias("sig"), "sim")
    )
    have = convs.join(kept, ["conv_id", "agent_id"]).select("agent_id", "sig", "created_ms", "conv_id")
    both = o.asof_both(wanted, have, ["agent_id", "sig"], "started_ms", "created_ms", ["conv_id"], block_width, ["conv_id"])
    near = F.col("before_created_ms") >= F.col("started_ms") - config.call_match_skew_ms
    candidate = both.select("call_id", "sim", F.explode(F.array(
        F.struct(F.col("after_conv_id").alias("conv_id"), (F.col("after_created_ms") - F.col("started_ms")).alias("away")),
        F.struct(F.when(near, F.col("before_conv_id")).alias("conv_id"), (F.col("started_ms") - F.col("before_created_ms")).alias("away")),
    )).alias("c")).select("call_id", "sim", "c.*").where(F.col("conv_id").isNotNull())
    sure = F.col("sim") >= config.transcript_match_min
    rank = F.struct(F.when(sure, 0).otherwise(1), F.when(sure, F.col("away")).otherwise(0), -F.col("sim"), F.col("away"), F.col("conv_id"))
    best = candidate.groupBy("call_id").agg(F.min_by(F.struct("conv_id", "sim"), rank).alias("b"))
    silent = calls.join(live_sig.select(F.col("conv_id").alias("call_id")), "call_id", "left_anti")
    timed = asof_conversation(silent, convs, config.call_match_skew_ms, block_width).select("call_id", F.col("conv_id").alias("__timed"))
    found = calls.join(best, "call_id", "left").join(timed, "call_id", "left")
    return found.select("call_id", F.coalesce("b.conv_id", "__timed").alias("conv_id"), F.col("b.sim").alias("sim"))


def match_artifacts(results: DataFrame, artifacts: DataFrame, allow_newest: bool) -> DataFrame:
    """Artifact of each run result: same conversation id, else same second of the stamp, else (optionally) the newest.

    Within a class the last file name wins. Every class is one lookup against a pre-aggregated side, so a
    session with many runs never multiplies. ``results``: ``session_id, run_stamp, conversation_id``;
    ``artifacts``: ``session_id, file, stamp, conversation_id``.
    """
    by_conv = artifacts.where(F.coalesce("conversation_id", F.lit("")) != "").groupBy("session_id", "conversation_id").agg(F.max("file").alias("__conv"))
    second = F.substring("stamp", 1, 19)
    by_stamp = artifacts.groupBy("session_id", second.alias("__sec"), "stamp").agg(F.max("file").alias("__file"))
    newest = artifacts.groupBy("session_id").agg(F.max("file").alias("__newest"))
    prefixed = (
        results.withColumn("__sec", F.substring("run_stamp", 1, 19)).join(by_stamp, ["session_id", "__sec"])
        .where(F.col("stamp").startswith(tx.stamp_second("run_stamp")))
        .groupBy("session_id", "run_stamp").agg(F.max("__file").alias("__stamp"))
    )
    joined = (
        results.join(by_conv, ["session_id", "conversation_id"], "left").join(prefixed, ["session_id", "run_stamp"], "left")
        .join(newest, "session_id", "left")
    )
    last = F.col("__newest") if allow_newest else F.lit(None).cast("string")
    how = (
        F.when(F.col("__conv").isNotNull(), "conversation").when(F.col("__stamp").isNotNull(), "stamp")
        .when(last.isNotNull(), "newest").otherwise("none")
    )
    return joined.select(*results.columns, F.coalesce("__conv", "__stamp", last).alias("file"), how.alias("match"))


def newest_artifact(files: DataFrame, keys: list[str]) -> DataFrame:
    """Newest file per key by the stamp in its name, unstamped last, then by modification time."""
    rank = F.struct(F.coalesce(tx.embedded_stamp("name"), F.lit("")), F.col("mtime"), F.col("name"))
    return files.groupBy(*keys).agg(F.max_by("name", rank).alias("name"))


def newest_per_agent(convs: DataFrame) -> DataFrame:
    return convs.groupBy("agent_id").agg(F.max_by("conv_id", F.struct("created_ms", "conv_id")).alias("conv_id"))


def resolve_agents(names: list[str], agents: DataFrame) -> DataFrame:
    """Agent id for each configured name: case-insensitive part of exactly one agent label.

    The few names become aggregate columns of one pass over the agents.
    """
    def hit(n: str):
        return F.lower("label").contains(n.lower())
    stats = agents.agg(*[x for i, n in enumerate(names) for x in (
        F.count_if(hit(n)).alias(f"c{i}"), F.min(F.when(hit(n), F.col("id"))).alias(f"m{i}"))])
    return stats.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("matches"), F.when(F.col(f"c{i}") == 1, F.col(f"m{i}")).alias("agent_id"))
        for i, n in enumerate(names)
    ])).alias("r")).select(
        "r.*", F.when(F.col("r.matches") == 1, "resolved").when(F.col("r.matches") == 0, "none").otherwise("ambiguous").alias("status")
    )


def created_after(conversations: DataFrame, started_ms: int | Column, skew_ms: int = CallConfig.call_match_skew_ms, created: str = "created_ms") -> DataFrame:
    """Stored calls that can belong to a call begun at ``started_ms``, allowing for clocks that differ by ``skew_ms``."""
    return conversations.where(F.col(created) >= started_ms - F.lit(skew_ms))
