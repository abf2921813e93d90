"""Session building from a question pool ``id, language, ...``: batching, quotas, flows, sampling, repeats.

A pool has few languages and topics, so a window per language would be one task for most rows. Random
order is md5 order, and positions come from ``hash_ordinal``, which splits every group by hash prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convqa.functions import text as tx
from convqa.operators import ordered as o

MESSAGE = ("turn", "question_id", "question", "expected_answer", "audio_file")


def shuffle(df: DataFrame, ident: str, seed: str | int, keys: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Seeded shuffle: position of every row within ``keys`` in a reproducible random order."""
    hashed = df.withColumn("__h", o.seeded_hash(seed, ident))
    return o.hash_ordinal(hashed, list(keys), "__h", ident, name).drop("__h")


def session_id(name: Column, language: str | Column, number: Column) -> Column:
    bare = F.regexp_replace(name, "\\s+", "")
    return tx.padded_id(F.concat(bare, F.lit("-"), tx.col(language), F.lit("-")), number)


def build(questions: DataFrame, size: int, seed: str | int, caps: dict[str, int] | None = None,
          group: Sequence[str] = ("topic", "sub_topic")) -> DataFrame:
    """Cut each (group, language) pool into sessions of ``size``; the short last one is filled up with
    other questions of the pool. ``caps`` limits the number of sessions per language (0 or absent = all)."""
    keys = [*group, "language"]
    numbered = shuffle(questions, "id", seed, keys, "__rn")
    own = numbered.select(
        *keys, "id", F.expr(f"(__rn - 1) div {size} + 1").alias("session_no"), F.expr(f"(__rn - 1) % {size} + 1").alias("turn")
    )
    pool = questions.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    last = pool.select(
        *keys, F.expr(f"(__n - 1) div {size} + 1").alias("session_no"), F.expr(f"(__n - 1) % {size} + 1").alias("__used"),
    ).where(F.col("__used") < size)
    # At most size - 1 fillers per pool: a literal row_number bound is pruned map-side before the shuffle.
    outside = numbered.join(last, keys).where(F.expr(f"(__rn - 1) div {size} + 1") < F.col("session_no"))
    by_hash = Window.partitionBy(*keys).orderBy("__f", "id")
    fillers = (
        outside.withColumn("__f", o.seeded_hash(f"{seed}-fill", "id"))
        .withColumn("__k", F.row_number().over(by_hash)).where(F.col("__k") < size)
        .where(F.col("__k") + F.col("__used") <= size)
        .select(*keys, "id", "session_no", (F.col("__k") + F.col("__used")).alias("turn"))
    )
    turns = own.unionByName(fillers)
    for lang, cap in (caps or {}).items():
        if cap > 0:
            turns = turns.where((F.col("language") != lang) | (F.col("session_no") <= cap))
    return turns.withColumn("session_id", session_id(F.col(group[-1]), "language", F.col("session_no")))


def build_quota(questions: DataFrame, sessions: int, size: int, seed: str | int, reuse: bool = False) -> DataFrame:
    """Exactly ``sessions`` sessions of ``size`` turns per language. Without reuse the pool may run out, and
    no partial session is emitted; with reuse the pool is shuffled again for every pass."""
    wanted = sessions * size
    pool = questions.groupBy("language").agg(F.count(F.lit(1)).alias("__n"))
    if reuse:
        pool = pool.withColumn("__passes", F.expr(f"({wanted} + __n - 1) div __n"))
        copies = o.repeated(questions.join(pool, "language"), F.col("__passes"), "pass").withColumn("pass", (F.col("pass") + 1).cast("int"))
    else:
        copies = questions.join(pool, "language").withColumn("pass", F.lit(1))
    hashed = copies.withColumn("__h", o.seeded_hash(seed, "pass", "id"))
    numbered = o.hash_ordinal(hashed, ["language", "pass"], "__h", "id", "__rn")
    at = (F.col("pass") - 1) * F.col("__n") + F.col("__rn")
    limit = F.lit(wanted) if reuse else F.expr(f"least(cast({wanted} as bigint), __n div {size} * {size})")
    return (
        numbered.withColumn("position", at).where(F.col("position") <= limit)
        .withColumn("session_no", F.expr(f"(position - 1) div {size} + 1"))
        .withColumn("turn", F.expr(f"(position - 1) % {size} + 1"))
        .withColumn("session_id", F.format_string("S%03d_%s", "session_no", "language"))
        .drop("__h", "__rn", "__n", "__passes")
    )


def repeat_check(turns: DataFrame, pool: DataFrame) -> DataFrame:
    """Per language: is every pool question used before any question repeats? (``position`` from 1)

    Only the two earliest uses of each question matter, so no running distinct count is needed.
    """
    uses = Window.partitionBy("language", "id").orderBy("position")
    first_two = turns.withColumn("__k", F.row_number().over(uses)).where(F.col("__k") <= 2)
    per_question = first_two.groupBy("language", "id").agg(
        F.min(F.when(F.col("__k") == 1, F.col("position"))).alias("__first"),
        F.min(F.when(F.col("__k") == 2, F.col("position"))).alias("__second"),
    )
    used = per_question.groupBy("language").agg(
        F.count(F.lit(1)).alias("seen"), F.max("__first").alias("all_seen_at"), F.min("__second").alias("first_repeat")
    )
    sizes = pool.groupBy("language").agg(F.countDistinct("id").alias("pool_size"))
    exhausted = (F.col("seen") == F.col("pool_size")) & (F.col("first_repeat") > F.col("all_seen_at"))
    return sizes.join(used, "language").select(
        "language", "pool_size", "seen", "first_repeat",
        (F.col("first_repeat").isNull() | exhausted).alias("ok"),
    )


def uncovered(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """Questions that no session asks."""
    return questions.join(turns.select(F.col("id")).distinct(), "id", "left_anti")


def select_sessions(df: DataFrame, only: Sequence[str]) -> DataFrame:
    """``ar,en``-like lists select languages, any other list selects session ids."""
    wanted = [x.strip() for x in only]
    if all(w.lower() in ("ar", "en") for w in wanted):
        return df.where(F.col("language").isin([w.lower() for w in wanted]))
    return df.where(F.col("session_id").isin(wanted))


def first_sessions(sessions: DataFrame, order: str, n: int, per: Sequence[str] = ()) -> DataFrame:
    """First ``n`` sessions, overall or per language (a top-k, pruned map-side)."""
    if not per:
        return sessions.orderBy(order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(order))
    return sessions.withColumn("__k", rank).where(F.col("__k") <= n).drop("__k")


def sample_proportional(sessions: DataFrame, k: int, seed: str | int, languages: tuple[str, str] = ("ar", "en"),
                        ident: str = "session_id") -> DataFrame:
    """Random ``k`` sessions that keep the mix of two languages; a short side spills over to the other."""
    first, second = languages
    counts = sessions.agg(
        F.count_if(F.col("language") == first).alias("__a"), F.count_if(F.col("language") == second).alias("__b"),
        F.count(F.lit(1)).alias("__all"),
    )
    want_a = tx.round_half_up(F.lit(k) * F.col("__a") / F.col("__all"))
    quotas = counts.select(
        "__a", "__b", F.when(F.col("__all") > 0, want_a).otherwise(0).alias("__wa"),
    ).withColumn("__wb", k - F.col("__wa"))
    take_a = F.least(F.least("__wa", "__a") + F.greatest(F.col("__wb") - F.col("__b"), F.lit(0)), F.col("__a"))
    take_b = F.least(F.least("__wb", "__b") + F.greatest(F.col("__wa") - F.col("__a"), F.lit(0)), F.col("__b"))
    quotas = quotas.select(F.explode(F.array(
        F.struct(F.lit(first).alias("language"), take_a.alias("__take")),
        F.struct(F.lit(second).alias("language"), take_b.alias("__take")),
    )).alias("q")).select("q.*")
    ranked = shuffle(sessions.where(F.col("language").isin(first, second)), ident, seed, ["language"], "__k")
    # The quota side has exactly two rows.
    return ranked.join(F.broadcast(quotas), "language").where(F.col("__k") <= F.col("__take")).drop("__k", "__take")


def reshuffle_turns(turns: DataFrame, seed: str | int) -> DataFrame:
    """New random question order inside every session, turns numbered again."""
    return shuffle(turns.drop("turn"), "question_id", seed, ["session_id"], "turn")


def repeat(sessions: DataFrame, times: int) -> DataFrame:
    """Every session ``times`` times; copies get ``#2`` .. and all of one cycle come before the next."""
    copies = o.repeated(sessions, F.lit(times), "cycle").withColumn("cycle", (F.col("cycle") + 1).cast("int"))
    suffix = F.when(F.col("cycle") == 1, "").otherwise(F.concat(F.lit("#"), F.col("cycle").cast("string")))
    return copies.withColumn("session_id", F.concat("session_id", suffix))


def recycle(sessions: DataFrame, order: str, targets: dict[str, int], block: Column | None = None) -> DataFrame:
    """Cycle through each language's sessions until its target number of calls is reached exactly.

    ``order`` is an integer column unless ``block`` says how to cut it.
    """
    counted = sessions.groupBy("language").agg(F.count(F.lit(1)).alias("__n"))
    target = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    counted = counted.withColumn("__target", target[F.col("language")]).where(F.col("__target").isNotNull())
    ranked = o.ordinal(sessions, ["language"], [order], "__rn", block if block is not None else o.blocks_of(order))
    copies = o.repeated(ranked.join(counted, "language"), F.expr("greatest((__target + __n - 1) div __n, 1)"), "cycle").withColumn("cycle", (F.col("cycle") + 1).cast("int"))
    copies = copies.withColumn("call_no", (F.col("cycle") - 1) * F.col("__n") + F.col("__rn"))
    return copies.where(F.col("call_no") <= F.col("__target")).drop("__n", "__target", "__rn")


def compose_flows(questions: DataFrame, first: Column | str, second: Column | str, third: Column | str,
                  plan: DataFrame, topic: str = "KnowledgeHub", name: str = "MultiFlow") -> DataFrame:
    """Sessions of all steps of one flow, all steps of a second, then the full answer of a third.

    ``questions``: ``base, mode, language, step, id, question, expected_answer``, and ``part`` where an answer comes in pieces (then
    the rows of one turn share its number); ``plan``: one row per session, ``session_no`` and the three flow names.
    A session is built for a language only when all three parts exist in it. The questions of a flow are numbered once
    for all its sessions; a session's turn is that number behind the lengths of the parts before it.
    """
    pieces = questions if "part" in questions.columns else questions.withColumn("part", F.lit(1))
    pieces = pieces.withColumn("step", F.col("step").cast("bigint"))
    flow = ["base", "mode", "language"]
    numbered = o.running_sum(pieces, flow, ["step", "part"], F.when(F.col("part") == 1, 1).otherwise(0).cast("bigint"), "__nth", o.blocks_of("step"))
    lengths = numbered.groupBy(*flow).agg(F.max("__nth").alias("__len"))
    parts = plan.select("session_no", F.explode(F.array(*[
        F.struct(F.lit(i).alias("__part"), tx.col(c).alias("base"), F.lit(mode).alias("mode"))
        for i, (c, mode) in enumerate(((first, "incremental"), (second, "incremental"), (third, "fulldump")))
    ])).alias("p")).select("session_no", "p.*").join(lengths, ["base", "mode"])
    length = lambda i: F.max(F.when(F.col("__part") == i, F.col("__len"))).alias(f"__len{i}")
    complete = parts.groupBy("session_no", "language").agg(*[length(i) for i in range(3)]).where("__len0 is not null and __len1 is not null and __len2 is not null")
    # Sessions are numbered in plan order with the languages of one plan row next to each other.
    ids = o.ordinal(complete, [], ["session_no", "language"], "number", o.blocks_of("session_no", 4096))
    before = F.when(F.col("__part") == 0, 0).when(F.col("__part") == 1, F.col("__len0")).otherwise(F.col("__len0") + F.col("__len1"))
    placed = parts.join(ids, ["session_no", "language"]).select(*flow, "number", before.alias("__before"))
    turns = placed.join(numbered, flow)
    out = [
        session_id(F.lit(name), "language", F.col("number")).alias("session_id"), F.lit(f"{topic}/{name}").alias("subtopic"),
        "language", (F.col("__before") + F.col("__nth")).alias("turn"), F.col("id").alias("question_id"), "question", "expected_answer",
        F.concat(F.lit("wav/"), "id", F.lit(".wav")).alias("audio_file"),
    ]
    return turns.select(*out, *(["part"] if "part" in questions.columns else []))


def auto_flow_plan(questions: DataFrame, seed: str | int) -> DataFrame:
    """Random flow pairs plus a third flow per pair: floor(flows / 2) sessions.

    Flows lacking a step-by-step form cannot open a session. The third flow is the next one in the
    shuffled ring that has a full answer, so it differs from the pair, and from the third flow of
    other sessions while enough flows are available. A pair that holds every flow with a full answer
    has no third flow and gives no session.
    """
    modes = questions.groupBy("base").agg(
        F.bool_or(F.col("mode") == "incremental").alias("__inc"), F.bool_or(F.col("mode") == "fulldump").alias("__dump")
    )
    inc = shuffle(modes.where("__inc").select("base"), "base", seed, (), "__pos")
    pairs = inc.groupBy(F.expr("(__pos + 1) div 2").alias("session_no")).agg(
        F.min_by("base", "__pos").alias("first"), F.max_by("base", "__pos").alias("second"), F.count(F.lit(1)).alias("__n")
    ).where("__n = 2").drop("__n")
    dumps = shuffle(modes.where("__dump").select("base"), "base", f"{seed}-third", (), "__slot")
    total = modes.agg(F.count_if("__dump").alias("__total"))
    # Of three neighbouring ring slots one lies outside the pair, if any flow with a full answer does.
    ring = pairs.join(F.broadcast(total)).withColumn("__try", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    ring = ring.withColumn("__slot", F.expr("(session_no - 1 + __try) % __total + 1"))
    allowed = ring.join(dumps.withColumnRenamed("base", "third"), "__slot").where(
        (F.col("third") != F.col("first")) & (F.col("third") != F.col("second"))
    )
    return allowed.groupBy("session_no", "first", "second").agg(F.min_by("third", "__try").alias("third"))


def nest(turns: DataFrame, keys: Sequence[str] = ("session_id", "subtopic", "language")) -> DataFrame:
    """One row per session with its messages in turn order (the file form of a session)."""
    message = F.struct(*MESSAGE)
    return turns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(message)).alias("messages")
    )


def explode_messages(sessions: DataFrame) -> DataFrame:
    keep = [c for c in sessions.columns if c not in ("messages", "turns")]
    return sessions.select(*keep, F.explode("messages").alias("m")).select(*keep, "m.*")


def with_audio(questions: DataFrame, audio: str = "audio_file") -> DataFrame:
    """Questions that have a clip; the others cannot be played and are left out."""
    return questions.where(F.coalesce(F.col(audio), F.lit("")) != "")
