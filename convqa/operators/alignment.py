"""Customer utterances assigned to the played questions by content, with a session spread over many tasks.

An utterance moves a cursor over the questions: it stays with the question it belongs to or goes on to the next. What it
does depends on the cursor and on whether the current question already has its reply, so a block of utterances is a function
from (cursor, answered) to (cursor, answered). Blocks are worked out side by side for a window of cursors around a guess; the
blocks' results are then chained per session, one small row per block and cursor. Where the true cursor lies outside a
window, the chain gives a better guess and that block is worked out again; each round settles at least the first open block
of a session, and in practice all of them, as the length of a block's way hardly depends on where it starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convqa.functions import text as tx
from convqa.operators import ordered as o
from convqa.session import materialize

# Fixed values of the alignment rule.
FRAGMENT_FLOOR = 0.1
TAIL_CHARS = 12
TAIL_MARGIN = 0.15
NOISE_CHARS = 8

SPAN = 4_096  # utterances per block
WIDTH = 16  # cursors per window


def overlap(words: frozenset, question: Sequence[frozenset]) -> float:
    """Best share of common words with one of a question's texts, by the shorter side."""
    return max((len(words & other) / min(len(words), len(other)) for other in question if words and other), default=0.0)


def stays(here: float, there: float, answered: bool, chars: int) -> bool:
    """Whether an utterance is a piece of the current question (overlap ``here``) and does not open the next one (``there``).

    A limit on its length and a margin for the next question decide; which limit and margin depends on what came before.
    """
    if answered:
        longest, margin = TAIL_CHARS, TAIL_MARGIN
    elif max(here, there) < FRAGMENT_FLOOR:
        longest, margin = NOISE_CHARS, 1.0
    else:
        longest, margin = chars, 0.0
    return chars <= longest and here >= there - margin


def slots(turns: DataFrame, block_rows: int = o.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """One row per customer utterance: ``session_id, slot`` (from 1), ``text, words, chars, reply`` (the first text after it)."""
    spoken = turns.select(
        "session_id", F.col("ord").cast("bigint").alias("ord"), (F.lower(F.coalesce("speaker", F.lit(""))) == "customer").alias("asks"),
        tx.strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    numbered = o.running_sum(spoken, ["session_id"], ["ord"], F.col("asks").cast("int"), "slot", o.blocks_of("ord", block_rows))
    said = F.max(F.when(F.col("asks"), F.col("text"))).alias("text")
    reply = F.min_by("text", F.when(~F.col("asks"), F.col("ord"))).alias("reply")
    grouped = numbered.where("slot > 0").groupBy("session_id", F.col("slot").cast("bigint").alias("slot")).agg(said, reply)
    return grouped.select("session_id", "slot", "text", tx.words_loose("text").alias("words"), F.length(tx.norm_text_loose("text")).alias("chars"), "reply")


def _walk(session_type: str, positions: bool):
    """Function over rows sorted by session, block, kind and number: questions of a window, then the block's utterances.

    Gives the block's function for every start of the window (``positions`` false) or each utterance's question (true).
    """
    first_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[session_type]
    names = ["session_id", "slot", "pos"] if positions else ["session_id", "block", "pos", "answered", "end_pos", "end_answered"]
    types = [first_type, pa.int64(), pa.int64()] + ([] if positions else [pa.bool_(), pa.int64(), pa.bool_()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, states, out = None, {}, {}, []

        def done() -> None:
            if now is not None and not positions:
                out.extend((*now, pos, answered, *end) for (pos, answered), end in states.items())

        for batch in batches:
            for session, block, kind, n, words, expected, chars, replied, low, width, known in zip(*[c.to_pylist() for c in batch.columns]):
                if (session, block) != now:
                    done()
                    now, asked, states = (session, block), {}, {}
                if kind == 0:
                    asked[n] = (frozenset(words), frozenset(expected))
                    continue
                if not states:
                    flags = (False, True) if known is None else (known,)
                    states = {(p, a): (p, a) for p in range(low, low + width) for a in flags}
                own, moved = frozenset(words), {}
                for pos, answered in set(states.values()):
                    after = asked.get(pos + 1)
                    stay = pos > 0 and (after is None or stays(overlap(own, asked.get(pos, ())), overlap(own, after), answered, chars))
                    moved[pos, answered] = (pos, answered or replied) if stay else (pos + 1, replied)
                states = {start: moved[at] for start, at in states.items()}
                if positions:
                    out.append((session, n, next(iter(states.values()))[0]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    schema = f"session_id {session_type}, " + ("slot bigint, pos bigint" if positions else "block bigint, pos bigint, answered boolean, end_pos bigint, end_answered boolean")
    return run, schema


def _worked_out(spoken: DataFrame, asked: DataFrame, starts: DataFrame, span: int, positions: bool) -> DataFrame:
    """Blocks named in ``starts`` (``session_id, block, low, width, known``) with the questions their windows can reach."""
    reach = F.sequence(F.expr(f"low div {span}"), F.expr(f"(low + width + {span + 1}) div {span}"))
    wanted = starts.select("session_id", "block", "low", (F.col("low") + F.col("width") + span + 1).alias("high"), F.explode(reach).alias("part"))
    near = asked.withColumn("part", F.expr(f"pos div {span}")).join(wanted, ["session_id", "part"]).where("pos between low and high")
    none = F.array().cast("array<string>")
    nothing = [F.lit(0).alias("chars"), F.lit(False).alias("replied"), F.lit(0).cast("bigint").alias("low"), F.lit(0).alias("width"), F.lit(None).cast("boolean").alias("known")]
    questions = near.select("session_id", "block", F.lit(0).alias("kind"), F.col("pos").alias("n"), "words", "expected", *nothing)
    utterances = spoken.join(starts, ["session_id", "block"]).select(
        "session_id", "block", F.lit(1).alias("kind"), F.col("slot").alias("n"), "words", none.alias("expected"), "chars", F.col("reply").isNotNull().alias("replied"),
        F.col("low").cast("bigint").alias("low"), F.col("width").cast("int").alias("width"), "known")
    rows = questions.unionByName(utterances).repartition("session_id", "block").sortWithinPartitions("session_id", "block", "kind", "n")
    return rows.mapInArrow(*_walk(dict(spoken.dtypes)["session_id"], positions))


def _chain(functions: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """``session_id, block, low, known, settled``: the start of each block as far as the blocks' functions reach, guesses behind.

    Streams a session's blocks in order; what is held are the entries of one block.
    """
    session_type = dict(blocks.dtypes)["session_id"]
    first_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[session_type]
    types = [first_type, pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    names = ["session_id", "block", "low", "known", "settled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, block, pos, answered, sure, entries, out = None, None, 0, False, True, {}, []

        def step() -> None:
            """Close a block: tell its start and go to its end, by the nearest entry where the start itself was not worked out."""
            nonlocal pos, answered, sure
            out.append((session, block, pos if sure else max(1, pos - width // 2), answered if sure else None, sure))
            sure = sure and (pos, answered) in entries
            if entries:
                near = min(entries, key=lambda e: (abs(e[0] - pos), e[1] != answered))
                end = entries[near]
                pos, answered = end[0] + pos - near[0], end[1]

        for batch in batches:
            for s, b, p, a, end_p, end_a in zip(*[c.to_pylist() for c in batch.columns]):
                if (s, b) != (session, block):
                    if block is not None:
                        step()
                    if s != session:
                        pos, answered, sure = 0, False, True
                    session, block, entries = s, b, {}
                if p is not None:
                    entries[p, a] = (end_p, end_a)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if block is not None:
            step()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    rows = blocks.select("session_id", "block").join(functions, ["session_id", "block"], "left")
    ordered = rows.select("session_id", "block", "pos", "answered", "end_pos", "end_answered").repartition("session_id").sortWithinPartitions("session_id", "block")
    return ordered.mapInArrow(run, f"session_id {session_type}, block bigint, low bigint, known boolean, settled boolean")


def cursors(spoken: DataFrame, asked: DataFrame, span: int = SPAN, width: int = WIDTH) -> DataFrame:
    """``session_id, slot, pos``: the question each utterance belongs to.

    ``spoken``: rows of :func:`slots`; ``asked``: ``session_id, pos, words, expected``, positions from 1 without gaps.
    """
    spoken = materialize(spoken.select("session_id", "slot", "words", "chars", "reply", F.expr(f"(slot - 1) div {span}").alias("block")), "spoken")
    asked = materialize(asked, "asked")
    begin = [F.lit(0).cast("bigint").alias("low"), F.lit(1).alias("width"), F.lit(False).alias("known")]
    first = spoken.where("block = 0").select("session_id", "block").distinct().select("*", *begin)
    later = spoken.where("block > 0").select("session_id").distinct()
    starts = first
    if not later.isEmpty():
        # sessions of more than one block: guess that every utterance that is no noise opens a question, then chain and guess again
        long = spoken.join(later, "session_id", "left_semi")
        blocks = materialize(long.groupBy("session_id", "block").agg(F.sum((F.col("chars") > TAIL_CHARS).cast("bigint")).alias("moves")), "blocks")
        guessed = o.running_sum(blocks, ["session_id"], ["block"], F.col("moves"), "upto", o.blocks_of("block"))
        guess = F.greatest(F.lit(1), F.col("upto") - F.col("moves") - width // 2)
        todo = guessed.select(
            "session_id", "block", F.when(F.col("block") == 0, 0).otherwise(guess).cast("bigint").alias("low"), F.when(F.col("block") == 0, 1).otherwise(width).alias("width"),
            F.when(F.col("block") == 0, False).alias("known"))
        functions = None
        while True:
            more = materialize(_worked_out(spoken, asked, todo, span, positions=False), "functions")
            functions = more if functions is None else materialize(functions.unionByName(more).distinct(), "functions")
            chained = materialize(_chain(functions, blocks, width), "chained")
            if chained.where("not settled").isEmpty():
                break
            # a settled start is worked out only if its block stopped the chain
            have = functions.select("session_id", "block", F.col("pos").alias("low"), F.col("answered").alias("known"))
            missing = chained.where("settled").select("session_id", "block", "low", "known").join(have, ["session_id", "block", "low", "known"], "left_anti")
            todo = materialize(missing.select("*", F.lit(1).alias("width")).unionByName(
                chained.where("not settled").select("session_id", "block", "low", "known", F.lit(width).alias("width"))), "starts")
        starts = first.join(later, "session_id", "left_anti").unionByName(chained.select("session_id", "block", "low", F.lit(1).alias("width"), "known"))
    return _worked_out(spoken, asked, starts, span, positions=True)


def align(turns: DataFrame, order: DataFrame, questions: DataFrame, block_rows: int = o.DEFAULT_BLOCK_ROWS, width: int = WIDTH) -> DataFrame:
    """Text and answer of every played question: ``session_id, pos, question_id, question, answer``.

    The longest utterance of a question (the first of equals) is its text, the first reply to any of them its answer. Questions never
    reached stay empty. ``turns``: ``session_id, ord, speaker, text``; ``order``: ``session_id, pos, question_id``.
    """
    spoken = materialize(slots(turns, block_rows), "slots")
    script = order.join(questions.select(F.col("id").alias("question_id"), "question", "expected_answer"), "question_id", "left")
    asked = script.select("session_id", F.col("pos").cast("bigint").alias("pos"), tx.words_loose("question").alias("words"), tx.words_loose("expected_answer").alias("expected"))
    found = cursors(spoken.join(order.select("session_id").distinct(), "session_id", "left_semi"), asked, min(SPAN, block_rows), width)
    said = found.join(spoken.select("session_id", "slot", "text", "reply"), ["session_id", "slot"])
    per = said.groupBy("session_id", "pos").agg(
        F.max_by("text", F.struct(F.length("text"), -F.col("slot"))).alias("question"), F.min_by("reply", F.when(F.col("reply").isNotNull(), F.col("slot"))).alias("answer"))
    return order.join(per, ["session_id", "pos"], "left").select("session_id", "pos", "question_id", F.coalesce("question", F.lit("")).alias("question"), "answer")
