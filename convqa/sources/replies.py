"""Flow replies of any size, cut over many tasks.

A reply is JSON without line breaks to cut at, and its flow may be a large part of all text. Spark's text scan cuts it at every
quote instead, so what stands between two quotes is either a string or a few marks. A first pass tells for every split of a
file what it does to the open brackets, whether it begins inside a string or not; these summaries, a few words a split, are put
together in the order of the file. A second pass, which now knows where each split begins, hands on every step as a row, a full
answer as the pieces between its quotes, and the rest (the frame: scenarios with a mark in place of steps and answers).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convqa import schemas
from convqa.functions import text as tx
from convqa.sources.readers import unquoted_path

BITS = re.compile(r"[^\[\]{}]*[\[\]{}]|[^\[\]{}]+")
SLASHES = re.compile(r"\\*\Z")
EARLIER = "<"  # the word before the split; other words are marked "=", or "?" where it depends on what is before the split
FRAME, PIECE, STEP, ANSWER = "frame", "piece", "step", "answer"
STATE = "struct<inside:boolean,joined:boolean,word:string,member:string,stack:array<struct<mark:string,key:string,place:string>>>"
EFFECT = "struct<inside:boolean,joined:boolean,pops:int,word:string,member:string,stack:array<struct<mark:string,key:string,place:string>>>"
WRITTEN = "path string, kind string, owner string, start bigint, n bigint, text string"


def _quoted(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """``path, start, value``: text between quotes, in the order of the file within a split."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", '"').text(folder)
    return read.select(unquoted_path().alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


class _Place:
    """Where a reader stands in a file: inside a string or not, the last word, the member whose value is next, and the open brackets."""

    def __init__(self, start: int, inside: bool, joined: bool, word: str | None, member: str | None, stack: list[tuple]):
        self.start, self.inside, self.joined, self.word, self.member, self.stack = start, inside, joined, word, member, stack
        self.pops, self.n, self.fresh = 0, 0, True

    def turn(self, value: str) -> None:
        """The quote behind ``value``."""
        if self.inside:
            self.joined = len(SLASHES.search(value)[0]) % 2 == 1
            self.inside = self.joined
        else:
            self.inside, self.joined = True, False
        self.n, self.fresh = self.n + 1, False

    def spoken(self, value: str) -> None:
        short = value if len(value) <= 64 else ""
        self.word = None if self.joined else ("?" if self.fresh else "=") + short

    def bits(self, value: str) -> Iterator[tuple[str, str]]:
        """Marks of a text outside of strings, each after it has been taken: ``text, mark``."""
        self.member = self.word if value.strip() == ":" else None
        for k, bit in enumerate(BITS.findall(value)):
            mark = bit[-1]
            if mark in "[{":
                self.stack.append((mark, self.word if k == 0 and bit[:-1].strip() == ":" else None, f"{self.start:012x}{self.n:010x}{k:06x}"))
            elif mark in "]}":
                if self.stack:
                    self.stack.pop()
                else:
                    self.pops += 1
            else:
                mark = ""
            yield bit, mark


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split what it does, for a beginning outside of a string and for one inside."""
    key, both = None, ()

    def told() -> pa.RecordBatch:
        rows = [dict(inside=p.inside, joined=p.joined, pops=p.pops, word=p.word, member=p.member, stack=[dict(mark=m, key=w, place=x) for m, w, x in p.stack]) for p in both]
        entry = pa.struct([("mark", pa.string()), ("key", pa.string()), ("place", pa.string())])
        effect = pa.struct([("inside", pa.bool_()), ("joined", pa.bool_()), ("pops", pa.int32()), ("word", pa.string()), ("member", pa.string()), ("stack", pa.list_(entry))])
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array(rows[:1], effect), pa.array(rows[1:], effect)], names=["path", "start", "out", "in"])

    for batch in batches:
        for path, start, held in zip(*(c.to_pylist() for c in batch.columns)):
            value = held.decode("utf-8", "replace")
            if (path, start) != key:
                if key:
                    yield told()
                key = (path, start)
                both = [_Place(start, inside, False, EARLIER, EARLIER, []) for inside in (False, True)]
            for p in both:
                if p.inside:
                    p.spoken(value)
                else:
                    for _ in p.bits(value):
                        pass
                p.turn(value)
    if key:
        yield told()


def _begins(splits: list) -> list[tuple]:
    """State at the beginning of each split of a file, from the effects of the splits before it."""
    inside, joined, word, member, stack, made = False, False, None, None, [], []
    for s in sorted(splits, key=lambda s: s["start"]):
        made.append((s["start"], (inside, joined, word, member, list(stack))))
        e = s["in"] if inside else s["out"]

        def known(w: str | None) -> str | None:
            if w == EARLIER:
                return word  # noqa: B023
            return None if w is None or (w[0] == "?" and joined) else "=" + w[1:]  # noqa: B023

        pushed = [(x["mark"], known(x["key"]), x["place"]) for x in e["stack"]]
        stack = stack[: max(0, len(stack) - e["pops"])] + pushed
        member = member if e["member"] == EARLIER else known(e["member"])
        word, inside, joined = known(e["word"]), e["inside"], e["joined"]
    return made


def _scenario(stack: list[tuple]) -> bool:
    """Whether the innermost open bracket is a scenario: the whole reply, an element of an array, or of an object's ``flows``."""
    marks = "".join(m for m, _, _ in stack)
    return marks in ("{", "[{") or (marks == "{[{" and stack[1][1] == "=flows")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :data:`WRITTEN`: steps within a split whole, others in pieces; ``n`` of a frame, one a split, counts its octets."""
    key, p, frame, step, owner, begun, named, rows, octets = None, None, [], None, None, False, set(), [], 0

    def put(kind: str, of: str, text: str, n: int | None = None) -> None:
        rows.append((key[0], kind, of, key[1], p.n if n is None else n, text))

    def end() -> None:
        if step:
            put(PIECE, owner, "".join(step))
        put(FRAME, "", "".join(frame), octets)

    def made() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 6
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "kind", "owner", "start", "n", "text"])

    for batch in batches:
        for path, start, held, state in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
            value = held.decode("utf-8", "replace")
            if (path, start) != key:
                if key:
                    end()
                s = state.as_py()
                key, frame, named, octets = (path, start), [], set(), 0
                p = _Place(start, s["inside"], s["joined"], s["word"], s["member"], [(x["mark"], x["key"], x["place"]) for x in s["stack"]])
                p.fresh = False
                inner = [i for i, x in enumerate(p.stack) if i > 1 and x[0] == "{" and p.stack[i - 1][:2] == ("[", "=steps") and _scenario(p.stack[: i - 1])]
                step, owner, begun = ([], p.stack[inner[0] - 2][2] + p.stack[inner[0]][2], False) if inner else (None, None, False)
                below = inner[0] if inner else 0
            if p.inside:
                if step is not None:
                    step.append(value + '"')
                elif p.member == "=expected_answer" and _scenario(p.stack):
                    of = p.stack[-1][2]
                    more = len(SLASHES.search(value)[0]) % 2 == 1
                    put(ANSWER, of, value + ('"' if more else ""))
                    frame.append(("" if p.joined else of) + ("" if more else '"'))
                else:
                    frame.append(value + '"')
                p.spoken(value)
            else:
                for bit, mark in p.bits(value):
                    if step is not None:
                        step.append(bit)
                        if mark in ("]", "}") and len(p.stack) <= below:
                            put(STEP if begun else PIECE, owner, "".join(step))
                            step = None
                    elif mark == "{" and len(p.stack) > 2 and p.stack[-2][:2] == ("[", "=steps") and _scenario(p.stack[:-2]):
                        of = p.stack[-3][2]
                        frame.append(bit[:-1] + ("0" if of in named else f'"{of}"'))
                        named.add(of)
                        step, owner, begun, below = ["{"], of + p.stack[-1][2], True, len(p.stack) - 1
                    else:
                        frame.append(bit)
                (frame if step is None else step).append('"')
            p.turn(value)
            octets += len(held) + 1
        if rows:
            yield made()
            rows.clear()
    if key:
        end()
        yield made()


def _placed(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    raw = _quoted(spark, folder, glob)
    effects = raw.mapInArrow(_effects, f"path string, start bigint, out {EFFECT}, in {EFFECT}")
    begins = F.udf(_begins, f"array<struct<start:bigint,state:{STATE}>>")
    told = effects.groupBy("path").agg(begins(F.collect_list(F.struct("start", "out", "in"))).alias("s")).select("path", F.explode("s").alias("s")).select("path", "s.*")
    # a few words for every split; the rows stay where the scan has them, in its order
    return raw.join(F.broadcast(told), ["path", "start"]).select("path", "start", "value", "state").mapInArrow(_cut, WRITTEN)


def _joined(kind: Column) -> Column:
    """Pieces in the order of the file."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kind, F.struct("start", "n", "text")))), lambda x: x["text"]), "")


def _unquoted(text: Column) -> Column:
    return F.from_json(F.concat(F.lit('["'), text, F.lit('"]')), "array<string>")[0]


def read_reply_scenarios(spark: SparkSession, folder: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """All reply files of a folder, of any size: scenarios of the readable ones, and the names of the rest (``file, path``).

    The same three forms as ``readers.read_flow_replies``. ``path, file, scenario, n_steps`` and the scenario's other fields; its steps
    and its full answer are rows of :func:`read_reply_steps` and :func:`read_reply_answers`. All text is read and tested:
    a file with one unreadable step is not readable.
    """
    cut = _placed(spark, folder, glob)
    kind = F.col("kind")
    fine = F.when(kind == STEP, F.try_parse_json("text").isNotNull()).when(kind == ANSWER, _unquoted(F.col("text")).isNotNull())
    rows = cut.select("path", kind, F.when(kind == PIECE, F.col("owner")).alias("owner"), "start", "n", F.when(kind.isin(FRAME, PIECE), F.col("text")).alias("text"), fine.alias("fine"))
    grouped = rows.groupBy("path", "kind", "owner").agg(F.bool_and("fine").alias("fine"), F.sum("n").alias("octets"), _joined(F.col("text").isNotNull()).alias("text"))
    settled = grouped.withColumn("fine", F.when(kind == PIECE, F.try_parse_json("text").isNotNull()).otherwise(F.col("fine")))
    octets = F.sum(F.when(kind == FRAME, F.col("octets")))
    files = settled.groupBy("path").agg(F.bool_and("fine").alias("fine"), F.max(F.when(kind == FRAME, F.col("text"))).alias("text"), octets.alias("octets"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select(unquoted_path().alias("path"), "length")
    # a quote was put behind the last piece of a file, where there may be none
    text = F.when(F.col("octets") > F.col("length"), F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.coalesce("text", F.lit("")))
    told = found.join(files, "path", "left").select("path", F.element_at(F.split("path", "/"), -1).alias("file"), text.alias("text"), F.coalesce("fine", F.lit(True)).alias("fine"))
    told = told.withColumn("ok", F.col("fine") & tx.is_json("text"))
    bad = told.where(~F.col("ok")).select("file", "path")
    held = schemas.SCENARIO.replace(schemas.STEP, "string")
    spec = schemas.FLOW_SPEC.replace(schemas.SCENARIO, held)
    flows = F.when(tx.strip("text").startswith("["), F.from_json("text", f"array<{held}>")).otherwise(
        F.coalesce(F.from_json("text", spec)["flows"], F.array(F.from_json("text", held))))
    good = told.where("ok").select("path", "file", F.explode(flows).alias("s")).select("path", "file", "s.*").where(F.coalesce("flow_id", "id").isNotNull())
    marks = F.filter("steps", lambda x: F.length(x) > 1)
    return good.select("path", "file", F.coalesce(F.get(marks, F.lit(0)), "expected_answer").alias("scenario"), F.size("steps").cast("bigint").alias("n_steps"),
                       *[c for c in good.columns if c not in ("path", "file", "steps", "expected_answer")]), bad


def read_reply_steps(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """``path, scenario, place`` and the fields of every step; ``place`` is in the order of the file, ``scenario`` that of the scenarios."""
    cut = _placed(spark, folder, glob)
    pieces = cut.where(F.col("kind") == PIECE).groupBy("path", "owner").agg(_joined(F.lit(True)).alias("text"))
    every = cut.where(F.col("kind") == STEP).select("path", "owner", "text").unionByName(pieces)
    return every.select("path", F.substring("owner", 1, 28).alias("scenario"), F.substring("owner", 29, 28).alias("place"), F.from_json("text", schemas.STEP).alias("s")).select("path", "scenario", "place", "s.*")


def read_reply_answers(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """``path, scenario, start, n, text``: full answers in pieces; in the order of ``start`` and ``n`` they are the answer."""
    cut = _placed(spark, folder, glob)
    return cut.where(F.col("kind") == ANSWER).select("path", F.col("owner").alias("scenario"), "start", "n", _unquoted(F.col("text")).alias("text"))
