"""Exact encoding and decoding with a merge-type SentencePiece model, by backtracking.

An Aho-Corasick automaton lists the pieces that start at each position. The encoder walks from the left with the
longest piece first; a piece may follow another if merging their joined text by score leaves just these two (checked by
re-merging, kept per pair); where no piece fits, the position is marked as closed and the last piece is shortened.
No piece has a space mark after another character, and characters fall into kinds of which no piece holds two (letters
of a script, digits), so no merge joins neighbours of two kinds. A text falls into chunks (spaces, then characters of one
kind) that are encoded apart, and a worker remembers the ids of the chunks it has met, up to a fixed number. Short chunks
are merged outright. Texts are decoded from their ids.

Defined results: null and empty texts give only the end id; characters outside the vocabulary become byte pieces; text that looks
like a control piece is ordinary text; ids of control pieces decode to nothing. Repeated rows give repeated results;
other columns pass through.
"""

from __future__ import annotations

import array
import functools
import itertools
import operator
import re
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from convqa.llm.arrow import add_columns

SPACE = "▁"
NORMAL, BYTE, CONTROL = 1, 6, 3
REMEMBERED = 200_000
# up to so many characters, merging takes less time than the walk
SHORT = 24


class PieceCoder:
    """Encoder and decoder for one model; ``pieces`` are (text, score, type) in id order."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.texts = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.scores = {p: s for p, s, k in pieces if k == NORMAL}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        # bytes beyond ASCII stand as lone surrogates until the whole text is read as UTF-8
        byte_of = {i: chr(b) if b < 128 else chr(0xDC00 + b) for b, i in self.byte_ids.items()}
        self.shown = [p if k == NORMAL else byte_of.get(i, "") for i, (p, _, k) in enumerate(pieces)]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        # packed ids of chunks met lately, and of those met before them
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.unknown = re.compile("[^" + "".join(re.escape(p) for p in self.ids if len(p) == 1) + "]")
        kinds = ["[" + "".join(map(re.escape, kind)) + "]++" for kind in self._kinds()]
        self.split = re.compile(" *+(?:" + "|".join([*kinds, "[^ ]"]) + ")| +").findall

    def _kinds(self) -> list[list[str]]:
        """Characters that pieces hold side by side, directly or by way of others, most first; those that stand alone are left out."""
        kind: dict[str, list[str]] = {}
        for p in self.ids:
            chars = p.lstrip(SPACE)
            if SPACE in chars:
                raise ValueError("a piece has a space mark after another character")
            for a, b in zip(chars, chars[1:]):
                x, y = (kind.setdefault(c, [c]) for c in (a, b))
                if x is not y:
                    x, y = (x, y) if len(x) >= len(y) else (y, x)
                    x += y
                    kind.update(dict.fromkeys(y, x))
        return sorted({id(k): k for k in kind.values() if len(k) > 1 or k[0] * 2 in self.ids}.values(), key=len, reverse=True)

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def load(path: str) -> PieceCoder:
        """Coder of a model file; a worker process keeps it, with what it remembers, from task to task."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("a merge-type model with byte pieces and no rewriting of characters is needed")
        return PieceCoder([(p.piece, p.score, p.type) for p in model.pieces])

    def merged(self, text: str) -> list[str]:
        """Pieces left after joining neighbours, best score first and leftmost among equals."""
        parts, score, none = list(text), self.scores.get, float("-inf")
        gains = list(map(score, map(operator.add, text, text[1:]), itertools.repeat(none)))
        while gains and (best := max(gains)) > none:
            k = gains.index(best)
            parts[k] = joined = parts[k] + parts.pop(k + 1)
            del gains[k]
            if k < len(gains):
                gains[k] = score(joined + parts[k + 1], none)
            if k:
                gains[k - 1] = score(parts[k - 1] + joined, none)
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: nothing before)."""
        known = self.pairs.get((left, right))
        if known is None:
            parts = [self.texts[right]] if left < 0 else [self.texts[left], self.texts[right]]
            known = self.merged("".join(parts)) == parts
            if len(self.pairs) > 3 * REMEMBERED:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _known_run(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        n = len(text)
        if n <= SHORT:
            return [self.ids[p] for p in self.merged(text)]
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, i) in self.automaton.iter(text):
            at[end - length + 1].append((length, i))  # ends only grow, so the longest comes last
        closed = bytearray(n + 1)
        taken: list[tuple[int, int]] = []  # (index among the pieces at its start, id)
        pos, try_from = 0, len(at[0]) - 1
        while pos < n:
            left = taken[-1][1] if taken else -1
            for k in range(try_from, -1, -1):
                length, i = at[pos][k]
                if not closed[pos + length] and self.fits(left, i):
                    taken.append((k, i))
                    pos += length
                    try_from = len(at[pos]) - 1 if pos < n else 0
                    break
            else:
                if not taken:
                    return [self.ids[p] for p in self.merged(text)]
                closed[pos] = 1
                k, i = taken.pop()
                pos -= len(self.texts[i])
                try_from = k - 1
        return [i for _, i in taken]

    def encode_chunk(self, chunk: str) -> list[int]:
        if not self.unknown.search(chunk):
            return self._known_run(chunk)
        out: list[int] = []
        start = 0
        for found in self.unknown.finditer(chunk):
            if start < found.start():
                out += self._known_run(chunk[start:found.start()])
            out += [self.byte_ids[b] for b in found[0].encode()]
            start = found.end()
        if start < len(chunk):
            out += self._known_run(chunk[start:])
        return out

    def _of(self, chunk: str) -> bytes:
        made = self.chunks.get(chunk) or self.older.get(chunk) or array.array("i", self.encode_chunk(chunk.replace(" ", SPACE))).tobytes()
        if len(chunk) < 64:
            if len(self.chunks) >= REMEMBERED:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = made
        return made

    def coded(self, text: str) -> tuple[bytes, str]:
        """Ids as packed 32-bit numbers, without an end id, and the text that they decode to."""
        if not text:
            return b"", ""
        known, of = self.chunks.get, self._of
        packed = b"".join([known(c) or of(c) for c in self.split(" " + text.replace(SPACE, " "))])
        return packed, self.decode(memoryview(packed).cast("i"))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.coded(text or "")[0], dtype=np.int32).tolist()

    def surface(self, ids: Iterable[int]) -> str:
        """Text of ids with every space mark shown as a space, the first one included."""
        shown = "".join(map(self.shown.__getitem__, ids))
        return shown.encode(errors="surrogateescape").decode(errors="replace").replace(SPACE, " ")

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; the space that encoding puts before a text is taken off."""
        text = self.surface(ids)
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str, text: str = "text", end_id: int | None = 2, batch_bytes: int = 8 << 20) -> DataFrame:
    """Input columns, ``ids`` (array of int, closed by ``end_id``) and ``decoded`` (the text of the ids).

    ``batch_bytes`` of texts are worked on at a time; what they become takes several times as much of a worker's memory.

    ``model_path`` is a file that every worker has, or one sent out with ``SparkContext.addFile`` (then its bare name).
    """

    def make() -> Callable[[pa.Array], dict[str, pa.Array]]:
        coder = PieceCoder.load(model_path if "/" in model_path else SparkFiles.get(model_path))
        close = b"" if end_id is None else array.array("i", [end_id]).tobytes()

        def step(column: pa.Array) -> dict[str, pa.Array]:
            made = [coder.coded(t or "") for t in column.to_pylist()]
            flat = b"".join([m[0] + close for m in made])
            sizes = np.array([(len(m[0]) + len(close)) // 4 for m in made], dtype=np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            return {"ids": pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(flat, dtype=np.int32))), "decoded": pa.array([m[1] for m in made], pa.string())}

        return step

    fields = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]
    return add_columns(docs, text, fields, make, limit=batch_bytes)
