"""Pairs of similar contents, formed and counted inside a task from packed bags of words."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from convqa.llm.arrow import give_back

BUCKETS = 1024  # of a sketch
LEFT_PART, RIGHT_PART = 512, 4096  # contents that one product of sketches compares
ROWS_AT_ONCE, TOKENS_AT_ONCE = 4096, 1 << 20
RIGHT, LEFT = 0, 1  # order in which the sides of a group arrive


def squeezed(bags: DataFrame) -> DataFrame:
    """Bags with ``words`` and ``counts`` (joined with blanks) as one compressed ``bag``: a third less on disk than blocks of many rows compressed."""
    kept = [f for f in bags.schema.fields if f.name not in ("words", "counts")]
    source = bags.select(*[f.name for f in kept], "words", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist())
            bag = pa.array([zlib.compress(f"{words}\n{counts}".encode()) for words, counts in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], bag], names=[*batch.schema.names[:-2], "bag"])

    return source.mapInArrow(run, StructType([*kept, StructField("bag", BinaryType())]))


def _unpacked(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of all contents end to end, their counts, and where each content starts (one more entry than contents)."""
    texts = [zlib.decompress(bag).partition(b"\n") for bag in rows.column("bag").to_pylist()]
    split = lambda k: pc.split_pattern(pa.array([t[k] for t in texts], pa.large_binary()).cast(pa.large_string()), pattern=" ")
    words = split(0)
    starts = np.append(0, np.cumsum(pc.list_value_length(words).to_numpy()))
    return words.flatten(), split(2).flatten().cast(pa.int64()).to_numpy(), starts


def _sketch(starts: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Square roots of the counts per bucket of words, a row per content.

    Two counts share at most their smaller one, which is at most the root of their product. Words that fall into one bucket can
    only raise that, so the product of two rows is never less than what the contents share.
    """
    k = len(starts) - 1
    sketch = np.empty((k, BUCKETS), np.float32)
    for s in range(0, k, LEFT_PART):
        e = min(s + LEFT_PART, k)
        part = slice(starts[s], starts[e])
        cell = np.repeat(np.arange(e - s), np.diff(starts[s:e + 1])) * BUCKETS + ids[part] % BUCKETS
        sketch[s:e] = np.sqrt(np.bincount(cell, n[part], (e - s) * BUCKETS)).reshape(-1, BUCKETS)
    return sketch


class Block:
    """The right contents that a task holds, in the order of their sizes."""

    def __init__(self, minimum: float):
        self.half, self.ratio = minimum / 2, minimum / (2 - minimum)
        self.words = pa.array([], pa.large_string())
        self.parts: list[tuple] = []

    def hold(self, rows: pa.RecordBatch) -> None:
        """Words become numbers at once, so a block takes some eight bytes a word."""
        words, n, starts = _unpacked(rows)
        new = words.filter(pc.is_null(pc.index_in(words, value_set=self.words))).unique()
        self.words = pa.concat_arrays([self.words, new])
        ids = pc.index_in(words, value_set=self.words).to_numpy()
        self.parts.append((rows.column("sig"), rows.column("size").to_numpy(), np.diff(starts), ids, n.astype(np.min_scalar_type(n.max(initial=0)))))

    def close(self) -> None:
        names, sizes, lengths, ids, n = zip(*self.parts)
        self.parts = []
        self.names, self.size = pa.chunked_array(names), np.concatenate(sizes)
        self.starts, self.ids, self.n = np.append(0, np.cumsum(np.concatenate(lengths))), np.concatenate(ids), np.concatenate(n)
        self.scratch = np.zeros(len(self.words), np.int64)

    def pairs(self, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of left and right contents that share enough, and their similarity. Left ones come by size as well."""
        size = rows.column("size").to_numpy()
        words, n, starts = _unpacked(rows)
        ids = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        known = ids >= 0  # a word that no held content has is never shared
        starts = np.append(0, np.cumsum(known))[starts]
        ids, n = ids[known], n[known]
        left = _sketch(starts, ids, n)
        first = np.searchsorted(self.size, size[0] * self.ratio - 1e-6)
        last = np.searchsorted(self.size, size[-1] / self.ratio + 1e-6, side="right") if self.ratio else len(self.size)
        for r in range(first, last, RIGHT_PART):
            b = slice(r, min(r + RIGHT_PART, last))
            bounds, held = self.starts[r:b.stop + 1], self.size[b]
            right = _sketch(bounds - bounds[0], self.ids[bounds[0]:bounds[-1]], self.n[bounds[0]:bounds[-1]]).T
            for s in range(0, len(size), LEFT_PART):
                a = slice(s, min(s + LEFT_PART, len(size)))
                if size[a.stop - 1] < held[0] * self.ratio - 1e-6 or held[-1] < size[s] * self.ratio - 1e-6:
                    continue
                # The margin is wider than the rounding of 1 024 products of single precision.
                need = ((size[a, None] + held) * (self.half * (1 - 2e-4)) - 1e-3).astype(np.float32)
                i, j = np.nonzero(left[a] @ right >= need)
                i, j = i + s, j + r
                fit = np.minimum(size[i], self.size[j]) >= self.half * (size[i] + self.size[j]) - 1e-9
                yield from self._counted(size, ids, n, starts, i[fit], j[fit])

    def _counted(self, size, ids, n, starts, i, j) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What the pairs share, exactly: the counts of a left content are laid out by word and looked up by the right ones."""
        edges = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i))
        for at, to in zip(edges[:-1], edges[1:]):
            one = i[at]
            own = slice(starts[one], starts[one + 1])
            self.scratch[ids[own]] = n[own]
            lengths = self.starts[j[at:to] + 1] - self.starts[j[at:to]]
            for part in np.split(np.arange(at, to), np.flatnonzero(np.diff(np.cumsum(lengths) // TOKENS_AT_ONCE)) + 1):
                others = j[part]
                length = lengths[part - at]
                begins = np.cumsum(length) - length
                where = np.arange(length.sum()) + np.repeat(self.starts[others] - begins, length)
                both = np.add.reduceat(np.minimum(self.scratch[self.ids[where]], self.n[where]), begins)
                sim = 2.0 * both / (size[one] + self.size[others])
                kept = sim >= 2 * self.half
                if kept.any():
                    yield np.full(kept.sum(), one), others[kept], sim[kept]
            self.scratch[ids[own]] = 0


def similar_pairs(minimum: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function over rows ``group, side, agent_id, sig, size, bag`` in the order of group, side (right first) and size.

    A group's right contents are held; its left ones pass by. A product of two sketches bounds what two contents share from above,
    for hundreds of contents with thousands at a time, and only pairs whose bound suffices are counted, word by word.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, open_ = None, None, False
        for batch in batches:
            group, side = batch.column("group").to_numpy(), batch.column("side").to_numpy()
            new = np.arange(len(group)) % ROWS_AT_ONCE == 0
            new[1:] |= (group[1:] != group[:-1]) | (side[1:] != side[:-1])
            starts = np.flatnonzero(new)
            for start, stop in zip(starts, np.append(starts[1:], len(group))):
                rows = batch.slice(start, stop - start)
                if group[start] != current:
                    current, block, open_ = group[start], Block(minimum), True
                if side[start] == RIGHT:
                    block.hold(rows)
                    continue
                if open_:
                    if not block.parts:
                        continue
                    block.close()
                    open_ = False
                found = list(block.pairs(rows))
                if not found:
                    continue
                i, j, sim = (np.concatenate(x) for x in zip(*found))
                i = pa.array(i)
                yield from pa.table({
                    "agent_id": rows.column("agent_id").take(i), "sig": rows.column("sig").take(i), "other": block.names.take(pa.array(j)), "sim": sim}).to_batches()
            give_back()

    return run
