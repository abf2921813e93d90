"""Toxicity by a factorization machine over hashed terms.

Terms are words and, for longer words, their first four to seven bytes (compounds share them); each is a 64-bit hash number, and a
text is the set of its terms. Every term that enough documents of a bounded labelled sample hold enters the machine, whatever its share
of labels, with a weight and pairwise factors fitted by AdaGrad (weights and factors that do not help shrink to zero), so that terms that
matter only together (an insult and the mention of a group that is as common elsewhere) count by their product, and terms may speak
against the label. Scores are calibrated on a part of the sample that was kept back. Whole texts are scored inside Arrow
batches; nothing is shuffled.

Defined results: null and empty texts get the score of a text without terms; without any label, or with one class only, every score
is 0. A very long text is scored whole, a batch of its own; repeated rows score alike, labels of one id count once; an empty table gives
no rows. Other columns pass through, those named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from convqa.llm import hashing
from convqa.llm.arrow import add_columns, text_bytes

FACTORS = 6
PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class Machine:
    terms: np.ndarray  # sorted hash numbers
    weights: np.ndarray
    factors: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, flat: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        z = self.slope * raw_score(flat, doc, docs, self.weights, self.factors, self.bias)[0] + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def raw_score(flat: np.ndarray, doc: np.ndarray, docs: int, w: np.ndarray, v: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Linear part and the sum over pairs of factor products, and the factor sums, of ``docs`` texts; ``flat`` are places of terms, once a text."""
    add = lambda values: np.bincount(doc, weights=values, minlength=docs)
    s = np.stack([add(v[flat, f]) for f in range(v.shape[1])], axis=1)
    return bias + add(w[flat]) + 0.5 * ((s * s).sum(axis=1) - add((v * v).sum(axis=1)[flat])), s


def term_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash number and text of every term occurrence. Letters and all bytes above ASCII make words."""
    low = hashing.lowered_latin(raw)
    starts, ends, doc = hashing.spans(((low >= 97) & (low <= 122)) | (low >= 128), offsets)
    sums = hashing.prefix_sums(low)
    salt = np.uint64(0x5851F42D4C957F2D)
    codes, docs = [hashing.span_hashes(sums, starts, ends)], [doc]
    for n in PREFIXES:
        long = ends - starts > n
        codes.append(hashing.span_hashes(sums, starts[long], starts[long] + n) ^ salt)
        docs.append(doc[long])
    return np.concatenate(codes), np.concatenate(docs)


def term_sets(column: pa.Array) -> list[np.ndarray]:
    raw, offsets = text_bytes(column)
    codes, docs = term_spans(raw, offsets)
    order = np.lexsort((codes, docs))
    codes, docs = codes[order], docs[order]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (docs[1:] != docs[:-1])
    codes, docs = codes[first], docs[first]
    return np.split(codes, np.searchsorted(docs, np.arange(1, len(offsets) - 1)))


def fit(sets: list[np.ndarray], y: np.ndarray, prior: float, min_docs: int = 4, epochs: int = 45, seed: int = 3, sparse: float = 4e-3, spread: float = 0.02) -> Machine:
    """``prior`` is the share of label 1 among all labelled rows; the sample may hold another share."""
    kept_back = np.arange(len(y)) % 5 == 4
    rows = np.flatnonzero(~kept_back)
    # terms are chosen by how many documents hold them alone: a partner of a pair may be equally common in both classes
    terms, n = np.unique(np.concatenate([sets[r] for r in rows]), return_counts=True)
    terms = terms[n >= min_docs]
    held_terms = []
    for own in sets:
        at = np.searchsorted(terms, own)
        at[at == len(terms)] = 0
        held_terms.append(at[terms[at] == own] if len(terms) else at[:0])

    def flat_of(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [held_terms[r] for r in part]
        return np.concatenate(lists), np.repeat(np.arange(len(part)), [len(x) for x in lists])

    p0 = y[rows].mean()
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(terms)), rng.normal(0, spread, (len(terms), FACTORS)), float(np.log(p0 / (1 - p0)))
    gw, gv, gb = np.full_like(w, 1e-2), np.full_like(v, 1e-2), 1e-2
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
            flat, doc = flat_of(part)
            z, s = raw_score(flat, doc, len(part), w, v, bias)
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) / len(part)
            back = lambda values: np.bincount(flat, weights=values[doc], minlength=len(terms))  # noqa: B023, E731
            dw = back(e)
            dv = np.stack([back(e * s[:, f]) for f in range(FACTORS)], axis=1) - dw[:, None] * v + 1e-4 * v
            gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + e.sum() ** 2
            w, v, bias = w - 0.3 * dw / np.sqrt(gw), v - 0.1 * dv / np.sqrt(gv), bias - 0.3 * e.sum() / np.sqrt(gb)
            w = np.sign(w) * np.maximum(np.abs(w) - 0.3 * sparse / np.sqrt(gw), 0)
            size = np.sqrt((v * v).sum(axis=1))
            v *= np.maximum(1 - 0.1 * sparse / np.sqrt(gv.mean(axis=1)) / np.maximum(size, 1e-12), 0)[:, None]
    held = kept_back if kept_back.any() and 0 < y[kept_back].mean() < 1 else np.ones(len(y), bool)
    flat, doc = flat_of(np.flatnonzero(held))
    z, t = raw_score(flat, doc, int(held.sum()), w, v, bias)[0], y[held]
    # kept-back rows weighted to the share that the label has among all labelled rows
    share = t.mean()
    cost = np.where(t == 1, prior / share, (1 - prior) / (1 - share))
    slope, shift = 1.0, float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    for _ in range(2000):
        q = 1 / (1 + np.exp(-np.clip(slope * z + shift, -40, 40)))
        e = cost * (q - t) / len(t)
        slope, shift = max(0.05, slope - 0.3 * ((e * z).sum() + 0.01 * (slope - 1))), shift - 0.3 * e.sum()
    return Machine(terms, w, v, bias, float(slope), float(shift))


def label_share(labels: DataFrame, label: str = "toxic") -> float:
    """Share of label 1 among the labelled rows."""
    got = labels.where(F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    return 0.0 if got is None else float(got)


def sample_ids(labels: DataFrame, key: str = "doc_id", label: str = "toxic", sample_docs: int = 6000) -> DataFrame:
    """At most ``sample_docs`` labelled ids, half of each class, the first in hash order; an id with both labels has label 1."""
    per = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    order = F.xxhash64(F.col(key), F.lit(13))
    # top rows by hash, kept per task and merged: a class that holds nearly all rows is never sorted in one place
    first, second = (per.where(F.col(label) == c).orderBy(order, key).limit(sample_docs // 2) for c in (0, 1))
    return first.union(second)


def train(sample: DataFrame, prior: float, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine | None:
    """Machine from the rows of a bounded labelled sample; null if a class is absent."""

    def make() -> Callable[[pa.Array], dict[str, pa.Array]]:
        return lambda column: {"__terms": pa.array([s.tobytes() for s in term_sets(column)], pa.binary())}

    if not 0 < prior < 1:
        return None
    got = add_columns(sample.select(key, label, text), text, [StructField("__terms", BinaryType())], make, limit=1 << 20).select(key, label, "__terms").toArrow().sort_by(key)
    y = np.array(got.column(1).to_pylist(), dtype=np.float64)
    if len(np.unique(y)) < 2:
        return None
    return fit([np.frombuffer(b, np.uint64) for b in got.column(2).to_pylist()], y, prior)


def predict(docs: DataFrame, machine: Machine | None, text: str = "text", name: str = "score") -> DataFrame:
    """Input columns and the calibrated probability of label 1."""

    def make() -> Callable[[pa.Array], dict[str, pa.Array]]:
        def step(column: pa.Array) -> dict[str, pa.Array]:
            if machine is None:
                return {name: pa.array(np.zeros(len(column)))}
            raw, offsets = text_bytes(column)
            codes, docs_of = term_spans(raw, offsets)
            size = len(machine.terms)
            at = np.searchsorted(machine.terms, codes)
            at[at == size] = 0
            hit = machine.terms[at] == codes if size else np.zeros(len(codes), bool)
            doc, flat = np.divmod(np.unique(docs_of[hit] * size + at[hit]), max(size, 1))  # each term once a text
            return {name: pa.array(machine.score(flat, doc, len(column)))}

        return step

    return add_columns(docs, text, [StructField(name, DoubleType())], make, limit=1 << 20)
