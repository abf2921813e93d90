"""Language identification by averaged hashed subword embeddings and a linear softmax.

Byte runs of two to four bytes are hashed into buckets; a text is the average of its buckets' embeddings, and a linear layer
gives the languages. Both are trained together by stochastic gradient descent in numpy on a bounded sample (``train_docs``
rows, spread over the languages by a hash of the id); a part of the sample is kept back to fit the softmax temperature and the limit
under which a prediction counts as rejected. Predicting multiplies embedding and layer out to one score per bucket and language and sums it
over whole texts, inside Arrow batches; nothing is shuffled.

Defined results: a null text and one without a letter get ``und`` with score 0 and are rejected; so does everything when
nothing can be learned. A very long text is averaged whole, a batch of its own; repeated rows get the same prediction and each counts
for the sample; an empty table gives no rows. Other columns pass through, those named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructField

from convqa.llm.arrow import add_columns, text_bytes
from convqa.llm.hashing import lowered_latin

BITS, WIDTH, LENGTHS = 13, 16, (2, 3, 4)
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language, already divided by the temperature
    bias: np.ndarray
    reject_below: float


def plain_bytes(raw: np.ndarray) -> np.ndarray:
    """Lower case; digits and ASCII signs as spaces."""
    out = lowered_latin(raw)
    out[(out < 128) & ~((out >= 97) & (out <= 122))] = 32
    return out


def buckets(raw: np.ndarray, length: int) -> np.ndarray:
    """Bucket of the run of ``length`` bytes that starts at each byte."""
    code = np.zeros(len(raw) - length + 1, np.uint32)
    for k in range(length):
        code = (code << np.uint32(8)) | raw[k:len(raw) - length + 1 + k]
    return (code * np.uint32(0x9E3779B1) + np.uint32(length * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)


def histograms(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each bucket in each text."""
    out = np.zeros((len(offsets) - 1, 1 << BITS), np.float32)
    for t in range(len(offsets) - 1):
        text = raw[offsets[t]:offsets[t + 1]]
        for length in LENGTHS:
            if len(text) >= length:
                out[t] += np.bincount(buckets(text, length), minlength=1 << BITS)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], kept_back: np.ndarray, epochs: int = 25, batch: int = 32, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (x.shape[1], WIDTH)).astype(np.float32)
    layer = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    rows = np.flatnonzero(~kept_back) if (~kept_back).any() else np.arange(len(x))
    # averages over thousands of buckets are small numbers, hence the large step
    for epoch in range(epochs):
        rate = 40.0 * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // batch)):
            hidden = x[part] @ embed
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ layer.T
            layer -= min(rate, 0.5) * (hidden.T @ p)
            bias -= 0.05 * p.sum(axis=0)
            embed -= rate * (x[part].T @ back)
    held = kept_back if kept_back.any() else np.ones(len(x), bool)
    logits = x[held] @ embed @ layer + bias

    def likelihood(temperature: float) -> float:
        z = logits / temperature
        z = z - z.max(axis=1, keepdims=True)
        return float((z[np.arange(len(z)), y[held]] - np.log(np.exp(z).sum(axis=1))).mean())

    temperature = max((0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 1.0, 1.3, 1.7, 2.5), key=likelihood)
    z = logits / temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    best = (p / p.sum(axis=1, keepdims=True)).max(axis=1)
    return Model(languages, (embed @ layer / temperature).astype(np.float64), (bias / temperature).astype(np.float64), float(np.quantile(best, 0.01)))


def training_sample(labelled: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", train_docs: int = 2400) -> DataFrame:
    """At most about ``train_docs`` rows: the first of each language in hash order; the ranking sees ids and languages only."""
    usable = labelled.where(F.col(language).isNotNull() & F.col(text).isNotNull())
    sizes = usable.groupBy(F.col(language).alias("__lang")).agg(F.count("*").alias("__n"))
    most = max(20, train_docs // max(1, sizes.count()))
    order = F.xxhash64(F.col(key), F.lit(11))
    # a language that holds most rows sends on little more than its part before it is ranked
    share = (F.shiftrightunsigned(order, 11).cast("double") / float(1 << 53)) * F.col("__n") <= 2.0 * most + 40
    place = F.row_number().over(Window.partitionBy(language).orderBy(order, key))
    near = usable.select(key, language).join(sizes, F.col(language) == F.col("__lang")).where(share)
    ids = near.select(key, language).withColumn("__place", place).where(F.col("__place") <= most).select(F.col(key).alias("__key")).distinct()
    return usable.join(F.broadcast(ids), F.col(key) == F.col("__key")).select(key, text, language)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", train_docs: int = 2400) -> Model | None:
    """Model from a bounded sample of ``labelled``; null if there is none."""

    def make() -> Callable[[pa.Array], dict[str, pa.Array]]:
        def step(column: pa.Array) -> dict[str, pa.Array]:
            raw, offsets = text_bytes(column)
            return {"__shares": pa.array([h.astype(np.float16).tobytes() for h in histograms(plain_bytes(raw), offsets)], pa.binary())}

        return step

    sample = training_sample(labelled, key, text, language, train_docs)
    got = add_columns(sample.select(key, language, text), text, [StructField("__shares", BinaryType())], make, limit=1 << 20).select(key, language, "__shares").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([(key, "ascending"), (language, "ascending")])
    names = got.column(1).to_pylist()
    languages = sorted(set(names))
    x = np.stack([np.frombuffer(v, np.float16).astype(np.float32) for v in got.column(2).to_pylist()])
    y = np.array([languages.index(n) for n in names])
    return fit(x, y, languages, np.arange(len(y)) % 5 == 4)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Input columns, ``lang_pred``, ``score`` (probability) and ``rejected`` (less sure than the calibrated limit)."""

    def make() -> Callable[[pa.Array], dict[str, pa.Array]]:
        def step(column: pa.Array) -> dict[str, pa.Array]:
            texts = column.to_pylist()
            letters = np.array([t is not None and LETTER.search(t) is not None for t in texts], bool)
            if model is None:
                return {"lang_pred": pa.array([UNKNOWN] * len(texts)), "score": pa.array(np.zeros(len(texts))), "rejected": pa.array(np.ones(len(texts), bool))}
            raw, offsets = text_bytes(column)
            raw = plain_bytes(raw)
            total = np.zeros((len(texts), len(model.languages)))
            count = np.zeros(len(texts))
            starts, ends = offsets[:-1], offsets[1:]
            for length in LENGTHS:
                if len(raw) < length:
                    continue
                at = buckets(raw, length)
                stop = np.maximum(starts, ends - length + 1)
                first, last = np.minimum(starts, len(at)), np.minimum(stop, len(at))
                count += stop - starts
                for k in range(len(model.languages)):
                    sums = np.concatenate([[0.0], np.cumsum(model.scores[:, k][at])])
                    total[:, k] += sums[last] - sums[first]
            z = total / np.maximum(count, 1)[:, None] + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best, score = p.argmax(axis=1), p.max(axis=1)
            names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            score = np.where(letters, score, 0.0)
            return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "rejected": pa.array(~letters | (score < model.reject_below))}

        return step

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    return add_columns(docs, text, fields, make, limit=1 << 20)
