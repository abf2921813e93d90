"""Word n-gram sets of texts as sorted 64-bit numbers, per Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from convqa.llm import hashing
from convqa.llm.arrow import text_bytes

_STEP = np.uint64(0xC6BC279692B5C323)


def _run(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of word runs from the hashes of their words, order kept."""
    acc = np.full(len(parts[0]), len(parts), np.uint64) * _STEP
    for h in parts:
        acc = hashing.mixed(acc * _STEP + h)
    return acc


def sets_of(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a batch: numbers sorted within each text, and where each text's begin (one more entry than texts).

    A text with fewer words than ``words`` gives its whole sequence as one shingle, one without words none.
    """
    raw, offsets = text_bytes(column)
    low = hashing.lowered(raw)
    starts, ends, doc = hashing.spans(hashing.word_mask(low), offsets)
    h = hashing.span_hashes(hashing.prefix_sums(low), starts, ends)
    texts = len(offsets) - 1
    per = np.bincount(doc, minlength=texts)
    n = max(0, len(h) - words + 1)
    whole = np.flatnonzero(doc[:n] == doc[words - 1:]) if n else np.zeros(0, np.int64)
    codes, docs = [_run([h[whole + k] for k in range(words)])], [doc[whole]]
    first = np.concatenate([[0], np.cumsum(per)])
    for size in range(1, words):
        short = np.flatnonzero(per == size)
        codes.append(_run([h[first[short] + k] for k in range(size)]))
        docs.append(short)
    code, docs_of = np.concatenate(codes), np.concatenate(docs)
    order = np.lexsort((code, docs_of))
    code, docs_of = code[order], docs_of[order]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != code[:-1]) | (docs_of[1:] != docs_of[:-1])
    code, docs_of = code[keep], docs_of[keep]
    return code, np.searchsorted(docs_of, np.arange(texts + 1))


def signatures(code: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers per text that depend on the set only (sums of evenly spread bits)."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A3F6B):
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(hashing.mixed(code ^ np.uint64(salt)), out=sums[1:])
        out.append((sums[begins[1:]] - sums[begins[:-1]]).view(np.int64))
    return out[0], out[1]
