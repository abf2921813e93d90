"""Hash numbers of words and word runs, made for a whole Arrow batch of texts at once with numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
UPPER_TO_LOWER = np.arange(256, dtype=np.uint8)
UPPER_TO_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread evenly (a finalizer of the splitmix kind); one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`span_hashes` reads the hash of any span of bytes."""
    up, _ = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * up[:len(raw)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span; equal bytes give equal numbers wherever they stand."""
    _, down = _powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of ``inside`` that do not cross a text's end, and the text of each."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < len(inside))]
    opens[borders] = inside[borders]
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[borders - 1] = inside[borders - 1]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_mask(raw: np.ndarray) -> np.ndarray:
    """Bytes that are not one of the six white-space characters."""
    return ~((raw == 32) | ((raw >= 9) & (raw <= 13)))


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return UPPER_TO_LOWER[raw]


def lowered_latin(raw: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of Latin-1 in lower case."""
    out = UPPER_TO_LOWER[raw]
    second = np.zeros(len(raw), bool)
    if len(raw) > 1:
        second[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[second] += 0x20
    return out
