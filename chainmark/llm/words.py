"""Words and word n-grams of Arrow text columns as 64-bit hashes, in NumPy.

Texts are taken a few megabytes at a time, so memory does not follow the
number of rows in a batch; one text alone may be longer than that and is then
hashed in pieces cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Byte classes: which bytes belong to a word.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x41:0x5B] = LETTERS[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _codes(seed: int, lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=_U) + _U(seed * 1000))
    if lower:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(n + n // 4 + 1, base, _U)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


@dataclass
class Texts:
    """Words of some rows: row i of the batch from ``first`` on has ``count[i]``."""

    first: int
    count: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    @property
    def before(self) -> np.ndarray:
        """Words in the rows before each row."""
        return np.cumsum(self.count) - self.count

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.begin[k] : self.end[k]].tobytes()


def _hash(data: np.ndarray, starts: np.ndarray, classes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = classes[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    at = starts[(starts > 0) & (starts < len(data))]
    opens[at] = inside[at]
    closes[at - 1] = inside[at - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(codes[data] * _power(_MULT, len(data)), out=total[1:])
    hashes = (total[end] - total[begin]) * _power(_INVERSE, len(data) + 1)[begin]
    return mix(hashes + (end - begin).astype(_U) * _MULT), begin, end


def texts(column: pa.Array | pa.ChunkedArray, classes: np.ndarray = SPACED, lower: bool = False, seed: int = 1, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """Words of every text; a null counts as an empty text. Slices of whole rows, of about ``size`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    whole = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    codes, k = _codes(seed, lower), 0
    while k < len(column):
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + size, "right")) - 1)
        data, starts = whole[offsets[k] : offsets[to]], offsets[k:to] - offsets[k]
        parts, at = [], 0
        while at < len(data):
            cut = at + 2 * size
            if cut < len(data):
                gap = np.flatnonzero(~classes[data[cut:]])
                cut = cut + int(gap[0]) if len(gap) else len(data)
            cut = min(cut, len(data))
            inner = starts[(starts >= at) & (starts < cut)] - at
            h, b, e = _hash(data[at:cut], inner, classes, codes)
            parts.append((h, b + at, e + at))
            at = cut
        hashes, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
        bounds = np.append(np.searchsorted(begin, starts), len(begin))
        # an empty last row starts where the data ends
        yield Texts(k, np.diff(bounds), hashes, begin, end, data)
        k = to


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, rows not minded."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    size = len(hashes) - n + 1
    out = np.zeros(size, _U)
    for i in range(n):
        out *= _MULT
        out += hashes[i : i + size]
    return mix(out)


def inside_rows(count: np.ndarray, n: int) -> np.ndarray:
    """Which of the positions of ``grams`` lie within one row."""
    total = int(count.sum())
    if total < n:
        return np.zeros(0, bool)
    left = np.repeat(np.cumsum(count), count) - np.arange(total)
    return left[: total - n + 1] >= n
