"""Words of many texts at once as 64-bit numbers, straight from UTF-8 bytes.

A word's number is a polynomial hash over a table of random 64-bit values, one per
byte, taken from one running sum, so a batch costs a few NumPy passes whatever
the number of words.  Equal words get equal numbers on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20_240_117).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
"""Space and the control characters 0x09 to 0x0D."""
PUNCTUATION = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
"""Every ASCII character but letters and digits."""
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLDED = _TABLE[_FOLD]

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        have = 1 << max(16, (size - 1).bit_length())
        for slot, factor in enumerate((_BASE, _INVERSE)):
            table = np.ones(1, U64)
            while len(table) < have:
                table = np.concatenate([table, table * U64(pow(factor, len(table), 1 << 64))])
            _powers[slot] = table
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all others."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


class Words(NamedTuple):
    """Words of some texts: number, text index, byte span inside the joined bytes."""

    code: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    first: np.ndarray
    """Index of each text's first word, and the word count at the end."""


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE, fold: bool = True) -> Words:
    """Words of the texts that lie between ``offsets`` in ``data``; ASCII letters ``fold`` to lower case."""
    n = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, none, data, np.zeros(n + 1, np.int64))
    inside = ~separator[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_FOLDED if fold else _TABLE)[data] * up[: len(data)], out=sums[1:])
    code = mix((sums[end] - sums[start]) * down[start])
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(n), np.diff(first))
    return Words(code, text, start, end, data, first)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes (or one longer text): from, to, bytes, offsets."""
    data, offsets = text_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingle_codes(code: np.ndarray, width: int) -> np.ndarray:
    """Numbers of all runs of ``width`` words; empty when there are fewer."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(width):
        out = out * U64(0xD6E8FEB86659FD93) + code[k : k + n]
    return mix(out)


def shingle_set(code: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; a text with fewer words is one shingle, without words none."""
    if 0 < len(code) < width:
        return shingle_codes(code, len(code))
    return np.unique(shingle_codes(code, width))
