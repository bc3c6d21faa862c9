"""Hashing of words and word windows for a whole Arrow batch at once, with numpy.

Texts are UTF-8; words are runs of bytes other than space and U+0009 to U+000D, so no code point is ever cut.
A word's hash is a polynomial over its bytes modulo 2**64, mixed; a window's hash mixes those of its words.
Two different windows share a 64-bit hash with a probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * _BASE)
_BYTE_LOWER = _BYTE[_LOWER]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    return word_spans(raw, at, lower)[:2]


def word_spans(raw: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte, number of bytes) of every word."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, U), none, none, none
    solid = ~_IS_SPACE[raw]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    cut = at[:-1]
    first[cut[cut < n]] = True
    first &= solid
    body = raw[solid]
    starts = np.flatnonzero(first[solid])
    if not len(starts):
        return np.zeros(0, U), none, none, none
    lengths = np.diff(np.append(starts, len(body)))
    place = np.arange(len(body)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE, U))
    values = (_BYTE_LOWER if lower else _BYTE)[body]
    values *= powers[place]
    hashes = mix(np.add.reduceat(values, starts) + lengths.astype(U))
    begin = np.flatnonzero(first)
    return hashes, np.searchsorted(at, begin, side="right") - 1, begin, lengths


def windows(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every window of width words within a row; with short, a row of fewer words (but one at least) is one window."""
    factors = mix(np.arange(11, 11 + width, dtype=U) * _BASE) | U(1)
    counts = np.bincount(rows, minlength=n_rows)
    n = len(hashes) - width + 1
    out_h, out_r, out_i = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > 0:
        inside = np.flatnonzero(rows[:n] == rows[width - 1 :])
        total = np.zeros(len(inside), U)
        for j in range(width):
            total += hashes[inside + j] * factors[j]
        out_h, out_r, out_i = mix(total), rows[inside], inside
    if short:
        few = np.flatnonzero((counts > 0) & (counts < width))
        if len(few):
            begin = np.cumsum(counts)[few] - counts[few]
            total = np.zeros(len(few), U)
            for j in range(width - 1):
                there = counts[few] > j
                total[there] += hashes[begin[there] + j] * factors[j]
            total += counts[few].astype(U) * factors[-1] + U(1)
            out_h, out_r, out_i = np.append(out_h, mix(total)), np.append(out_r, few), np.append(out_i, begin)
    return out_h, out_r, out_i


def sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash), ordered by both."""
    if len(rows) and (rows[1:] < rows[:-1]).any():
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    else:
        hashes = hashes.copy()
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):  # many short sorts are cheaper than one long one
        if b - a > 1:
            hashes[a:b].sort()
    if len(hashes):
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]))
        hashes, rows = hashes[new], rows[new]
    return hashes, rows


def shingle_sets(column, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): row i's set of word windows is hashes[offsets[i]:offsets[i + 1]], ascending."""
    raw, at = text_bytes(column)
    h, r = words(raw, at, lower)
    h, r, _ = windows(h, r, len(at) - 1, width, short=True)
    h, r = sets(h, r, len(at) - 1)
    return h, np.searchsorted(r, np.arange(len(at)))


def by_bytes(column, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of rows of about limit bytes of text each (a longer text stands alone), which bound the memory of the calls above."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    out, a, total = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > a and total + size > limit:
            out.append((a, i))
            a, total = i, 0
        total += size
    return [*out, (a, len(sizes))] if len(sizes) > a else out
