"""Hashes of the words of many texts at once, in NumPy.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D).  Texts
are worked on in spans of a few MB, cut between words, so memory does not follow
the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPAN = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SPAN + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers


def _span_hashes(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of one span."""
    black = ~_IS_SPACE[data]
    edge = np.diff(black.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    chars = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(chars * power[: len(data)], out=total[1:])
    return starts, mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls have no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def word_hashes(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of neighbouring texts: index of the first, word hashes of all, and where the words of each begin and end.

    A group is as many whole texts as a span holds, or one longer text, hashed in
    several spans.
    """
    data, offsets = texts_of(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SPAN, "right")) - 1
        if j > i:  # whole texts; a space stands between them
            j = min(j, n)
            lengths = np.diff(offsets[i : j + 1])
            shift = np.arange(j - i)
            span = np.full(int(offsets[j] - offsets[i]) + (j - i), 32, np.uint8)
            at = np.arange(int(offsets[j] - offsets[i])) + np.repeat(shift, lengths)
            span[at] = data[offsets[i] : offsets[j]]
            starts, hashes = _span_hashes(span, lower)
            yield i, hashes, np.searchsorted(starts, np.append(offsets[i:j] - offsets[i] + shift, len(span)))
            i = j
            continue
        text, parts, at = data[offsets[i] : offsets[i + 1]], [], 0
        while at < len(text):
            end = min(len(text), at + SPAN)
            if end < len(text):
                space = np.flatnonzero(_IS_SPACE[text[at:end]])
                while not len(space) and end < len(text):  # a word longer than a span
                    end = min(len(text), end + SPAN)
                    space = np.flatnonzero(_IS_SPACE[text[at:end]])
                if end < len(text) or len(space) and at + space[-1] + 1 < end:
                    end = at + int(space[-1]) + 1 if len(space) else end
            parts.append(_span_hashes(text[at:end], lower)[1])
            at = end
        hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield i, hashes, np.array([0, len(hashes)])
        i += 1


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the text each is in; a text of fewer words has one, of all its words."""
    counts = np.diff(bounds)
    n = len(hashes)
    odd = [mix64(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(size)]
    text = np.repeat(np.arange(len(counts)), counts)
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            total += hashes[k : n - size + 1 + k] * odd[k]
        inside = text[: n - size + 1] == text[size - 1 :]
        out, of = mix64(total[inside]), text[: n - size + 1][inside]
    else:
        out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += hashes[bounds[short[has]] + k] * odd[k]
        extra = mix64(extra + counts[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
    return out, of


def distinct_per_text(values: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of every text in ascending order, their counts, and where each text's begin and end."""
    order = np.lexsort((values, of))
    v, t = values[order], of[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(v)))
    return v[at], counts, np.searchsorted(t[at], np.arange(n + 1))
