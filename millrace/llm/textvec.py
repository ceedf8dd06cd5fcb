"""Vectorised word tokenizing and 64-bit hashing over Arrow string batches.

A word is a run of bytes outside space and \\t..\\r, after A-Z are lower-cased; other
letters keep their case. Every function works on whole texts, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

WordFunction = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case; comparisons of bytes run many to an instruction, tables do not."""
    return raw + (raw - np.uint8(65) < 26).view(np.uint8) * np.uint8(32)


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw - np.uint8(9) < 5) | (raw == 32)


_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (finalizer of a common hash)."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, PIECE_BYTES + 1)
        for table, base in ((0, _P), (1, _P_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            p = np.multiply.accumulate(p)
            if len(_powers) > table:
                _powers[table] = p
            else:
                _powers.append(p)
    return _powers[0], _powers[1]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty. Called once a batch, it also
    gives back what Arrow holds of earlier ones."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    pa.default_memory_pool().release_unused()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    if places is None or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8), offsets.astype(np.int64)


def bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in raw; texts begin at offsets (relative to raw)."""
    n = len(raw)
    solid = np.empty(n + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(is_space(raw), out=solid[1:-1])
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:n]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    return starts, ends


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial by prefix sums, then mixed with the length."""
    power, inverse = _power_tables(len(raw))
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + _U(1)) * power[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _long_words(raw: np.ndarray, extra: WordFunction | None) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of one long text, and the extra values, in slices cut at white space."""
    out, more, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        end = min(at + PIECE_BYTES, len(raw))
        while end < len(raw):
            gap = np.flatnonzero(is_space(raw[at:end]))
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(end + PIECE_BYTES, len(raw))
        part = lower(raw[at:end])
        s, e = bounds(part, np.zeros(1, np.int64))
        out.append(span_hash(part, s, e))
        if extra:
            more.append(extra(raw[at:end], s, e))
        at = end
    return np.concatenate(out), np.concatenate(more)


def words_with(texts: pa.Array, extra: WordFunction | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (first row, word hashes, row offsets into them, extra(bytes, starts, ends))
    for bounded runs of rows; extra sees the bytes before lower-casing."""
    raw, offsets = flat(texts)
    for i, j in pieces(offsets):
        lo, hi = offsets[i], offsets[j]
        if hi - lo > 2 * PIECE_BYTES:
            w, more = _long_words(raw[lo:hi], extra)
            yield i, w, np.array([0, len(w)]), more
            continue
        part = lower(raw[lo:hi])
        own = offsets[i : j + 1] - lo
        s, e = bounds(part, own)
        more = extra(raw[lo:hi], s, e) if extra else np.zeros(0, np.uint64)
        yield i, span_hash(part, s, e), np.searchsorted(s, own), more


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, word hashes, row offsets into them) for bounded runs of rows."""
    for first, words, offsets, _ in words_with(texts, None):
        yield first, words, offsets


def shingle_hashes(words: np.ndarray, row_offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct k-word shingles; a row with fewer words has its whole
    sequence as the only one, a row without words has none."""
    m = len(words)
    if m >= k:
        h = words[: m - k + 1].copy()
        for d in range(1, k):
            h *= _U(0x9FB21C651E98DF25)
            h += words[d : m - k + 1 + d]
        h = mix(h)
    out = []
    for a, b in zip(row_offsets[:-1].tolist(), row_offsets[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(h[a : b - k + 1])
            if len(own) > 1:
                keep = np.empty(len(own), dtype=bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
            out.append(own)
        elif b > a:
            one = words[a : a + 1].copy()
            for d in range(1, b - a):
                one *= _U(0x9FB21C651E98DF25)
                one += words[a + d : a + d + 1]
            out.append(mix(one + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
