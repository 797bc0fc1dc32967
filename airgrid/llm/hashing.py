"""Vectorised hashing of words and shingles over Arrow text columns.

Texts stay UTF-8 bytes in Arrow buffers from end to end; no Python string is made.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which are never
part of a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)  # masks of the first k bytes
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
PIECE = 1 << 20  # bytes of a long text, or shingles, that are looked at together
_ALSO = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], dtype=U64)
_TAKE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is overwritten."""
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


def lower(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[raw]


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(max(n, 1 << 20), base, dtype=U64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U64))
        _POWERS[which] = (made[0], made[1])
    return _POWERS[which]


def prefix_sums(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums of a rolling hash: those of a span are the difference at its ends times a power."""
    up, _ = powers(len(raw) + 1, which)
    total = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
    return total


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over runs of rows with about ``most`` bytes."""
    raw, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (n + 1)."""
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SEP[raw]
    first = np.empty(len(raw) + 1, dtype=bool)
    first[:-1] = inside
    first[-1] = False
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    begins, stops = first.copy(), np.zeros(len(raw) + 1, dtype=bool)
    begins[1:-1] &= ~inside[:-1] | edge[1:-1]
    stops[1:] = inside
    stops[1:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def strong_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit hash of each span of bytes; spans with one hash are taken as equal.

    Each 8 bytes of a span are mixed with a key of their place in it, and the results added up, so
    that no algebra of the bytes carries over to the sums, as it does with a rolling hash.
    """
    n = ends - starts
    words = (n + 7) >> 3
    row = np.repeat(np.arange(len(n)), words)
    place = np.arange(len(row)) - np.repeat(np.cumsum(words) - words, words)
    at = starts[row] + 8 * place
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    word = eights[at] & _LOW_BYTES[np.minimum(n[row] - 8 * place, 8)]
    held = np.flatnonzero(words)
    begin = (np.cumsum(words) - words)[held]
    out = []
    for seed in _BASES:
        keys = mix(np.arange(int(words.max()) if len(words) else 0, dtype=U64) * U64(0x9E6C63D0876A9A47) + U64(seed))
        total = np.zeros(len(n), dtype=U64)
        if len(held):
            total[held] = np.add.reduceat(mix(word ^ keys[place]), begin)
        out.append(mix(total ^ (n.astype(U64) + U64(seed))).view(np.int64))
    return out[0], out[1]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of a 128-bit hash of each word, A-Z in lower case, and for each row the number of words before it (n + 1).

    A long text is read in pieces of about PIECE bytes that end between words.
    """
    first, second, counts, at = [], [], [], 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw):  # on to the next separator
            found = np.flatnonzero(_SEP[raw[end : end + 4096]])
            if len(found):
                end += int(found[0])
                break
            end += 4096
        end = min(end, len(raw))
        edges = offsets[(offsets > at) & (offsets < end)] - at
        part = _LOWER[raw[at:end]]
        starts, ends, _ = words(part, np.concatenate([[0], edges, [end - at]]))
        h1, h2 = strong_hashes(part, starts, ends)
        first.append(h1.view(U64))
        second.append(h2.view(U64))
        counts.append(starts + at)
        at = end
    if not first:
        none = np.zeros(0, dtype=U64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    return np.concatenate(first), np.concatenate(second), np.searchsorted(np.concatenate(counts), offsets)


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of each row (repeats kept) and their offsets.

    A-Z are lower-cased.  A row with fewer than ``size`` words, but at least one,
    has its whole sequence as its one shingle.
    """
    w1, w2, at = word_hashes(raw, offsets)
    n = np.diff(at)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    hashes = np.zeros(out[-1], dtype=U64)
    for a in range(0, len(hashes), PIECE):
        b = min(a + PIECE, len(hashes))
        rows = np.searchsorted(out, np.arange(a, b), "right") - 1
        begin = at[:-1][rows] + (np.arange(a, b) - out[:-1][rows])
        left = at[1:][rows] - begin
        for k in range(size):
            place = np.minimum(begin + k, len(w1) - 1)
            hashes[a:b] += np.where(left > k, w1[place] * _TAKE[k % 5] ^ w2[place] * _ALSO[k % 5] + U64(k + 1), U64(0))
        mix(hashes[a:b])
    return hashes, out


NEAR = 1 << 16  # values of 4 bytes that are hashed by all functions before the next


def min_hashes(values: np.ndarray, offsets: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """(len(factors), rows) of 32-bit minima; every row must have a value."""
    out = np.empty((len(factors), len(offsets) - 1), dtype=np.uint32)
    x = (values >> U64(32)).astype(np.uint32)
    # Some rows at a time, whose values stay in a processor's cache for all functions.
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + NEAR, "right")) - 1)
        own, starts = x[offsets[at] : offsets[to]], offsets[at:to] - offsets[at]
        y = np.empty_like(own)
        for k in range(len(factors)):
            np.multiply(own, factors[k], out=y)
            y ^= shifts[k]
            np.minimum.reduceat(y, starts, out=out[k, at:to])
        at = to
    return out


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1 << 20, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) of 64-bit keys from ``rows`` minima each; the band is part of the key."""
    bands = signature.shape[0] // rows
    out = np.empty((signature.shape[1], bands), dtype=U64)
    for b in range(bands):
        key = np.full(signature.shape[1], (b + 1) * 0x632BE59BD9B4E019 & (2**64 - 1), dtype=U64)
        for r in range(rows):
            key = mix(key ^ signature[b * rows + r].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(r))
        out[:, b] = key
    return out
