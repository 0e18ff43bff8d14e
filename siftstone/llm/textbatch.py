"""Whole Arrow batches of text as numpy arrays: no Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a worker takes some 50 bytes of memory for each, on top of the batch.
CHUNK_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ASCII letters, digits and every byte of a multi-byte character.
WORD_BYTE = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def released() -> None:
    """Gives freed memory back to the system: an idle worker keeps what its largest batch took, beside those that work."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def plain(texts: pa.Array) -> pa.Array:
    """Nulls become empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "") if texts.null_count else texts


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``limit`` bytes (one text at least) and where they begin."""
    if not len(texts):
        return
    ends = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    begin = 0
    while begin < len(texts):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and len + 1 offsets into them."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _raised(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and len + 1 offsets of the texts' words.

    A word is a run of letters, digits and non-ASCII characters, lower-cased.
    """
    data, at = buffers(pc.utf8_lower(texts))
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = WORD_BYTE[data]
    cuts = at[1:-1]
    cuts = cuts[cuts < n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    begins = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _raised(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + _U(1)) * up, out=total[1:])
    return mixed((total[ends] - total[begins]) * down[begins]), np.searchsorted(begins, at)


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles (with repeats) and their offsets.

    A text of fewer words, but one at least, has one shingle: all its words.
    """
    return word_shingles(*words(texts), n)


def word_shingles(w: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingles` of what :func:`words` gave."""
    count = np.diff(at)
    kept = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(kept)])
    if not len(w):
        return w, out_at
    index = np.arange(out_at[-1]) + np.repeat(at[:-1] - out_at[:-1], kept)
    last = np.repeat(at[1:], kept)
    padded = np.concatenate([w, np.zeros(n, np.uint64)])
    h = padded[index]
    for k in range(1, n):
        h = h * _U(_BASE) + np.where(index + k < last, padded[index + k], _U(0))
    return mixed(h), out_at


def sequence_digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each text's words in their order."""
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for _, part in chunks(texts):
        for c, d in zip(out, word_digests(*words(part))):
            c.append(d)
    return np.concatenate(out[0]), np.concatenate(out[1])


def word_digests(w: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """:func:`sequence_digests` of what :func:`words` gave."""
    place = np.arange(len(w), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
    out = []
    for salt in (_U(0), _U(0xD6E8FEB86659FD93)):
        total = np.concatenate([[_U(0)], np.cumsum(mixed(mixed(w ^ salt) + place * _U(_BASE)))])
        out.append(mixed(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))
    return out
