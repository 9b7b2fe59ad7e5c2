"""Vectorised byte kernels over Arrow string columns.

Everything here works on one Arrow batch at a time: the texts of a batch are one byte buffer with offsets, and
words, shingles and hashes are computed for all of them with numpy, without a Python loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_P1, _P2, _P3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
_P4, _P5 = U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5)
#: Byte values that separate words: space and 0x09-0x0D.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z become a-z and each separator a space, other bytes stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[_IS_SPACE] = 0x20
#: Shingles longer than this are hashed one by one.
_LONG = 512
_BLOCK = 1 << 16


class Words(NamedTuple):
    """Words of a batch, each followed by one space in ``buffer``."""

    buffer: np.ndarray  # uint8
    start: np.ndarray  # int64, of each word
    end: np.ndarray  # int64, exclusive
    first: np.ndarray  # int64, len(docs) + 1: the first word of each document


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if kind == pa.large_string() else b"", kind))
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (raw[:0], np.zeros(1, np.int64))


def letters_only() -> np.ndarray:
    """Separators for ``split_words`` that leave ASCII letters, digits and all bytes of other scripts."""
    table = np.zeros(256, dtype=bool)
    table[:128] = [not chr(b).isalnum() for b in range(128)]
    return table


def split_words(column: pa.Array, separators: np.ndarray = _IS_SPACE) -> Words:
    """Words are runs of bytes that are no separators (space and 0x09-0x0D, if not given); A-Z are lower-cased."""
    raw, offsets = as_bytes(column)
    n = len(offsets) - 1
    padded = np.full(len(raw) + n, 0x20, dtype=np.uint8)
    if len(raw):
        keep = np.ones(len(padded), dtype=bool)
        keep[offsets[1:] + np.arange(n)] = False
        padded[keep] = raw
    space = separators[padded]
    after = np.empty(len(padded), dtype=bool)  # a separator right after a word byte
    if len(padded):
        after[0] = False
        np.logical_and(space[1:], ~space[:-1], out=after[1:])
    ends = np.flatnonzero(after)
    first = np.searchsorted(ends, np.concatenate([[0], offsets[1:] + np.arange(1, n + 1)])).astype(np.int64)
    padded[after] = 0x20
    buffer = _FOLD[padded[~space | after]]
    end = np.flatnonzero(buffer == 0x20)
    start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64) if len(end) else np.zeros(0, np.int64)
    return Words(buffer, start, end.astype(np.int64), first)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, first) of the ``width``-word shingles; a shorter document is one shingle of all its words."""
    count = np.diff(words.first)
    per = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    index = np.arange(first[-1], dtype=np.int64) + np.repeat(words.first[:-1] - first[:-1], per)
    last = index + np.repeat(np.minimum(count, width), per) - 1
    start = words.start[index]
    return start, words.end[last] - start, first


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _merge(acc: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (acc ^ (_rotl(v * _P2, 31) * _P1)) * _P1 + _P4


def xxh64(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buffer[start : start + length] for all spans at once."""
    out = np.empty(len(start), dtype=U64)
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    words8 = np.lib.stride_tricks.as_strided(padded.view(), (max(len(padded) - 7, 0), 8), (1, 1))
    lanes = words8.view(U64).reshape(-1) if words8.flags.c_contiguous else np.ndarray((len(padded) - 7,), U64, padded, 0, (1,))
    halves = np.ndarray((len(padded) - 3,), np.uint32, padded, 0, (1,))
    long = length > _LONG
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh64_intdigest(buffer[start[i] : start[i] + length[i]].tobytes(), seed)
    rest = np.flatnonzero(~long) if long.any() else None
    total = len(start) if rest is None else len(rest)
    with np.errstate(over="ignore"):
        for a in range(0, total, _BLOCK):
            at = slice(a, a + _BLOCK) if rest is None else rest[a : a + _BLOCK]
            out[at] = _xxh64_block(lanes, halves, padded, start[at], length[at], U64(seed))
    return out


def _xxh64_block(lanes, halves, raw, start, length, seed):
    pos, left = start.copy(), length.copy()
    h = np.full(len(start), seed + _P5, dtype=U64)
    big = np.flatnonzero(length >= 32)
    if len(big):
        p, n = pos[big], length[big] // 32
        acc = [np.full(len(big), v, dtype=U64) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        for k in range(int(n.max())):
            on = np.flatnonzero(n > k)
            q = p[on] + 32 * k
            for j in range(4):
                acc[j][on] = _rotl(acc[j][on] + lanes[q + 8 * j] * _P2, 31) * _P1
        x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for v in acc:
            x = _merge(x, v)
        h[big] = x
        pos[big] += 32 * n
        left[big] -= 32 * n
    h += length.astype(U64)
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        if not len(on):
            break
        h[on] = _rotl(h[on] ^ (_rotl(lanes[pos[on]] * _P2, 31) * _P1), 27) * _P1 + _P4
        pos[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    if len(on):
        h[on] = _rotl(h[on] ^ (halves[pos[on]].astype(U64) * _P1), 23) * _P2 + _P3
        pos[on] += 4
        left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left > 0)
        if not len(on):
            break
        h[on] = _rotl(h[on] ^ (raw[pos[on]].astype(U64) * _P5), 11) * _P1
        pos[on] += 1
        left[on] -= 1
    h ^= h >> U64(33)
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    h ^= h >> U64(32)
    return h


def lean(reader):
    """The batches of a partition; at its end free memory goes back to the system, since workers live on, next to
    those of other stages."""
    pa.set_memory_pool(pa.system_memory_pool())
    yield from reader
    trim()


def trim() -> None:
    """Hand free memory back to the system."""
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batches(reader, column: str, max_bytes: int = 16 << 20):
    """Cut Arrow batches into slices of bounded text size; one longer text is a slice of its own."""
    for batch in lean(reader):
        if not batch.num_rows:
            continue
        sizes = np.diff(as_bytes(batch.column(column))[1])
        group = np.cumsum(sizes) // max_bytes
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)
