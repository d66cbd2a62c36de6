"""Vectorised text kernels over the UTF-8 buffer of an Arrow column.

A block of texts is one uint8 array plus row offsets. Words, 64-bit word hashes, shingles and character n-grams
come from whole-array operations, so no Python object is made for a word. Hashes are the same on every machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes (or code points) of one row that are worked on at a time; a block of several rows is never longer.
PIECE = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_ROOT = U(0x9E3779B97F4A7C15) | U(1)
_ROOT_INVERSE = U(pow(int(_ROOT), -1, 2**64))
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_powers = [np.ones(1, U), np.ones(1, U)]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the n + 1 offsets of rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def fmix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _power(n: int) -> list[np.ndarray]:
    """At least n powers of the root and of its inverse; those of up to two pieces are kept."""
    if len(_powers[0]) >= n:
        return _powers
    out = []
    for root in (_ROOT, _ROOT_INVERSE):
        steps = np.full(n, root, U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if n <= 2 * PIECE:
        _powers[:] = out
    return out


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row where its words begin among them (n + 1)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~IS_SPACE[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    full = offs[1:] > offs[:-1]
    before[offs[:-1][full]] = False
    after[offs[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from differences of one running polynomial."""
    if not len(starts):
        return np.empty(0, U)
    up, down = _power(len(buf) + 1)
    run = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=run[1:])
    return fmix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U))


def split_at_spaces(buf: np.ndarray) -> Iterator[np.ndarray]:
    """A long row in parts of at most a piece that end after white space; a word longer than that is a part of its own."""
    s, n = 0, len(buf)
    while s < n:
        e = min(s + PIECE, n)
        if e < n and not IS_SPACE[buf[e]]:
            gap = np.flatnonzero(IS_SPACE[buf[s:e]])
            if len(gap):
                e = s + int(gap[-1]) + 1
            else:
                while e < n and not len(gap := np.flatnonzero(IS_SPACE[buf[e : e + PIECE]])):
                    e = min(e + PIECE, n)
                e = e + int(gap[0]) if e < n else n
        yield buf[s:e]
        s = e


def _long_row(buf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and byte lengths of the words of one long row, a piece at a time; a word longer than a piece is hashed on its own."""
    for part in split_at_spaces(buf):
        if len(part) > PIECE:
            yield np.array([int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little")], U), np.array([len(part)])
        else:
            starts, ends, _ = word_bounds(part, np.array([0, len(part)]))
            yield word_hashes(part, starts, ends), ends - starts


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and byte lengths of all words, and for each row where its words begin among them (n + 1).

    Memory beyond the words themselves is bounded by a piece, however long the row.
    """
    if len(buf) <= PIECE:
        starts, ends, at = word_bounds(buf, offs)
        return word_hashes(buf, starts, ends), ends - starts, at
    hashes, lengths, at = [], [], [0]
    for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        own = list(_long_row(buf[i:j]))
        hashes += [h for h, _ in own]
        lengths += [n for _, n in own]
        at.append(at[-1] + sum(len(h) for h, _ in own))
    return np.concatenate([np.empty(0, U), *hashes]), np.concatenate([np.empty(0, np.int64), *lengths]), np.array(at)


def byte_sums(value: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each row the sum of its bytes' values (a table of 256)."""
    if len(buf) <= PIECE:
        return row_sums(value[buf], offs)
    out = []
    for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        count = sum((np.bincount(buf[k : min(k + PIECE, j)], minlength=256) for k in range(i, j, PIECE)), np.zeros(256, np.int64))
        out.append(count @ value)
    return np.array(out)


def pieces(buf: np.ndarray, offs: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(part, its row offsets, first row): the whole block, or long rows in parts that share `overlap` items with the next."""
    if len(buf) <= PIECE:
        yield buf, offs, 0
        return
    for row, (i, j) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        for k in range(i, max(j - overlap, i + 1), PIECE):
            part = buf[k : min(k + PIECE + overlap, j)]
            yield part, np.array([0, len(part)]), row


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows, A-Z lowered, and their row offsets."""
    if len(buf) <= PIECE:
        offs = np.concatenate(([0], np.cumsum(buf & 0xC0 != 0x80)))[offs]
    else:
        offs = np.cumsum([0, *(np.count_nonzero(buf[i:j] & 0xC0 != 0x80) for i, j in zip(offs[:-1], offs[1:], strict=True))])
    return np.frombuffer(TO_LOWER[buf].tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4"), offs


def point_ngrams(points: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For each size of n-gram: for each code point the hash bucket (below 2**bits) of the n from there, or -1 where they leave the row."""
    wide = points.astype(U)
    run, done = np.zeros(len(wide), U), 0
    for n in sizes:
        for j in range(done, n):
            run = run[: max(0, len(wide) - j)] * _MIX[40] + wide[j:]
        done = n
        out = np.full(len(wide), -1, np.int64)
        out[: len(run)] = (fmix(run) >> U(64 - bits)).astype(np.int64)
        for j in range(1, n):
            at = offs[1:] - j
            out[at[at >= 0]] = -1
        yield out


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their row offsets; with `short`, a row of 1 to k-1 words gives its whole sequence as one."""
    n = np.diff(at)
    count = np.maximum(n - k + 1, 0)
    if short:
        count = np.where((n > 0) & (n < k), 1, count)
    out_at = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(at[:-1], count) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], count)
    padded = np.concatenate((words, np.zeros(k, U)))
    h = np.zeros(len(first), U)
    left = np.repeat(np.minimum(n, k), count)
    for j in range(k):
        w = padded[first + j] * _MIX[j]
        h += np.where(left > j, w, U(0)) if short else w
    return fmix(h + left.astype(U)), out_at


def ngram_codes(buf: np.ndarray, offs: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each byte, the hash bucket (below 2**bits) of the n bytes from there, or -1 where they leave the row."""
    size = len(buf)
    if size < n:
        return np.full(size, -1, np.int64)
    code = np.zeros(size, U)
    wide = buf.astype(U)
    for j in range(n):
        code[: size - j] += wide[j:] << U(8 * j)
    out = ((code * _MIX[32 + n]) >> U(64 - bits)).astype(np.int64)
    for j in range(1, n):
        at = offs[1:] - j
        out[at[at >= 0]] = -1
    return out


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    run = np.concatenate(([0], np.cumsum(values)))
    return run[offs[1:]] - run[offs[:-1]]
