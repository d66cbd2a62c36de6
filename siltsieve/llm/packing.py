"""Hierarchical multi-length packing.

Each document becomes token ids (and an end id). What fills whole windows of the largest context size goes there at once. The
rest of each document is routed to the smallest context tier that holds it; tiers are packed from the largest down, the gap
that a piece leaves in its window is filled with the best-fitting shorter pieces and, last, with a part of one. Windows are
powers of two, so a full window needs no padding at any tier. Windows are then dealt to step groups of equal token counts.

A task packs the rows of its own input split, so nothing is shuffled; at most `pool` rests are held at a time, and what is
left at the end of a task is cut into windows of smaller powers of two. Words are tokenised once and kept in a bounded cache
of each Python worker; white space never joins tokens in this vocabulary, so ids of words make up ids of texts.

Defined results: a null or empty text is its end id alone; repeated rows and identifiers are packed as often as they come; a
null identifier stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import bisect_right, insort
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import blocks, give_back, table

TIERS = (2048, 1024, 512, 256)
VOCABULARY = "word_bpe_49k.json"
END_ID, POOL, STEP_TOKENS, CACHE_WORDS = 1, 4096, 32_768, 700_000


class WordTokens:
    """Ids of words, by hash of the word in lower case; grows to CACHE_WORDS words and starts anew."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self._reset()

    def _reset(self):
        self.ids, self.filled = np.empty(1 << 16, np.uint32), 0
        # sorted hashes with starts and counts of ids: all, and those learned since they were last merged
        self.known, self.recent = self._none(), self._none()

    @staticmethod
    def _none():
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def _merged(x, y):
        keys, start, count = (np.concatenate(p) for p in zip(x, y, strict=True))
        order = np.argsort(keys, kind="stable")
        return keys[order], start[order], count[order]

    def _learn(self, raw: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        words = [raw[i:j].decode("utf-8", "replace") for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        count = np.array([len(x) for x in found], np.int64)
        new = np.array([i for x in found for i in x], np.uint32)
        while len(self.ids) < self.filled + len(new):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[self.filled : self.filled + len(new)] = new
        start = self.filled + np.cumsum(count) - count
        self.filled += len(new)
        self.recent = self._merged(self.recent, (keys, start, count))
        if len(self.recent[0]) > 1 << 16:
            self.known, self.recent = self._merged(self.known, self.recent), self._none()

    def _find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each hash is known, and the start and count of its ids."""
        hit, begin, count = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        for keys, start, n in (self.known, self.recent):
            if len(keys):
                place = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                own = keys[place] == distinct
                hit |= own
                begin[own], count[own] = start[place[own]], n[place[own]]
        return hit, begin, count

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, the end id after each, and row offsets; a long row is encoded a piece at a time."""
        buf, offs = K.texts(column)
        if len(buf) <= K.PIECE:
            return self._encode(buf, offs)
        ids, at = [], [0]
        for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            own = [self._encode(part, np.array([0, len(part)]))[0][:-1] for part in K.split_at_spaces(buf[i:j])]
            ids += [*own, np.array([END_ID], "<u4")]
            at.append(at[-1] + sum(map(len, own)) + 1)
        return np.concatenate(ids), np.array(at)

    def _encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # case tells apart names of special tokens, and letters before combining marks (U+0300 to U+036F), where only the lower one may be composed
        raw = buf.tobytes()
        if not any(x in raw for x in (b"<|", b"\xcc", b"\xcd")):
            buf = K.TO_LOWER[buf]
        starts, ends, at = self._units(buf, *K.word_bounds(buf, offs))
        code, distinct = pd.factorize(K.word_hashes(buf, starts, ends))
        if len(self.known[0]) > CACHE_WORDS:
            self._reset()
        hit, begin, count = self._find(distinct)
        if not hit.all():
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            new = first[~hit]
            self._learn(raw, distinct[~hit], starts[new], ends[new])
            _, begin, count = self._find(distinct)
        count, begin = count[code], begin[code]
        run = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(begin - run[:-1], count) + np.arange(run[-1])]
        rows = run[at]
        return np.insert(ids, rows[1:], END_ID).astype("<u4"), rows + np.arange(len(rows))

    @staticmethod
    def _units(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, with a full stop or comma after a letter or digit as a unit of its own, where the tokenizer parts them too."""
        if not len(starts):
            return starts, ends, at
        before, earlier = buf[np.maximum(ends - 2, 0)], buf[np.maximum(ends - 3, 0)]
        letter = _ALNUM[before] | ((earlier == 0xC3) & (before != 0x97) & (before != 0xB7) & (ends - starts >= 3))
        cut = np.flatnonzero(((buf[ends - 1] == 46) | (buf[ends - 1] == 44)) & (ends - starts >= 2) & letter)
        stop = ends[cut] - 1
        ends = ends.copy()
        ends[cut] -= 1
        return np.insert(starts, cut + 1, stop), np.insert(ends, cut + 1, stop + 1), at + np.searchsorted(cut, at)


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_loaded: dict[int, WordTokens] = {}


def _tokens(vocabulary: str) -> WordTokens:
    key = zlib.crc32(vocabulary.encode())
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordTokens(vocabulary)
    return _loaded[key]


#: Texts that show whether white space, the case of A-Z and a stop after a letter part or change tokens, as `WordTokens` takes for granted.
_PROBES = ("Plain words", "two  gaps\tand\nlines ", "ENDS here. And, THERE.", "a1. B2, c3", "caf\u00e9. \u00dcber, na\u00efve", "x.y z,w ... -- (it's) 12,500.75", "\u65e5\u672c \u8a9e. \u044f\u0437\u044b\u043a, ok")


def check_vocabulary(vocabulary: str) -> None:
    """Raises if ids of words do not make up ids of texts in this vocabulary."""
    words = WordTokens(vocabulary)
    got, offs = words.encode(pa.array(_PROBES))
    for text, a, b in zip(_PROBES, offs[:-1], offs[1:], strict=True):
        if got[a:b].tolist() != [*words.tokenizer.encode(text, add_special_tokens=False).ids, END_ID]:
            raise ValueError(f"this vocabulary's tokens cross words or depend on case: {text!r}")


def token_ids(vocabulary: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows by the task's cache of words, the end id after each, and row offsets."""
    return _tokens(vocabulary).encode(column)


def pack(rests: list[tuple[int, int, int]], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """rests: (length, document, start). Full windows as lists of (document, start, length), and the rests that filled none.

    With `last` everything is packed, in windows down to one token; each window is full, so its length is a power of two.
    """
    pool, total = sorted(rests), sum(r[0] for r in rests)
    sizes = [*tiers]
    while last and sizes[-1] > 1:
        sizes.append(sizes[-1] // 2)
    windows = []
    for k, size in enumerate(sizes):
        smallest = k >= len(tiers) - 1
        while pool and total >= size and (smallest or pool[-1][0] > size // 2):
            if not last and total < tiers[0]:
                break
            length, doc, start = pool.pop()
            if length > size:
                insort(pool, (length - size, doc, start + size))
                length = size
            window, gap = [(doc, start, length)], size - length
            while gap:
                if i := bisect_right(pool, (gap, 2**62, 2**62)):
                    length, doc, start = pool.pop(i - 1)
                else:
                    length, doc, start = pool.pop(0)
                    insort(pool, (length - gap, doc, start + gap))
                    length = gap
                window.append((doc, start, length))
                gap -= length
            windows.append(window)
            total -= size
    return windows, pool


def step_groups(lengths: list[int], step: int = STEP_TOKENS) -> list[int]:
    """For each window the number of its step group; groups get near equal token counts."""
    n = max(1, -(-sum(lengths) // step))
    heap, out = [(0, g) for g in range(n)], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        held, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (held + lengths[i], g))
    return out


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")])


def pack_documents(docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, pool: int = POOL, step: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, and with `with_ids` the ids."""
    check_vocabulary(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([*SCHEMA, ("ids", pa.list_(pa.int32()))]) if with_ids else SCHEMA

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        tokens = _tokens(sent.value)
        held: dict[int, tuple] = {}  # document's number here -> id, ids of its rest, start of the rest, tokens
        rests, n_docs, n_sequences, n_groups = [], 0, 0, 0

        def emit(windows):
            nonlocal n_sequences, n_groups
            out = [[] for _ in schema]
            groups = step_groups([sum(p[2] for p in w) for w in windows], step)
            for window, group in zip(windows, groups, strict=True):
                at, size = 0, sum(p[2] for p in window)
                for doc, start, length in window:
                    key, ids, first, n = held[doc]
                    own = ids[start - first : start - first + length]
                    row = (key, start, length, zlib.crc32(own.tobytes()), n, base + n_sequences, at, size, base + n_groups + group)
                    for c, v in zip(out, (*row, own.astype(np.int32)) if with_ids else row, strict=True):
                        c.append(v)
                    at += length
                n_sequences += 1
            n_groups += max(groups, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

        for batch in batches:
            for part in blocks(batch, "text"):
                ids, offs = tokens.encode(part.column(1))
                whole = []
                for key, a, b in zip(part.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    n, own = b - a, ids[a:b]
                    full = n - n % tiers[0]
                    if full:
                        held[-1 - n_docs] = (key, own, 0, n)
                        whole += [[(-1 - n_docs, s, tiers[0])] for s in range(0, full, tiers[0])]
                    if full < n:
                        held[n_docs] = (key, own[full:].copy(), full, n)
                        rests.append((n - full, n_docs, full))
                    n_docs += 1
                if whole:
                    yield emit(whole)
                    for k in [k for k in held if k < 0]:
                        del held[k]
                if len(rests) >= pool:
                    windows, rests = pack(rests, tiers, last=False)
                    if windows:
                        yield emit(windows)
                    left = {r[1] for r in rests}
                    held = {k: v for k, v in held.items() if k in left}
        windows, _ = pack(rests, tiers)
        if windows:
            yield emit(windows)
        give_back()

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, ", ".join(f"{f.name} {'array<int>' if f.name == 'ids' else 'long'}" for f in schema))


def vocabulary(name: str = VOCABULARY) -> str:
    """The text of a public tokenizer file, read by the driver and sent to the tasks."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary=vocabulary())


QUERIES = {"op5_packing": op5_packing}
SQL: dict[str, str] = {}
