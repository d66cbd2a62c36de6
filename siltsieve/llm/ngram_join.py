"""N-gram Jaccard self-join by prefix trees, and the groups that its links make.

Documents become sets of hashed word n-grams in one global order: hashed document frequency first (a count table of fixed
size over all documents), then the n-gram's hash. Rows with one and the same set are one class and go on as one row. Two
sets with the wanted Jaccard share an n-gram among their first n - ceil(t n) + 1, so classes meet at those n-grams. At a
meeting place the ordered sets are stored in a trie; each set walks it, sharing the overlap counted so far between all sets
behind a node, and leaves a subtree when what remains on either side can no longer reach the needed overlap. The pairs that
come through are checked on whole sets.

Groups of near copies would meet at every one of their common n-grams. Minimum hashes first link each class with a few
classes of its bucket, checked on whole sets, and what that connects is one component; afterwards only n-grams at which two
components meet are walked, and no pair within one. No link between different texts is lost: whatever is left out is
connected already. Meeting places with many sets are dealt to tasks as pairs of fixed-size blocks.

Defined results: texts without words, null or empty, have an empty set and are linked with nothing; texts with fewer words
than n have their whole sequence as one n-gram; rows that repeat an identifier are rows of their own, their group being named
by its smallest identifier (null only if all are null); an empty table gives no rows; other columns are not read.
N-grams are compared by 64-bit hash, classes by a 128-bit digest of their sets.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import blocks, cut, table
from .components import components

BITS, CHUNK_BITS = 21, 14
LOWEST = -(2**63)
#: Minimum hashes of a set; the first BANDS of them name its buckets, and AGREE of all must be equal for a look at whole sets.
MINHASHES, BANDS, AGREE, LEADERS = 8, 4, 5, 3
_SALT = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, MINHASHES, dtype=np.uint64) | np.uint64(1)
#: Sets in a block of a large meeting place.
BLOCK = 500
#: Meeting places with more sets are checked on whole sets at once.
LARGE = 64
#: Up to so many identifiers or n-grams are sent to all tasks; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Tasks whose count tables are added up together.
FAN = 64


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    buf, offs = K.texts(column)
    words, _, at = K.words_of(K.TO_LOWER[buf], offs)
    h, h_at = K.shingle_hashes(words, at, n)
    for a, b in zip(h_at[:-1].tolist(), h_at[1:].tolist(), strict=True):
        yield np.unique(h[a:b])


def prefix_length(size: int, percent: int) -> int:
    return size + percent * -size // 100 + 1


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def frequency_levels(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """For each of 2**BITS hash buckets a byte that rises with the number of documents whose n-grams fall there."""
    width = 1 << CHUNK_BITS

    def count(batches):
        total = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for part in blocks(batch, "text"):
                sets = list(shingle_sets(part.column(0), n))
                if sets:
                    np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - BITS)).astype(np.int64), np.uint32(1))
        yield from _chunks(total)

    def _chunks(total):
        ks, at, v = [], [], []
        for k in range(len(total) // width):
            own = total[k * width : (k + 1) * width]
            hit = np.flatnonzero(own)
            if len(hit):
                dense = len(hit) > width // 3
                ks.append(k)
                at.append(b"" if dense else hit.astype("<u2").tobytes())
                v.append((own if dense else own[hit]).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(at, pa.binary()), pa.array(v, pa.binary())], names=["chunk", "at", "n"])

    def sums(batches, kind) -> dict[int, np.ndarray]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, v in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("chunk", "at", "n")), strict=True):
                own = totals.setdefault(k, np.zeros(width, np.int64))
                own[np.frombuffer(at, "<u2") if at else slice(None)] += np.frombuffer(v, kind).astype(np.int64)
        return totals

    def some(batches):
        for k, own in sums(batches, "<u4").items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b""], pa.binary()), pa.array([own.astype("<i8").tobytes()], pa.binary())], names=["chunk", "at", "n"])

    def add(batches):
        for k, own in sums(batches, "<i8").items():
            level = np.minimum(4 * np.log2(np.maximum(own, 1)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "level"])

    counts = "chunk int, at binary, n binary"
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, counts)
    # chunks are few: the tables of each FAN tasks are added up first, so no task reads those of all
    parts = parts.withColumn("salt", F.expr(f"spark_partition_id() div {FAN}")).repartition("chunk", "salt").select("chunk", "at", "n").mapInArrow(some, counts)
    out = np.zeros(1 << BITS, np.uint8)
    for r in parts.repartition("chunk").mapInArrow(add, "chunk int, level binary").collect():  # 2**BITS bytes in all
        out[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.level, np.uint8)
    return out


def _order(u: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Places of n-gram hashes in the global order."""
    return (level[(u >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (u >> np.uint64(8))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_rows(docs: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """id, n (set size), digest, prefix (in the global order), m0.. (minimum hashes) of every row, and its key if docs has a third column."""
    keyed = docs.columns[2:]
    names = ["id", "n", "digest", "prefix", *(f"m{k}" for k in range(MINHASHES)), *keyed]

    def rows(batches):
        level = levels.value
        for batch in batches:
            for part in blocks(batch, "text"):
                size, digest, prefix, minimum = [], [], [], []
                for u in shingle_sets(part.column(1), n):
                    size.append(len(u))
                    digest.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                    if not len(u):
                        prefix.append(np.empty(0, np.int64))
                        minimum.append([0] * MINHASHES)
                        continue
                    p = prefix_length(len(u), percent)
                    key = _order(u, level)
                    first = np.argpartition(key, p - 1)[:p] if p < len(u) else np.arange(len(u))
                    prefix.append(_signed(u[first[np.argsort(key[first], kind="stable")]]))
                    minimum.append([int(_signed(K.fmix(u * s).min(keepdims=True))[0]) for s in _SALT])
                offs = np.concatenate(([0], np.cumsum([len(x) for x in prefix]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(offs, np.concatenate(prefix))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), lists, *(pa.array([m[k] for m in minimum], pa.int64()) for k in range(MINHASHES)), *part.columns[2:]], names=names)

    return docs.mapInArrow(rows, "id long, n long, digest binary, prefix array<long>, " + ", ".join([*(f"m{k} long" for k in range(MINHASHES)), *(f"{k} long" for k in keyed)]))


def _only(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` is among the keys (distinct, cut): by broadcast up to MOST_BROADCAST keys, else by a shuffle."""
    return df.join(_small(keys), on, "left_semi")


def whole_sets(digests: DataFrame, classes: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """digest, grams: the whole set of each of these classes, from the text of one of its rows."""
    wanted = cut(digests.distinct())
    ids = cut(classes.join(wanted, "digest").select(F.col("rep").alias("id")).distinct())

    def sets(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                found = list(shingle_sets(part.column(0), n))
                digest = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in found]
                offs = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offs, _signed(np.concatenate(found)))], names=["digest", "grams"])

    whole = _only(texts.withColumn("id", F.coalesce("id", F.lit(LOWEST))), ids, "id").select("text").mapInArrow(sets, "digest binary, grams array<long>")
    # one set a class: an identifier or text that repeats gives its set again
    return cut(whole.join(_small(wanted), "digest", "left_semi").dropDuplicates(["digest"]))


def linked(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b of digests) whose whole sets reach the similarity."""
    left, right = whole.select(F.col("digest").alias("a"), F.col("grams").alias("ga")), whole.select(F.col("digest").alias("b"), F.col("grams").alias("gb"))
    shared = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).alias("both"))
    return shared.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest")))


class Trie:
    """Ordered sets by those of their first n-grams that other components hold, with compressed paths.

    A set comes as a Record; sets go in by rising size. A node knows the sizes of the sets behind it and how much any of them
    has left after it.
    """

    __slots__ = ("keys", "mask", "kids", "ends", "least", "most", "left")

    def __init__(self, keys: list[int], bit: dict[int, int]):
        self.keys, self.mask, self.kids, self.ends, self.least, self.most, self.left = keys, _mask(keys, bit), {}, [], 2**62, 0, 0

    def insert(self, r: Record, bit: dict[int, int]) -> None:
        node, at, keys = self, 0, r.keys
        node._widen(r, 0)
        while at < len(keys):
            kid = node.kids.get(keys[at])
            if kid is None:
                kid = node.kids[keys[at]] = Trie(keys[at:], bit)
                kid._widen(r, len(keys))
                kid.ends.append(r)
                return
            same = 0
            for x, y in zip(kid.keys, keys[at:], strict=False):
                if x != y:
                    break
                same += 1
            if same < len(kid.keys):
                upper = Trie(kid.keys[:same], bit)
                # places before the split are not known any more for the sets behind it: their sizes bound what is left
                upper.least, upper.most, upper.left = kid.least, kid.most, kid.most
                kid.keys = kid.keys[same:]
                kid.mask = _mask(kid.keys, bit)
                upper.kids[kid.keys[0]] = kid
                node.kids[keys[at]] = kid = upper
            at += same
            kid._widen(r, at)
            node = kid
        node.ends.append(r)

    def _widen(self, r: Record, at: int) -> None:
        self.least, self.most = min(self.least, r.size), max(self.most, r.size)
        self.left = max(self.left, r.size - (r.places[at - 1] + 1 if at else 0))

    def meet(self, x: Record, before: int, percent: int) -> Iterator[Record]:
        """Sets here, of another root than x's, that may reach the needed overlap with x, no n-gram of `before` being common.

        The overlap so far is counted once for all sets behind a node. Behind it, no more can come than what either side has
        left: the sets their n-grams after the node, x those not before the node in the global order.
        """
        size, keys, mask, root, last = x.size, x.keys, x.mask, x.root, x.last
        least_need = needed(size, self.least, percent)
        todo = [(self, 0)]
        while todo:
            node, both = todo.pop()
            for r in node.ends:
                if r.root == root or percent * size > 100 * r.size:
                    continue
                common = mask & r.mask
                if common & before:
                    continue
                left = size - x.first if last <= r.last else r.size - r.first
                if common.bit_count() + left >= needed(size, r.size, percent):
                    yield r
            for kid in node.kids.values():
                if percent * size > 100 * kid.most:
                    continue
                shared = both + (kid.mask & mask).bit_count()
                if kid.kids and kid.keys[-1] <= last:
                    passed = bisect_right(keys, kid.keys[-1])
                    if shared + min(size - (x.places[passed - 1] + 1 if passed else 0), kid.left) < least_need:
                        continue
                todo.append((kid, shared))


class Record:
    """A set on its walk: size, number of its first n-grams and the last of them, keys (its meeting n-grams in the global order) with their places and weights."""

    __slots__ = ("digest", "size", "first", "last", "root", "keys", "places", "weights", "own", "whole", "mask")

    def __init__(self, digest, size, first, last, root, keys, places, weights, own, whole):
        self.digest, self.size, self.first, self.last, self.root, self.keys = digest, size, first, last, root, keys
        self.places, self.weights, self.own, self.whole, self.mask = places, weights, own, whole, 0


def _mask(keys: list[int], bit: dict[int, int]) -> int:
    """The bits of these n-grams; one that stands for several has as many."""
    out = 0
    for k in keys:
        if k in bit:
            out |= bit[k]
    return out


def _find(parent: dict, x):
    while (up := parent.get(x, x)) != x:
        parent[x] = parent.get(up, up)
        x = up
    return x


def walk_group(rows: list[Record], place: int, percent: int, blocks_differ: bool, checked: bool) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of digests of one meeting place (or pair of its blocks)."""
    seen: set[int] = set()
    shared: dict[int, int] = {}
    for r in rows:
        shared |= {k: w for k, w in zip(r.keys, r.weights, strict=True) if k in seen}
        seen.update(r.keys)
    if place not in shared or len({r.root for r in rows}) < 2:
        return
    bit, at, before = {}, 0, 0
    for k in sorted(shared):
        if k == place:
            before = (1 << at) - 1
        bit[k] = ((1 << shared[k]) - 1) << at
        at += shared[k]
    parent: dict = {}
    trie = Trie([], bit)
    for x in sorted(rows, key=lambda r: (r.size, r.digest)):
        x.mask = _mask(x.keys, bit)
        if trie.kids:
            for r in trie.meet(x, before, percent):
                if blocks_differ and r.own == x.own:
                    continue
                if checked:
                    u, v = _find(parent, r.root), _find(parent, x.root)
                    if u == v or len(r.whole & x.whole) < needed(x.size, r.size, percent):
                        continue
                    parent[u] = v
                yield min(x.digest, r.digest), max(x.digest, r.digest)
        trie.insert(x, bit)


_ONE, _MANY = np.dtype([("gram", "<i8"), ("c", "<i8")]), np.dtype([("gram", "<i8"), ("c0", "<i8"), ("c1", "<i8"), ("rows", "<i8"), ("members", "<i8")])


def _summed(x: np.ndarray) -> np.ndarray:
    """Entries of one n-gram made one."""
    x = x[np.argsort(x["gram"], kind="stable")]
    at = np.flatnonzero(np.concatenate(([True], x["gram"][1:] != x["gram"][:-1]))) if len(x) else np.empty(0, np.int64)
    out = np.empty(len(at), _MANY)
    if len(x):
        out["gram"], out["c0"], out["c1"] = x["gram"][at], np.minimum.reduceat(x["c0"], at), np.maximum.reduceat(x["c1"], at)
        out["rows"], out["members"] = np.add.reduceat(x["rows"], at), np.add.reduceat(x["members"], at)
    return out


def meetings(classes: DataFrame, levels, parts: int) -> DataFrame:
    """gram, rows, weight: the n-grams at which two components meet, with their numbers of classes. classes: prefix, root, digest.

    Of n-grams that the very same classes hold only the first in the global order is a meeting place, as no later one can be
    the first that two of them have in common; weight is how many it stands for. The sum of the classes' hashes tells.
    Entries travel as packed bytes, for each task and part once: 16 bytes for an n-gram that the task holds once in a class
    that is a component alone, 40 bytes for others however often the task holds them.
    """

    def pack(batches):
        for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
            m = batch.column(0).value_lengths().to_numpy()
            x = np.empty(int(m.sum()), _MANY)
            x["gram"] = batch.column(0).flatten().to_numpy()
            x["c0"] = x["c1"] = np.repeat(batch.column(1).to_numpy(), m)
            x["members"] = np.repeat(batch.column(2).to_numpy(), m)
            x["rows"] = 1
            x = _summed(x)
            part = (x["gram"].view(np.uint64) % np.uint64(parts)).astype(np.int32)
            x, part = x[np.argsort(part, kind="stable")], np.sort(part)
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(x) else np.empty(0, np.int64)
            ones, many = [], []
            for i, j in zip(at, [*at[1:], len(x)], strict=True):
                own = x[i:j]
                single = (own["rows"] == 1) & (own["c0"] == own["members"])
                one = np.empty(int(single.sum()), _ONE)
                one["gram"], one["c"] = own["gram"][single], own["c0"][single]
                ones.append(one.tobytes())
                many.append(own[~single].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array(ones, pa.binary()), pa.array(many, pa.binary())], names=["part", "one", "many"])

    def meet(batches):
        def finish(held):
            total = _summed(np.concatenate(held))
            total = total[total["c0"] != total["c1"]]
            place = _order(total["gram"].view(np.uint64), levels.value)
            # signed, and still in the global order
            place = (place ^ np.uint64(1 << 63)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(total["gram"]), pa.array(total["rows"]), pa.array(total["members"]), pa.array(place)], names=["gram", "rows", "members", "place"])

        now, held, size = None, [], 0
        for batch in batches:
            for part, one, many in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if part != now and held:
                    yield finish(held)
                    held, size = [], 0
                now = part
                single = np.frombuffer(one, _ONE)
                x = np.empty(len(single), _MANY)
                x["gram"], x["c0"], x["c1"], x["rows"], x["members"] = single["gram"], single["c"], single["c"], 1, single["c"]
                held += [x, np.frombuffer(many, _MANY)]
                size += len(x) + len(many) // _MANY.itemsize
                if size > 1 << 21:  # sums so far take the place of their entries
                    held = [_summed(np.concatenate(held))]
                    size = 0
        if held:
            yield finish(held)

    packed = classes.select("prefix", F.xxhash64("root").alias("c"), F.xxhash64("digest").alias("h")).mapInArrow(pack, "part int, one binary, many binary")
    met = packed.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "gram long, rows long, members long, place long")
    first = met.groupBy("members", "rows").agg(F.min(F.struct("place", "gram")).alias("first"), F.count("*").cast("int").alias("weight"))
    return cut(first.select("first.gram", "rows", "weight"))


SEGMENT = 1 << 18  # bytes of a part of the bitmap
_PROBES = _SALT[:3]


def _probe(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(grams.view(np.uint64) * p) >> np.uint64(64 - bits) for p in _PROBES]


def gram_filter(grams: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """A Bloom filter of a column of n-grams: log2 of its bits and its bytes; 16 bits for an n-gram, 2 to 16 MB in all.

    Built in parts of SEGMENT bytes by as many tasks. More n-grams than fit only let more needless rows through.
    """
    bits = min(27, max(24, (16 * count).bit_length()))
    width = SEGMENT * 8

    def spread(batches):
        for batch in batches:
            at = np.concatenate(_probe(batch.column(0).to_numpy(), bits))
            at = np.unique(at)
            part = (at // np.uint64(width)).astype(np.int32)
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(at) else np.empty(0, np.int64)
            ends = [*cuts[1:], len(at)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array([(at[i:j] % np.uint64(width)).astype("<u4").tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary())], names=["part", "at"])

    def gather(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                held.setdefault(part, np.zeros(width, bool))[np.frombuffer(at, "<u4")] = True
        for part, on in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["part", "bytes"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in grams.mapInArrow(spread, "part int, at binary").repartition("part").mapInArrow(gather, "part int, bytes binary").collect():  # 2**(bits - 3) bytes in all
        out[r.part * SEGMENT : (r.part + 1) * SEGMENT] = np.frombuffer(r.bytes, np.uint8)
    return bits, out


def thinned(classes: DataFrame, mixed: DataFrame) -> DataFrame:
    """digest, n, root, last (of the first n-grams), firsts: those of a class's first n-grams, with places, that may be among the mixed."""
    sent = classes.sparkSession.sparkContext.broadcast(gram_filter(mixed.select("gram"), mixed.count()))

    def thin(batches):
        bits, on = sent.value
        for batch in batches:
            lists = batch.column(3)
            flat, m = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            hit = np.ones(len(flat), bool)
            for at in _probe(flat, bits):
                hit &= (on[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            ends = np.cumsum(m)
            place = np.arange(len(flat)) - np.repeat(ends - m, m)
            offs = np.concatenate(([0], np.cumsum(np.add.reduceat(hit, ends - m) if len(m) else m))).astype(np.int32)
            firsts = pa.ListArray.from_arrays(offs, pa.StructArray.from_arrays([pa.array(place[hit].astype(np.int32)), pa.array(flat[hit])], names=["pos", "gram"]))
            out = pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(flat[ends - 1]), firsts], names=["digest", "n", "root", "last", "firsts"])
            yield out.filter(pa.array(np.diff(offs) > 0))

    return classes.select("digest", "n", "root", "prefix").mapInArrow(thin, "digest binary, n long, root binary, last long, firsts array<struct<pos:int,gram:long>>")


def walked(met: DataFrame, levels, percent: int, checked: bool) -> DataFrame:
    """Pairs a, b of digests in different components that tries let through. met: gram, rows, digest, n, last, root, firsts[, grams].

    With `checked`, whole sets (grams) come along: pairs are verified here, and none is looked at whose two sides have been
    connected here already, so a large meeting place gives at most as many pairs as it has sets in a block.
    """
    met = met.withColumn("blocks", F.expr(f"(rows + {BLOCK - 1}) div {BLOCK}")).withColumn("own", F.pmod(F.xxhash64("digest", "gram"), F.col("blocks")))
    # block i meets block j for i <= j: a set goes where its own block is one of the two
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "digest", "n", "last", "root", F.col("firsts.gram").alias("keys"), F.col("firsts.pos").alias("places"), F.col("firsts.weight").alias("weights"), *["grams"] * checked)
    met = met.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")

    def order(x) -> list[int]:
        return _order(x.to_numpy(zero_copy_only=False).view(np.uint64), levels.value).tolist()

    def walk(batches):
        now, rows, out = None, [], []

        def flush(k=None):
            out.extend(walk_group(rows, k[3], percent, k[1] != k[2], checked))

        for batch in batches:
            for part in (batch.slice(x, 2000) for x in range(0, batch.num_rows, 2000)):
                c = {name: part.column(k) for k, name in enumerate(part.schema.names)}
                grams, places, lasts, flat = c["gram"].to_pylist(), order(c["gram"]), order(c["last"]), order(c["keys"].flatten())
                pos, weights = c["places"].flatten().to_pylist(), c["weights"].flatten().to_pylist()
                at, m = 0, c["keys"].value_lengths().to_pylist()
                plain = zip(grams, places, *(c[k].to_pylist() for k in ("i", "j", "own", "digest", "n", "root")), lasts, m, strict=True)
                whole = c["grams"] if checked else None
                for k, (gram, place, i, j, own, digest, n, root, last, size) in enumerate(plain):
                    key = (gram, i, j, place)
                    if key != now:
                        if now is not None and len(rows) > 1:
                            flush(now)
                        now, rows = key, []
                    rows.append(Record(digest, n, prefix_length(n, percent), last, root, flat[at : at + size], pos[at : at + size], weights[at : at + size], own, frozenset(whole[k].as_py()) if checked else None))
                    at += size
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])
                    out.clear()
        if now is not None and len(rows) > 1:
            flush(now)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return met.mapInArrow(walk, "a binary, b binary").distinct()


def _small(df: DataFrame) -> DataFrame:
    """df (cut), marked for broadcast if it has at most MOST_BROADCAST rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, percent: int = 80, key_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest identifier that links reach).

    With `key_col`, a column of unique longs: key, and keep_key, the key of the one row that has the component's smallest
    identifier and of these the smallest key (null where no row of the component has an identifier, and for empty sets).
    """
    texts = _texts(docs, id_col, text_col)
    keyed = key_col is not None
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(texts, "text", n))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(key_col).cast("long").alias("key")) if keyed else texts
    rows = cut(set_rows(source, levels, n, percent).withColumn("row", F.monotonically_increasing_id()))
    # one row of each set goes on; the others are named by their row numbers
    full = rows.where("n > 0")
    first = full.groupBy("digest").agg(F.min(F.struct(F.coalesce("id", F.lit(LOWEST)).alias("id"), "row")).alias("rep"), F.min("id").alias("known"), *[F.min(F.when(F.col("id").isNotNull(), F.struct("id", "key"))).alias("keeper")] * keyed)
    first = cut(first.select("digest", "known", F.col("rep.id").alias("rep"), F.col("rep.row").alias("row"), *["keeper"] * keyed))
    others = cut(full.select("digest", "row").join(first.select("digest", F.col("row").alias("first")), "digest").where("row <> first").select("row"))
    classes = full.join(_small(others), "row", "left_anti")

    mins = F.array(*(f"m{k}" for k in range(MINHASHES))).alias("mins")
    keys = classes.select("digest", mins, F.posexplode(F.array(*(f"m{k}" for k in range(BANDS)))).alias("k", "m"))
    picks = [F.min(F.struct(F.xxhash64("digest", F.lit(k)), "digest", "mins")).alias(f"p{k}") for k in range(LEADERS)]
    leaders = keys.groupBy("k", "m").agg(F.count("*").alias("rows"), *picks).where("rows > 1")
    leaders = leaders.select("k", "m", F.explode(F.array(*(F.struct(F.col(f"p{k}.digest").alias("a"), F.col(f"p{k}.mins").alias("own")) for k in range(LEADERS)))).alias("p"))
    agree = F.size(F.filter(F.zip_with("mins", "p.own", lambda x, y: x == y), lambda x: x))
    stars = keys.join(leaders, ["k", "m"]).where((F.col("digest") != F.col("p.a")) & (agree >= AGREE))
    stars = cut(stars.select(F.least("p.a", "digest").alias("a"), F.greatest("p.a", "digest").alias("b")).distinct())
    sure = cut(linked(stars, whole_sets(_ends(stars), first, texts, n), percent))
    roots = cut(components(sure).withColumnRenamed("node", "digest"))
    rooted = classes.join(_small(roots), "digest", "left").select("digest", "n", "prefix", F.coalesce("root", "digest").alias("root"))

    total = rows.agg(F.sum(F.size("prefix"))).first()[0] or 0
    mixed = meetings(rooted, levels, max(16, total >> 20))
    thin = thinned(rooted, mixed).select("digest", "n", "root", "last", F.inline("firsts")).join(mixed, "gram")
    firsts = F.array_sort(F.collect_list(F.struct("pos", "gram", "weight", "rows"))).alias("firsts")
    thin = cut(thin.groupBy("digest", "n", "root", "last").agg(firsts))
    met = thin.select("*", F.explode("firsts").alias("at")).select("*", "at.gram", "at.rows").drop("at")
    large = met.where(f"rows > {LARGE}")
    found = cut(walked(large.join(whole_sets(large.select("digest"), first, texts, n), "digest"), levels, percent, checked=True))
    pairs = cut(walked(met.where(f"rows <= {LARGE}"), levels, percent, checked=False))
    more = linked(pairs, whole_sets(_ends(pairs), first, texts, n), percent)
    found = components(roots.select(F.col("digest").alias("a"), F.col("root").alias("b")).unionByName(found).unionByName(more))

    named = first.select("digest", "known", *["keeper"] * keyed).join(found.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "known", *["keeper"] * keyed, F.coalesce("root", "digest").alias("root"))
    best = named.groupBy("root").agg(F.min("known").alias("component_id"), *[F.min("keeper").getField("key").alias("keep_key")] * keyed)
    by_digest = named.join(best, "root").select("digest", "component_id", *["keep_key"] * keyed)
    joined = rows.select("id", "n", "digest", *["key"] * keyed).join(by_digest, "digest", "left")
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), *["key", "keep_key"] * keyed)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


QUERIES = {"op4_ngram_jaccard_join": op4_ngram_jaccard_join}
SQL: dict[str, str] = {}
