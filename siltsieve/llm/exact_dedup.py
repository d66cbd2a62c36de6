"""Exact duplicates by Patricia-trie owners.

Texts are dealt by byte length and content hash to owner partitions. There each full byte string goes into a compressed
radix trie whose terminal nodes hold the owning identifier and the number of rows, so equality is decided on all bytes and
never on a hash alone. Each scan task first merges its own copies in a trie of the same kind, so a text that a third of all
rows share reaches its owner once for each task and flush, not once for each row.

Defined results: a null text counts as empty and is grouped like any other; a null identifier ranks lowest; rows that
repeat the largest identifier all stay, as an identifier names one document; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import shutil
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

LOWEST = -(2**63)


#: What a node takes besides its edge.
NODE_BYTES = 200


class Node:
    __slots__ = ("edge", "kids", "owner", "rows", "spill")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.owner, self.rows, self.spill = edge, {}, None, 0, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common start of a and b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """A compressed radix trie over byte strings; when its nodes exceed `most_bytes`, whole subtrees go to a file and are finished later, one at a time.

    `size` is the bytes of all edges and NODE_BYTES for each node, exactly: a subtree that goes takes off what its own nodes
    hold, so a prefix that many texts share counts once. The files are the task's own; a lost executor's are made anew with
    its tasks.
    """

    def __init__(self, most_bytes: int = 64 << 20, smallest: bool = True):
        self.root, self.most, self.size, self.pick = Node(b""), most_bytes, 0, min if smallest else max
        self.spilled: list = []

    def _own(self, node: Node, owner: int, rows: int) -> None:
        node.owner = owner if node.owner is None else self.pick(node.owner, owner)
        node.rows += rows

    def insert(self, text: bytes, owner: int, rows: int = 1) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                node.spill.write(struct.pack("<qqq", len(text), owner, rows) + text)
                return
            if at == len(text):
                return self._own(node, owner, rows)
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self._own(kid, owner, rows)
                self.size += len(kid.edge) + NODE_BYTES
                if self.size > self.most:
                    self._spill()
                return
            same = _common(kid.edge, text, at)
            if same < len(kid.edge):
                upper = Node(kid.edge[:same])
                kid.edge = kid.edge[same:]
                upper.kids[kid.edge[0]] = kid
                node.kids[text[at]] = kid = upper
                self.size += NODE_BYTES
            node, at = kid, at + same

    def _walk(self, node: Node, before: bytes) -> Iterator[tuple[bytes, int, int]]:
        todo = [(node, before)]
        while todo:
            node, before = todo.pop()
            whole = before + node.edge
            if node.spill is None and node.rows:
                yield whole, node.owner, node.rows
            todo += [(kid, whole) for kid in node.kids.values()]

    @staticmethod
    def _held(node: Node) -> int:
        """Bytes of the nodes of a subtree."""
        todo, held = [node], 0
        while todo:
            node = todo.pop()
            held += len(node.edge) + NODE_BYTES
            todo += node.kids.values()
        return held

    def _spill(self) -> None:
        """Moves the heaviest subtree below the first branching to a file of its own."""
        node, before = self.root, b""
        while len(live := [x for x in node.kids.values() if x.spill is None]) == 1 and not node.rows and live[0].kids:
            before += node.edge
            node = live[0]
        before += node.edge
        if not live:
            return
        held = {id(x): self._held(x) for x in live}
        kid = max(live, key=lambda x: held[id(x)])
        if not kid.kids and len(live) == 1:
            return  # one text alone
        out = tempfile.TemporaryFile()  # noqa: SIM115
        for text, owner, rows in self._walk(kid, before):
            out.write(struct.pack("<qqq", len(text), owner, rows) + text)
        todo = [kid]
        while todo:  # what was spilled below goes along, so that a text stays in one file
            node = todo.pop()
            todo += node.kids.values()
            if node.spill is not None:
                node.spill.seek(0)
                shutil.copyfileobj(node.spill, out)
                self.spilled.remove(node.spill)
                node.spill.close()
        kid.kids, kid.owner, kid.rows, kid.spill, kid.edge = {}, None, 0, out, kid.edge[:1]
        self.size -= held[id(kid)] - len(kid.edge) - NODE_BYTES
        self.spilled.append(out)

    def finish(self) -> Iterator[tuple[bytes, int, int]]:
        """All (text, owner, rows); spilled subtrees after the rest."""
        yield from self._walk(self.root, b"")
        self.root = Node(b"")
        for out in self.spilled:
            out.seek(0)
            part = Patricia(self.most, self.pick is min)
            while head := out.read(24):
                size, owner, rows = struct.unpack("<qqq", head)
                part.insert(out.read(size), owner, rows)
            out.close()
            yield from part.finish()


OWNED = pa.schema([("n_bytes", pa.int64()), ("digest", pa.binary()), ("text", pa.binary()), ("owner", pa.int64()), ("rows", pa.int64())])
FOUND = pa.schema([("digest", pa.binary()), ("owner", pa.int64()), ("rows", pa.int64())])
HELD = pa.schema([("digest", pa.binary()), ("ids", pa.list_(pa.int64()))])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20, weigh=lambda r: 64) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches, fold) -> Iterator[tuple[bytes, int]]:
    for batch in batches:
        for text, owner in zip(batch.column(0), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            yield (raw.lower() if fold else raw), (LOWEST if (k := owner.as_py()) is None else k)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold_case: bool = True, smallest: bool = True, trie_bytes: int = 64 << 20) -> DataFrame:
    """One row for each distinct text: digest (SHA-256 of the normalised text), owner, rows."""

    def local(batches):
        def merged():
            trie = Patricia(2**62, smallest)
            for text, owner in _rows(batches, fold_case):
                trie.insert(text, owner)
                if trie.size > trie_bytes // 2:  # merged enough; what follows goes to a new trie
                    yield from trie.finish()
                    trie = Patricia(2**62, smallest)
            yield from trie.finish()

        yield from _batches(((len(t), hashlib.sha256(t).digest(), t, o, n) for t, o, n in merged()), OWNED, weigh=lambda r: r[0] + 64)

    def final(batches):
        trie = Patricia(trie_bytes, smallest)
        for batch in batches:
            for text, owner, rows in zip(*(batch.column(k) for k in range(3)), strict=True):
                trie.insert(text.as_py(), owner.as_py(), rows.as_py())
        yield from _batches(((hashlib.sha256(t).digest(), o, n) for t, o, n in trie.finish()), FOUND)

    merged = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id")).mapInArrow(local, "n_bytes long, digest binary, text binary, owner long, rows long")
    return merged.repartition("n_bytes", "digest").select("text", "owner", "rows").mapInArrow(final, "digest binary, owner long, rows long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold_case: bool = True, smallest: bool = True, trie_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""

    def held(batches):
        def grouped():
            by: dict[bytes, list] = {}
            n = 0
            for text, owner in _rows(batches, fold_case):
                by.setdefault(hashlib.sha256(text).digest(), []).append(owner)
                if (n := n + 1) % 200_000 == 0:
                    yield from by.items()
                    by = {}
            yield from by.items()

        yield from _batches(grouped(), HELD, weigh=lambda r: 64 + 8 * len(r[1]))

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id")).mapInArrow(held, "digest binary, ids array<long>")
    found = owners(docs, id_col, text_col, fold_case=fold_case, smallest=smallest, trie_bytes=trie_bytes)
    null = lambda c: F.nullif(c, F.lit(LOWEST))
    return rows.join(found, "digest").select(F.explode("ids").alias("id"), "owner", "rows", "digest").select(
        null(F.col("id")).alias("doc_id"), null(F.col("owner")).alias("keep_id"), F.col("rows").alias("group_size"), (F.col("id") == F.col("owner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), smallest=False)


OP6_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
QUERIES = {"op6_exact_dedup": op6_exact_dedup}
SQL = {"op6_exact_dedup": OP6_SQL}
