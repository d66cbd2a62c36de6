"""Delta-maintained token totals by source, language and tokenizer version.

A change to a document is a signed row: an insert adds its tokens, a delete takes them away, a revision takes the old
version's away and adds the new one's. Changes are summed where the texts are read, a row for each group and Arrow batch, so
no text is shuffled. A rollup is a chain of snapshots, each with the totals of all groups and the names of the batches that
they contain: a commit adds a batch's sums to the newest snapshot and puts the next one in place by one rename, so a batch and
its name appear together or not at all. A batch counts once however often it is sent or restarted, and of two writers the one
that comes second starts again from the other's snapshot. Reading the totals reads one snapshot, not the history.

Tokenizer versions: `word-bpe-49k`, the ids of a public vocabulary; `bytes-1`, one token for each UTF-8 byte; `words-1`, runs of
anything but ASCII white space.

Defined results: null source or language is a group of its own; a null or empty text has no tokens but is one document;
groups whose documents all went away leave the totals; repeated rows count as often as they come; an empty table commits its
name and changes nothing; a rollup without commits has no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import blocks, fresh_dir, give_back, table
from .packing import VOCABULARY, token_ids, vocabulary

#: Documents of fewer characters are withdrawn in the query.
SHORT = 200
KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
ARROW = pa.schema([("source", pa.string()), ("lang", pa.string()), ("tokenizer", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


def _bytes(column: pa.Array, _) -> np.ndarray:
    return np.diff(K.texts(column)[1])


def _words(column: pa.Array, _) -> np.ndarray:
    return np.diff(K.words_of(*K.texts(column))[2])


def _vocabulary(column: pa.Array, text: str) -> np.ndarray:
    return np.diff(token_ids(text, column)[1]) - 1  # without the end id


#: Tokenizer versions: what counts a column of texts, and the vocabulary file that it needs.
COUNTERS: dict[str, tuple[Callable, str | None]] = {"word-bpe-49k": (_vocabulary, VOCABULARY), "bytes-1": (_bytes, None), "words-1": (_words, None)}


def changes(docs: DataFrame, signs: dict[str, int], text_col: str = "text") -> DataFrame:
    """Signed sums (KEYS, docs, tokens) for each tokenizer version of `signs`; one pass over the texts."""
    spark = docs.sparkSession
    needed = {f for name in signs if (f := COUNTERS[name][1])}
    sent = spark.sparkContext.broadcast({f: vocabulary(f) for f in needed})

    def count(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                for name, sign in signs.items():
                    counter, file = COUNTERS[name]
                    n = counter(part.column(2), sent.value[file] if file else None)
                    own = pa.table([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["source", "lang", "n"])
                    own = own.group_by(["source", "lang"]).aggregate([("n", "sum"), ([], "count_all")])
                    signed = lambda c: pc.multiply(own.column(c).cast(pa.int64()), sign).combine_chunks()  # noqa: B023, E731
                    flat = [own.column(c).combine_chunks() for c in ("source", "lang")]
                    yield pa.RecordBatch.from_arrays([*flat, pa.array([name] * own.num_rows, pa.string()), signed("count_all"), signed("n_sum")], schema=ARROW)
        give_back()

    columns = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(count, TOTALS)


def inserts(docs: DataFrame, *tokenizers: str, text_col: str = "text") -> DataFrame:
    return changes(docs, dict.fromkeys(tokenizers, 1), text_col)


def deletes(docs: DataFrame, *tokenizers: str, text_col: str = "text") -> DataFrame:
    return changes(docs, dict.fromkeys(tokenizers, -1), text_col)


def revisions(docs: DataFrame, old: str, new: str, text_col: str = "text") -> DataFrame:
    """Takes the old version's counts away and adds the new one's."""
    return changes(docs, {old: -1, new: 1}, text_col)


class Rollup:
    """Snapshots of totals under one shared folder: v=<number>/totals and v=<number>/batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def version(self) -> int:
        """Number of the newest snapshot, 0 for none."""
        if not self._fs.exists(self._at()):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at())]
        return max([int(n[2:]) for n in names if n.startswith("v=")], default=0)

    def _read(self, version: int, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/v={version}/{part}") if version else self.spark.createDataFrame([], schema)

    def totals(self) -> DataFrame:
        return self._read(self.version(), "totals", TOTALS)

    def batches(self) -> DataFrame:
        return self._read(self.version(), "batches", "batch string")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch of signed sums; False, and no work, if the rollup holds one of that name."""
        stage = f"open-{uuid.uuid4().hex}"  # its own, so that no other writer's files can get into it
        sums = f"{self.path}/{stage}-sums"
        add = lambda rows: rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        done, summed = False, False
        try:
            while not done:
                now = self.version()
                if not self._read(now, "batches", "batch string").where(F.col("batch") == batch).isEmpty():
                    return False
                if not summed:  # texts are counted once, however often a snapshot is made
                    add(deltas).write.parquet(sums)
                    summed = True
                both = add(self._read(now, "totals", TOTALS).unionByName(self.spark.read.schema(TOTALS).parquet(sums)))
                both.where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/{stage}/totals")
                names = self._read(now, "batches", "batch string").unionByName(self.spark.createDataFrame([(batch,)], "batch string"))
                names.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{stage}/batches")
                done = self._publish(stage, now + 1)
        finally:
            for left in (stage, f"{stage}-sums"):
                self._fs.delete(self._at(left), True)
        return True

    def _publish(self, stage: str, version: int) -> bool:
        """Renames the staged snapshot; False if another writer has made this version."""
        target, inside = self._at(f"v={version}"), self._at(f"v={version}", stage)
        if self._fs.exists(target):
            return False
        renamed = self._fs.rename(self._at(stage), target)
        if self._fs.exists(inside):  # the other came in between: a rename onto a folder moves into it
            self._fs.delete(inside, True)
            return False
        if not renamed:
            if self._fs.exists(target):
                return False
            raise OSError(f"snapshot {version} of {self.path} could not be put in place")
        return True


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, one of them sent twice.

    All documents are loaded by words-1 and bytes-1; words-1 is revised to word-bpe-49k; documents of less than SHORT
    characters are deleted from both versions; the revision is sent again and ignored.
    """
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    rollup = Rollup(spark, fresh_dir(spark, "token-rollup"))
    rollup.commit("load", inserts(docs, "words-1", "bytes-1"))
    rollup.commit("new-tokenizer", revisions(docs, "words-1", "word-bpe-49k"))
    rollup.commit("withdraw-short", deletes(docs.where(F.length(F.coalesce("text", F.lit(""))) < SHORT), "word-bpe-49k", "bytes-1"))
    rollup.commit("new-tokenizer", revisions(docs, "words-1", "word-bpe-49k"))
    return rollup.totals()


QUERIES = {"op9_token_counts": op9_token_counts}
SQL: dict[str, str] = {}
