"""Line deduplication over levelled sorted runs of line hashes.

A batch of documents is first one sorted row for each line hash: the number of documents that hold the line and the largest
of their identifiers. It is merge-anti-joined with the runs that earlier batches left: hashes that no run holds become a new
run at level 0, hashes that one does go to the list of repeats. So a hash stands in one run only, with what its first batch
said of it, and all later batches add to it by the repeats, which are few where most lines are unique. When a level has
`fanout` runs they are merged into one run of the next level. Runs are bucketed and sorted by hash, with one file a bucket, so
the anti-joins and merges shuffle the batch alone and never a run. A line's total is its row in the runs and its repeats;
that holds because all rows of one identifier fall into one batch.

Lines to drop: while they are at most `most_broadcast`, by count, their hashes go to all tasks and texts are cleaned where they
are read, without a shuffle of texts. Beyond that each row's own list is joined to it; both ways give the same rows.

Defined results: a null or empty text is one empty line; a null identifier ranks lowest; rows of one identifier are one
document when holders are counted; an empty table gives no rows; other columns pass through `clean_lines` untouched.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, UPPER, cut, fresh_dir, remove_dir, table

LOWEST = -(2**63)
_STRIP = SPACE.encode()
#: Holders of one line are looked up by so many tasks.
SALTS = 16
#: Up to so many common lines are sent to all tasks (about 100 bytes each there).
MOST_BROADCAST = 100_000


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key is too short to count."""
    key = line.strip(_STRIP).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int, key_col: str | None = None) -> DataFrame:
    """hash, id[, key]: each long enough line of each row, once."""
    keyed = key_col is not None

    def split(batches):
        for batch in batches:
            hashes, ids, keys = [], [], []
            extra = batch.column(2).to_pylist() if keyed else [None] * batch.num_rows
            for text, ident, key in zip(batch.column(0), batch.column(1).to_pylist(), extra, strict=True):
                own = {h for x in (text.as_py() or "").encode().split(b"\n") if (h := line_hash(x, min_chars))}
                hashes += own
                ids += [LOWEST if ident is None else ident] * len(own)
                keys += [key] * len(own)
            columns = [pa.array(hashes, pa.binary()), pa.array(ids, pa.int64()), *([pa.array(keys, pa.string())] if keyed else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "id", "key"][: len(columns)])

    rows = docs.select(F.col(text_col).cast("string"), F.col(id_col).cast("long"), *([F.col(key_col).cast("string")] if keyed else []))
    return rows.mapInArrow(split, "hash binary, id long" + ", key string" * keyed)


class LineRuns:
    """Levelled sorted runs, bucketed tables under one folder of the shared file system; no hash is in two of them."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2):
        self.spark, self.path, self.fanout, self.levels, self.made = spark, path, fanout, [[]], 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.n_repeats = f"line_run_{uuid.uuid4().hex}", 0

    def _write(self, run: DataFrame, level: int) -> None:
        """run: partitioned by hash into `buckets`, so each bucket is one sorted file."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.made += 1
        at = f"{self.path}/level-{level}/run-{self.made}"
        run.select("hash", "n_docs", "last_id").write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").option("path", at).saveAsTable(f"{self.name}_{self.made}")
        self.levels[level].append((f"{self.name}_{self.made}", at))

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE {run[0]}")
        remove_dir(self.spark, run[1])

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def repeats(self) -> DataFrame | None:
        """hash, n_docs, last_id of the hashes that a batch found in a run, a row for each batch."""
        return self.spark.read.parquet(f"{self.path}/repeats") if self.n_repeats else None

    def split(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows whose hash no run holds, rows whose hash one does) of a batch partitioned by hash; each run is merged with it once."""
        names = []
        for k, run in enumerate(self.runs()):
            names.append(f"in_{k}")
            batch = batch.join(run.select("hash", F.lit(True).alias(names[-1])), "hash", "left")
        batch = cut(batch.select("hash", "n_docs", "last_id", (F.coalesce(*names, F.lit(False)) if names else F.lit(False)).alias("known")))
        return batch.where("not known"), batch.where("known")

    def add(self, lines: DataFrame) -> None:
        """lines: hash, id of documents that no earlier batch held."""
        summed = lines.distinct().groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id"))
        new, seen = self.split(summed.repartition(self.buckets, "hash"))
        self._write(new, 0)
        seen.select("hash", "n_docs", "last_id").write.mode("append").parquet(f"{self.path}/repeats")
        self.n_repeats += 1
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged([self.spark.table(name) for name, _ in old]), level + 1)
            for run in old:
                self._drop(run)
            level += 1

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """All rows of the runs, which share no hash, bucket by bucket."""
        names = ("n_docs", "last_id")
        out = runs[0]
        for run in runs[1:]:
            other = run.select("hash", *(F.col(c).alias(f"o_{c}") for c in names))
            out = out.join(other, "hash", "full").select("hash", *(F.coalesce(c, f"o_{c}").alias(c) for c in names))
        return out

    def common(self, min_docs: int) -> DataFrame:
        """hash, keep_id of the lines that at least so many documents hold."""
        more = self.repeats().groupBy("hash").agg(F.sum("n_docs").alias("more"), F.max("last_id").alias("later"))
        total = lambda run: run.join(more, "hash", "left").select("hash", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last_id", "later").alias("keep_id"))
        every = reduce(DataFrame.unionByName, [total(run) for run in self.runs()])
        return every.where(F.col("n") >= min_docs).select("hash", "keep_id")

    def remove(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = [[]]
        remove_dir(self.spark, self.path)


def common_lines(docs: DataFrame, id_col: str, text_col: str, *, min_chars: int, min_docs: int, n_batches: int, fanout: int) -> DataFrame:
    """hash, keep_id of the lines that at least `min_docs` documents hold, kept in the shared folder."""
    spark = docs.sparkSession
    lines = cut(line_table(docs, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(n_batches))))
    runs = LineRuns(spark, fresh_dir(spark, "line-runs"), fanout)
    for k in range(n_batches):
        runs.add(lines.where(F.col("batch") == k).select("hash", "id"))
    common = cut(runs.common(min_docs))
    runs.remove()
    return common


def dropped_lines(lines: DataFrame, common: DataFrame) -> DataFrame:
    """lines: hash, id, key -> key, drop: for each key, the hashes of the lines that its rows lose."""
    # a line that very many documents hold is dealt to SALTS tasks; the salt goes with the row
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(11)), F.lit(SALTS)))
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    lost = salted.join(common, ["hash", "salt"]).where("id <> keep_id").select("key", "hash").distinct()
    return lost.groupBy("key").agg(F.collect_list("hash").alias("drop"))


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4, fanout: int = 2, most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """docs with the text replaced by its kept lines, and n_lines, n_dropped after its columns."""
    inner = [f"c{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*inner)
    text, ident = inner[docs.columns.index(text_col)], inner[docs.columns.index(id_col)]
    common = common_lines(named, ident, text, min_chars=min_chars, min_docs=min_docs, n_batches=n_batches, fanout=fanout)
    at, text_at = len(inner), inner.index(text)
    if common.count() <= most_broadcast:
        sent = docs.sparkSession.sparkContext.broadcast({bytes(r.hash): r.keep_id for r in common.collect()})
        joined = named.withColumn("id", F.coalesce(F.col(ident).cast("long"), F.lit(LOWEST)))
    else:
        # lists go by identifier and text, so that rows without an identifier do not share one
        sent = None
        keyed = named.withColumn("key", F.sha2(F.concat(F.coalesce(F.col(ident).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))), 256))
        lists = dropped_lines(line_table(keyed, ident, text, min_chars, "key"), common)
        joined = keyed.join(lists, "key", "left").select(*inner, "drop")

    def lost_of(value, lines: list[bytes]) -> set[bytes]:
        """Hashes of the lines that a row loses; value: its identifier, or its own list."""
        if sent is None:
            return set(value or ())
        return {h for x in lines if (h := line_hash(x, min_chars)) and sent.value.get(h, value) != value}

    def keep(batches):
        for batch in batches:
            out, n_lines, n_dropped = [], [], []
            for value, last in zip(batch.column(text_at), batch.column(at), strict=True):
                raw = (value.as_py() or "").encode()
                lines = raw.split(b"\n")
                if lost := lost_of(last.as_py(), lines):
                    kept = [x for x in lines if line_hash(x, min_chars) not in lost]
                    out.append(b"\n".join(kept).decode())
                    n_dropped.append(len(lines) - len(kept))
                else:
                    out.append(raw.decode())
                    n_dropped.append(0)
                n_lines.append(len(lines))
            columns = [batch.column(k) for k in range(at)]
            columns[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*inner, "n_lines", "n_dropped"])

    fields = [T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in named.schema]
    done = joined.mapInArrow(keep, T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
    return done.toDF(*docs.columns, "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_WS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_WS}), '{UPPER}', '{LOWER}') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.r, k.doc_id, k.i, k.line, hot.key IS NOT NULL AND hot.keep_id <> k.doc_id AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
QUERIES = {"op8_line_dedup": op8_line_dedup}
SQL = {"op8_line_dedup": OP8_SQL}
