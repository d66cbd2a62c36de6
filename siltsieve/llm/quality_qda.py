"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text becomes a short vector of statistics (sizes, shares of character kinds, repetition), each transformed to be
near normal. Class means and covariances come from sums over all labelled training rows; each covariance is shrunk towards
the pooled one and its own scaled diagonal, and factored once (Cholesky). A document's score is the logistic of the
difference of the classes' Mahalanobis log densities plus the log prior odds, tempered to the training rows by Platt's method
on their own sums (a bounded, documented sample of them).

Defined results: a null or empty text has the statistics of an empty text; with labels of one class or none every score is
that class's smoothed share; rows that repeat count as often as they come; an empty table gives no rows; labels, lang,
source and doc_id are no inputs; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import blocks, cut, table
from .linear import below_share, fit_platt, sigmoid, with_slack
from .quality_rules import dup_lines, repeat_words
from .toxicity import fold_expr

SHRINK_POOLED, SHRINK_DIAGONAL, FLOOR = 0.05, 0.05, 1e-3
#: About so many labelled training rows (a few more at most) fix the temperature.
CALIBRATION = 4000
THRESHOLD = 0.5


def _kind(members: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(members)] = 1
    return out


_SHARES = {
    "upper": _kind(bytes(range(65, 91))), "lower": _kind(bytes(range(97, 123))), "digit": _kind(b"0123456789"), "space": _kind(b" \t\r\x0b\x0c"),
    "line": _kind(b"\n"), "bang": _kind(b"!?"), "stop": _kind(b".,;:"), "symbol": _kind(b"#*$%&<>@^~=_+"), "bar": _kind(b"|/\\"), "quote": _kind(b"\"'`()[]{}-"),
    "wide": (np.arange(256) >= 128).astype(float),
}
NAMES = ("log_bytes", "log_words", "word_length", *_SHARES, "distinct_words", "same_next", "repeat_words", "dup_lines")
D = len(NAMES)


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A share, smoothed and on a log scale."""
    return np.log((count + 0.5) / (total + 50.0))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    buf, offs = K.texts(column)
    words, lengths, at = K.words_of(buf, offs)
    n_bytes, n_words = np.diff(offs), np.diff(at)
    out = [np.log1p(n_bytes), np.log1p(n_words), np.log1p(K.row_sums(lengths.astype(float), at) / np.maximum(n_words, 1))]
    out += [_share(K.byte_sums(kind, buf, offs), n_bytes) for kind in _SHARES.values()]
    row = np.repeat(np.arange(len(n_words)), n_words)
    first = ~pd.Series(words + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).duplicated().to_numpy() if len(words) else np.empty(0, bool)
    same = np.zeros(len(words))
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    raw = buf.tobytes()
    lines = np.array([dup_lines(raw[i:j]) for i, j in zip(offs[:-1], offs[1:], strict=True)], float)
    out += [np.log((K.row_sums(first.astype(float), at) + 1) / (n_words + 1)), _share(K.row_sums(same, at), n_words), _share(repeat_words(words, at), n_words), _share(lines, K.byte_sums(_SHARES["line"], buf, offs) + 1)]
    return np.stack(out, 1)


class Qda:
    """Two normal densities with cached Cholesky factors."""

    def __init__(self, n: np.ndarray, total: np.ndarray, outer: np.ndarray):
        """n: rows of classes 0 and 1; total, outer: sums of x and of x x'."""
        self.ok = bool((n >= 2).all())
        self.a, self.b = 1.0, 0.0
        self.prior = float(np.log((n[1] + 1) / (n[0] + 1)))
        if not self.ok:
            return
        mean = total / n[:, None]
        cov = [outer[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
        self.mean, self.inverse, self.log_det = mean, [], []
        for k in (0, 1):
            extra = min(0.5, 5 * D / n[k])  # few rows, more shrinkage
            s = cov[k] * (1 - SHRINK_POOLED - extra) + pooled * (SHRINK_POOLED + extra)
            s = (1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * np.diag(np.diag(s)) + FLOOR * np.eye(D)
            factor = np.linalg.cholesky(s)
            self.inverse.append(np.linalg.inv(factor))
            self.log_det.append(2 * float(np.log(np.diag(factor)).sum()))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, and the log prior odds."""
        if not self.ok:
            return np.full(len(x), self.prior)
        far = [(((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(1) + self.log_det[k] for k in (0, 1)]
        return (far[0] - far[1]) / 2 + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.margin(x) + self.b)


def _vectors(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id, stats of every row; one pass over the texts."""

    def measure(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                x = statistics(part.column(1))
                stats = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * D, x.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), stats], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measure, "doc_id long, stats array<double>")


def fit(stats: DataFrame, labels: DataFrame, label: str, where) -> Qda:
    """Sums over all labelled rows that `where` lets in; the driver gets one row for each class and place."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(where).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = stats.join(known, "doc_id")

    def sums(batches):
        kept = {}
        for batch in batches:
            x, y = _vectors(batch), batch.column(batch.schema.get_field_index("y")).to_numpy()
            for k in np.unique(y):
                own = x[y == k]
                kept[int(k)] = kept.get(int(k), 0) + np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        for k, v in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["y", "v"])

    total = np.zeros((2, 1 + D + D * D))
    for r in rows.select("stats", "y").mapInArrow(sums, "y int, v array<double>").select("y", F.posexplode("v")).groupBy("y", "pos").agg(F.sum("col").alias("v")).collect():
        total[r.y, r.pos] = r.v
    model = Qda(total[:, 0], total[:, 1 : 1 + D], total[:, 1 + D :].reshape(2, D, D))
    if model.ok:
        # every row is taken or left by its own hash, so about CALIBRATION rows reach the driver however many partitions there are
        share = with_slack(CALIBRATION) / total[:, 0].sum()
        some = rows.where(below_share(share, "doc_id", F.lit(13))).select("stats", "y").collect()
        if some:
            y = np.array([r.y for r in some])
            z = np.clip(model.margin(np.array([r.stats for r in some])), -60, 60)
            model.a, model.b = fit_platt(z, y)
    return model


def score_statistics(docs: DataFrame, labels: DataFrame, *, modulus: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Held-out rows are never learned from."""
    stats = cut(statistics_table(docs))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, "quality", fold_expr(modulus) != held))

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                p = model.value.score(_vectors(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", F.coalesce(fold_expr(modulus) == held, F.lit(False)).alias("held_out"), "stats").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
SQL: dict[str, str] = {}
