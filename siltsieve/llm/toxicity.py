"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams of 3 to 6 characters (code points, A-Z lowered). For each the log ratio of its
smoothed shares in toxic and in clean training documents is taken; logistic regression learns weights for presence times
ratio. The weights that matter are kept (`features`, largest first), so scoring a text is a table look-up for each character
and a distinct count over the few positions that hit. Scores are calibrated (Platt) on held-back training rows.

A score is the probability of toxicity were both classes as common (`PRIOR`): both fits weigh the classes so, whatever their
shares among the labels or in the sample, and a fixed threshold means the same at every size.

The training sample is bounded by `sample` rows and linear.SAMPLE_BYTES (the only bounds); whole texts are learned from and
scored, long ones in pieces. Defined results: a null or empty text scores by the intercept alone; with labels of one class or
none every score is the smoothed share of that class; repeated rows give repeated rows; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import blocks, table
from .linear import Rows, fit_logistic, fit_platt, labelled_sample, sigmoid

BITS = 17
NGRAMS = (3, 4, 5, 6)
SAMPLE, FEATURES, L2, THRESHOLD = 4000, 5000, 1e-2, 0.3
#: Pseudo-documents of each class that hold every feature: rare n-grams get small ratios.
SMOOTH = 5.0
PRIOR = 0.5
N = len(NGRAMS) << BITS


def presence(buf: np.ndarray, offs: np.ndarray, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features, of those that `useful` marks, of each row and row offsets."""
    points, offs = K.code_points(buf, offs)
    keys = []
    for part, part_offs, first in K.pieces(points, offs, max(NGRAMS) - 1):
        for k, code in enumerate(K.point_ngrams(part, part_offs, NGRAMS, BITS)):
            hit = code >= 0
            code += k << BITS
            hit &= useful[code]
            at = np.flatnonzero(hit)
            keys.append(np.unique((first + np.searchsorted(part_offs, at, "right") - 1) * N + code[at]))
    keys = np.unique(np.concatenate(keys))
    return keys % N, np.searchsorted(keys, np.arange(len(offs)) * N)


def all_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row and row offsets; a row marks a table, so nothing is sorted."""
    points, offs = K.code_points(buf, offs)
    mark, out = np.zeros(N, bool), []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        own = points[a:b]
        for part, part_offs, _ in K.pieces(own, np.array([0, len(own)]), max(NGRAMS) - 1):
            for k, code in enumerate(K.point_ngrams(part, part_offs, NGRAMS, BITS)):
                mark[code[: max(0, len(part) - NGRAMS[k] + 1)] + (k << BITS)] = True
        out.append(np.flatnonzero(mark))
        mark[out[-1]] = False
    return np.concatenate([np.empty(0, np.int64), *out]), np.cumsum([0, *map(len, out)])


def _chunks(texts: list[bytes], useful: np.ndarray | None = None, most_bytes: int = 1 << 20):
    """(row numbers, features, offsets) of so many bytes of texts at a time."""
    start = 0
    while start < len(texts):
        end, size = start + 1, len(texts[start])
        while end < len(texts) and size + len(texts[end]) <= most_bytes:
            size += len(texts[end])
            end += 1
        own = texts[start:end]
        block = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])
        columns, at = all_features(*block) if useful is None else presence(*block, useful)
        yield np.arange(start, end), columns, at
        start = end


def _balanced(y: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Weights that give the classes these shares."""
    n1 = int(y.sum())
    return np.where(y == 1, prior / max(1, n1), (1 - prior) / max(1, len(y) - n1))


def train(texts: list[bytes], y: np.ndarray, weight: np.ndarray | None = None, *, l2: float = L2, features: int = FEATURES) -> tuple[np.ndarray, float, float, float]:
    """Weight of each feature, intercept, calibration a, b. Every fifth row is held back for the calibration. Sampling weights are not used, as both fits balance the classes."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.0) / (len(y) + 2) if not len(y) or y.max() == 0 else (y.sum() + 1) / (len(y) + 2)
        p = min(max(p, 1e-6), 1 - 1e-6)
        return np.zeros(N, np.float32), float(np.log(p / (1 - p))), 1.0, 0.0
    held = np.arange(len(y)) % 5 == 4
    sums = np.full((2, N), SMOOTH)
    for rows, columns, at in _chunks(texts):
        own = np.repeat(~held[rows], np.diff(at))
        kind = np.repeat(y[rows], np.diff(at))
        for k in (0, 1):
            sums[k] += np.bincount(columns[own & (kind == k)], minlength=N)
    clean, toxic = sums
    n1, n0 = (y[~held] == 1).sum() + 2 * SMOOTH, (y[~held] == 0).sum() + 2 * SMOOTH
    ratio = np.log((toxic / n1) / (clean / n0))
    seen = toxic + clean - 2 * SMOOTH >= 3
    strength = np.where(seen, np.abs(ratio) * np.sqrt(toxic + clean), 0)
    top = np.argsort(-strength, kind="stable")[:features]
    new = np.full(N, -1)
    new[top] = np.arange(len(top))
    # a second pass over the sample keeps the chosen features alone
    parts = [(rows, new[columns].astype(np.int32), np.diff(at)) for rows, columns, at in _chunks(texts, new >= 0)]
    columns, count = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    row = np.repeat(np.arange(len(y)), count)

    def rows(mask):
        use = mask[row]
        own = columns[use]
        return Rows(own, ratio[top][own].astype(np.float32), np.concatenate(([0], np.cumsum(count[mask]))))

    w, b = fit_logistic(rows(~held), y[~held], len(top), l2, weight=_balanced(y[~held]))
    a, c = fit_platt(rows(held).dot(w) + b, y[held], _balanced(y[held]))
    out = np.zeros(N, np.float32)
    out[top] = w * ratio[top]
    return out, float(b), float(a), float(c)


def margins(buf: np.ndarray, offs: np.ndarray, w: np.ndarray, b: float, useful: np.ndarray) -> np.ndarray:
    columns, at = presence(buf, offs, useful)
    return b + K.row_sums(w[columns].astype(float), at)


def fold_expr(modulus: int) -> Column:
    """crc32 of doc_id as text, by modulus."""
    return F.expr(f"crc32(cast(cast(doc_id as string) as binary)) % {modulus}")


def fold_of(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_toxicity(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, held: int = 2, sample: int = SAMPLE, l2: float = L2, features: int = FEATURES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Held-out rows are never learned from."""
    w, b, a, c = train(*labelled_sample(docs, labels, "toxic", sample, fold_expr(modulus) != held), l2=l2, features=features)
    model = docs.sparkSession.sparkContext.broadcast((w, np.abs(w) > 0, b, a, c))

    def score(batches):
        w, useful, b, a, c = model.value
        for batch in batches:
            for part in blocks(batch, "text"):
                p = sigmoid(a * margins(*K.texts(part.column(1)), w, b, useful) + c)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], schema=SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", F.coalesce(fold_expr(modulus) == held, F.lit(False)))
    return rows.select("doc_id", "text", "held_out").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
