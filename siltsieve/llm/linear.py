"""What the trained scorers share: bounded labelled samples and L2-regularised logistic regression on sparse rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bytes of texts in a training sample.
SAMPLE_BYTES = 32 << 20


def below_share(share: float, *key) -> Column:
    """Whether a row's hash falls into this share of all hashes; every row is judged on its own, so a sample needs no sort."""
    return F.shiftrightunsigned(F.xxhash64(*key), 1) < min(int(share * 2.0**63), 2**63 - 1) if share < 1 else F.lit(True)


def with_slack(most: int) -> float:
    """A sample of this expected size has `most` rows at least, but for six standard deviations."""
    return most + 6 * most**0.5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, where=None, seed: int = 7, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Whole texts, labels and weights of at most `most` labelled documents and `most_bytes` bytes, the same ones at every run.

    Of each class come the labels with the smallest hashes of their identifiers, up to half of `most`; a text that would
    exceed the bytes is left out. A weight is the number of labels of the class by those picked, so that weighted sums stand
    for all labels whatever the bounds. Rows without a label, identifier or text are no examples; an identifier that repeats
    counts once. The driver gets about `most` identifiers and then their texts, however many partitions there are.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if where is not None:
        known = known.where(where)
    known = cut(known.groupBy("doc_id").agg(F.max("y").alias("y")))
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    half = most // 2
    chosen = F.lit(False)
    for y, n in total.items():
        chosen = chosen | ((F.col("y") == y) & below_share(with_slack(half) / n, "doc_id", F.lit(seed)))
    picked = known.where(chosen).select("doc_id", "y", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1).alias("h")).collect()
    picked.sort(key=lambda r: (r.h, r.doc_id))
    picked = [r for y in (0, 1) for r in [r for r in picked if r.y == y][:half]]
    if not picked:
        return [], np.empty(0, np.int64), np.empty(0)
    place = {r.doc_id: (r.h, r.doc_id) for r in picked}
    ids = spark.createDataFrame([(r.doc_id, r.y) for r in picked], "doc_id long, y int")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = cut(own.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")))  # ids: at most `most` rows
    sizes = rows.select("doc_id", F.octet_length("text").alias("n")).collect()
    left, fits = most_bytes, []
    for r in sorted(sizes, key=lambda r: place[r.doc_id]):
        if r.n <= left:
            left -= r.n
            fits.append((r.doc_id,))
    if not fits:
        return [], np.empty(0, np.int64), np.empty(0)
    got = rows.join(F.broadcast(spark.createDataFrame(fits, "doc_id long")), "doc_id").collect()
    got.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in got], np.int64)
    share = {k: total[k] / max(1, int((y == k).sum())) for k in total}
    return [r.text.encode() for r in got], y, np.array([share[k] for k in y.tolist()])


class Rows:
    """Sparse rows: column indices, values, and offsets of rows."""

    def __init__(self, columns: np.ndarray, values: np.ndarray, at: np.ndarray):
        self.columns, self.values, self.at = columns, values, at
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.columns], len(self.at) - 1)

    def dot_t(self, r: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.columns, self.values * r[self.row], n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Rows, y: np.ndarray, n_features: int, l2: float, rounds: int = 150, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent with a restart when the loss rises, until it falls no more; deterministic."""
    n = len(y)
    s = np.ones(n) if weight is None else weight
    s = s / s.sum()
    norms = np.bincount(x.row, x.values**2, n)
    step = 1 / (0.25 * float((s * (norms + 1)).sum()) + l2)
    w, b = np.zeros(n_features), 0.0
    vw, vb, t, last, still = w.copy(), b, 1.0, np.inf, 0
    for _ in range(rounds):
        z = x.dot(vw) + vb
        g = s * (sigmoid(z) - y)
        nw, nb = vw - step * (x.dot_t(g, n_features) + l2 * vw), vb - step * g.sum()
        z = x.dot(nw) + nb
        loss = float((s * np.logaddexp(0, np.where(y == 1, -z, z))).sum() + l2 / 2 * (nw @ nw))
        if loss > last + 1e-12:
            step, t, vw, vb = step / 2, 1.0, w.copy(), b
            continue
        still = still + 1 if last - loss < 1e-4 * loss else 0
        step *= 1.15
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t, last = nw, nb, t2, loss
        if still == 3:
            break
    return w, b


def fit_platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """a, b of sigmoid(a z + b) by Newton steps, with smoothed targets."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    n1 = int(y.sum())
    n0 = len(y) - n1
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    s = np.ones(len(y)) if weight is None else weight * len(y) / weight.sum()
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        g = s * (p - t)
        h = s * p * (1 - p)
        ga, gb = g @ z + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = h @ (z * z) + 1e-3, h @ z, h.sum() + 1e-6
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(abs(da), abs(db), 1.0)
        a, b = a - da / size, b - db / size
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, b
