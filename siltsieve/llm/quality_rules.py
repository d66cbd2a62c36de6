"""Quality rules: countable base rules and a hashed n-gram logistic regression.

Features are relative frequencies of hashed character n-grams (of bytes) and word n-grams. The regression is trained on a
bounded sample of labelled rows (`sample` rows and linear.SAMPLE_BYTES, the only bounds), its scores are turned into probabilities on held-back rows of that
sample (Platt), both weighted by the classes' shares of all labels, and every whole text is scored in Arrow batches against a fixed threshold. A document is kept if no base rule
fails and its probability of good quality reaches the threshold.

Defined results: a null or empty text has no words and fails the base rules; with labels of one class or none the method
keeps whatever passes the base rules (probability 1 or the class's); repeated rows give repeated rows; an empty table gives
no rows; other columns are neither read nor features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import blocks, table
from .linear import Rows, fit_logistic, fit_platt, labelled_sample, sigmoid

BITS = 16
CHAR_NGRAMS, WORD_NGRAMS = (1, 2, 3), (1, 2)
#: Relative frequencies are multiplied by this, so that common n-grams are near 1.
SCALE = 20.0
SAMPLE, L2, THRESHOLD = 4000, 1e-5, 0.3
# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_IS_WORD_START = ((np.arange(256) & 0xC0 != 0x80) & ~K.IS_SPACE).astype(np.int64)  # bytes that begin a code point of a word
N_FEATURES = (len(CHAR_NGRAMS) + len(WORD_NGRAMS)) << BITS


def families(buf: np.ndarray, offs: np.ndarray, words: np.ndarray, at: np.ndarray):
    """(feature of each n-gram or -1, row offsets, first row) of each family of n-grams; of long rows a piece at a time."""
    for k, n in enumerate(CHAR_NGRAMS):
        for part, part_offs, first in K.pieces(buf, offs, n - 1):
            code = K.ngram_codes(part, part_offs, n, BITS)
            yield k, np.where(code >= 0, code + (k << BITS), -1), part_offs, first
    for k, n in enumerate(WORD_NGRAMS, len(CHAR_NGRAMS)):
        h, h_at = K.shingle_hashes(words, at, n, short=False)
        yield k, (h >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS), h_at, 0


def matrix(texts: list[bytes]) -> Rows:
    """The sparse feature rows of whole texts."""
    columns, values, at = [], [], [0]
    for text in texts:
        buf, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        words, _, words_at = K.words_of(buf, offs)
        found: dict[int, list] = {}
        for k, code, _, _ in families(buf, offs, words, words_at):
            found.setdefault(k, []).append(np.unique(code[code >= 0], return_counts=True))
        n = 0
        for own in found.values():
            f, c = own[0]
            if len(own) > 1:  # a long text came in pieces
                f, where = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
                c = np.bincount(where, np.concatenate([x for _, x in own]))
            if len(f):
                columns.append(f.astype(np.int32))
                values.append((SCALE / c.sum() * c).astype(np.float32))
                n += len(f)
        at.append(at[-1] + n)
    cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return Rows(cat(columns, np.int32), cat(values, np.float32), np.array(at))


def train(texts: list[bytes], y: np.ndarray, weight: np.ndarray | None = None, l2: float = L2) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias and the calibration a, b. Every fifth row of the sample is held back for the calibration.

    `weight` is each row's share of all labels, so that probabilities are those of the labelled rows, not of the sample.
    """
    weight = np.ones(len(y)) if weight is None else weight
    if not len(y) or y.min() == y.max():
        p = 1.0 if not len(y) else (1 + y.sum()) / (2 + len(y))
        return np.zeros(N_FEATURES, np.float32), float(np.log(p / (1 - p))) if p < 1 else 40.0, 1.0, 0.0
    held = np.arange(len(y)) % 5 == 4
    fit = [t for t, h in zip(texts, held, strict=True) if not h]
    w, b = fit_logistic(matrix(fit), y[~held], N_FEATURES, l2, weight=weight[~held])
    a, c = fit_platt(matrix([t for t, h in zip(texts, held, strict=True) if h]).dot(w) + b, y[held], weight[held])
    return w.astype(np.float32), float(b), float(a), float(c)


def margins(buf: np.ndarray, offs: np.ndarray, words: np.ndarray, at: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    n_rows = len(offs) - 1
    total, count = (np.zeros((len(CHAR_NGRAMS) + len(WORD_NGRAMS), n_rows)) for _ in range(2))
    for k, code, code_at, first in families(buf, offs, words, at):
        own = slice(first, first + len(code_at) - 1)
        total[k, own] += K.row_sums(np.where(code >= 0, w[code], 0.0), code_at)
        count[k, own] += K.row_sums(code >= 0, code_at)
    return b + SCALE * (total / np.maximum(count, 1)).sum(0)


def repeat_words(words: np.ndarray, at: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """For each row the words that lie in a window of `width` words found twice or more in the row."""
    n = len(at) - 1
    h, h_at = K.shingle_hashes(words, at, width, short=False)
    if not len(h):
        return np.zeros(n, np.int64)
    row = np.repeat(np.arange(n), np.diff(h_at))
    # twice in the row: the window's number together with the row's
    window = pd.factorize(h)[0].astype(np.int64) * n + row
    code = pd.factorize(window)[0]
    twice = np.bincount(code)[code] > 1
    change = np.zeros(len(words) + 1, np.int64)
    first = at[row] + np.arange(len(h)) - h_at[row]
    np.add.at(change, first[twice], 1)
    np.add.at(change, first[twice] + width, -1)
    return K.row_sums(np.cumsum(change[:-1]) > 0, at)


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"
ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]]) for c in SCHEMA.split(", ")])


def _scored(part: pa.RecordBatch, text: int, model, threshold: float) -> tuple:
    """The columns of SCHEMA after doc_id, for one block."""
    w, b, a, c = model
    buf, offs = K.texts(part.column(text))
    words, _, at = K.words_of(buf, offs)
    n = np.diff(at)
    inside = K.byte_sums(_IS_WORD_START, buf, offs)
    repeats = repeat_words(words, at)
    raw = buf.tobytes()
    lines = [dup_lines(raw[i:j]) for i, j in zip(offs[:-1], offs[1:], strict=True)]
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    p = sigmoid(a * margins(buf, offs, words, at, w, b) + c)
    return n, inside, K.byte_sums(_IS_SYMBOL, buf, offs), lines, repeats, failed, ~failed & (p >= threshold), p


def _model(docs: DataFrame, labels: DataFrame, sample: int, l2: float):
    return docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, "quality", sample), l2=l2))


def score_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, l2: float = L2, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, kept, p_good. One pass over the texts besides the sample's."""
    model = _model(docs, labels, sample, l2)

    def score(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                columns = [part.column(0), *_scored(part, 1, model.value, threshold)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(columns, ARROW, strict=True)], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, l2: float = L2, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns; no shuffle of texts."""
    model = _model(docs, labels, sample, l2)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            names = [f"c{k}" for k in range(batch.num_columns)]
            for part in blocks(pa.RecordBatch.from_arrays(batch.columns, names=names), names[at]):
                yield part.filter(pa.array(_scored(part, at, model.value, threshold)[6]))

    inner = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return inner.mapInArrow(keep, inner.schema).toDF(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL: dict[str, str] = {}
