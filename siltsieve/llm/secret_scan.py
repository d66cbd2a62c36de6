"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of token characters. Over each a window of fixed length slides; the counts of its characters change by
one in and one out, and the window's entropy follows from a running sum of count * log2(count), so a step costs the same
however long the window is. Windows are judged per character class (hex, base 64), overlapping ones merge into one span, and
an allow-list suppresses identifiers that only look random. A window counts only with at least 2 digits and 2 letters, and
all-letter and all-digit candidates are skipped whatever their entropy, so that long names are no secrets.

Spans are offsets in code points, the end exclusive; an `assign` span is the whole match, key and value. Defined results: a
null or empty text has no spans and the digest of an empty string; repeated rows give repeated rows; whole texts are scanned
whatever their length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]{24,}", re.A)  # the runs of [0-9a-f]+ of 24 and more characters
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}", re.A)
#: Looks random but is no secret: UUIDs, version-control and content digests announced as such, data URIs' start, paths, and names of words joined by - or _.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:sha(?:1|256|512)|md5)-[A-Za-z0-9+/=]+|(?:[A-Za-z]+[-_/])+[A-Za-z]+|[0-9_/=+-]+")
WINDOW = 20
#: Bits a character from which a window of 20 counts as random, by class.
LEAST_HEX, LEAST_MIXED = 3.1, 3.7
#: One entry more than a window has characters: the next one comes in before the first goes out.
_XLOGX = [0.0] + [k * math.log2(k) for k in range(1, WINDOW + 2)]
_HEXDIGITS = frozenset("0123456789abcdefABCDEF")


def window_entropies(s: str, width: int = WINDOW) -> list[float]:
    """Shannon entropy in bits of every window of s, by incremental counts."""
    counts: dict[str, int] = {}
    total, out, log_width = 0.0, [], math.log2(width)
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += _XLOGX[k + 1] - _XLOGX[k]
        if i >= width:
            old = s[i - width]
            k = counts[old]
            counts[old] = k - 1
            total += _XLOGX[k - 1] - _XLOGX[k]
        if i >= width - 1:
            out.append(log_width - total / width)
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Merged spans of the random windows of the text's candidates."""
    spans: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if s.isalpha() or s.isdigit() or ALLOWED.fullmatch(s):
            continue
        digits = [0]
        letters = [0]
        other = [0]  # what is no hex digit
        for c in s:
            digits.append(digits[-1] + c.isdigit())
            letters.append(letters[-1] + c.isalpha())
            other.append(other[-1] + (c not in _HEXDIGITS))
        for i, h in enumerate(window_entropies(s)):
            j = i + WINDOW
            n_digits, n_letters = digits[j] - digits[i], letters[j] - letters[i]
            if n_digits >= 2 and n_letters >= 2 and h >= (LEAST_MIXED if other[j] - other[i] else LEAST_HEX):
                a, b = m.start() + i, m.start() + j
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(found)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_entropy", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(batches):
    for batch in batches:
        rows = []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = value.as_py() or ""
            base = base_spans(text)
            more = [(a, 3, b) for a, b in entropy_spans(text)]
            kinds = [k for _, k, _ in base]
            rows.append((key, kinds.count(0), kinds.count(1), kinds.count(2), len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, counts of the kinds, digest of the base spans, all spans. One pass, no shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
SQL: dict[str, str] = {}
