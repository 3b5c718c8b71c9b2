"""Secret scans: known shapes, and sliding-window Shannon entropy over candidate strings.

Base spans (kinds assign, access, hex) are the whole matches of fixed patterns. The method adds spans: every maximal run
of a character class is a candidate; a window slides over it, the entropy of its character counts is kept up to date by
two count changes a step, and the union of windows at or above the class's threshold is a span (kinds entropy_base64
and entropy_hex). Candidates on the allow list, and spans that base spans already cover, are not reported.

Defined results: null and empty texts have no spans; very long texts and candidates are scanned whole; rows are
independent, so repeated rows and repeated or null ids each give a row; an empty table gives an empty result; other
columns may have any names. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small

KINDS = ("assign", "access", "hex", "entropy_base64", "entropy_hex")

# The shapes of base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

#: Per class, the narrower first: candidate runs, window, bits a character that its windows must reach.
CLASSES = {
    "entropy_hex": (re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-F]{20,}|[0-9a-f]{20,})(?![0-9A-Fa-f])"), 20, 3.0),
    "entropy_base64": (re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"), 20, 3.7),
}
#: Candidates that look random but are not secrets: words, snake or kebab case, paths, numbers, UUIDs, placeholders.
#: No pattern can match a string in two ways, so that none takes more than linear time to fail.
ALLOWED = (
    r"[A-Za-z]+",
    r"[0-9_=+/-]+",
    r"[A-Z]?[a-z]*(?:[/_=+-][A-Z]?[a-z]*)*",
    r"[A-Z][A-Z/_=+-]*",
    r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}",
    r".*(?:EXAMPLE|example|xxxx|XXXX|placeholder|0123456789|abcdefghij|ABCDEFGHIJ).*",
)


def entropy_spans(run: str, window: int, least: float) -> list[tuple[int, int]]:
    """The maximal stretches of `run` covered by windows of at least `least` bits a character."""
    if len(run) < window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0  # of c log2 c; the entropy is log2(window) - total / window
    for ch in run[:window]:
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
    most = (math.log2(window) - least) * window + 1e-9
    spans: list[list[int]] = []
    for start in range(len(run) - window + 1):
        if start:
            c = counts[run[start - 1]]
            counts[run[start - 1]] = c - 1
            total += term[c - 1] - term[c]
            c = counts.get(run[start + window - 1], 0)
            counts[run[start + window - 1]] = c + 1
            total += term[c + 1] - term[c]
        if total <= most:
            if spans and start <= spans[-1][1]:
                spans[-1][1] = start + window
            else:
                spans.append([start, start + window])
    return [(lo, hi) for lo, hi in spans]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def all_spans(text: str, base: list[tuple[str, int, int]], allowed: re.Pattern) -> list[tuple[str, int, int]]:
    found = list(base)
    for kind, (candidates, window, least) in CLASSES.items():
        # Spans of one class never cover one another, so those found before the class decide.
        before = sorted((s, e) for _, s, e in found)
        starts, furthest = [s for s, _ in before], list(accumulate((e for _, e in before), max))
        for m in candidates.finditer(text):
            if not allowed.fullmatch(m[0]):
                for lo, hi in entropy_spans(m[0], window, least):
                    lo, hi = lo + m.start(), hi + m.start()
                    k = bisect_right(starts, lo)
                    if not k or furthest[k - 1] < hi:
                        found.append((kind, lo, hi))
    return found


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in in_order(spans))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, lo, hi in sorted(spans, key=lambda s: s[1:]):
        if lo >= at:
            out += [text[at:lo], mark]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per input row: the id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile("|".join(f"(?:{a})" for a in allow))
        for b in small(batches):
            out: list[list] = [[] for _ in range(5)]
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                kinds = [k for k, _, _ in base]
                row = [kinds.count(k) for k in KINDS[:3]] + [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(all_spans(text or "", base, allowed))]
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], *[pa.array(c, pa.string()) for c in out[3:]]], schema.names)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]", allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with every reported span replaced by `mark`, and chars_col (if there) counted anew for the rows changed."""
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile("|".join(f"(?:{a})" for a in allow))
        for b in small(batches):
            texts = b.column(at).to_pylist()
            new = [t if t is None or not (s := all_spans(t, base_spans(t), allowed)) else redacted(t, s, mark) for t in texts]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if chars is not None:
                counts = b.column(chars).to_pylist()
                columns[chars] = pa.array([c if n is t else len(n) for c, n, t in zip(counts, new, texts)], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
