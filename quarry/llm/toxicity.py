"""Toxicity scores by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. The ordinary one is what
zstandard's training picks from all pieces of ordinary documents. Most of a toxic document is ordinary text as well, on
which two dictionaries differ by chance only; so the other one is trained on the toxic documents' passages around byte
strings that are over-represented in them, and is searched together with the ordinary one. A window then compresses to
fewer bytes exactly as far as it holds what marks toxic text, and text that both know cancels out. A document's windows
are compressed with both, and the bytes saved (their maximum, the numbers of windows that save 1, 2, 3 and 4 bytes or
more, the sum) are calibrated to a probability by a logistic model. The calibration uses documents that the
dictionaries it sees were not trained on (two folds); the final dictionaries are trained on all of the sample.

Fitting reads the whole texts of at most `sample` labelled documents of each class, chosen by hash; the folds and the
final training are tasks of their own, of which the driver gets features and dictionaries, not texts. Scoring uses
every whole text.

Defined results: null and empty texts are scored as one empty window; rows with null ids are not held out and have no
labels; labels that are null or not 0 or 1 are not learned from; if a document has both labels each counts; without
both classes every score is the share of toxic labels (0 without labels); rows are independent, so repeated rows and
repeated or null ids each give a row; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small

SAMPLE = 2000  # labelled documents of each class that fitting reads at most
WINDOW, STRIDE = 64, 48  # bytes
ORDINARY_BYTES = 131_072
PIECE = 256  # bytes of an ordinary sample for training
TOXIC_BYTES = 1024
AROUND = 3  # bytes on each side of a mark that make its passage
COVER = {"k": 24, "d": 6}  # segments and the strings in them that zstandard's training counts, for passages
SEGMENTS = 300
SIZES = (12, 10, 8, 6)  # of the byte strings considered
ALIKE = 2
CANDIDATES = 1000
COST = 2.0
DECAY = 0.6
LEAST_GAIN = 0.01
LEAST_DOCS = 4  # toxic documents that a candidate is in, and their share of all
LEAST_SHARE = 0.005
LEAST_Z = 3.0
FOLDS = 2
COUNTED_AT_ONCE = 2_000_000  # byte strings whose documents are counted at a time


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def normalised(text: str | None) -> bytes:
    return (" " + " ".join((text or "").lower().split()) + " ").encode()


def windows(octets: bytes) -> list[bytes]:
    return [octets[k : k + WINDOW] for k in range(0, max(1, len(octets) - (WINDOW - STRIDE)), STRIDE)]


def _gram_hashes(octets: bytes, size: int) -> np.ndarray:
    b, h = np.frombuffer(octets, np.uint8).astype(np.uint64), np.uint64(0)
    n = len(b) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h + b[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h


def _document_frequency(texts: list[bytes], size: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted gram hashes that at least `least` texts hold, and the number of texts that hold each.

    Hashes are counted range by range, texts merged some at a time, so that memory does not grow with the texts.
    """
    parts = 1 + sum(map(len, texts)) // COUNTED_AT_ONCE
    found = []
    for part in range(parts):
        lo, hi = np.uint64((part << 64) // parts), np.uint64(((part + 1) << 64) // parts - 1)
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        held, waiting = [], 0
        for k, t in enumerate(texts, 1):
            h = _gram_hashes(t, size)
            held.append(np.unique(h[(h >= lo) & (h <= hi)] if parts > 1 else h))
            waiting += len(held[-1])
            if k == len(texts) or waiting > COUNTED_AT_ONCE // 4:
                new, n = np.unique(np.concatenate(held), return_counts=True)
                keys, at = np.unique(np.concatenate((keys, new)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, n)), len(keys)).astype(np.int64)
                held, waiting = [], 0
        found.append((keys[counts >= least], counts[counts >= least]))
    return np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])


def _frequency_of(keys: np.ndarray, texts: list[bytes], size: int) -> np.ndarray:
    """How many texts hold each of the sorted keys."""
    counts = np.zeros(len(keys), np.int64)
    if len(keys):
        for t in texts:
            h = _gram_hashes(t, size)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            counts[np.unique(at[keys[at] == h])] += 1
    return counts


def distinctive(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Byte strings over-represented in toxic documents, best first.

    Candidates are strings whose z-score is over LEAST_Z. They are chosen one by one for the share of toxic
    documents that they mark, less COST times the share of ordinary ones, where a toxic document counts DECAY times as
    much for every chosen string that it holds already; so rarer marks come in before more variants of frequent ones.
    Any five bytes are in at most ALIKE of the chosen.
    """
    names: list[bytes] = []
    ordinary_share: list[float] = []
    held: list[np.ndarray] = []
    for size in SIZES:
        grams, a = _document_frequency(toxic, size, max(LEAST_DOCS, LEAST_SHARE * len(toxic)))
        b = _frequency_of(grams, ordinary, size)
        z = np.log((a + 0.5) / (len(toxic) + 1) / ((b + 0.5) / (len(ordinary) + 1))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        gain = np.where(z > LEAST_Z, a / len(toxic) - COST * b / max(1, len(ordinary)), 0.0)
        best = np.argsort(-gain, kind="stable")[:CANDIDATES]
        best = np.sort(best[gain[best] > 0])
        keys, found = grams[best], {}
        rows = np.zeros((len(keys), len(toxic)), bool)
        for d, t in enumerate(toxic):
            h = _gram_hashes(t, size)
            k = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            hit = np.flatnonzero(keys[k] == h) if len(keys) else []
            rows[k[hit], d] = True
            for x in hit:
                found.setdefault(int(k[x]), t[x : x + size])
        names += [found[k] for k in range(len(keys))]
        ordinary_share += (b[best] / max(1, len(ordinary))).tolist()
        held.append(rows)
    chosen: list[bytes] = []
    if not names:
        return chosen
    holds, cost = np.concatenate(held).astype(np.float32), COST * np.array(ordinary_share)
    weight, alike, open_ = np.full(len(toxic), 1 / len(toxic), np.float32), Counter(), np.ones(len(names), bool)
    parts = [{n[k : k + 5] for k in range(len(n) - 4)} for n in names]
    while len(chosen) < SEGMENTS:
        gain = np.where(open_, holds @ weight - cost, -1.0)
        k = int(gain.argmax())
        if gain[k] <= LEAST_GAIN:
            break
        open_[k] = False
        if any(alike[p] >= ALIKE for p in parts[k]):
            continue
        chosen.append(names[k])
        alike.update(parts[k])
        weight *= np.where(holds[k] > 0, DECAY, 1.0).astype(np.float32)
    return chosen


def _trained(size: int, samples: list[bytes], **cover: int) -> bytes:
    """What zstandard's training makes of the samples; samples too few to train on are the dictionary themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, **cover).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


def passages(toxic: list[bytes], marks: list[bytes]) -> list[bytes]:
    """The toxic texts' bytes in and around marks, longer marks first."""
    if not marks:
        return []
    found = re.compile(b"|".join(map(re.escape, sorted(marks, key=lambda m: (-len(m), m)))))
    return [t[max(0, m.start() - AROUND) : m.end() + AROUND] for t in toxic for m in found.finditer(t)]


def train(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The contents of the ordinary dictionary, and of the toxic one behind it (the last bytes are searched first)."""
    base = _trained(ORDINARY_BYTES, [t[k : k + PIECE] for t in ordinary for k in range(0, len(t), PIECE)])
    return base, base + _trained(TOXIC_BYTES, passages(toxic, distinctive(toxic, ordinary)), **COVER)


class Compressor:
    """Compressed lengths of windows with one dictionary."""

    def __init__(self, content: bytes):
        import zstandard

        parameters = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, min_match=5, window_log=18, hash_log=18, chain_log=18, search_log=6, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        dictionary = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        self.compress = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress

    def lengths(self, some: list[bytes]) -> np.ndarray:
        compress = self.compress
        return np.fromiter((len(compress(w)) for w in some), np.int64, len(some))


def features(octets: bytes, ordinary: Compressor, toxic: Compressor) -> list[float]:
    some = windows(octets)
    saved = ordinary.lengths(some) - toxic.lengths(some)
    at_least = [float((saved >= k).sum()) for k in (1, 2, 3, 4)]
    return [float(saved.max()), *at_least, float(saved.clip(0).sum()), float(len(some))]


def _design(x: np.ndarray) -> np.ndarray:
    n = x[:, -1:]
    return np.hstack([np.ones((len(x), 1)), x[:, :1], np.log1p(x[:, 1:6]), x[:, 1:6] / n, np.log(n)])


@dataclass
class Model:
    """What scoring needs; about 300 kB whatever the corpus."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((_design(x) - self.mean) / self.scale @ self.weights, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, ...]:
    a = _design(x)
    mean, scale = a.mean(0), a.std(0) + 1e-9
    mean[0], scale[0] = 0, 1
    a = (a - mean) / scale
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), a.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def fit_part(part: int, sets: tuple[list[bytes], list[bytes]]) -> tuple[tuple[bytes, bytes] | None, list[list[float]], list[int]]:
    """One of FOLDS + 1 parts of fitting on ordinary and toxic texts: a fold's features and labels by dictionaries of
    the other texts, or, as the last part, the dictionaries of all."""
    if part == FOLDS:
        return train(sets[1], sets[0]), [], []
    pair = [Compressor(c) for c in train(*([t for j, t in enumerate(s) if j % FOLDS != part] for s in (sets[1], sets[0])))]
    mine = [(features(t, *pair), label) for label, s in enumerate(sets) for t in s[part::FOLDS]]
    return None, [x for x, _ in mine], [y for _, y in mine]


def calibrated(dictionaries: tuple[bytes, bytes], x: list[list[float]], y: list[int], toxic_share: float) -> Model:
    """toxic_share: of all labels; the classes' samples are weighted by it."""
    yy = np.array(y, float)
    weight = np.where(yy == 1, toxic_share / (yy == 1).sum(), (1 - toxic_share) / (yy == 0).sum()) * len(yy)
    return Model(*dictionaries, *_logistic(np.array(x), yy, weight))


def constant(toxic_share: float) -> Model:
    nothing = np.zeros(1)
    return Model(b"", b"", nothing, nothing, nothing, toxic_share)


def fit(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model:
    """Fit in this process."""
    if not toxic or not ordinary:
        return constant(toxic_share)
    sets = [normalised(t) for t in ordinary], [normalised(t) for t in toxic]
    parts = [fit_part(k, sets) for k in range(FOLDS + 1)]
    return calibrated(parts[-1][0], [x for p in parts for x in p[1]], [y for p in parts for y in p[2]], toxic_share)


def fit_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labels of rows that are not held out, on the whole texts of at most `sample` documents of each class.

    Every part of fitting is a task; the driver collects a row of features for each document of the sample.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id is not null").distinct()
    shares = {r["__label"]: r["n"] for r in usable.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    if len(shares) < 2:
        return constant(share)
    chosen = [usable.where(F.col("__label") == k).orderBy(F.xxhash64("__id"), "__id").limit(sample) for k in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows
    found = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(few, "__id")
    # Ids that repeat give more rows than labels; the sample's bound holds for rows too.
    place = F.row_number().over(Window.partitionBy("__label").orderBy(F.xxhash64("__id"), "__id", F.xxhash64("__text"), "__text"))
    rows = found.withColumn("__at", place).where(F.col("__at") <= sample)
    parts = rows.select(F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("__part"), "__label", "__at", "__text").repartitionByRange(FOLDS + 1, "__part")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        table = table.sort_by([("__label", "ascending"), ("__at", "ascending")])
        texts = [normalised(t) for t in table.column("__text").to_pylist()]
        ordinary = int((table.column("__label").to_numpy() == 0).sum())
        made, x, y = fit_part(part, (texts[:ordinary], texts[ordinary:])) if 0 < ordinary < len(texts) else (None, [], [])
        out = {"part": [part] * len(x), "label": y, "x": x, "ordinary": [None] * len(x), "toxic": [None] * len(x)}
        if made:
            out = {"part": [part], "label": [None], "x": [None], "ordinary": [made[0]], "toxic": [made[1]]}
        return pa.table({n: pa.array(out[n], t) for n, t in (("part", pa.int32()), ("label", pa.int32()), ("x", pa.list_(pa.float64())), ("ordinary", pa.binary()), ("toxic", pa.binary()))})

    got = parts.groupBy("__part").applyInArrow(run, "part int, label int, x array<double>, ordinary binary, toxic binary").collect()
    made = [(bytes(r["ordinary"]), bytes(r["toxic"])) for r in got if r["part"] == FOLDS]
    mine = sorted((r["part"], r["label"], r["x"]) for r in got if r["part"] < FOLDS)
    if not made or len({y for _, y, _ in mine}) < 2:
        return constant(share)  # labels of documents that are not there
    return calibrated(made[0], [x for *_, x in mine], [y for _, y, _ in mine], share)


def _scorer(model: Model):
    pair: list[Compressor] = []

    def scores(texts: list[str | None]) -> np.ndarray:
        if model.constant is not None:
            return np.full(len(texts), model.constant)
        if not pair:
            pair.extend((Compressor(model.ordinary), Compressor(model.toxic)))
        return model.scores(np.array([features(normalised(t), *pair) for t in texts])) if texts else np.empty(0)

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for b in small(batches):
            p = scores(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], schema.names)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    chosen = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, in one pass."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for b in small(batches):
            yield b.filter(pa.array(scores(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
