"""Language identification by a bidirectional gated recurrent network over bytes.

Texts in lower case are cut into windows of WINDOW bytes; a network of HIDDEN gated recurrent units reads each from both
ends and gives every byte a probability for every language, and a document has the mean of its bytes' as its own. It is
trained in numpy, by backpropagation through the whole window and Adam's steps, to label every byte.

Fitting takes at most DOCUMENTS labelled texts, as many of each language, chosen by a hash of the text, and of all the
windows of those at most WINDOWS, as many of each language, chosen by a hash as well. It is one task's work; the driver
sees the weights, about 60 kB. Labelling covers every byte of every text, windows being labelled side by side.

Defined results: `und` with score 0 where the text is null or has no letter, and everywhere if there is nothing to learn
from; with a single language that one, with score 1. Rows with null ids are not held out and not learned from; equal
labelled texts count once in a language; rows that share an id are each predicted by their text; of equally likely
languages the first in order; very long texts are used whole; an empty table gives an empty result; other columns may
have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small

DOCUMENTS = 8_000  # labelled texts that fitting takes at most
WINDOWS = 32_000  # windows of those
WINDOW = 64
HIDDEN = 8
BATCH = 256  # windows a training step takes
EPOCHS = 2
RATE = 0.01
TOGETHER = 2048  # windows that are labelled side by side
SEED = 20_033
PAD = 32  # what fills a window up; it is not labelled
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def octets_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def windows_of(octets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows, width) bytes, the last filled up, and how many of each are the text's."""
    n = -(-len(octets) // width)
    filled = np.full(n * width, PAD, np.uint8)
    filled[: len(octets)] = octets
    sizes = np.full(n, width, np.int64)
    if n:
        sizes[-1] = len(octets) - (n - 1) * width
    return filled.reshape(n, width), sizes


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the languages, the second of three axes."""
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def squash(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place; room is for as many numbers."""
    np.abs(x, out=room)
    room += 1
    x /= room


def slope(s: np.ndarray) -> np.ndarray:
    """The derivative of squash where it gives s."""
    return np.square(1 - np.abs(s))


class Direction:
    """One direction of the network. For a byte's column w of the table and the state h, with u = U h + b:
    the gates update z and reset r are (1 + squash(w + u)) / 2, the candidate c is squash(w + r u), and c + z (h - c) is
    the next state. squash has the shape of a hyperbolic tangent at a quarter of its price. Rows of table, U and b are
    z's, r's and c's. Windows are side by side in the last axis, which keeps numpy's loops long.
    """

    def __init__(self, weights: dict[str, np.ndarray], name: str):
        self.table, self.u, self.b = (weights[f"{name}_{k}"] for k in ("table", "u", "b"))
        self.hidden = self.u.shape[1]

    def states(self, inputs: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """inputs (steps, windows); states (steps, hidden, windows), and what going back needs of each step."""
        d, n = self.hidden, inputs.shape[1]
        h, kept = np.zeros((d, n), np.float32), []
        out = np.empty((len(inputs), d, n), np.float32)
        table = self.table.copy()
        table[: 2 * d] += self.b[: 2 * d, None]
        bias = self.b[2 * d :, None]
        w, u, room = (np.empty((3 * d, n), np.float32) for _ in range(3))
        for t, byte in enumerate(inputs):
            np.take(table, byte, axis=1, out=w, mode="clip")
            np.matmul(self.u, h, out=u)
            gates = np.add(w[: 2 * d], u[: 2 * d], out=None if keep else w[: 2 * d])
            squash(gates, room[: 2 * d])
            gates += 1
            gates *= 0.5
            z, r, uc = gates[:d], gates[d:], np.add(u[2 * d :], bias, out=None if keep else u[2 * d :])
            c = np.multiply(r, uc, out=None if keep else r)
            c += w[2 * d :]
            squash(c, room[:d])
            if keep:
                kept.append((h, z, r, c, uc))
            h = np.subtract(h, c, out=out[t])
            h *= z
            h += c
        return out, kept

    def back(self, inputs: np.ndarray, kept: list, d_out: np.ndarray, grads: dict[str, np.ndarray], name: str) -> None:
        """Sets in grads what the gradients of all states, d_out, say of the weights."""
        d, dh = self.hidden, np.zeros_like(d_out[0])
        dw, du = (np.empty((len(inputs), 3 * d, inputs.shape[1]), np.float32) for _ in range(2))
        for t in range(len(inputs) - 1, -1, -1):
            h, z, r, c, uc = kept[t]
            dh = dh + d_out[t]
            dc = dh * (1 - z) * slope(c)
            dw[t, :d] = dh * (h - c) * 0.5 * slope(2 * z - 1)
            dw[t, d : 2 * d] = dc * uc * 0.5 * slope(2 * r - 1)
            dw[t, 2 * d :] = dc
            du[t] = dw[t]
            du[t, 2 * d :] *= r
            dh = dh * z + self.u.T @ du[t]
        before = np.stack([k[0] for k in kept])
        grads[f"{name}_u"] = np.matmul(du, before.transpose(0, 2, 1)).sum(0)
        grads[f"{name}_b"] = du.sum((0, 2))
        flat = inputs.ravel()
        grads[f"{name}_table"] = np.stack([np.bincount(flat, dw[:, k].ravel(), 256) for k in range(3 * d)]).astype(np.float32)


@dataclass
class Network:
    """weights: a table, U and b for each direction (f, b), and out and bias from both states to the languages."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def random(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for name in "fb":
            w[f"{name}_table"] = rng.normal(0, 0.3, (3 * hidden, 256))
            w[f"{name}_u"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
            w[f"{name}_b"] = np.zeros(3 * hidden)
        w["out"], w["bias"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (len(languages), 2 * hidden)), np.zeros(len(languages))
        return Network(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """(steps, languages, windows) for windows (windows, steps)."""
        inputs = np.ascontiguousarray(rows.T)
        f, _ = Direction(self.weights, "f").states(inputs)
        b, _ = Direction(self.weights, "b").states(inputs[::-1])
        return self._labelled(f, b[::-1])

    def _labelled(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        d, out = f.shape[1], self.weights["out"]
        return _softmax(out[:, :d] @ f + out[:, d:] @ b + self.weights["bias"][:, None])

    def loss(self, rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes of windows, and its gradients."""
        inputs, each = np.ascontiguousarray(rows.T), np.arange(len(labels))
        forth, back = Direction(self.weights, "f"), Direction(self.weights, "b")
        f, kept_f = forth.states(inputs, keep=True)
        b, kept_b = back.states(inputs[::-1], keep=True)
        p = self._labelled(f, b[::-1])
        used = (np.arange(len(inputs))[:, None] < sizes).astype(np.float32)
        total = used.sum()
        value = float(-(np.log(np.maximum(p[:, labels, each], 1e-12)) * used).sum() / total)
        p[:, labels, each] -= 1
        p *= used[:, None] / total
        grads = {"out": np.concatenate([np.matmul(p, x.transpose(0, 2, 1)).sum(0) for x in (f, b[::-1])], 1), "bias": p.sum((0, 2))}
        d, out = forth.hidden, self.weights["out"]
        forth.back(inputs, kept_f, out[:, :d].T @ p, grads, "f")
        back.back(inputs[::-1], kept_b, (out[:, d:].T @ p)[::-1], grads, "b")
        return value, grads


def train(rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, hidden: int = HIDDEN) -> Network:
    """Adam over the windows in a shuffled order; the rate falls to nothing in the end."""
    network = Network.random(languages, hidden)
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    rng, step = np.random.default_rng(SEED + 1), 0
    steps = epochs * -(-len(rows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = order[at : at + BATCH]
            _, grads = network.loss(rows[some], sizes[some], labels[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for k, g in grads.items():
                g = g / max(1.0, norm)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                network.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def predict(network: Network, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    usable = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if network.languages else []
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not usable:
        return names, scores
    sums, lengths = np.zeros((len(usable), len(network.languages))), np.zeros(len(usable), np.int64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def label() -> None:
        rows, sizes, owner = (np.concatenate(x) for x in zip(*held))
        for at in range(0, len(rows), TOGETHER):
            part = slice(at, at + TOGETHER)
            p = network.probabilities(rows[part])
            p *= (np.arange(WINDOW)[:, None] < sizes[part])[:, None]
            np.add.at(sums, owner[part], p.sum(0, dtype=np.float64).T)
        held.clear()

    for j, k in enumerate(usable):
        octets = octets_of(texts[k])
        lengths[j] = len(octets)
        # A very long text comes in parts, so that what is held is bounded.
        for at in range(0, len(octets), WINDOW * TOGETHER):
            rows, sizes = windows_of(octets[at : at + WINDOW * TOGETHER])
            held.append((rows, sizes, np.full(len(rows), j)))
            waiting += len(rows)
            if waiting >= TOGETHER:
                label()
                waiting = 0
    if held:
        label()
    mean = sums / lengths[:, None]
    best = mean.argmax(1)
    for j, k in enumerate(usable):
        names[k] = network.languages[best[j]]
        scores[k] = min(1.0, max(0.0, float(mean[j, best[j]])))
    return names, scores


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, window, size, order) of each labelled text's windows; the order is by a hash."""
    for b in small(batches):
        for lang, text, h in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("h").to_pylist()):
            rows, sizes = windows_of(octets_of(text))
            if len(rows):
                order = np.random.default_rng([SEED, h & (2**63 - 1)]).integers(0, 2**62, len(rows))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(sizes), pa.array(order)], ["lang", "window", "size", "place"])


def _fitted(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("place", "ascending"), ("lang", "ascending"), ("window", "ascending")])
    languages = sorted(set(rows.column("lang").to_pylist()))
    number = {x: k for k, x in enumerate(languages)}
    labels = np.array([number[x] for x in rows.column("lang").to_pylist()])
    windows = np.frombuffer(b"".join(rows.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    network = train(windows, rows.column("size").to_numpy(), labels, languages)
    return pa.table({"name": list(network.weights), "shape": pa.array([list(v.shape) for v in network.weights.values()], pa.list_(pa.int32())), "data": [v.tobytes() for v in network.weights.values()]})


def fit_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = DOCUMENTS, windows: int = WINDOWS) -> Network:
    """Fit on rows that are not held out and have a language; see the bounds above."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("id is not null and lang is not null and text <> ''").where(~held_out(F.col("id"))).withColumn("h", F.xxhash64("lang", "text"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(documents).collect())
    if len(languages) < 2:
        return Network(languages, {})

    def share(rows: DataFrame, most: int, by: str) -> DataFrame:
        """As many of each language, those that come first."""
        place = F.row_number().over(Window.partitionBy("lang").orderBy(by))
        return rows.withColumn("nth", place).where(F.col("nth") <= max(1, most // len(languages))).drop("nth")

    few = share(known.groupBy("lang", "h").agg(F.count("*").alias("n")), documents, "h").select("h")
    chosen = known.join(F.broadcast(few), "h").groupBy("h").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    each = chosen.mapInArrow(_window_rows, "lang string, window binary, size long, place long")
    some = share(each, windows, "place")
    got = some.groupBy().applyInArrow(_fitted, "name string, shape array<int>, data binary").collect()
    return Network(languages, {r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in got})


def identify(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, held_out, lang_pred, score."""
    if len(network.languages) == 1:
        letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        base = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
        named = base.select("id", "held_out", F.when(letters, network.languages[0]).otherwise(UNKNOWN).alias("lang_pred"), letters.cast("double").alias("score"))
        return named.withColumnRenamed("id", id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            names, scores = predict(network, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    chosen = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)
