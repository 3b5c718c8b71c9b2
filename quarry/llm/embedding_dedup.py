"""Embedding near-deduplication by cross-polytope hashing.

A vector is turned by fast Hadamard rotations with random signs; the axis that it then lies closest to, with its sign,
is a hash of 2 d values. `hashes` of them make a bucket of a table; each vector enters its own bucket and those in which
one hash takes its second-closest axis (multiprobe). Vectors of one label that share a bucket are candidates, and their
cosine in double precision decides. The number of hashes grows with the number of vectors, so that buckets stay small;
the tables make up for it.

Equal vectors are collapsed first. Buckets are compared in cells of chunk against chunk, each by one matrix product; a
cell counts the links that no earlier table or bucket has (so none is counted twice) and returns a count and a spanning
forest, one row per vector, however dense its links are. The vectors of a bucket with more than SPLIT of them are hashed
again by rotations of their own, as many as that bucket asks for, so that what a vector sends does not grow with it.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and those whose label is
null, link with nothing (n_links 0, component_id their own id); vectors of different lengths do not link; rows that
share an id each count as a vector; null ids come after all others; an empty table gives an empty result; other columns
may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, connected_components, durable

TABLES = {1: 4, 2: 4, 3: 4, 4: 6, 5: 8, 6: 12}  # by hashes; each keeps recall at cosine 0.98 above 0.99
CHUNK = 256  # vectors of a bucket that a cell compares with as many
SPLIT = 16_384  # a bucket of more vectors is hashed again
SEED, SPLIT_SEED = 20_011, 20_021


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (a power of two wide), without scaling."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def cross_polytope(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest and the second-closest signed axis of each row, after one rotation per row of signs."""
    for s in signs:
        x = hadamard(x * s)
    two = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
    size = np.abs(np.take_along_axis(x, two, 1))
    swap = (size[:, 0] < size[:, 1]) | ((size[:, 0] == size[:, 1]) & (two[:, 0] > two[:, 1]))
    two[swap] = two[swap][:, ::-1]
    axes = two * 2 + (np.take_along_axis(x, two, 1) < 0)
    return axes[:, 0], axes[:, 1]


def bucket_codes(x: np.ndarray, hashes: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables, 1 + hashes) bucket numbers: a table's own bucket first, then its probes."""
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, width]).choice([-1.0, 1.0], (tables, hashes, 3, width))
    out = np.empty((len(x), tables, 1 + hashes), np.int64)
    for t in range(tables):
        near, next_ = zip(*(cross_polytope(padded, signs[t, j]) for j in range(hashes)))
        base = 2 * width
        own = sum(near[j] * base**j for j in range(hashes))
        out[:, t, 0] = own
        for j in range(hashes):
            out[:, t, 1 + j] = own + (next_[j] - near[j]) * base**j
    return out


def hashes_for(count: int, width: int) -> int:
    """The fewest hashes whose buckets outnumber the entries of `count` vectors; six at most."""
    k = 1
    while k < 6 and (2 * max(2, width)) ** k < count * (k + 1):
        k += 1
    return k


def unit(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = np.array(vectors.to_pylist(), np.float64)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _entries(hashes: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = np.array([len(v) for v in b.column("vec").to_pylist()], np.int64)
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                codes = bucket_codes(unit(b.column("vec").take(pa.array(rows))), hashes, tables)
                each = tables * (1 + hashes)
                keys = b.column("key").take(pa.array(np.repeat(rows, each)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + hashes), len(rows))), pa.array(codes.reshape(-1))], ["key", "t", "code"])

    return run


def _again(hashes: int, tables: int):
    """Rows (node, u, sub) of the second hashing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = np.array([len(v) for v in b.column("vec").to_pylist()], np.int64)
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                codes = bucket_codes(unit(b.column("vec").take(pa.array(rows))), hashes, tables, SPLIT_SEED)
                nodes = b.column("node").take(pa.array(np.repeat(rows, tables * (1 + hashes))))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + hashes), len(rows))), pa.array(codes.reshape(-1))], ["node", "u", "sub"])

    return run


def first_shared(left: np.ndarray, right: np.ndarray, t: int, code: int) -> np.ndarray:
    """Of pairs by their codes (pair, table, probe): whether bucket `code` of table t is the first that both are in."""
    todo = np.ones(len(left), bool)
    for p in range(left.shape[2]):
        for u in range(t):
            todo &= ~(left[:, u, p, None] == right[:, u]).any(1)
        todo &= ~((left[:, t, p] < code) & (left[:, t, p, None] == right[:, t]).any(1))
    return todo


def _cell(threshold: float, hashes: int, tables: int, again: tuple[int, int]):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        t, code, u, sub, i, j = (k.as_py() for k in key[2:])
        x, first, n = unit(rows.column("vec")), rows.column("c").to_numpy() == i, rows.column("n").to_numpy()
        ids = rows.column("node").to_numpy()
        one = np.flatnonzero(first)
        two = one if i == j else np.flatnonzero(~first)
        linked = x[one] @ x[two].T >= threshold
        if two is one:
            linked &= ~np.eye(len(one), dtype=bool)
        a, b = np.nonzero(linked)
        if len(a):
            codes = bucket_codes(x, hashes, tables)
            keep = first_shared(codes[one[a]], codes[two[b]], t, code)
            if u >= 0:
                codes = bucket_codes(x, *again, SPLIT_SEED)
                keep &= first_shared(codes[one[a]], codes[two[b]], u, sub)
            linked[a[~keep], b[~keep]] = False
        links = np.zeros(len(x), np.int64)
        links[one] += linked @ n[two]
        near = np.zeros((len(x), len(x)), bool)
        near[np.ix_(one, two)] = linked
        if two is not one:
            links[two] += linked.T @ n[one]
        near |= near.T
        root = np.arange(len(x))
        todo = near.any(1)
        while todo.any():
            start = int(np.argmax(todo))
            reached = np.zeros(len(x), bool)
            reached[start] = True
            front = reached.copy()
            while front.any():
                front = near[front].any(0) & ~reached
                reached |= front
            root[reached] = start
            todo &= ~reached
        some = np.flatnonzero(links)
        return pa.table({"node": ids[some], "links": links[some], "root": ids[root[some]]})

    return run


def _sized(entries: DataFrame, bucket: list[str], count: str) -> tuple[DataFrame, int]:
    """Entries of buckets with two or more, with their bucket's size, and the largest size."""
    busy = durable(entries.groupBy(*bucket).agg(F.count("*").alias(count)).where(F.col(count) > 1).select(F.xxhash64(*bucket).alias("__b"), count))
    shared, most = busy.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    return attach(entries.withColumn("__b", F.xxhash64(*bucket)), busy, "__b", count, shared).drop("__b"), most


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per input row: the id, n_links, component_id, kept."""
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"), F.col(label_col).alias("label"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    keyed = durable(base.select("id", F.when(usable, F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.col("vec").cast("string")), 256)).alias("key"), F.when(usable, F.col("vec")).alias("vec"), "label"))
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("vec").alias("vec"), F.first("label").alias("label"))
    classes = durable(classes.withColumn("node", F.xxhash64("key")))
    total, count, width = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(2))).first()
    hashes = hashes_for(count, width)
    tables = TABLES[hashes]
    entries = classes.select("node", "vec", F.to_json(F.struct("label", "node", "n", F.size("vec").alias("d"))).alias("key")).mapInArrow(_entries(hashes, tables), "key string, t int, code long")
    entry = F.from_json("key", "label string, node long, n long, d int").alias("e")
    entries = durable(entries.select(entry, "t", "code").select("e.label", "e.d", "t", "code", "e.node"))
    bucket = ["label", "d", "t", "code"]
    met, most = _sized(entries, bucket, "m")
    again = (1, TABLES[1])
    split = [*bucket, "u", "sub"]
    kept = met.where(F.col("m") <= SPLIT).withColumns({"u": F.lit(-1), "sub": F.lit(0).cast("long")})
    if most > SPLIT:
        more = hashes_for(most, width)
        again = (more, TABLES[more])
        crowded = met.where(F.col("m") > SPLIT).drop("m")
        hashed = classes.select("node", "vec").join(crowded.select("node").distinct(), "node").mapInArrow(_again(*again), "node long, u int, sub long")
        kept = kept.unionByName(_sized(durable(crowded.join(hashed, "node")), split, "m")[0])
    dealt = kept.withColumn("s", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn("c", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("s")).cast("int"))
    cells = dealt.select(*split, "node", "c", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o"))
    cells = cells.select(*split, "node", "c", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    cells = cells.join(classes.select("node", "n", "vec"), "node")
    found = durable(cells.groupBy(*split, "i", "j").applyInArrow(_cell(threshold, hashes, tables, again), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    parts = durable(parts)
    lows = parts.join(classes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("members"))
    named = attach(parts, durable(lows), "root", "members", count).select("node", "component")
    table = classes.join(links, "node", "left").join(named, "node", "left").select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id"))
    linked = attach(keyed.where("key is not null").select("id", "key"), durable(table), "key", "n", total).select("id", "n_links", "component_id")
    alone = keyed.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
