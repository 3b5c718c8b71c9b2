"""A stored vector index with exact top k by the triangle inequality.

Unit vectors are stored by the nearest of some centres, a folder each, sorted by their distance to it. For a query at
distance d from a centre, a vector at distance r from it is no nearer to the query than |d - r|. So once the clusters
nearest to a query have given k vectors, the k-th of which is t away, all clusters whose distances are wholly outside
d - t to d + t are not read, nor are, by the order of the files, the row groups outside it. Which clusters hold like
vectors is a matter of speed alone; the result is that of `retrieval.dense_top_k`.

Centres are means of a sample of SAMPLE vectors, chosen by a hash of their ids; every vector is in the index. The driver
holds the centres and QUERY_BLOCK bytes of queries at a time.

Defined results: as in `dense_top_k`, null and empty vectors take no part, vectors of length zero score 0, ties go by
the ids as text. All vectors of an index have one width.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import durable
from .retrieval import BATCH_ROWS, QUERY_BLOCK, top_k

SAMPLE = 20_000
ROUNDS = 6  # of moving the centres
MOST = 4_096  # centres
FIRST = 2  # clusters that a query begins with
NOWHERE = -1  # the cluster of vectors of length zero
ROW_GROUP = 1 << 20  # bytes
SPANS = 32  # of distances that row groups are chosen by


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    rows = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if not len(rows):
        return np.zeros((0, 1))
    return pc.list_flatten(rows).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (rows * rows).sum(1)[:, None] + (centres * centres).sum(1) - 2 * rows @ centres.T
    return np.sqrt(np.maximum(squared, 0))


def moved_centres(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres: the sample's first vectors, moved to the means of those that are nearest to them."""
    centres = sample[:k].copy()
    for _ in range(rounds):
        nearest = distances(sample, centres).argmin(1)
        count = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        some = count > 0
        centres[some] = sums[some] / count[some, None]
    return centres


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def clusters(self) -> pa.Table:
        """(cluster, centre, n, nearest, farthest); MOST rows and one."""
        return self.spark.read.parquet(f"{self.path}/clusters").orderBy("cluster").toArrow()


def build_vector_index(index: VectorIndex, docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int | None = None) -> None:
    """Writes the index of docs, in place of one that is there."""
    base = docs.where(F.size(vector_col) > 0).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    some = base.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample = unit(matrix(some["vector"]))
    k = min(len(sample), clusters or min(MOST, max(1, math.isqrt(base.count()))))
    centres = moved_centres(sample, k) if k else np.zeros((0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            rows = unit(matrix(b.column("vector")))
            cluster, distance = np.full(len(rows), NOWHERE, np.int32), np.zeros(len(rows))
            there = np.flatnonzero(rows.any(1))
            if len(there):
                far = distances(rows[there], centres)
                cluster[there] = far.argmin(1)
                distance[there] = far.min(1)
            width = rows.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists, pa.array(cluster), pa.array(distance)], ["id", "vector", "cluster", "distance"])

    schema = T.StructType([base.schema["id"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    placed = base.mapInArrow(assign, schema)
    # By range, so that a cluster with very many vectors goes over several tasks and files, each with distances of its own.
    dealt = placed.repartitionByRange("cluster", "distance").sortWithinPartitions("cluster", "distance")
    dealt.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("cluster").parquet(f"{index.path}/vectors")
    written = index.spark.read.schema("cluster int, distance double").parquet(f"{index.path}/vectors")
    sizes = written.groupBy("cluster").agg(F.count("*").alias("n"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"))
    named = index.spark.createDataFrame([(j, c.tolist()) for j, c in enumerate(centres)], "cluster int, centre array<double>")
    sizes.join(F.broadcast(named), "cluster", "left").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/clusters")


@dataclass(frozen=True)
class _Reading:
    """Which queries (rows of `units`) want which cluster, and which distances there."""

    wanted: dict[int, np.ndarray]
    low: dict[int, np.ndarray]
    high: dict[int, np.ndarray]

    def filter(self) -> F.Column:
        """A condition on cluster and distance: folders and row groups that no query wants are not read.

        It is of the same depth for any number of clusters: bounds are looked up by cluster, and what row groups are
        chosen by is the union of all bounds in SPANS pieces at most.
        """
        if not self.wanted:
            return F.lit(False)
        bounds = {c: (float(self.low[c].min()), float(self.high[c].max())) if len(q) else (0.0, 3.0) for c, q in self.wanted.items()}
        folders = F.col("cluster").isin(*self.wanted)
        if all(low <= 0 and high >= 2 for low, high in bounds.values()):
            return folders
        places = range(NOWHERE, max(bounds) + 1)
        lows, highs = (F.lit([bounds.get(c, (3.0, 0.0))[side] for c in places]) for side in (0, 1))
        place = F.col("cluster") - F.lit(NOWHERE)
        mine = F.col("distance").between(F.get(lows, place), F.get(highs, place))
        spans = reduce(operator.or_, [F.col("distance").between(low, high) for low, high in _union(list(bounds.values()))])
        return folders & spans & mine


def _union(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint spans that cover the same; the whole range if they are more than SPANS."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out if len(out) <= SPANS else [(out[0][0], out[-1][1])]


def _scores(reading: _Reading, units: np.ndarray, names: pa.Array, k: int, digits: int):
    """The k best of each batch for each query that wants its cluster, ties settled as in the final ranking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            clusters = b.column("cluster").to_numpy()
            for c in np.unique(clusters).tolist():
                part = b.take(pa.array(np.flatnonzero(clusters == c)))
                n, queries = part.num_rows, reading.wanted.get(c, np.empty(0, np.int64))
                far = part.column("distance").to_numpy()
                queries_at = np.flatnonzero((reading.low[c] <= far.max()) & (reading.high[c] >= far.min())) if len(queries) else queries
                queries = queries[queries_at]
                if not len(queries):
                    continue
                order = np.empty(n, np.int64)
                order[pc.sort_indices(part.column("id").cast(pa.string())).to_numpy()] = np.arange(n)
                score = np.rint(units[queries] @ matrix(part.column("vector")).T * 10**digits).astype(np.int64)
                best = np.argpartition(-(score * n - order), min(k, n) - 1, axis=1)[:, : min(k, n)]
                q, d = np.repeat(np.arange(len(queries)), best.shape[1]), best.ravel()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(queries[q])), pa.array(queries[q]), part.column("id").take(pa.array(d)), pa.array(score[q, d])], ["q", "row", "d", "score"])

    return run


def _plan(clusters: pa.Table, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of clusters with centres: their numbers, nearest and farthest distances, and the queries' distances to them."""
    there = np.flatnonzero(np.asarray(clusters["cluster"]) != NOWHERE)
    some = clusters.take(pa.array(there))
    centres = matrix(some["centre"]) if len(there) else np.zeros((0, units.shape[1]))
    return np.asarray(some["cluster"]), np.asarray(some["nearest"]), np.asarray(some["farthest"]), distances(units, centres)


def _first(numbers: np.ndarray, sizes: np.ndarray, far: np.ndarray, k: int, zero: bool) -> _Reading:
    """Each query's FIRST nearest clusters, or as many as hold k vectors, and vectors of length zero."""
    order = far.argsort(1, kind="stable")
    held = np.cumsum(sizes[order], 1)
    upto = np.maximum(FIRST, (held < k).sum(1) + 1)
    wanted: dict[int, list[int]] = {}
    for q, row in enumerate(order):
        for c in row[: upto[q]]:
            wanted.setdefault(int(numbers[c]), []).append(q)
    if zero:
        wanted[NOWHERE] = list(range(len(far)))
    arrays = {c: np.array(q, np.int64) for c, q in wanted.items()}
    return _Reading(arrays, {c: np.zeros(len(q)) for c, q in arrays.items()}, {c: np.full(len(q), 3.0) for c, q in arrays.items()})


def _rest(first: _Reading, numbers: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, far: np.ndarray, within: np.ndarray) -> _Reading:
    """Further clusters that can hold a vector within a distance of the query."""
    done = [{int(x) for x in first.wanted.get(int(c), ())} for c in numbers]
    wanted, low, high = {}, {}, {}
    for j, c in enumerate(numbers):
        can = np.flatnonzero((far[:, j] - within <= farthest[j]) & (far[:, j] + within >= nearest[j]))
        can = np.array([q for q in can.tolist() if q not in done[j]], np.int64)
        if len(can):
            wanted[int(c)], low[int(c)], high[int(c)] = can, far[can, j] - within[can], far[can, j] + within[can]
    return _Reading(wanted, low, high)


def _search(index: VectorIndex, held: pa.Table, kind: T.DataType, k: int, digits: int) -> tuple[DataFrame, _Reading, _Reading, pa.Table]:
    clusters, units, names = index.clusters(), unit(matrix(held["v"])), held["q"].combine_chunks()
    numbers, nearest, farthest, far = _plan(clusters, units)
    sizes = {int(c): n for c, n in zip(clusters["cluster"].to_pylist(), clusters["n"].to_pylist())}
    vectors = index.vectors()
    schema = T.StructType([T.StructField("q", kind), T.StructField("row", T.LongType()), T.StructField("d", vectors.schema["id"].dataType), T.StructField("score", T.LongType())])
    one = _first(numbers, np.array([sizes[int(c)] for c in numbers], np.int64), far, k, NOWHERE in sizes)
    scored = durable(vectors.where(one.filter()).mapInArrow(_scores(one, units, names, k, digits), schema))
    # A row per query comes back: its k-th score so far.
    nth = top_k(scored, "row", "d", k).where(F.col("rank") == k).select("row", "score").toArrow()
    within = np.full(len(units), 3.0)
    least = np.asarray(nth["score"]) / 10**digits - 10.0**-digits
    within[np.asarray(nth["row"]).astype(np.int64)] = np.sqrt(np.maximum(2 - 2 * least, 0)) + 1e-9
    within[~units.any(1)] = 3.0  # a query of length zero scores 0 with all
    two = _rest(one, numbers, nearest, farthest, far, within)
    more = vectors.where(two.filter()).mapInArrow(_scores(two, units, names, k, digits), schema)
    return scored.unionByName(more), one, two, clusters


def indexed_dense_top_k(index: VectorIndex, queries: DataFrame, doc_id: str = "vec_id", query_id: str = "query_id", query_vector: str = "query_vector", k: int = 10, digits: int = 6) -> DataFrame:
    """The rows of `retrieval.dense_top_k` over the vectors of the index: (query_id, doc_id, score, rank)."""
    if k <= 0:
        raise ValueError("k must be positive")
    asked = queries.where(F.size(query_vector) > 0).select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    rounds, found = max(1, math.ceil(n * width * 8 / QUERY_BLOCK)), None
    for r in range(rounds):
        held = asked.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r).toArrow()
        part = _search(index, held, asked.schema["q"].dataType, k, digits)[0] if held.num_rows else None
        found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        found = index.vectors().limit(0).crossJoin(asked.select("q")).select("q", F.col("id").alias("d"), F.lit(0).alias("score"))
    ranked = top_k(found.select("q", "d", (F.col("score") / 10**digits).alias("score")), "q", "d", k)
    return ranked.withColumnsRenamed({"q": query_id, "d": doc_id})


def search_report(index: VectorIndex, queries: DataFrame, query_id: str = "query_id", query_vector: str = "query_vector", k: int = 10, digits: int = 6) -> dict[str, int]:
    """How many clusters there are, how many are read at all, and in how many pairs of query and cluster."""
    asked = queries.where(F.size(query_vector) > 0).select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"))
    held = asked.toArrow()
    _, one, two, clusters = _search(index, held, asked.schema["q"].dataType, k, digits)
    return {"clusters": clusters.num_rows, "read": len(one.wanted.keys() | two.wanted.keys()), "pairs": sum(len(q) for r in (one, two) for q in r.wanted.values()), "all_pairs": clusters.num_rows * held.num_rows}
