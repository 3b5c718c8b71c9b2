"""Whitening of embeddings by a tall and skinny QR factorisation.

Entries become whole numbers, floor(256 c). Over the distinct vectors (the fit list), exact sums give the mean; every
partition factors its centred rows, block by block, and keeps the triangle R alone; triangles are merged in a tree, of
FAN each, every merge being a factorisation of the stacked ones; the singular values s and right vectors of the last R
give the components, with eigenvalues s * s / n. No covariance is formed for it, so small components keep their digits.
A vector's deviation is exact, and the covariance of what comes out is measured over the fit list in one more pass.

The driver sees the sums and the components asked for, whose size is the vectors' width times their number.

Defined results: vectors that are null or empty or hold null or non-finite entries are dropped, and so are those whose
length is not that of the most distinct vectors (of lengths as common, the greater), since a mean has one length;
repeated rows and rows that share an id come each with results, and count once in the fit if their vectors become equal;
entries beyond the range of a long become its nearest end. Components that the fit list does not vary in (a singular
value below FLAT of the first) have no whitened values and do not appear, so no row comes of a single distinct vector.
A deviation beyond a long is null there, and whole in deviation_exact up to 38 digits. Of equal eigenvalues any basis
may come, the same for all rows. No rows give an empty table; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

SCALE = 256
COMPONENTS = 4
FAN = 16  # triangles or sums that a task merges
FLAT = 1e-11
BLOCK = 1 << 21  # entries that are factored at a time, or as many rows as the vectors are wide
LONG = 1 << 62


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, width, x) of the rows that are not dropped."""
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
    usable = (F.size("vec") > 0) & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    x = F.transform("vec", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    return base.where(F.coalesce(usable, F.lit(False))).select("id", F.size("vec").alias("width"), x.alias("x"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass(frozen=True)
class Fit:
    """What the fit list's sums say: vectors, their width, per-dimension sums and the greatest absolute entry."""

    n: int
    width: int
    sums: tuple[int, ...]
    most: int

    @property
    def fits_long(self) -> bool:
        return self.n * self.most < LONG

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean, from the exact n * x - sums."""
        if self.fits_long:
            return (x * self.n - np.array(self.sums, np.int64)) / self.n
        return ((x.astype(object) * self.n - np.array(self.sums, object)) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the sum of (n * x - sums) squared, exactly."""
        if self.fits_long and self.width * (2 * self.n * self.most) ** 2 < LONG:
            y = x * self.n - np.array(self.sums, np.int64)
            return (y * y).sum(1).tolist()
        largest = max(self.most, max(map(abs, self.sums)))
        kind = np.int64 if self.width * self.most * largest < LONG else object
        wide, sums = x.astype(kind), np.array(self.sums, kind)
        squares, products = (wide * wide).sum(1).tolist(), (wide * sums).sum(1).tolist()
        constant = sum(s * s for s in self.sums)
        return [self.n * (self.n * a - 2 * b) + constant for a, b in zip(squares, products)]


SUMS = "width int, part int, n long, high array<long>, low array<long>, most long"


def _carried(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums as high * 2**32 + low, low below 2**32."""
    return high + (low >> 32), low & 0xFFFFFFFF


def _greatest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min()))


def _partition_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per width of vectors in the partition."""
    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        widths = b.column("width").to_numpy()
        for width in np.unique(widths).tolist():
            x = matrix(b.column("x").take(pa.array(np.flatnonzero(widths == width))), width)
            high, low = _carried((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))
            n, h, lo, most = seen.get(width, (0, 0, 0, 0))
            seen[width] = (n + len(x), *_carried(h + high, lo + low), max(most, _greatest(x)))
    rows = [{"width": w, "part": part, "n": n, "high": h.tolist(), "low": lo.tolist(), "most": min(most, 2**63 - 1)} for w, (n, h, lo, most) in seen.items()]
    yield pa.RecordBatch.from_pylist(rows, _SUMS)


_SUMS = pa.schema([("width", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("most", pa.int64())])


def _merge_sums(rows: pa.Table) -> pa.Table:
    width = rows.column("width")[0].as_py()
    high, low = (matrix(rows.column(c).combine_chunks(), width).sum(0) for c in ("high", "low"))
    high, low = _carried(high, low)
    total = {"width": width, "part": rows.column("part")[0].as_py(), "n": pc.sum(rows.column("n")).as_py(), "high": high.tolist(), "low": low.tolist(), "most": pc.max(rows.column("most")).as_py()}
    return pa.Table.from_pylist([total], _SUMS)


def tree(rows: DataFrame, parts: int, keys: list[str], merge: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """One row for all parts (numbers below `parts`), by merging FAN rows at a time."""
    while parts > 1:
        parts = -(-parts // FAN)
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy(*keys, "part").applyInArrow(merge, schema)
    return rows


def fit_sums(fit: DataFrame, parts: int) -> Fit | None:
    """Of the width that the most vectors of the fit list have."""
    sums = tree(fit.select("width", "x").mapInArrow(_partition_sums, SUMS), parts, ["width"], _merge_sums, SUMS)
    found = sums.orderBy(F.desc("n"), F.desc("width")).first()
    if found is None:
        return None
    return Fit(found["n"], found["width"], tuple((h << 32) + lo for h, lo in zip(found["high"], found["low"])), found["most"])


def triangle(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """R of the rows that r stands for and further ones."""
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def _triangles(fit: Fit):
    step = max(fit.width, BLOCK // fit.width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, fit.width))
        for b in batches:
            for at in range(0, b.num_rows, step):
                r = triangle(r, fit.centred(matrix(b.column("x").slice(at, step), fit.width)))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["part", "r"])

    return run


def _merge_triangles(width: int):
    def run(rows: pa.Table) -> pa.Table:
        r = np.zeros((0, width))
        for one in rows.sort_by("r_part").column("r"):
            r = triangle(r, one.values.to_numpy().reshape(-1, width))
        return pa.table({"part": rows.column("part").slice(0, 1), "r": pa.array([r.ravel()], pa.list_(pa.float64())), "r_part": rows.column("part").slice(0, 1)})

    return run


def _spectrum(fit: Fit, components: int):
    """(component, e, share of all variance, vector) from the last triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in b.column("r"):
                _, s, vectors = np.linalg.svd(one.values.to_numpy().reshape(-1, fit.width), full_matrices=False)
                some = [k for k in range(min(components, len(s))) if s[k] > FLAT * s[0]]
                # Either sign is right; the largest entry is positive here.
                up = [np.sign(vectors[k][np.abs(vectors[k]).argmax()]) for k in some]
                e = s * s / fit.n
                yield pa.RecordBatch.from_pylist([{"component": k + 1, "e": e[k], "share": e[k] / e.sum(), "vector": (vectors[k] * u).tolist()} for k, u in zip(some, up)], _COMPONENT)

    return run


_COMPONENT = pa.schema([("component", pa.int32()), ("e", pa.float64()), ("share", pa.float64()), ("vector", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Whitening:
    fit: Fit
    e: tuple[float, ...]
    share: tuple[float, ...]
    vectors: np.ndarray  # a row per component

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.fit.centred(x) @ self.vectors.T / np.sqrt(self.e)


def components_of(fit_list: DataFrame, fit: Fit, parts: int, components: int = COMPONENTS) -> Whitening | None:
    rows = fit_list.where(F.col("width") == fit.width).select("x").mapInArrow(_triangles(fit), "part int, r array<double>")
    # Triangles are stacked in the order of their partitions, so that a task that runs again gives the same bits.
    last = tree(rows.withColumn("r_part", F.col("part")), parts, [], _merge_triangles(fit.width), "part int, r array<double>, r_part int")
    found = last.mapInArrow(_spectrum(fit, components), "component int, e double, share double, vector array<double>").orderBy("component").collect()
    if not found:
        return None
    return Whitening(fit, tuple(r["e"] for r in found), tuple(r["share"] for r in found), np.array([r["vector"] for r in found]))


def _whitened(by: Whitening):
    """(x) to (w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([_lists(by.whiten(matrix(b.column("x"), by.fit.width)))], ["w"])

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def identity_error(fit_list: DataFrame, by: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity. Spark's covariance centres as
    it goes and merges partitions by their means."""
    k = len(by.e)
    w = fit_list.where(F.col("width") == by.fit.width).select("x").mapInArrow(_whitened(by), "w array<double>")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = w.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def _rows(by: Whitening):
    """(id, x) to (id, deviation, deviation_exact, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"), by.fit.width)
            exact = by.fit.deviations(x)
            short = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            wide = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([b.column("id"), short, wide, _lists(by.whiten(x))], ["id", "deviation", "deviation_exact", "w"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: the id, component, n, deviation, whitened, explained, identity_error,
    deviation_exact."""
    spark = vectors.sparkSession
    base = whole_vectors(vectors, id_col, vector_col)
    fit_list = durable(base.select("width", "x").distinct())
    parts = max(1, fit_list.rdd.getNumPartitions())
    fit = fit_sums(fit_list, parts)
    by = fit and components_of(fit_list, fit, parts, components)
    kind = base.schema["id"].dataType
    if not by:
        rest = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL(rest)]))
    error = identity_error(fit_list, by)
    schema = T.StructType([T.StructField("id", kind), T.StructField("deviation", T.LongType()), T.StructField("deviation_exact", T.DecimalType(38, 0)), T.StructField("w", T.ArrayType(T.DoubleType()))])
    made = base.where(F.col("width") == fit.width).select("id", "x").mapInArrow(_rows(by), schema)
    each = made.select("id", "deviation", "deviation_exact", F.posexplode("w").alias("k", "whitened"))
    share = F.get(F.array(*[F.lit(s) for s in by.share]), F.col("k"))
    return each.select(
        F.col("id").alias(id_col),
        (F.col("k") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share.alias("explained"),
        F.lit(error).alias("identity_error"),
        "deviation_exact",
    )
