"""Pieces that the corpus operators share: durable intermediates, hot-key joins and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = 50_000_000  # rows of one key that a single task may be dealt


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's spark.checkpoint.dir names it.

    Only where that is unset and the driver is the only machine (local mode, tests) is a temporary folder made, which
    goes with the process; a cluster without a shared folder is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder, so that neither lost executors nor reuse recompute what is above."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what a task makes of texts in Python is bounded by some of them."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_from(total: int) -> int:
    """From how many of `total` rows on a key is hot: a thousandth, or HOT_ROWS where that is less.

    So no more than the larger of 1,000 and total / HOT_ROWS keys are hot, 200,000 of 10^13 rows, a few megabytes; and
    what shuffles by key has neither a thousandth of the rows nor HOT_ROWS of them under one key.
    """
    return max(100, min(total // 1000, HOT_ROWS))


def attach(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key, where `count` in the table says how many rows have that key.

    Hot keys (`hot_from`) are broadcast and their rows never move; the rest shuffle.
    """
    least = hot_from(total)
    hot = F.broadcast(table.where(F.col(count) >= least))
    cold = table.where(F.col(count) < least)
    here = rows.join(hot, key, "inner")
    rest = rows.join(F.broadcast(table.where(F.col(count) >= least).select(key)), key, "left_anti")
    return here.unionByName(rest.join(cold, key, how))


def without(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The rows whose key is not in the table of `attach`; rows of hot keys go before anything shuffles."""
    least = hot_from(total)
    cold = rows.join(F.broadcast(table.where(F.col(count) >= least).select(key)), key, "left_anti")
    return cold.join(table.where(F.col(count) < least).select(key), key, "left_anti")


def attach_spread(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, spread: list[str]) -> DataFrame:
    """The inner join of `attach` for a 64-bit key, in one pass over rows that are dear to compute.

    Rows of hot keys take their values from the broadcast, and shuffle by a hash of `spread` instead of their key.
    """
    least = hot_from(total)
    others = [c for c in table.columns if c != key]
    hot = table.where(F.col(count) >= least).select(F.col(key), F.lit(True).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in others])
    tagged = rows.join(F.broadcast(hot), key, "left")
    tagged = tagged.select(
        F.when(F.col("__hot"), F.xxhash64(*spread)).otherwise(F.col(key)).alias("__key"),
        F.when(F.col("__hot"), F.col(key)).alias("__own"),
        *[c for c in rows.columns if c != key],
        *[f"__hot_{c}" for c in others],
    )
    cold = table.where(F.col(count) < least).withColumnRenamed(key, "__key").withColumn("__cold", F.lit(True))
    met = tagged.join(cold, "__key", "left").where("__own is not null or __cold")
    mine = {key: F.coalesce("__own", "__key")}
    return met.select(*[mine.get(c, F.col(c)).alias(c) for c in rows.columns], *[F.when(F.col("__own").isNotNull(), F.col(f"__hot_{c}")).otherwise(F.col(c)).alias(c) for c in others])


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """Columns (node, root) for every end of an edge; root is the smallest node that can be reached.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Every round is two grouped minima and two
    joins over the edges, and is written to the shared folder; the driver sees a count and a checksum alone.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = durable(e), None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # The centre of a star holds as many edges as the star has members, hence the care for hot keys.
        large = attach(both, low, "u", "n", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        pairs = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("p"))
        e = durable(pairs.select("p.u", F.col("p.m").alias("v")).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
