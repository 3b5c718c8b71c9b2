"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 is a blocked counting Bloom filter whose blocks are dealt to tasks: every row sends the numbers of its two slots,
counted within a task first, and a slot that is set a second time goes to a second filter, the repeated slots. Pass 2
tests every row against that second filter. A row that misses in any of its slots has no equal anywhere and passes
straight through. The others are possibly repeated: only they shuffle, and grouping them by their full SHA-256 settles
which are equal.

The filter has BITS_PER_ROW bits for every row, however many rows there are. Up to BROADCAST_BITS it is broadcast; a
larger one stays dealt out, and digests, not texts, go to its blocks. `drop_exact_duplicates` moves texts only of rows
that a filter of the digests to be dropped, which is always broadcast, does not rule out.

Defined results: null text counts as empty; a null id sorts after every other id; rows that share id and text are one
document (`exact_dedup` marks each of them, `drop_exact_duplicates` returns the one whose columns as JSON have the
smallest SHA-256); an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, durable

BLOCK_BITS = 32768  # what one bitmap of bitmap_construct_agg holds
BITS_PER_ROW = 16
BROADCAST_BITS = 2**28
BROADCAST_ROWS = 100_000  # ids and digests, about 100 bytes each


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


@dataclass(frozen=True)
class Slots:
    """A blocked Bloom filter: a bitmap of set slots per block, and how many slots its rows have there."""

    blocks: int
    bitmaps: DataFrame
    total: int
    broadcast: bool

    def test(self, df: DataFrame, digest: str) -> DataFrame:
        """df with a boolean column __maybe: whether both slots of the digest are set."""
        block, one, two = _places(F.col(digest), self.blocks)
        at = df.withColumn("__block", block)
        if self.broadcast:
            at = at.join(F.broadcast(self.bitmaps.drop("__n")), "__block", "left")
        else:
            at = attach(at, self.bitmaps, "__block", "__n", self.total, "left").drop("__n")

        def is_set(pos: Column) -> Column:
            byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (pos % 8).cast("int")) == 1

        return at.withColumn("__maybe", F.coalesce(is_set(one) & is_set(two), F.lit(False))).drop("__block", "__bitmap")


def _places(digest: Column, blocks: int) -> tuple[Column, Column, Column]:
    h = F.xxhash64(digest)
    g = F.xxhash64(F.lit(7), digest)
    return F.pmod(h, F.lit(blocks)), F.pmod(g, F.lit(BLOCK_BITS)), F.pmod(F.shiftrightunsigned(g, 32), F.lit(BLOCK_BITS))


def set_slots(digests: DataFrame, digest: str, rows: int, least: int, most_bits: int | None = None, broadcast_bits: int = BROADCAST_BITS) -> Slots:
    """The slots that at least `least` rows set, in a filter of BITS_PER_ROW bits a row, or most_bits where that is less."""
    bits = BLOCK_BITS
    while bits < rows * BITS_PER_ROW and bits < (most_bits or bits + 1):
        bits *= 2
    block, one, two = _places(F.col(digest), bits // BLOCK_BITS)
    slot = digests.select(block.alias("__block"), F.explode(F.array_distinct(F.array(one, two))).alias("__pos"))
    counted = slot.groupBy("__block", "__pos").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    bitmaps = counted.groupBy("__block").agg(F.bitmap_construct_agg("__pos").alias("__bitmap"), F.sum("n").alias("__n"))
    return Slots(bits // BLOCK_BITS, durable(bitmaps), 2 * rows, bits <= broadcast_bits)


def _groups(maybe: DataFrame) -> DataFrame:
    return durable(maybe.groupBy("__sha").agg(F.min("__id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256."""
    digests = durable(docs.select(F.col(id_col).alias("__id"), text_digest(F.col(text_col)).alias("__sha")))
    rows = digests.count()
    flagged = set_slots(digests, "__sha", rows, 2, broadcast_bits=broadcast_bits).test(digests, "__sha")
    alone = flagged.where("not __maybe").select("__id", "__sha", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    maybe = flagged.where("__maybe").drop("__maybe")
    met = attach(maybe, _groups(maybe), "__sha", "group_size", rows, "left").select(
        "__id", "__sha", F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    )
    return alone.unionByName(met).select(F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("__sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bits: int = BROADCAST_BITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("__id"), text_digest(F.col(text_col)).alias("__sha"))
    digests = durable(packed.select("__id", "__sha"))
    rows = digests.count()
    maybe = set_slots(digests, "__sha", rows, 2, broadcast_bits=broadcast_bits).test(digests, "__sha").where("__maybe").drop("__maybe")
    met = attach(maybe, _groups(maybe), "__sha", "group_size", rows)
    lost = ~F.col("__id").eqNullSafe(F.col("keep_id"))
    # Of an id and a text: whether its rows go, or all but one of several do.
    touched = met.groupBy(F.col("__id").alias("__its_id"), F.col("__sha").alias("__its_sha")).agg(F.first(lost).alias("__lost"), F.count("*").alias("n"))
    touched = durable(touched.where("__lost or n > 1").drop("n"))
    some, twins = touched.agg(F.count("*"), F.count_if(~F.col("__lost"))).first()
    on = F.col("__sha").eqNullSafe(F.col("__its_sha")) & F.col("__id").eqNullSafe(F.col("__its_id"))
    if some <= broadcast_rows:
        joined = packed.join(F.broadcast(touched), on, "left")
        out = joined.where("__lost is null").select("row.*")
    else:
        tested = set_slots(touched, "__its_sha", some, 1, broadcast_bits, broadcast_bits).test(packed, "__sha")
        joined = tested.where("__maybe").join(touched, on, "left")
        out = tested.where("not __maybe").select("row.*").unionByName(joined.where("__lost is null").select("row.*"))
    if twins:
        one = joined.where("not __lost").groupBy("__id", "__sha").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
        out = out.unionByName(one.select("row.*"))
    return out
