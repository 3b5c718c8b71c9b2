"""SimHash near-deduplication: fingerprints, pigeonhole blocks, verified Hamming links, components.

A 64-bit fingerprint is split into `r` blocks. Two fingerprints that differ in at most `distance` bits agree on at
least r - distance whole blocks, so they meet in one of the C(r, distance) tables whose key is the bits of that many
blocks. r grows with the number of distinct fingerprints (`blocks_for`), which keeps the chance load of a table's key
small; every choice finds every link.

Equal fingerprints are collapsed first. Keys that few fingerprints share are joined natively; a key that many share is
dealt in chunks to cells (chunk i, chunk j) that each compare their two chunks and return only a spanning forest, so
neither a task nor the output grows with the square of a group. The fingerprints of a key that very many share meet by
pigeonhole once more, over the bits that are not in the key, before they are dealt to cells; so what they send is a
fixed number of rows each, unless that many agree on those bits too.

Defined results: null text counts as empty; texts without words have fingerprint zero and link like any other; very
long texts are used whole; null ids take part but never name a component while another id is there; rows that share an
id each get a row; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, connected_components, durable, small, without
from .exact_dedup import BROADCAST_BITS, BROADCAST_ROWS, set_slots

BITS = 64
SEED = 42
DIRECT = 64  # a key shared by more fingerprints than this goes to cells
CHUNK = 1024  # fingerprints per chunk of a cell
SPLIT = 16_384  # a key shared by more fingerprints than this is split by further bits first
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each n-word shingle of the A-Z-lower-cased text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends, h = ends.tolist(), xxhash.xxh64_intdigest
    return np.array([h(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :] or ends[-1:])], np.uint64)


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per run of `lengths` hashes: the word whose bits are those set in over half of the run's hashes."""
    docs = len(lengths)
    out = np.zeros(docs, np.uint64)
    group = 128
    ends = np.cumsum(lengths)
    for at in range(0, docs, group):
        some = lengths[at : at + group]
        lo, hi = ends[at] - lengths[at], ends[min(at + group, docs) - 1]
        if hi == lo:
            continue
        octets = hashes[lo:hi].view(np.uint8).reshape(-1, 8)
        base = np.repeat(np.arange(len(some), dtype=np.int64) * 2048, some)
        counts = np.zeros((len(some), 8, 256), np.int64)
        for k in range(8):
            counts[:, k] = np.bincount((base >> 3) + octets[:, k], minlength=256 * len(some)).reshape(-1, 256)
        bits = (counts @ _BIT) * 2 > some[:, None, None]  # (docs, byte, bit)
        out[at : at + group] = np.packbits(bits.reshape(len(some), 64), axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Columns (__id, fp): the SimHash of every row as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            runs = [shingle_hashes(t, shingle) for t in b.column(1).to_pylist()]
            lengths = np.array([len(r) for r in runs], np.int64)
            fp = majority_bits(np.concatenate(runs) if runs else np.empty(0, np.uint64), lengths)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["__id", "fp"])

    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def blocks_for(count: int, distance: int) -> int:
    """The fewest blocks whose keys hold about four fingerprints of `count` by chance, or fewer."""
    for r in range(distance + 1, 17):
        if (r - distance) * (BITS // r) >= max(1, count).bit_length() - 2:
            return r
    return 16


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _choices(places: list[int], r: int, distance: int) -> list[int]:
    """The places in r blocks: for every choice of r - distance blocks, the mask of their bits, as a signed integer."""
    block = [sum(1 << p for p in places[len(places) * k // r : len(places) * (k + 1) // r]) for k in range(r)]
    return [_signed(sum(block[k] for k in some)) for some in combinations(range(r), r - distance)]


def table_masks(r: int, distance: int) -> list[int]:
    return _choices(list(range(BITS)), r, distance)


def further_masks(mask: int, distance: int) -> list[int]:
    """For fingerprints that agree on the mask's bits: masks over the others, on one of which close pairs agree too."""
    others = [k for k in range(BITS) if not mask >> k & 1]
    return _choices(others, distance + 2, distance)


def spanning_edges(left: np.ndarray, right: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Star edges (member, root) of the components among links within `left`, or between left and right."""
    if right is None:
        near = np.bitwise_count(left[:, None] ^ left[None, :]) <= distance
    else:
        between = np.bitwise_count(left[:, None] ^ right[None, :]) <= distance
        n, m = between.shape
        near = np.zeros((n + m, n + m), bool)
        near[:n, n:], near[n:, :n] = between, between.T
    every = (left if right is None else np.concatenate([left, right])).view(np.int64)
    todo, edges = near.any(1), []
    np.fill_diagonal(near, False)
    todo &= near.any(1)
    while todo.any():
        root = int(np.argmax(todo))
        reached = np.zeros(len(every), bool)
        front = np.zeros(len(every), bool)
        reached[root] = front[root] = True
        while front.any():
            front = near[front].any(0) & ~reached
            reached |= front
        todo &= ~reached
        edges += [(int(every[k]), int(every[root])) for k in np.flatnonzero(reached) if k != root]
    return edges


def hamming_links(classes: DataFrame, count: int, distance: int) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct fingerprints within `distance` bits.

    Tables and keys are hashed to one number g; where two of them have the same, more is compared, and nothing else.
    """
    masks = table_masks(blocks_for(count, distance), distance)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))
    keys = classes.select("fp", each.alias("k")).select("fp", "k.t", F.xxhash64("k.t", "k.key").alias("g"))
    total = count * len(masks)
    busy = durable(keys.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > DIRECT))
    most = busy.agg(F.max("n")).first()[0] or 0
    few = without(keys.select("fp", "g"), busy, "g", "n", total) if most else keys.select("fp", "g")
    other = few.select("g", F.col("fp").alias("fp2"))
    direct = few.join(other, "g").where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance)).select(F.col("fp").alias("u"), F.col("fp2").alias("v"))

    if not most:
        return direct
    many = attach(keys, busy, "g", "n", total)
    dealt = _cells(many.where(F.col("n") <= SPLIT))
    if most > SPLIT:
        further = classes.sparkSession.createDataFrame([(t, further_masks(m % (1 << 64), distance)) for t, m in enumerate(masks)], "t int, masks array<long>")
        again = many.where(F.col("n") > SPLIT).join(F.broadcast(further), "t").select("g", "fp", F.explode("masks").alias("mask"))
        again = again.select(F.xxhash64("g", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("g"), "fp")
        alike = durable(again.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
        dealt = dealt.unionByName(_cells(attach(again, alike, "g", "n", alike.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])))

    def cell(key: tuple, rows: pa.Table) -> pa.Table:
        fp = rows.column("fp").to_numpy().view(np.uint64)
        first = rows.column("c").to_numpy() == key[1].as_py()
        edges = spanning_edges(fp[first], None if key[1] == key[2] else fp[~first], distance)
        u, v = zip(*edges) if edges else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return direct.unionByName(dealt.groupBy("g", "i", "j").applyInArrow(cell, "u long, v long"))


def _cells(rows: DataFrame) -> DataFrame:
    """Rows (g, fp, n) dealt to the cells (g, i, j) of pairs of chunks; c is a row's own chunk."""
    dealt = rows.withColumn("s", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn("c", F.pmod(F.xxhash64(F.lit(3), F.col("fp")), F.col("s")).cast("int"))
    cells = dealt.select("g", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o"))
    return cells.select("g", "fp", "c", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per input row: the id, fingerprint (16 hex digits), component_id (smallest id of those reachable)."""
    fps = durable(fingerprints(docs, id_col, text_col, shingle))
    classes = durable(fps.groupBy("fp").agg(F.min("__id").alias("low"), F.count("*").alias("n")))
    total, count = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    linked = connected_components(hamming_links(classes.select("fp"), count, distance))
    linked = durable(linked.select(F.col("node").alias("fp"), "root"))
    low = linked.join(classes, "fp").groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    named = attach(linked, durable(low), "root", "members", count).select("fp", "component_id")
    table = durable(classes.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "low").alias("component_id")))
    return attach(fps, table, "fp", "n", total).select(F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that name their group, by the smallest id and for one id by text; all their columns.

    Rows are told apart by id and text, so of rows that share an id only those go that are not the last of their group.
    What goes is a list of ids and hashes. Up to broadcast_rows it is broadcast; of a longer one, a filter is, and only
    rows that this does not rule out shuffle. The default distance is op2's: with four-word shingles 4 differing bits are
    what 64 * acos(2J / (1 + J)) / pi expects at a Jaccard similarity J of 0.96.
    """
    text = F.xxhash64(F.col(text_col))
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text.alias("text")).alias("__key"), F.col(text_col).alias("__words"))
    groups = simhash_groups(keyed, "__key", "__words", shingle, distance)
    lost = groups.where(~F.col("__key").eqNullSafe(F.col("component_id"))).select(F.col("__key.id").alias("__lost"), F.col("__key.text").alias("__lost_text")).distinct()
    lost = durable(lost)
    some = lost.count()
    on = docs[id_col].eqNullSafe(lost["__lost"]) & (F.xxhash64(docs[text_col]) == lost["__lost_text"])
    if some <= broadcast_rows:
        return docs.join(F.broadcast(lost), on, "left_anti")
    tested = set_slots(lost, "__lost_text", some, 1, BROADCAST_BITS, BROADCAST_BITS).test(docs.withColumn("__hash", text), "__hash").drop("__hash")
    rest = tested.where("__maybe").drop("__maybe")
    met = rest.join(lost, rest[id_col].eqNullSafe(lost["__lost"]) & (F.xxhash64(rest[text_col]) == lost["__lost_text"]), "left_anti")
    return tested.where("not __maybe").drop("__maybe").unionByName(met)
