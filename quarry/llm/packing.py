"""Best-fit packing of token sequences by exact-complement hashing.

Texts become token ids, an end id is added, and only those longer than the capacity are cut. What remains to be decided
depends on nothing but how many pieces there are of each length, a histogram of at most `capacity` numbers whatever the
corpus. Over it `plan` looks, for every length, for one, two or three shorter lengths that exactly fill the gap (by
indexes of single, pair and triple sums over the lengths still there), takes as many as the counts allow, and puts what
is left into the fullest sequence that it fits (best fit, longest first). The plan is a short list of combinations with
multiplicities. Pieces find their place in it by their rank among the pieces of their length; ranks come from counts
per (length, bucket) and a numbering within each bucket, so no length is gathered in one task.

Defined results: null and empty texts are the end id alone; very long texts are cut, never shortened; a repeated row is
packed again; null ids are packed like others; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, small

ROWS_PER_BUCKET = 20_000


class Tokenizer:
    """The ids that a byte-level BPE file of the `tokenizers` library gives (add_special_tokens=False). The merges are
    run by tiktoken's core over the same vocabulary, which is several times as fast; tests hold the ids against the
    library's own."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE file is asked for")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or spec["normalizer"]:
            raise ValueError("added tokens that match as they are and texts as they are are asked for")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Byte-level files show bytes as characters: printable Latin-1 as itself, the others from U+0100 on, in order.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        octet = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(octet[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = special
        self.split = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")  # the longest counts

    def encode(self, text: str) -> np.ndarray:
        """Strings of added tokens are ordinary text (the library's encode_special_tokens=True)."""
        return np.array(self.core.encode_ordinary(text), "<u4")

    def encode_added(self, text: str) -> np.ndarray:
        """Strings of added tokens become their ids, the text between them is encoded apart, as the library does."""
        found, at = [], 0
        for m in self.split.finditer(text):
            found += [self.encode(text[at : m.start()]), np.array([self.added[m[0]]], "<u4")]
            at = m.end()
        return np.concatenate([*found, self.encode(text[at:])]) if found else self.encode(text)


_made: dict[tuple[str, str], Tokenizer] = {}


def pieces(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Columns (id, piece, start, length, ids_crc32[, ids]): whole texts, or pieces of `capacity` after a shorter first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _made:
            _made[path, pattern] = Tokenizer(path, pattern)
        tokenizer = _made[path, pattern]
        for b in small(batches):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                all_ids = np.append(tokenizer.encode_added(text or ""), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(all_ids) % capacity or capacity, len(all_ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(row)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(all_ids[lo:hi].tobytes()))
                    if with_ids:
                        ids.append(all_ids[lo:hi].astype(np.int32))
            columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), schema.names)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _times(counts: np.ndarray, combination: tuple[int, ...]) -> int:
    """How often the counts can supply the whole combination."""
    return min(int(counts[x]) // combination.count(x) for x in set(combination))


def _filling(counts: np.ndarray, first: int, gap: int, parts: int) -> tuple[int, ...] | None:
    """Up to `parts` (at most three) lengths that sum to `gap` and are there besides `first`; larger parts first."""
    there = counts > 0

    def pair(total: int, most: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        a = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
        for x in a[there[a] & there[total - a]].tolist():
            if _times(counts, (*taken, x, total - x)):
                return x, total - x
        return None

    if parts >= 1 and there[gap] and _times(counts, (first, gap)):
        return (gap,)
    if parts >= 2 and (found := pair(gap, gap - 1, (first,))):
        return found
    for x in range(gap - 2 if parts >= 3 else 0, (gap + 2) // 3 - 1, -1):
        if there[x] and _times(counts, (first, x)) and (found := pair(gap - x, x, (first, x))):
            return (x, *found)
    return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences), covering the histogram exactly.

    With few pieces, filling gaps exactly by triples can use up the short ones that best fit needs later; so plans with
    fillings of up to three, two, one and no parts are made, and the one with the fewest sequences is taken.
    """
    plans = [_plan(histogram, capacity, parts) for parts in (3, 2, 1, 0)]
    return min(plans, key=lambda combinations: sum(n for _, n in combinations))


def _plan(histogram: dict[int, int], capacity: int, parts: int) -> list[tuple[tuple[int, ...], int]]:
    """One plan. A step uses up a length or a set of alike sequences, so its size is bounded by the capacity, not the
    counts."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    done: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while counts[length]:
            gap = capacity - length
            found = _filling(counts, length, gap, parts) if gap else ()
            if found is None:
                break
            combination = (length, *found)
            n = _times(counts, combination)
            for x in combination:
                counts[x] -= n
            done.append((combination, n))
    open_: dict[int, list[list]] = {}  # gap -> [lengths, number]
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for gap in sorted(g for g in open_ if g >= length):
            for entry in list(open_.get(gap, ())):
                if not left:
                    break
                n = min(left, entry[1])
                entry[1] -= n
                left -= n
                if not entry[1]:
                    open_[gap].remove(entry)
                open_.setdefault(gap - length, []).append([(*entry[0], length), n])
            if not left:
                break
        # Lengths that repeat fill the new sequences they open.
        each = max(1, capacity // length)
        if full := left // each:
            open_.setdefault(capacity - each * length, []).append([(length,) * each, full])
        if rest := left % each:
            open_.setdefault(capacity - rest * length, []).append([(length,) * rest, 1])
    done += [(tuple(lengths), n) for entries in open_.values() for lengths, n in entries if n]
    return done


def segments(combinations: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For ranks lo, lo + 1, ... of a length: the first sequence and the offset; sorted by length and lo."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in combinations:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "lo": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds ids."""
    cut = durable(pieces(docs, path, pattern, id_col, text_col, capacity, end_id, with_ids))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    buckets = max(64, sum(histogram.values()) // ROWS_PER_BUCKET)
    # By place in the table that was just written, which does not change: equal rows, however many, are spread as well.
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    sizes = durable(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")))
    ranked = numbered.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("at") - 1).drop("base", "at", "bucket")
    where = segments(plan(histogram, capacity))
    combined = where["length"] * (1 << 44) + where["lo"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(combined, length * (1 << 44) + rank, "right") - 1
            found = {"sequence_id": pa.array(where["sequence"][k] + rank - where["lo"][k]), "offset": pa.array(where["offset"][k])}
            yield pa.RecordBatch.from_arrays([found[n] if n in found else b.column(n) for n in schema.names], schema.names)

    schema = T.StructType([*[f for f in cut.schema.fields if f.name != "ids"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), *[f for f in cut.schema.fields if f.name == "ids"]])
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)
