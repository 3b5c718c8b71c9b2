"""Removal of repeated passages by suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller id, or same document and earlier
start). The work is divided so that equal strings meet without all-against-all merging:

1. Anchors. In every document, each string of `length` bytes selects the least-hashed K-byte gram of its first
   W + K - 1 bytes. Equal strings select the same gram, at the same place within them. So a string can only repeat if
   its anchor's hash repeats. Anchors shuffle once by hash, and those without another leave. A task sends one anchor of
   a hash that it holds several times to meet others, and knows of the rest that they repeat; so no more anchors of a
   hash meet than there are slabs of text, however common it is.
2. Copies. An anchor's context is the text of all strings that select it (at most length + W - 1 bytes). Occurrences
   with the same context are collapsed to the earliest before anything else; the later ones repeat it in full. Contexts
   are the same if the gram's hash is and, of all their bytes, a 64-bit hash and TAG bits of an independent one; so
   the bits decide only among contexts of one gram.
3. Shards. The distinct contexts of an anchor with two or more go to one shard, which builds a suffix array by
   Larsson-Sadakane refinement and common prefixes by Kasai's rule, both in numpy; runs of suffixes with `length`
   bytes in common are equal strings, of which the earliest start stays. A string holds half of its other bytes on one
   side of the gram, so the contexts of an anchor with very many are dealt by the bytes on the left and by those on the
   right of it: two rows each, however many there are. What still shares a side with very many is dealt to chunks; each
   pair of chunks is merged by binary search of one chunk's strings in the other's suffix array.
4. Spans. Starts that repeat are gathered as ranges per document, joined to the text once, and cut out.

Defined results: null text is empty; texts below `length` bytes lose nothing; very long texts are used whole; rows
with null ids come first, and of those equal texts count as one document; a repeated row (same id and text) is one
document with its copies and all get the same result; rows that share an id but not a text are documents of their own,
in the order of their texts' hashes; an empty table gives an empty result; other columns may have any
names. Ids are integers. A text of 1 GiB or more, which places are not wide enough for, fails the query.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, attach_spread, durable, hot_from
from .exact_dedup import BROADCAST_BITS, set_slots

LENGTH = 100
K = 32  # bytes of an anchor gram
W = 69  # grams an anchor is chosen among; W + K - 1 <= length
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64((1 << 24) - 1)
SLAB = 1 << 22  # bytes handled at a time; one document may be longer
KNOWN = 1 << 18  # hashes that a task remembers as repeated
TOGETHER = 64  # anchors of one hash, known to repeat, that a slab sends under one salt
LONGEST = 1 << 30
TAG, TAG_AT = 16, 47  # bits of a context's second hash, and where `at` has them
CHUNK = 2048  # contexts of one anchor that a shard takes whole


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(octets: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k bytes (k a power of two), by doubling."""
    h, size, power = octets.astype(np.uint64) + np.uint64(1), 1, _ODD
    with np.errstate(over="ignore"):
        while size < k:
            h = h[:-size] * power + h[size:]
            power, size = power * power, size * 2
        return _mix(h)


def _words(octets: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((max(0, len(octets) - 7),), "<u8", octets.tobytes(), strides=(1,)).copy()


def anchors(octets: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For documents side by side in one array: per anchor its document's number, first and last string start, the
    gram's place, gram hash and two hashes of the whole context. Places count from the array's beginning."""
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 3
    if len(octets) < length:
        return none
    gram = gram_hashes(octets)
    if len(octets) > int(_LOW):
        least = _long_minima(gram)
    else:
        least = _minima(gram)
    doc = np.repeat(np.arange(len(starts)), ends - starts)[: len(least)]
    strings = np.flatnonzero(np.arange(len(least)) + length <= ends[doc])
    if not len(strings):
        return none
    at, doc = least[strings], doc[strings]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    first, last = strings[new], strings[np.concatenate((new[1:], [len(strings)])) - 1]
    final, c = last + length - K, (last - first).astype(np.uint64)
    d, words = c ^ _ODD, _words(octets)
    with np.errstate(over="ignore"):
        for k in range(0, length + W - 1, K):  # pieces that cover the context, the last of them at its end
            piece = np.minimum(first + k, final)
            c = _mix(c * _ODD + gram[piece])
            for w in range(0, K, 8):
                d = _mix((d ^ words[piece + w]) * _ODD)
    return doc[new], first, last, at[new], gram[at[new]], c, d


def _minima(gram: np.ndarray) -> np.ndarray:
    """For each W grams in a row, the place of the least (the first of equal ones)."""
    v, size = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64), 1
    while size < W:
        by = min(size, W - size)
        v, size = np.minimum(v[:-by], v[by:]), size + by
    return (v & _LOW).astype(np.int64)


def _long_minima(gram: np.ndarray) -> np.ndarray:
    """_minima for arrays whose places don't fit beside a hash: slab by slab."""
    return np.concatenate([_minima(gram[lo : lo + SLAB + W - 1]) + lo for lo in range(0, len(gram) - W + 1, SLAB)])


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The order of all suffixes, each up to its text's end, equal ones by place (Larsson and Sadakane).

    Every refinement doubles the depth and re-sorts only the groups that are still tied; a group's rank is the place
    of its first member, so the ranks of settled suffixes stay as they are. Symbols are 0 to 256; left: symbols before
    a suffix's end. The order must be complete, not only as deep as a match: Kasai's rule relies on it.
    """
    n = len(symbols)
    wide = np.concatenate([symbols.astype(np.int64), np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key * 257 + np.where(left > k, wide[k : k + n], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h, deepest = 7, int(left.max(initial=0))
    while h < deepest:
        tied = np.flatnonzero(~(head & np.concatenate((head[1:], [True]))))  # places in groups of two or more
        if not len(tied):
            break
        members = order[tied]
        key = rank[members] * (n + 1) + np.where(left[members] > h, rank[np.minimum(members + h, n - 1)] + 1, 0)
        again = np.argsort(key, kind="stable")
        order[tied] = members[again]
        key = key[again]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        head[tied] = fresh
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        h *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, begins: np.ndarray, left: np.ndarray, cap: int) -> np.ndarray:
    """Per place in order, the symbols that its suffix shares with the one before, up to `cap` (Kasai's rule).

    Texts (beginning at `begins`) are walked side by side: from one place of a text to the next, at most one symbol of
    the common prefix is lost, so each text only extends what it already has. left: symbols before a suffix's end.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    by_place = np.zeros(n, np.int64)
    sizes = np.diff(np.concatenate((begins, [n])))
    have = np.zeros(len(begins), np.int64)
    for step in range(int(sizes.max(initial=0))):
        lanes = np.flatnonzero(sizes > step)
        at = begins[lanes] + step
        prev = before[at]
        bound = np.where(prev >= 0, np.minimum(np.minimum(left[at], left[prev]), cap), 0)
        have[lanes] = np.minimum(np.maximum(have[lanes] - 1, 0), bound)
        go = np.arange(len(lanes))
        while len(go):
            got = have[lanes[go]]
            go, got = go[ok := got < bound[go]], got[ok]
            same = symbols[at[go] + got] == symbols[prev[go] + got]
            go = go[same]
            have[lanes[go]] += 1
        by_place[at] = have[lanes]
    return by_place[order]


class Shard:
    """Contexts with the strings that start in them, sorted by suffix array.

    After building: `order` lists the starts of whole strings in text order, `run` numbers equal strings, and `best`
    has each run's earliest (document rank, place).
    """

    def __init__(self, contexts: list[bytes], doc: np.ndarray, first: np.ndarray, length: int):
        sizes = np.array([len(c) + 1 for c in contexts], np.int64)
        begins = np.cumsum(sizes) - sizes
        symbols = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int16) + 1
        symbols[begins + sizes - 1] = 0
        owner = np.repeat(np.arange(len(contexts)), sizes)
        place = np.arange(len(symbols)) - begins[owner]
        left = sizes[owner] - 1 - place
        order = suffix_order(symbols, left)
        shared = common_prefixes(symbols, order, begins, left, length)
        whole = left[order] >= length
        run = np.cumsum(~((shared >= length) & whole))  # a suffix too short for a string never lies between equal ones
        self.symbols, self.length, self.order, self.run = symbols, length, order[whole], run[whole]
        self.owner = owner[self.order]
        self.doc, self.at = doc[self.owner], first[self.owner] + place[self.order]

    def earliest(self) -> tuple[np.ndarray, np.ndarray]:
        """Per start in order: the (doc, at) of the earliest equal string in this shard."""
        if not len(self.order):
            return self.doc, self.at
        heads = np.flatnonzero(np.concatenate(([True], self.run[1:] != self.run[:-1])))
        by = np.lexsort((self.at, self.doc, self.run))
        size = np.diff(np.concatenate((heads, [len(self.run)])))
        return np.repeat(self.doc[by][heads], size), np.repeat(self.at[by][heads], size)

    def strings(self) -> np.ndarray:
        """The strings in order as fixed-size byte rows that compare like texts."""
        rows = (self.symbols[self.order[:, None] + np.arange(self.length)] - 1).astype(np.uint8)
        return rows.view(f"V{self.length}").ravel()


def search(sorted_rows: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """For each row, its place among sorted rows by binary search (all rows at once), or -1 where it is not there."""
    s, r = sorted_rows.view(np.uint8).reshape(-1, length), rows.view(np.uint8).reshape(-1, length)
    width = -length % 8
    big = lambda x: np.pad(x, ((0, 0), (0, width))).view(">u8").astype(np.uint64)
    s, r = big(s), big(r)
    lo, hi = np.zeros(len(r), np.int64), np.full(len(r), len(s), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        probe = s[np.minimum(mid, len(s) - 1)]
        differ = probe != r
        k = differ.argmax(1)
        take = np.arange(len(r))
        less = differ.any(1) & (probe[take, k] < r[take, k]) & open_
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    ok = lo < len(s)
    ok[ok] = (s[lo[ok]] == r[ok]).all(1)
    return np.where(ok, lo, -1)


def later_starts(one: Shard, two: Shard | None) -> tuple[np.ndarray, np.ndarray]:
    """The (doc, at) of starts that an earlier equal string precedes: within `one`, or else between `one` and `two`."""
    d1, a1 = one.earliest()
    if two is None:
        late = (d1 != one.doc) | (a1 != one.at)
        return one.doc[late], one.at[late]
    d2, a2 = two.earliest()
    if not len(d1) or not len(d2):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = []
    for mine, (d, a), (od, oa), other in ((one, (d1, a1), (d2, a2), two), (two, (d2, a2), (d1, a1), one)):
        heads = np.flatnonzero(np.concatenate(([True], other.run[1:] != other.run[:-1])))
        my_heads = np.concatenate(([True], mine.run[1:] != mine.run[:-1]))
        hit = search(other.strings()[heads], mine.strings()[my_heads], one.length)[np.cumsum(my_heads) - 1]
        k = heads[np.maximum(hit, 0)]
        late = (hit >= 0) & ((od[k] < mine.doc) | ((od[k] == mine.doc) & (oa[k] < mine.at)))
        found.append((mine.doc[late], mine.at[late]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _ranges(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(at):
        return doc, at, at
    by = np.lexsort((at, doc))
    doc, at = doc[by], at[by]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)))
    heads = np.flatnonzero(new)
    return doc[heads], at[heads], at[np.concatenate((heads[1:], [len(at)])) - 1]


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents in groups of about SLAB bytes: ids, all bytes, starts and ends."""
    ids, texts, size = [], [], 0

    def flush() -> tuple:
        octets = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        return ids, octets, ends - [len(t) for t in texts], ends

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            if len(t or b"") >= LONGEST:
                raise ValueError(f"document {i} is of {len(t)} bytes, and places go up to {LONGEST}")
            if size and size + len(t or b"") > SLAB:
                yield flush()
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1])
    if ids:
        yield flush()


ALONE, FIRST, KNOWN_TO_REPEAT = 0, 1, 2  # and greater numbers: known to repeat, with a salt


def _meetings(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How each anchor of a slab meets others (ALONE, FIRST of several here, KNOWN_TO_REPEAT plus a salt that counts on
    every TOGETHER of them), and the sorted hashes that the task now knows to repeat, a FIRST of which has been sent."""
    order = np.argsort(h, kind="stable")
    by = h[order]
    head = np.concatenate(([True], by[1:] != by[:-1]))
    several = ~(head & np.concatenate((head[1:], [True])))
    old = known[np.minimum(np.searchsorted(known, by), len(known) - 1)] == by if len(known) else np.zeros(len(by), bool)
    nth = np.arange(len(by)) - np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
    how = np.empty(len(h), np.int32)
    how[order] = np.where(old | (several & ~head), KNOWN_TO_REPEAT + nth // TOGETHER, np.where(several, FIRST, ALONE))
    new = by[head & several & ~old]
    known = np.sort(np.concatenate((known, new)) if len(known) + len(new) <= KNOWN else new[:KNOWN])
    return how, known


def _anchor_rows(length: int):
    """at: the tag << 47 | first start << 16 | starts after it << 8 | the gram's offset from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty(0, np.uint64)
        for ids, octets, starts, ends in _slabs(batches):
            doc, first, last, gram, h, c, d = anchors(octets, starts, ends, length)
            if not len(doc):
                continue
            how, known = _meetings(h, known)
            at = (d >> np.uint64(64 - TAG)).astype(np.int64) << TAG_AT | (first - starts[doc]) << 16 | (last - first) << 8 | (gram - first)
            columns = [*(pa.array(x.view(np.int64)) for x in (h, c)), pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(at), pa.array(how)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", "doc", "at", "how"])

    return run


def _contexts(length: int, most: int):
    """A row per context, with `side` null; of an anchor with more than `most` contexts, a row for the bytes on each
    side of the gram that has enough of them, `side` being their hash with the anchor's."""
    other = (length - K) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("h", "doc", "at", "side", "context")}
            for doc, text, rows in zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("rows").to_pylist()):
                for r in rows:
                    a, g = r["at"] >> 16, r["at"] & 255
                    t = text[a : a + (r["at"] >> 8 & 255) + length]
                    sides: list[int | None] = [None]
                    if r["n"] > most:
                        beside = ((b"l", t[g - other : g]) if g >= other else None, (b"r", t[g + K : g + K + other]) if g + K + other <= len(t) else None)
                        sides = [int.from_bytes(hashlib.blake2b(s[1], digest_size=8, key=s[0] + r["h"].to_bytes(8, "big", signed=True)).digest(), "big", signed=True) for s in beside if s]
                    for side in sides:
                        for k, v in zip(out, (r["h"], doc, r["at"], side, t)):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(out[k], pa.int64()) for k in list(out)[:4]], pa.array(out["context"], pa.binary())], list(out))

    return run


def _can_repeat(h: list[int], at: np.ndarray, text: list[bytes], length: int) -> np.ndarray:
    """Which contexts share, with another of their anchor, the bytes that a common string must have.

    A string around the gram holds at least half of its other length - K bytes on one side of it.
    """
    side = (length - K) // 2
    left, right = [], []
    for key, g, t in zip(h, (at & 255).tolist(), text):
        left.append((key, t[g - side : g]) if g >= side else None)
        right.append((key, t[g + K : g + K + side]) if g + K + side <= len(t) else None)
    lefts, rights = Counter(left), Counter(right)
    return np.array([(x is not None and lefts[x] > 1) or (y is not None and rights[y] > 1) for x, y in zip(left, right)], bool)


def _merge(length: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        text, at = rows.column("context").to_pylist(), rows.column("at").to_numpy()
        can = np.flatnonzero(_can_repeat(rows.column("h").to_pylist(), at, text, length))
        doc, at, first = rows.column("doc").to_numpy()[can], at[can] >> 16, rows.column("c").to_numpy()[can] == key[1].as_py()
        text = [text[k] for k in can.tolist()]
        part = lambda who: Shard([t for t, w in zip(text, who) if w], doc[who], at[who], length)
        late = (np.empty(0, np.int64),) * 2
        if len(can) > 1 and key[1] == key[2]:
            late = later_starts(part(first), None)
        elif len(can) > 1 and first.any() and not first.all():
            late = later_starts(part(first), part(~first))
        d, lo, hi = _ranges(*late)
        return pa.table({"doc": d, "r": lo << 33 | (hi - lo) << 2 | 2})

    return run


def cut(text: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the text, and the spans removed, given ranges of string starts."""
    spans: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi + length)
        else:
            spans.append([lo, hi + length])
    left, at = [], 0
    for lo, hi in spans:
        left.append(text[at:lo])
        at = hi
    return b"".join([*left, text[at:]]), [(lo, hi) for lo, hi in spans]


def _cells(contexts: DataFrame, shard: F.Column, count: F.Column) -> DataFrame:
    """Contexts dealt to (shard, chunk, chunk): one cell for up to CHUNK of a shard, else one for each pair of chunks."""
    dealt = contexts.withColumn("s", F.greatest(F.lit(1), F.ceil(count / CHUNK)).cast("int")).withColumn("c", F.pmod(F.xxhash64(F.lit(3), "doc", "at"), F.col("s")).cast("int"))
    cells = dealt.select(shard.alias("shard"), "h", "doc", "at", "context", "c", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o"))
    return cells.select("shard", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "h", "doc", "at", "context", "c")


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Over columns (doc, text): rows (doc, r) with ranges of string starts; r is first << 33 | further << 2 | kind.

    kind 0: an anchor that occurs elsewhere; kind 1: the same range when it is the earliest with its context, which
    takes it back; kind 2: starts that the suffix arrays found to be later occurrences.
    """
    # Which anchor of several in a task meets others depends on their order, so a task that runs again must see the same.
    ordered = docs.select("doc", "text").sortWithinPartitions("doc", F.xxhash64("text"))
    rows = ordered.mapInArrow(_anchor_rows(length), "h long, c long, doc long, at long, how int")
    # Anchors that are known to repeat go by their hash and a salt, exclusive-or of which is undone behind the shuffle.
    salt = F.when(F.col("how") >= KNOWN_TO_REPEAT, F.xxhash64(F.lit(9), "how")).otherwise(F.lit(0).cast("long"))
    rows = rows.select(F.col("h").bitwiseXOR(salt).alias("key"), "c", "doc", "at", "how")
    shared = rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where((F.col("how") != ALONE) | (F.col("n") > 1))
    tagged = durable(shared.select(F.col("key").bitwiseXOR(salt).alias("h"), "c", "doc", "at"))
    place = F.col("at").bitwiseAND(F.lit((1 << TAG_AT) - 1)).alias("at")
    met = tagged.select("doc", place)
    earliest = F.min(F.struct("doc", place)).alias("p")
    classes = durable(tagged.groupBy("h", "c", F.shiftright("at", TAG_AT).alias("tag")).agg(earliest).select("h", "p.doc", "p.at"))
    several = durable(classes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    contexts, most = several.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    asked = attach_spread(classes, several, "h", "n", contexts, ["doc", "at"])


    def texts_of(some: DataFrame, texts: DataFrame) -> DataFrame:
        each = texts.join(some.groupBy("doc").agg(F.collect_list(F.struct("h", "at", "n")).alias("rows")), "doc").select("doc", "text", "rows")
        return each.mapInArrow(_contexts(length, CHUNK), "h long, doc long, at long, side long, context binary")

    shards = max(1, contexts // CHUNK)
    cells = _cells(texts_of(asked.where(F.col("n") <= CHUNK), docs), F.pmod(F.xxhash64(F.lit(5), "h"), F.lit(shards)), F.lit(1))
    if contexts and most > CHUNK:
        crowd = durable(asked.where(F.col("n") > CHUNK))
        holders = durable(crowd.select("doc").distinct())
        # Texts of documents without crowded anchors do not move for them.
        maybe = set_slots(holders, "doc", holders.count(), 1, BROADCAST_BITS).test(docs, "doc").where("__maybe").drop("__maybe")
        sides = durable(texts_of(crowd, maybe))
        alike = durable(sides.groupBy("side").agg(F.count("*").alias("m")).where("m > 1"))
        total = alike.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        # Shards of the others have numbers from 0 on; these have negative ones.
        cells = cells.unionByName(_cells(attach(sides, alike, "side", "m", total), -1 - F.col("side").bitwiseAND(F.lit(2**62 - 1)), F.col("m")))
    late = cells.groupBy("shard", "i", "j").applyInArrow(_merge(length), "doc long, r long")
    first, further = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255))
    there = F.shiftleft(first, 33).bitwiseOR(F.shiftleft(further, 2))
    return met.select("doc", there.alias("r")).unionByName(classes.select("doc", there.bitwiseOR(F.lit(1)).alias("r"))).unionByName(late)


def _cut_rows(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans, sizes = [], [], []
            for text, rows in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("ranges").to_pylist()):
                rows = rows or []
                back = {r >> 33 for r in rows if r & 3 == 1}
                left, gone = cut(text, [(r >> 33, (r >> 33) + (r >> 2 & 0x7FFFFFFF)) for r in rows if r & 3 == 2 or (r & 3 == 0 and r >> 33 not in back)], length)
                kept.append(left)
                spans.append(gone)
                sizes.append(len(text))
            out = [b.column("id"), pa.array(sizes, pa.int64()), pa.array([n - len(k) for n, k in zip(sizes, kept)], pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                out += [pa.array(kept, pa.binary()), pa.array([[{"start": lo, "end": hi} for lo, hi in s] for s in spans], SPANS)]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


@dataclass(frozen=True)
class Repeated:
    """Documents (doc, n) that n > 1 rows hold, and how many such rows there are."""

    rows: DataFrame
    total: int
    documents: int


def _documents(base: DataFrame) -> tuple[DataFrame, Repeated | None]:
    """Rows (id, doc, text) whose doc tells apart all that differ in id or text, in the order of ids; and those repeated."""
    hashed = base.withColumn("h", F.xxhash64("text"))
    alike = durable(hashed.groupBy("doc").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).where("n > 1"))
    documents, total, shared = alike.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("low") != F.col("high"))).first()
    if not shared:
        return base, Repeated(alike.select("doc", "n"), total, documents) if documents else None
    # Some id has several texts: documents are numbered anew, in order of id and hash.
    pair = F.struct("doc", "h")
    counted = hashed.groupBy("doc", "h").agg(F.count("*").alias("n")).repartitionByRange("doc", "h").sortWithinPartitions("doc", "h")
    numbered = durable(counted.select(pair.alias("pair"), "n", F.monotonically_increasing_id().alias("number")))
    every = numbered.agg(F.sum("n")).first()[0]
    base = attach(hashed.select("id", "text", pair.alias("pair")), numbered, "pair", "n", every).select("id", F.col("number").alias("doc"), "text")
    several = numbered.where("n > 1").select(F.col("number").alias("doc"), "n")
    documents, total = several.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return base, Repeated(several, total, documents) if documents else None


def _once(base: DataFrame, repeated: Repeated) -> DataFrame:
    """One row for each document. Copies are put together within tasks before they move."""
    maybe = set_slots(repeated.rows, "doc", repeated.documents, 1, BROADCAST_BITS).test(base, "doc")
    either = maybe.where("__maybe").groupBy("doc").agg(F.first("text").alias("text"))
    return maybe.where("not __maybe").select("doc", "text").unionByName(either)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """One row per input row: the id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept (the bytes left,
    binary since a cut may split a character) and spans (start, end in bytes)."""
    if length < W + K - 1:
        raise ValueError(f"strings are of {W + K - 1} bytes at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A null id becomes a key of the text alone, below every id.
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**62)) - F.xxhash64(text).bitwiseAND(F.lit(2**60 - 1)))
    base, repeated = _documents(docs.select(F.col(id_col).cast("long").alias("id"), key.alias("doc"), text.alias("text")))
    once = _once(base, repeated) if repeated else base
    ranges = repeated_ranges(once.select("doc", "text"), length).groupBy("doc").agg(F.collect_list("r").alias("ranges"))
    hot = durable(repeated.rows.where(F.col("n") >= hot_from(repeated.total)).select("doc")) if repeated else None
    if hot is None or hot.isEmpty():
        joined = base.join(ranges, "doc", "left").select("id", "text", "ranges")
    else:
        # No more than a thousand documents or so; their copies stay where they are.
        there = base.join(F.broadcast(hot.join(ranges, "doc", "left")), "doc")
        rest = base.join(F.broadcast(hot), "doc", "left_anti").join(ranges, "doc", "left")
        joined = there.select("id", "text", "ranges").unionByName(rest.select("id", "text", "ranges"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start:int,end:int>>" if with_text else "")
    return joined.mapInArrow(_cut_rows(length, with_text), schema).withColumnRenamed("id", id_col)
