"""Greedy segments over rows: where a fold would walk a whole document, as joins of slabs of it.

A segment begins at a group's first row, goes on as the rule allows, and where it ends the next begins; so the rows'
successors, where the next segment would begin if one began here, decide everything. Rules are

* most: a segment ends before the row with which its weights would sum up to more than the limit, however heavy its
  first row is by itself;
* least: a segment ends with the row with which its weights sum up to the limit or more.

It also ends before a row that `starts` and after one that `ends`. A group's rows are dealt to slabs by their place, SLAB
places each, whatever other rows the group has. Within slabs successors come from prefix sums by binary search, and the
segments that begin are found by doubling their steps, all rows at once in numpy. What a slab makes of a segment that is
open at its beginning depends on that segment's weight alone, and at most on as many cases as rows can still belong to
it; these cases, a few numbers a slab, are followed from slab to slab, and then every slab is marked by itself. Groups
within one slab, which nearly all are, take the one step of marking.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import durable

SLAB = 1 << 16  # places
ROWS = 1 << 17  # rows of short groups that are marked together
CLOSED = -1  # no segment is open
LISTED = 1_000_000  # slabs of long groups that are broadcast


@dataclass(frozen=True)
class Rule:
    limit: int
    least: bool = False

    def first_start(self, sums: np.ndarray, held: int) -> int:
        """Over rows with running sums: where the next segment begins if an open one has the weight `held` before them and
        no start or end comes first; len(sums) if it goes on."""
        if self.least:
            return min(int(np.searchsorted(sums, self.limit - held, "left")) + 1, len(sums))
        return int(np.searchsorted(sums, self.limit - held, "right"))


def successors(rule: Rule, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each row, where the next segment begins if one begins there (len(weights) if none does)."""
    n = len(weights)
    sums = np.cumsum(weights)
    before = sums - weights
    far = np.searchsorted(sums, before + rule.limit, "left") + 1 if rule.least else np.searchsorted(sums, before + rule.limit, "right")
    far = np.clip(far, np.arange(n) + 1, n)
    sure = np.append(np.flatnonzero(begins), n)
    return np.minimum(far, sure[np.searchsorted(sure, np.arange(n), "right").clip(max=len(sure) - 1)])


def marked(after: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Which rows are met by going on from the roots, by doubling: after k rounds all within 2**k steps."""
    n = len(after)
    out = np.zeros(n + 1, bool)
    out[roots] = True
    step = np.append(after, n)
    longest = int(np.diff(np.append(np.sort(roots), n)).max(initial=1))
    for _ in range(longest.bit_length() + 1):
        out[step[np.flatnonzero(out)]] = True
        step = step[step]
    return out[:n]


def last_and_count(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row as the beginning of a segment: where the last segment of the slab begins, and how many there are."""
    n = len(after)
    to = np.where(after < n, after, np.arange(n))
    count = (after < n).astype(np.int64)
    while (to[to] != to).any():
        count += count[to]
        to = to[to]
    return to, count + 1


def _unit_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the values of the keys change."""
    change = np.zeros(len(table), bool)
    change[:1] = True
    for k in keys:
        c = table.column(k).combine_chunks()
        one, two = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False)
        nulls = np.asarray(c.is_null())
        change[1:] |= differ | (nulls[1:] != nulls[:-1])
    return np.flatnonzero(change)


def _units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units (rows with equal keys, which come sorted), and where each unit begins."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < ROWS:
            continue
        table = pa.Table.from_batches(held)
        at = _unit_starts(table, keys)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at[:-1]
        rest = table.slice(at[-1])
        held, size = rest.to_batches(), 0  # a unit has SLAB places at most
    table = pa.Table.from_batches(held) if held else None
    if table is not None and len(table):
        yield table, _unit_starts(table, keys)


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    weights = table.column("__weight").to_numpy().astype(np.int64)
    starts, ends = (table.column(c).to_numpy().astype(bool) for c in ("__starts", "__ends"))
    return weights, starts, ends


def _begins(starts: np.ndarray, ends: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Where segments begin in any case, but for a unit's first row, where only its own `starts` is known."""
    out = starts.copy()
    out[1:] |= ends[:-1]
    out[units] = starts[units]
    return out


def _marking(keys: list[str], rule: Rule):
    """The segment numbers of rows that come sorted by the keys and place; a unit's numbers are given once it is whole."""
    names = [*keys, "__weight", "__starts", "__ends", "__held", "__before"]

    def run(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        batches = (pa.RecordBatch.from_arrays(list(c), names) for c in columns)
        for table, units in _units(batches, keys):
            weights, starts, ends = _columns(table)
            begins = _begins(starts, ends, units)
            held = pc.fill_null(table.column("__held"), CLOSED).to_numpy()[units]
            before = pc.fill_null(table.column("__before"), 0).to_numpy()[units]
            barred = begins.copy()
            barred[units] = True
            after = successors(rule, weights, barred)
            sizes = np.diff(np.append(units, len(weights)))
            # Nothing leads into the next unit, whose first row may belong to a segment of the slab before it.
            after[after >= np.repeat(units + sizes, sizes)] = len(weights)
            roots = barred.copy()
            for u in np.flatnonzero(held != CLOSED):  # slabs of long groups
                lo, hi = units[u], units[u + 1] if u + 1 < len(units) else len(weights)
                sure = np.flatnonzero(begins[lo:hi])
                first = min(rule.first_start(np.cumsum(weights[lo:hi]), int(held[u])), int(sure[0]) if len(sure) else hi - lo)
                roots[lo] = False
                if first < hi - lo:
                    roots[lo + first] = True
            out = marked(after, np.flatnonzero(roots))
            count = np.cumsum(out)
            yield pa.array(count - np.repeat(count[units] - out[units], sizes) - 1 + np.repeat(before, sizes), pa.int64())

    # Not to be evaluated for fewer rows than come: a filter on the rows may not go below it.
    number = F.arrow_udf(run, "long").asNondeterministic()
    return number(*names)


def _cases(keys: list[str], rule: Rule):
    """Per slab of a long group: running sums up to where an open segment ends in any case; what is open at the slab's
    end, and how many segments begin, if the first of them begins at each of those rows or behind the last; the same
    for a segment that begins with the slab (fresh); and the slab's weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, units in _units(batches, keys):
            weights, starts, ends = _columns(table)
            all_begin = _begins(starts, ends, units)
            out: dict[str, list] = {c: [] for c in ("sums", "first", "open", "count", "total", "last")}
            for lo, hi in zip(units, np.append(units[1:], len(weights))):
                w, begins = weights[lo:hi], all_begin[lo:hi]
                after = successors(rule, w, begins)
                last, count = last_and_count(after)
                sums = np.cumsum(w)
                open_ = sums[-1] - (sums - w)[last]
                if ends[hi - 1]:
                    open_[:] = CLOSED
                elif rule.least:
                    open_ = np.where(open_ >= rule.limit, CLOSED, open_)
                sure = np.flatnonzero(begins)
                bound = int(sure[0]) if len(sure) else hi - lo
                # Rows behind the first that no open segment can reach are of no interest, nor are those behind a start.
                far = min(bound, rule.first_start(sums, 0)) + 1
                for column, value in zip(out.values(), (sums[:far].tolist(), bound, open_[: far + 1].tolist(), count[: far + 1].tolist(), int(sums[-1]), bool(ends[hi - 1]))):
                    column.append(value)
            one = table.select(keys).take(pa.array(units))
            arrays = [pa.array(out["sums"], pa.list_(pa.int64())), pa.array(out["first"], pa.int64()), pa.array(out["open"], pa.list_(pa.int64())), pa.array(out["count"], pa.list_(pa.int64())), pa.array(out["total"], pa.int64()), pa.array(out["last"], pa.bool_())]
            sizes = np.diff(np.append(units, len(weights)))
            made = one.append_column("rows", pa.array(sizes, pa.int64()))
            for name, array in zip(out, arrays):
                made = made.append_column(name, array)
            yield from made.to_batches()

    return run


def _following(group: list[str], rule: Rule):
    """Slabs sorted within groups to (group, slab, held, before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, before = None, CLOSED, 0
        for b in batches:
            keys = list(zip(*(b.column(g).to_pylist() for g in group)))
            helds, befores = [], []
            for k, key in enumerate(keys):
                if key != current:
                    current, held, before = key, CLOSED, 0
                helds.append(held)
                befores.append(before)
                rows, opened, counts = b.column("rows")[k].as_py(), b.column("open")[k].values, b.column("count")[k].values
                first = 0
                if held != CLOSED:
                    sums = b.column("sums")[k].values.to_numpy()
                    first = min(rule.first_start(sums, held), b.column("first")[k].as_py())
                if first < rows and first < len(opened):
                    held, before = opened[first].as_py(), before + counts[first].as_py()
                else:  # the open segment goes on to the slab's end, or ends there
                    held += b.column("total")[k].as_py()
                    if b.column("last")[k].as_py() or (rule.least and held >= rule.limit):
                        held = CLOSED
            columns = [*[b.column(g) for g in group], b.column("__slab"), pa.array(helds, pa.int64()), pa.array(befores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*group, "__slab", "__held", "__before"])

    return run


def greedy_segments(rows: DataFrame, group: list[str], place: str, weight: str, rule: Rule, starts: str | None = None, ends: str | None = None) -> DataFrame:
    """rows with `segment`, the number from 0 of each row's segment in its group.

    place: whole numbers from 0 or so on that differ within a group and give its order; weight: whole numbers from 0 on;
    starts, ends: columns of booleans. All columns are dealt out and written once, but Python sees the group's and the
    numbers only; texts may come along.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False)
    slab = F.floor(F.col(place) / SLAB).cast("long")
    keys = [*group, "__slab"]
    seen = Observation()
    base = rows.withColumns({"__weight": F.col(weight).cast("long"), "__starts": flag(starts), "__ends": flag(ends), "__slab": slab})
    # Dealt and sorted before it is written, so that nothing above is computed again and nothing is dealt again.
    base = durable(base.repartition(*keys).sortWithinPartitions(*keys, place).observe(seen, F.max(F.col("__slab") != 0).alias("long")))
    nothing = F.lit(None).cast("long")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in group]
    if seen.get["long"]:
        long_groups = durable(base.where(F.col("__slab") != 0).select(*group).distinct())
        n = long_groups.count()
        few = F.broadcast(long_groups) if n <= LISTED else long_groups
        some = base.alias("b").join(few.alias("l"), same("b", "l"), "left_semi").select(*keys, place, "__weight", "__starts", "__ends")
        kinds = T.StructType([base.schema[g] for g in group])
        at = T.StructType([*kinds, T.StructField("__slab", T.LongType())])
        many = T.ArrayType(T.LongType())
        cases = T.StructType([*at, *[T.StructField(c, t) for c, t in (("rows", T.LongType()), ("sums", many), ("first", T.LongType()), ("open", many), ("count", many), ("total", T.LongType()), ("last", T.BooleanType()))]])
        cased = some.repartition(*keys).sortWithinPartitions(*keys, place).mapInArrow(_cases(keys, rule), cases)
        entries = T.StructType([*at, T.StructField("__held", T.LongType()), T.StructField("__before", T.LongType())])
        entered = durable(cased.repartition(*group).sortWithinPartitions(*keys).mapInArrow(_following(group, rule), entries))
        known = F.broadcast(entered) if entered.count() <= LISTED else entered
        on = [*same("b", "e"), F.col("b.__slab") == F.col("e.__slab")]
        base = base.alias("b").join(known.alias("e"), on, "left").select("b.*", "e.__held", "e.__before")
        base = base.repartition(*keys).sortWithinPartitions(*keys, place)
    else:
        base = base.withColumns({"__held": nothing, "__before": nothing})
    return base.withColumn("segment", _marking(keys, rule)).drop("__weight", "__starts", "__ends", "__held", "__before", "__slab")
