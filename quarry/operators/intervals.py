"""Joins of spans with spans or points, as joins on equal keys.

A span lies in one or two bins of the least width, a power of two, that is no less than its own length: its level. Of
two spans that overlap, the one of the lower level lies in one or two bins of the other's level as well, and they share
the bin in which the later of both begins. So each span goes to its own level's bins, and to those of the levels above
that the other side has, and pairs meet on (keys, level, bin). A span is sent at most twice for each level that occurs
on the other side, whatever the lengths, and spans that meet in a bin are of its size, so few of them miss each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW = 1_000  # spans that are broadcast and compared with all


def _level(start: Column, end: Column) -> Column:
    """The least k for which 2 ** k is no less than the span's length, end - start + 1."""
    return F.when(end <= start, 0).otherwise(F.length(F.bin(end - start))).cast("int")


def _sided(df: DataFrame, span: tuple[str, str], on: tuple[str, ...], side: str) -> DataFrame:
    start, end = (F.col(c).cast("long") for c in span)
    kept = df.where(start.isNotNull() & end.isNotNull() & (start <= end))
    return kept.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side), start.alias(f"{side}_start"), end.alias(f"{side}_end"), _level(start, end).alias(f"{side}_level"))


def _levels(df: DataFrame, span: tuple[str, str]) -> list[int]:
    """The levels that occur, 64 at most."""
    start, end = (F.col(c).cast("long") for c in span)
    found = df.where(start.isNotNull() & end.isNotNull() & (start <= end)).select(_level(start, end).alias("level")).distinct()
    return sorted(r["level"] for r in found.collect())


def _binned(rows: DataFrame, side: str, levels: Column) -> DataFrame:
    """A row for each bin of each of the levels that a span lies in."""
    each = rows.withColumn("__level", F.explode(levels))
    start, end = F.expr(f"shiftright({side}_start, __level)"), F.expr(f"shiftright({side}_end, __level)")
    return each.withColumn("__bin", F.explode(F.sequence(start, end)))


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: tuple[str, ...] = ()) -> DataFrame:
    """(left, right): structs of the rows whose spans, ends included, have a number in common and that agree in `on`.

    Ends are whole numbers. Spans with a null end or the end before the start overlap nothing, nor do rows with a null in
    `on`. Repeated rows meet each for itself.
    """
    sides = {"left": (left, left_span), "right": (right, right_span)}
    rows = {s: _sided(df, span, on, s) for s, (df, span) in sides.items()}
    levels = {s: _levels(df, span) for s, (df, span) in sides.items()}
    found = None
    # Pairs whose right span is of the higher level or the same, and pairs whose left one is of a higher level.
    for high, low, strict in (("right", "left", False), ("left", "right", True)):
        own = F.array(F.col(f"{high}_level"))
        above = F.filter(F.lit(levels[high]).cast("array<int>"), lambda x: (x > F.col(f"{low}_level")) if strict else (x >= F.col(f"{low}_level")))
        pairs = _binned(rows[high], high, own).join(_binned(rows[low], low, above), [*[f"__k{i}" for i in range(len(on))], "__level", "__bin"])
        pairs = pairs.where((F.col("left_start") <= F.col("right_end")) & (F.col("right_start") <= F.col("left_end")))
        # Both may lie in two bins of the level; they meet in the one where the later begins.
        pairs = pairs.where(F.col("__bin") == F.expr("shiftright(greatest(left_start, right_start), __level)")).select("left", "right")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def with_ranges(rows: DataFrame, at: str, ranges: DataFrame, start: str, end: str, keep: bool = False) -> DataFrame:
    """rows beside the other columns of each range (start to end, both included) that `at` is in; keep: also the rows that are in
    none, with nulls. No more than FEW ranges are broadcast; more meet by interval_join."""
    named = [c for c in ranges.columns if c not in (start, end)]
    if ranges.limit(FEW + 1).count() <= FEW:
        joined = rows.join(F.broadcast(ranges), F.col(at).between(F.col(start), F.col(end)), "left" if keep else "inner")
        return joined.drop(start, end)
    # Points need not meet ranges row by row: few values of `at` occur, and ranges meet those.
    points = rows.select(F.col(at).alias("__at")).where(F.col(at).isNotNull()).distinct()
    met = interval_join(points, ranges, ("__at", "__at"), (start, end)).select("left.__at", *[F.col(f"right.{c}").alias(c) for c in named])
    return rows.join(met, F.col(at) == F.col("__at"), "left" if keep else "inner").drop("__at")
