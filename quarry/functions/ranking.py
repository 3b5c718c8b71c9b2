"""Ranking metrics of one query as Column expressions.

Ranked and relevant are arrays of string ids. recall and hit cut at k before they drop repeats; reciprocal rank and
nDCG drop repeats first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("k must be a positive integer")
    return k


def _top(ranked: Column, k: int) -> Column:
    return F.array_distinct(F.slice(ranked, 1, check_k(k)))


def recall_at_k(relevant: Column, ranked: Column, k: int) -> Column:
    distinct = F.array_distinct(relevant)
    found = F.size(F.array_intersect(distinct, _top(ranked, k)))
    return F.when(F.size(distinct) > 0, found / F.size(distinct)).otherwise(0.0)


def hit_at_k(relevant: Column, ranked: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(relevant, _top(ranked, k)), F.lit(False)).cast("double")


def first_relevant_rank(relevant: Column, ranked: Column) -> Column:
    """1-based, null if nothing relevant is ranked."""
    places = F.transform(F.array_distinct(ranked), lambda x, i: F.when(F.array_contains(relevant, x), i + 1))
    return F.array_min(F.array_compact(places))


def reciprocal_rank(relevant: Column, ranked: Column) -> Column:
    return F.coalesce(1.0 / first_relevant_rank(relevant, ranked), F.lit(0.0))


def _gain(grades: Column) -> Column:
    terms = F.transform(grades, lambda g, i: (F.pow(F.lit(2.0), g) - 1.0) / F.log2(i + 2))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def ndcg_at_k(grades: Column, ranked: Column, k: int) -> Column:
    """grades: a map of id to grade, all graded ids included."""
    values = F.transform(F.map_values(grades), lambda g: g.cast("double"))
    ideal = _gain(F.slice(F.sort_array(values, asc=False), 1, check_k(k)))
    mine = F.transform(F.slice(F.array_distinct(ranked), 1, k), lambda x: F.coalesce(F.try_element_at(grades, x).cast("double"), F.lit(0.0)))
    return F.when(F.coalesce(F.array_max(values), F.lit(0.0)) > 0, F.try_divide(_gain(mine), ideal)).otherwise(0.0)


def binary_grades(relevant: Column) -> Column:
    """Grade 1 for each relevant id."""
    return F.map_from_entries(F.transform(F.array_distinct(relevant), lambda x: F.struct(x, F.lit(1.0))))
