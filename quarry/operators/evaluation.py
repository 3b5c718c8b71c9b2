"""Evaluation of retrieval runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking as rk


def evaluate_retrieval(runs: DataFrame, k_values: Sequence[int] = (1, 3, 5, 10), by: str | None = None) -> DataFrame:
    """M5: macro averages over answerable queries, one row (per value of `by`).

    runs: relevant_ids, retrieved_ids and, if it has that column, relevance (a map of grades, which nDCG then uses).
    Queries without relevant ids are counted and left out.
    """
    ks = [rk.check_k(k) for k in dict.fromkeys(k_values)]
    relevant, ranked = F.coalesce("relevant_ids", F.array().cast("array<string>")), F.coalesce("retrieved_ids", F.array().cast("array<string>"))
    grades = F.coalesce(F.col("relevance"), rk.binary_grades(relevant)) if "relevance" in runs.columns else rk.binary_grades(relevant)
    answerable = F.size(relevant) > 0

    def mean(c: Column, name: str) -> Column:
        return F.coalesce(F.avg(F.when(answerable, c)), F.lit(0.0)).alias(name)

    columns = [F.count_if(answerable).alias("answerable_queries"), F.count_if(~answerable).alias("unanswerable_queries"), mean(rk.reciprocal_rank(relevant, ranked), "mrr")]
    for k in ks:
        columns += [mean(rk.recall_at_k(relevant, ranked, k), f"recall@{k}"), mean(rk.hit_at_k(relevant, ranked, k), f"hit@{k}"), mean(rk.ndcg_at_k(grades, ranked, k), f"ndcg@{k}")]
    return (runs.groupBy(by) if by else runs).agg(*columns)


def evaluate_simple(runs: DataFrame, by: str | None = None) -> DataFrame:
    """Hit at 1, 5 and 10, MRR and how many have no hit, over all queries; a query without relevant ids scores 0."""
    rank = F.coalesce(rk.first_relevant_rank(F.col("relevant_ids"), F.col("retrieved_ids")), F.lit(0))
    columns = [F.count("*").alias("queries")]
    columns += [F.coalesce(F.avg(rk.hit_at_k(F.col("relevant_ids"), F.col("retrieved_ids"), k)), F.lit(0.0)).alias(f"hit_at_{k}") for k in (1, 5, 10)]
    columns += [F.coalesce(F.avg(F.when(rank > 0, 1.0 / rank).otherwise(0.0)), F.lit(0.0)).alias("mrr"), F.count_if(rank == 0).alias("without_hit")]
    return (runs.groupBy(by) if by else runs).agg(*columns)


def compare_methods(results: dict[str, DataFrame], key: str = "profile") -> DataFrame:
    """(profile, method, hit_at_1, hit_at_5, hit_at_10, mrr) of profiles that every method has."""
    rows = [df.where(F.col(key).isNotNull()).select(key, F.lit(name).alias("method"), "hit_at_1", "hit_at_5", "hit_at_10", "mrr") for name, df in results.items()]
    # Each result is computed once; joins of their keys would compute it again.
    methods = F.size(F.collect_set("method").over(Window.partitionBy(key)))
    return reduce(DataFrame.unionByName, rows).withColumn("methods", methods).where(F.col("methods") == len(rows)).drop("methods")


def best_profile(comparison: DataFrame, key: str = "profile") -> DataFrame:
    """Per method the profile of the best MRR, the first by name on ties; no rows if there are none."""
    return comparison.groupBy("method").agg(F.min_by(key, F.struct((-F.col("mrr")).alias("m"), key)).alias(key), F.max("mrr").alias("mrr"))


def comparison_table(comparison: DataFrame, key: str = "profile") -> str:
    """K4: a Markdown table; a comparison has a row per profile and method, so it is read on the driver."""
    cell = lambda c: F.format_string("%.3f", c)
    line = F.concat_ws(" | ", key, "method", *[cell(c) for c in ("hit_at_1", "hit_at_5", "hit_at_10", "mrr")])
    rows = [r[0] for r in comparison.orderBy(key, "method").select(line).collect()]
    return "\n".join(["| profile | method | Hit@1 | Hit@5 | Hit@10 | MRR |", "|---|---|---|---|---|---|", *[f"| {r} |" for r in rows], ""])
