import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import ranking as rk
from quarry.operators import evaluation as ev

SCHEMA = "question_id string, relevant_ids array<string>, retrieved_ids array<string>, relevance map<string,double>"


def metric(spark, column, rel, ranked, grades=None):
    df = spark.createDataFrame([("q", rel, ranked, grades)], SCHEMA)
    return df.select(column.alias("x")).first()["x"]


def recall(k):
    return rk.recall_at_k(F.col("relevant_ids"), F.col("retrieved_ids"), k)


def reciprocal():
    return rk.reciprocal_rank(F.col("relevant_ids"), F.col("retrieved_ids"))


def ndcg(k):
    return rk.ndcg_at_k(F.col("relevance"), F.col("retrieved_ids"), k)


def test_recall_cuts_first_and_reciprocal_rank_drops_repeats_first(spark):
    assert metric(spark, recall(3), ["a", "b"], ["x", "a", "a", "b"]) == 0.5
    assert metric(spark, recall(4), ["a", "b"], ["x", "a", "a", "b"]) == 1.0
    assert metric(spark, reciprocal(), ["a", "b"], ["x", "a", "a", "b"]) == 0.5
    assert metric(spark, reciprocal(), ["b"], ["x", "a", "a", "b"]) == pytest.approx(1 / 3)


def test_empty_sides(spark):
    for column in (recall(1), rk.hit_at_k(F.col("relevant_ids"), F.col("retrieved_ids"), 1), reciprocal()):
        assert metric(spark, column, [], ["a"]) == 0.0
        assert metric(spark, column, ["a"], []) == 0.0


def test_ndcg_grades(spark):
    got = metric(spark, ndcg(2), ["a", "b"], ["b", "a"], {"a": 2.0, "b": 1.0})
    assert got == pytest.approx((1 / math.log2(2) + 3 / math.log2(3)) / (3 / math.log2(2) + 1 / math.log2(3)))
    assert metric(spark, ndcg(2), ["a"], ["a"], {"a": 0.0}) == 0.0
    assert metric(spark, ndcg(2), ["a"], ["a"], {}) == 0.0


@pytest.mark.parametrize("k", [0, -1, True, 1.5])
def test_k_is_checked(k):
    with pytest.raises(ValueError):
        rk.check_k(k)


def test_unanswerable_queries_are_left_out(spark):
    runs = spark.createDataFrame([("1", [], ["a"], None), ("2", ["a"], ["a"], None)], SCHEMA)
    row = ev.evaluate_retrieval(runs, (1, 1)).first()
    assert (row["answerable_queries"], row["unanswerable_queries"], row["mrr"], row["hit@1"]) == (1, 1, 1.0, 1.0)
    assert ev.evaluate_retrieval(runs.where("question_id = '1'")).first()["mrr"] == 0.0
    simple = ev.evaluate_simple(runs).first()
    assert (simple["queries"], simple["mrr"], simple["hit_at_1"]) == (2, 0.5, 0.5)
    assert ev.evaluate_simple(runs.limit(0)).first()["mrr"] == 0.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=4), st.lists(st.sampled_from("abcdef"), max_size=6)), min_size=1, max_size=12))
def test_recall_grows_with_k(spark, rows):
    df = spark.createDataFrame([("q", a, b, None) for a, b in rows], SCHEMA)
    for r in df.select(*[recall(k).alias(f"k{k}") for k in (1, 2, 3, 6)]).collect():
        assert list(r) == sorted(r) and all(0 <= x <= 1 for x in r)
