import numpy as np
import pytest

from quarry.operators import retrieval as re_
from quarry.operators import vector_index as vi


def frames(spark, seed, spread, n=400, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 8))
    rows = [(k, (centres[k % groups] + spread * rng.normal(size=8)).tolist()) for k in range(n)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [0.0] * 8), (1004, rows[7][1]), (1005, [3 * x for x in rows[7][1]]), (7, rows[8][1])]
    asked = [(k, rows[k * 5][1]) for k in range(30)] + [(90, [0.0] * 8), (91, None), (92, []), (93, [-x for x in rows[0][1]])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame(asked, "query_id int, query_vector array<double>")


def ranked(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 500])
@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_ranking_from_the_index_is_ranking(spark, tmp_path, k, spread):
    docs, asked = frames(spark, 3, spread)
    index = vi.VectorIndex(spark, str(tmp_path / "v"))
    vi.build_vector_index(index, docs)
    assert ranked(vi.indexed_dense_top_k(index, asked, k=k)) == ranked(re_.dense_top_k(docs, asked, k=k))


def test_clusters_that_are_too_far_are_not_read(spark, tmp_path):
    docs, asked = frames(spark, 4, 0.02)
    index = vi.VectorIndex(spark, str(tmp_path / "v"))
    vi.build_vector_index(index, docs.where("vec_id < 1000"), clusters=24)
    one = asked.where("query_id = 3")
    report = vi.search_report(index, one, k=5)
    assert report["clusters"] >= 12 and report["read"] <= 6
    everything = vi.search_report(index, asked.where("query_id < 30"), k=5)
    assert everything["pairs"] < everything["all_pairs"] / 3
    held = one.selectExpr("query_id as q", "query_vector as v")
    _, first, rest, _ = vi._search(index, held.toArrow(), held.schema["q"].dataType, 5, 6)
    assert not first.wanted.keys() & rest.wanted.keys()  # one query, so no cluster is read for it twice
    plan = index.vectors().where(first.filter())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan
    assert ranked(vi.indexed_dense_top_k(index, one, k=5)) == ranked(re_.dense_top_k(docs.where("vec_id < 1000"), one, k=5))


def test_queries_in_several_rounds_and_none(spark, tmp_path, monkeypatch):
    docs, asked = frames(spark, 5, 0.3)
    index = vi.VectorIndex(spark, str(tmp_path / "v"))
    vi.build_vector_index(index, docs, clusters=3)
    expected = ranked(re_.dense_top_k(docs, asked))
    monkeypatch.setattr(vi, "QUERY_BLOCK", 300)
    monkeypatch.setattr(vi, "BATCH_ROWS", 17)
    assert ranked(vi.indexed_dense_top_k(index, asked)) == expected
    assert vi.indexed_dense_top_k(index, asked.limit(0)).count() == 0


def test_centres_are_means(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(50, 2)) * 0.01 + c for c in ([0, 5], [5, 0])])
    centres = vi.moved_centres(points[[0, 50, *range(100)]], 2)
    assert np.allclose(sorted(centres.round(1).tolist()), [[0, 5], [5, 0]], atol=0.1)


def test_a_filter_over_very_many_clusters_is_a_condition_as_any_other(spark):
    many = range(vi.NOWHERE, vi.MOST)
    wanted = {c: np.array([0, 1]) for c in many if c % 3}
    wanted[vi.NOWHERE] = np.array([0])
    low = {c: np.array([0.2 + c / 10_000, 0.3 + c / 10_000])[: len(q)] for c, q in wanted.items()}
    high = {c: x + 0.05 for c, x in low.items()}
    rows = spark.range(len(many) * 20).selectExpr(f"cast(id % {len(many)} + {vi.NOWHERE} as int) as cluster", f"floor(id / {len(many)}) / 20D as distance")
    found = {(r.cluster, r.distance) for r in rows.where(vi._Reading(wanted, low, high).filter()).collect()}
    assert found == {(c, d / 20) for c in wanted for d in range(20) if low[c].min() <= d / 20 <= high[c].max()}


def test_spans_are_joined_and_bounded():
    assert vi._union([(0.5, 0.7), (0.1, 0.2), (0.6, 0.9), (0.2, 0.3)]) == [(0.1, 0.3), (0.5, 0.9)]
    assert vi._union([(k, k + 0.5) for k in range(vi.SPANS + 1)]) == [(0, vi.SPANS + 0.5)]
