import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as re_


def docs(spark, *texts, first=0):
    return spark.createDataFrame([(k + first, t) for k, t in enumerate(texts)], "doc_id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def ranking(df):
    return [(r.query_id, r.doc_id, r.score) for r in df.orderBy("query_id", "rank").collect()]


def test_bm25_against_plain_rule(spark):
    texts, query = ["g01 x20 g01", "g01 m03", "m03 m03 z1", "刀具补偿 g01", ""], "g01 m03 刀具 g01"
    tokens = [["g01", "x20", "g01"], ["g01", "m03"], ["m03", "m03", "z1"], ["g01", "刀", "具", "补", "偿", "刀具", "具补", "补偿"], []]
    mean = sum(map(len, tokens)) / 5
    expected = {}
    for k, doc in enumerate(tokens):
        score = 0.0
        for term, qtf in Counter(["g01", "m03", "g01", "刀", "具", "刀具"]).items():
            df = sum(term in d for d in tokens)
            tf = doc.count(term)
            if tf:
                score += qtf * math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(doc) / mean))
        expected[k] = score
    assert {d for _, d, _ in ranking(re_.bm25(docs(spark, *texts), asked(spark, query), keep_zero=False))} == {d for d, s in expected.items() if s}
    exact = ranking(re_.bm25(docs(spark, *texts), asked(spark, query), digits=None))
    assert [d for _, d, _ in exact] == sorted(expected, key=lambda d: (-expected[d], str(d))) and [s for *_, s in exact] == pytest.approx([expected[d] for _, d, _ in exact], abs=1e-12)
    got = ranking(re_.bm25(docs(spark, *texts), asked(spark, query)))
    assert {d: s for _, d, s in got} == pytest.approx(expected, abs=1e-7)
    assert [d for _, d, _ in got] == sorted(expected, key=lambda d: (-round(expected[d], 8), str(d)))


def test_ties_go_by_id_as_text_and_zeros_fill_up(spark):
    df = docs(spark, "a b", "a b", first=9)  # ids 9 and 10
    assert [d for _, d, _ in ranking(re_.bm25(df, asked(spark, "a")))] == [10, 9]
    got = ranking(re_.bm25(docs(spark, "a", "q", "r"), asked(spark, "a"), k=2))
    assert [(d, s > 0) for _, d, s in got] == [(0, True), (1, False)]
    assert ranking(re_.bm25(docs(spark, "a"), asked(spark, "zz"), k=5)) == [(0, 0, 0.0)]


def test_unrounded_scores_decide_below_the_eighth_place(spark, monkeypatch):
    """With b next to nothing, the longer of two documents scores less by less than a hundred-millionth."""
    df = docs(spark, "a " + "c " * 3, "a", "b")
    rounded, exact = (ranking(re_.bm25(df, asked(spark, "a"), b=1e-9, keep_zero=False, digits=n)) for n in (8, None))
    assert [d for _, d, _ in rounded] == [0, 1] and [d for _, d, _ in exact] == [1, 0]


def test_empty_tables(spark):
    assert re_.bm25(docs(spark, "a").limit(0), asked(spark, "a")).count() == 0
    assert re_.bm25(docs(spark, "a"), asked(spark, "a").limit(0)).count() == 0
    with pytest.raises(ValueError):
        re_.bm25(docs(spark, "a"), asked(spark, "a"), k=0)


def test_dense_top_k_takes_ties_by_id_and_skips_empty_vectors(spark):
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (9, [2.0, 0.0]), (3, [0.0, 1.0]), (4, []), (5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, [])], "query_id long, query_vector array<float>")
    got = re_.dense_top_k(vectors, queries, k=3).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(1, 10, 1.0), (1, 9, 1.0), (1, 3, 0.0)]
    assert re_.dense_top_k(vectors, queries.limit(0)).count() == 0


def test_dense_rounds_give_the_same(spark, monkeypatch):
    vectors = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 2)).alias("embedding"))
    queries = vectors.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    one = sorted(map(tuple, re_.dense_top_k(vectors, queries, k=4).collect()))
    monkeypatch.setattr(re_, "BATCH_ROWS", 7)
    for name in ("QUERY_BLOCK", "SCORE_BLOCK"):
        monkeypatch.setattr(re_, name, 100)
        assert sorted(map(tuple, re_.dense_top_k(vectors, queries, k=4).collect())) == one


def test_ranking_in_blocks_gives_the_same(spark, monkeypatch):
    texts = docs(spark, *[f"g{k % 5} m{k % 3} 刀具 x{k} " * (1 + k % 4) for k in range(40)])
    some = asked(spark, *[f"g{k % 7} x{k} 刀" for k in range(25)])
    rankers = [re_.bm25, lambda d, q: re_.bm25(d, q, digits=None), re_.character_overlap_top_k]
    whole = [sorted(map(tuple, r(texts, some).collect())) for r in rankers]
    monkeypatch.setattr(re_, "BATCH_ROWS", 7)
    for name, value in (("QUERY_BLOCK", 600), ("SCORE_BLOCK", 200)):
        monkeypatch.setattr(re_, name, value)
        for ranker, one in zip(rankers, whole):
            for got, expected in zip(sorted(map(tuple, ranker(texts, some).collect())), one, strict=True):
                assert got == pytest.approx(expected)


def test_character_overlap(spark):
    got = re_.character_overlap_top_k(docs(spark, "abc", "cba", "ad", "zz"), asked(spark, "abx"), k=3)
    assert ranking(got) == [(0, 0, 2), (0, 1, 2), (0, 2, 1)]


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 2.0, 1), (1, "y", 1.0, 2)], "query_id int, doc_id string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 9.0, 1), (1, "z", 3.0, 2)], "query_id int, doc_id string, score double, rank int")
    assert [d for _, d, _ in ranking(re_.reciprocal_rank_fusion(a, b, "query_id", "doc_id"))] == ["y", "x", "z"]
    assert ranking(re_.weighted_fusion(a, b, "query_id", "doc_id", 0.25)) == [(1, "y", 0.75), (1, "x", 0.25), (1, "z", 0.0)]


def test_judgments_from_either_label(spark):
    labels = spark.createDataFrame([("q", [("e1", 2, [1]), ("e1", 1, [1])])], "question_id string, relevant_evidence array<struct<evidence_id:string,relevance:int,pdf_pages:array<int>>>")
    r = re_.graded_judgments(labels).first()
    assert (r.relevant_ids, r.relevance) == (["e1", "e1"], {"e1": 1.0})
    mapped = spark.createDataFrame([("q", [("c1", 2)])], "question_id string, relevant_chunk_candidates array<struct<chunk_id:string,proposed_relevance:int>>")
    assert re_.graded_judgments(mapped).first().relevance == {"c1": 2.0}


def test_lexicon_longest_first(spark):
    table = spark.createDataFrame([("刀具补偿", "刀补;刀具半径补偿"), ("G00", "G零,机零零")], "s string, v string")
    out = re_.normalize_spoken(asked(spark, "刀具半径补偿和G零"), re_.lexicon_entries(table, "s", "v"))
    assert out.first().normalized_query == "刀具补偿和G00"


def test_metadata_filter_reaches_the_scan(spark, tmp_path, capsys):
    docs(spark, "a", "b").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "d"))
    re_.metadata_filter(spark.read.parquet(str(tmp_path / "d")), lang="en").select("doc_id").explain()
    plan = capsys.readouterr().out
    assert "EqualTo(lang,en)" in plan and "text" not in plan


def test_bm25_by_several_settings_at_once_is_bm25_by_each(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j % 7}" for j in range(k % 11))) for k in range(60)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "w0 w3"), (2, "w5 w5 w1"), (3, "none"), (4, None)], "query_id int, query string")
    monkeypatch.setattr(re_, "BATCH_ROWS", 7)
    monkeypatch.setattr(re_, "PRODUCTS", 3)
    found = re_.bm25_each(docs, asked, {"default": (1.5, 0.75), "flat": (1.5, 0.0)}, k=4)
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
    assert rows(found["default"]) == rows(re_.bm25(docs, asked, k=4))
    assert rows(found["flat"]) == rows(re_.bm25(docs, asked, k=4, b=0.0)) != rows(found["default"])


def test_a_comparison_computes_each_result_once(spark):
    from quarry.operators import evaluation as ev

    def result(profiles, mrr):
        seen = spark.sparkContext.accumulator(0)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        rows = [(p, 0.0, 0.0, 0.0, mrr) for p in profiles]
        return seen, spark.createDataFrame(rows, "profile string, hit_at_1 double, hit_at_5 double, hit_at_10 double, mrr double").mapInArrow(run, "profile string, hit_at_1 double, hit_at_5 double, hit_at_10 double, mrr double")

    (seen_a, a), (seen_b, b) = result(["p", "q", None], 0.5), result(["r", "q", None], 0.25)
    found = ev.compare_methods({"a": a, "b": b}).collect()
    assert sorted((r.profile, r.method, r.mrr) for r in found) == [("q", "a", 0.5), ("q", "b", 0.25)]
    assert (seen_a.value, seen_b.value) == (3, 3)


def _token_batch(docs, tokens):
    lists = pa.ListArray.from_arrays(np.arange(docs + 1, dtype=np.int32) * tokens, pa.array(np.arange(docs * tokens) % 50).cast(pa.string()))
    return pa.RecordBatch.from_arrays([lists], ["v"]), pa.array([str(n) for n in range(0, 50, 2)])


@pytest.mark.parametrize("pass_", ["frequencies", "postings"])
def test_memory_of_looking_up_tokens_does_not_grow_with_a_batch(pass_):
    docs = {"frequencies": 8000, "postings": 40}[pass_]
    batch, vocabulary = _token_batch(docs, 2_000_000 // docs)
    tracemalloc.start()
    if pass_ == "frequencies":
        rows = next(re_._frequencies(vocabulary)(iter([batch])))
        assert rows.column("docs")[-1].as_py() == docs and rows.column("df")[0].as_py() == docs
    else:
        assert re_._postings(batch.column("v"), vocabulary)[2].sum() == 1_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20


def test_postings_do_not_depend_on_how_tokens_are_cut(monkeypatch):
    rng = random.Random(5)
    lists = pa.array([[str(rng.randint(0, 9)) for _ in range(n)] for n in (0, 3, 40, 0, 0, 7, 1, 90, 0)], pa.list_(pa.string()))
    vocabulary = pa.array(["1", "3", "5", "7"])
    whole = re_._postings(lists, vocabulary)
    for most in (1, 7, 50):
        monkeypatch.setattr(re_, "TOKENS", most)
        for a, b in zip(whole, re_._postings(lists, vocabulary)):
            assert a.tolist() == b.tolist()
    assert [len(c) for c in re_._postings(lists.slice(0, 0), vocabulary)] == [0, 0, 0, 0]
