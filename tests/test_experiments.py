import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import blocks as bl
from quarry.operators import validate as va
from quarry.plans import experiments as ex
from quarry.schemas import ANSWER, EVIDENCE, QUESTION
from quarry.sources.pages import read_build_config

LINES = {
    1: ["2.1 Coordinates", "G90 selects absolute positions。", "G91 selects incremental ones。"],
    2: ["2.2 Feeds", "F sets the feed rate。", "表2-1 feeds", "F100 slow。", "F900 fast。"],
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "pages").mkdir()
    for page, texts in LINES.items():
        data = {"document_id": "D", "pdf_page": page, "pdf_index": page - 1, "elapsed_seconds": 1.0, "results": [{"rec_texts": texts, "rec_scores": [0.9] * len(texts), "rec_boxes": [[0, 0, 1, 1]] * len(texts)}]}
        (root / "pages" / f"p{page}.json").write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    config = {"document_id": "D", "batch_id": "b", "pdf_pages": [1, 2], "printed_page_offset": -8, "chapter_titles": {"2": "第2章 basics"}, "initial_title_paths": {"1": ["第2章 basics"]}, "note": "x"}
    (root / "config.json").write_text(json.dumps(config, ensure_ascii=False, indent=1), encoding="utf-8")
    made = ex.build_corpus(spark, read_build_config(spark, str(root / "config.json")), str(root / "pages"), str(root / "out"), "1-2", title="Manual")
    return root, made


def question(spark, schema, *rows):
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_corpus_is_traceable(spark, corpus):
    root, made = corpus
    assert made.blocks.count() == 8
    assert {r.strategy for r in made.chunks.select("strategy").distinct().collect()} == {"fixed", "structural"}
    assert {r.profile for r in made.token_chunks.select("profile").distinct().collect()} == {"fixed_t256_o51", "fixed_t512_o102", "fixed_t1024_o205", "structural_t512"}
    assert made.reports.count() == 4 and made.review_queue.count() == 3
    pages = bl.read_ocr_pages(spark, str(root / "pages"))
    report = ex.validate_corpus(made, pages, spark.createDataFrame([(1, "G90")], "pdf_page int, token string"))
    assert va.status(report).first().status == "pass"
    assert ex.corpus_hashes(spark, str(root / "out")).count() >= 5


def test_missing_page_files_are_named(spark, corpus):
    root, _ = corpus
    config = read_build_config(spark, str(root / "config.json"))
    config.pdf_pages.append(7)
    with pytest.raises(FileNotFoundError, match="7"):
        ex.build_corpus(spark, config, str(root / "pages"), str(root / "none"), "1-2")


def test_experiments_end_to_end(spark, corpus):
    _, made = corpus
    questions = question(spark, QUESTION, {"id": "q1", "question": "absolute G90"}, {"id": "q2", "question": "feed rate F"})
    answers = question(spark, ANSWER, {"question_id": "q1", "evidence_ids": ["e1"]}, {"question_id": "q2", "evidence_ids": ["e2"]})
    evidence = question(spark, EVIDENCE, {"evidence_id": "e1", "source_block_ids": ["D_P001_B002"]}, {"evidence_id": "e2", "source_block_ids": ["D_P002_B002"]})
    structural = made.token_chunks.where("profile = 'structural_t512'")
    labels, queue = ex.gold_labels(questions, answers, evidence, structural, "profile", 0.5)
    assert queue.count() == 2
    runs, metrics = ex.bm25_experiment(structural, questions, labels, "chunk_id", "retrieval_text")
    assert metrics.first()["answerable_queries"] == 2 and metrics.first()["recall@10"] == 1.0
    assert all(len(r.retrieved_ids) == structural.count() for r in runs.collect())
    _, simple = ex.overlap_experiment(structural, questions, labels, "chunk_id")
    assert 0 <= simple.first()["mrr"] <= 1
    vectors = structural.withColumn("v", F.array(F.length("text").cast("double"), F.lit(1.0)))
    _, dense = ex.dense_experiment(vectors, questions.withColumn("qv", F.array(F.lit(1.0), F.lit(0.0))), labels, "chunk_id", "v", "qv")
    assert dense.first()["hit@10"] == 1.0
    with pytest.raises(ValueError, match="empty"):
        ex.bm25_experiment(structural.limit(0), questions, labels, "chunk_id")
