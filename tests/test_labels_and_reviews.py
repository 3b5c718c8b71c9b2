import pytest
from pyspark.sql import functions as F

from quarry.operators import citations as ci
from quarry.operators import evaluation as ev
from quarry.operators import gold as go
from quarry.operators import review as rv
from quarry.operators import validate as va
from quarry.schemas import ANSWER, CHUNK, EVIDENCE, QUESTION, TOKEN_CHUNK


def rows(spark, schema, *dicts):
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], schema)


def inputs(spark):
    questions = rows(spark, QUESTION, {"id": "q1", "question": "?"}, {"id": "q2", "question": "?"})
    answers = rows(spark, ANSWER, {"question_id": "q1", "evidence_ids": ["e2", "e1"], "annotation_status": "reviewed"}, {"question_id": "q2", "evidence_ids": [], "annotation_status": "reviewed"})
    evidence = rows(
        spark,
        EVIDENCE,
        {"evidence_id": "e1", "source_block_ids": ["b1", "b2", "b3"], "text": "t1", "review_status": "reviewed", "pdf_pages": [1]},
        {"evidence_id": "e2", "source_block_ids": ["b4"], "text": "t2", "review_status": "reviewed", "pdf_pages": [2]},
    )
    return questions, answers, evidence


def test_gold_mapping(spark):
    chunks = rows(spark, CHUNK, {"chunk_id": "c1", "strategy": "s", "text": "x", "source_block_ids": ["b1", "b1", "b9"]}, {"chunk_id": "c2", "strategy": "s", "text": "y", "source_block_ids": ["b2", "b3", "b4"]})
    got = {r.question_id: r.relevant_chunk_candidates for r in go.gold_mapping(*inputs(spark), chunks).collect()}
    assert [(c.chunk_id, c.proposed_relevance, c.evidence_ids, c.evidence_coverage) for c in got["q1"]] == [("c2", 2, ["e1", "e2"], {"e1": 0.6667, "e2": 1.0}), ("c1", 1, ["e1"], {"e1": 0.3333})]
    assert got["q2"] == []
    report = go.mapping_report(go.gold_mapping(*inputs(spark), chunks)).first()
    assert (report.questions, report.candidate_pairs, report.questions_without_candidates) == (2, 2, ["q2"])
    queue = go.gold_review_queue(go.gold_mapping(*inputs(spark), chunks), inputs(spark)[0], chunks).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.evidence_ids, r.chunk_text) for r in queue] == [("c1", "e1", "x"), ("c2", "e1|e2", "y")]


def test_fragment_coverage_threshold(spark):
    fragment = lambda b, c: (b, 0, 1, 2, c)
    chunks = rows(spark, TOKEN_CHUNK, {"chunk_id": "c", "profile": "p", "text": "x", "source_fragments": [fragment("b1", 0.4), fragment("b2", 0.5), fragment("b9", 1.0)]}, {"chunk_id": "d", "profile": "p", "source_fragments": [fragment("b4", 0.49)]})
    got = go.gold_mapping(*inputs(spark), chunks, "profile", 0.5).where("question_id = 'q1'").first().relevant_chunk_candidates
    assert [(c.chunk_id, c.matched_source_block_ids, c.source_fragment_coverage, c.proposed_relevance) for c in got] == [("c", ["b2"], {"b1": 0.4, "b2": 0.5}, 1)]
    for bad in (0, 1.1):
        with pytest.raises(ValueError):
            go.gold_mapping(*inputs(spark), chunks, "profile", bad)


def test_cited_answers_keep_order_and_missing_evidence_fails(spark):
    _, answers, evidence = inputs(spark)
    got = {r.question_id: [e.evidence_id for e in r.evidence] for r in go.cited_answers(answers, evidence).collect()}
    assert got == {"q1": ["e2", "e1"], "q2": []}
    labels = {r.question_id: [(e.evidence_id, e.relevance) for e in r.relevant_evidence] for r in go.retrieval_labels(answers, evidence).collect()}
    assert labels["q1"] == [("e2", 2), ("e1", 2)]
    with pytest.raises(Exception, match="no evidence e2"):
        go.cited_answers(answers, evidence.where("evidence_id = 'e1'")).collect()
    with pytest.raises(Exception, match="no answer"):
        go.join_required(inputs(spark)[0], answers.where("question_id = 'q1'"), "id", "question_id", "answer").collect()


CITATION = ("D", "手册", [9], [1, 2], ["s"], ["b"], "quote")
RUN = "answer string, results array<struct<id:string,score:double,citation:struct<document_id:string,document_title:string,pdf_pages:array<int>,printed_pages:array<int>,title_paths:array<string>,source_block_ids:array<string>,quote:string>>>, cited_chunk_ids array<string>"


def cite(spark, results, cited, answer=" a "):
    return ci.attach_citations(spark.createDataFrame([(answer, results, cited)], RUN)).first()


def test_citations(spark):
    r = cite(spark, [("x", 2.0, CITATION), ("y", 1.0, (None, None, None, None, [], None, None)), ("x", 0.5, CITATION)], ["y", "x", "y"])
    assert r.answer == "a"
    assert [(c.citation_number, c.chunk_id, c.section, c.retrieval_score, c.display) for c in r.citations] == [(1, "y", None, 1.0, "[1]《未知文档》页码未知"), (2, "x", "s", 0.5, "[2]《手册》第1—2页，s")]
    assert [c.chunk_id for c in cite(spark, [("x", 2.0, CITATION)], []).citations] == ["x"]
    with pytest.raises(Exception, match="were not retrieved: z"):
        cite(spark, [("x", 2.0, CITATION)], ["z"])
    with pytest.raises(Exception, match="no citation metadata: x"):
        cite(spark, [("x", 2.0, None)], ["x"])
    with pytest.raises(Exception, match="must not be empty"):
        cite(spark, [("x", 2.0, CITATION)], ["x"], "  ")


BLOCKS = "block_id string, pdf_page int, printed_page int, block_type string, text string, normalized_text string, title_path array<string>, issues array<string>, review_status string"


def test_review_queues(spark):
    blocks = spark.createDataFrame([("b1", 112, 104, "p", "t", "t", ["第2章 x"], [], "s"), ("b2", 112, 104, "p", "t", "t", ["第3章 x"], ["low_confidence"], "s"), ("b3", 200, 1, "p", "t", "t", [], ["odd", "possible_ocr_confusion"], "s"), ("b4", 200, 1, "p", "t", "t", None, [], "s")], BLOCKS)
    evidence = spark.createDataFrame([("e1", ["b1", "b2"])], "evidence_id string, source_block_ids array<string>")
    chunks = spark.createDataFrame([("c1", 10, ["b1"]), ("c2", 64, ["b3"])], "chunk_id string, token_count int, source_block_ids array<string>")
    chapters = spark.createDataFrame([(111, 128, 2)], "start_page int, end_page int, chapter int")
    got = rv.data_review_queue(blocks, evidence, chunks, chapters)
    assert [(r.priority, r.block_id, r.reasons, r.short_chunk_ids) for r in got.collect()] == [
        ("P0", "b1", "short_structural_chunk|used_by_reviewed_evidence", "c1"),
        ("P0", "b2", "suspicious_chapter_path|ocr_or_structure_issue|used_by_reviewed_evidence", ""),
        ("P1", "b3", "ocr_or_structure_issue", ""),
    ]
    assert {r.priority: r["items"] for r in rv.priority_counts(got).collect()} == {"P0": 2, "P1": 1}
    assert [(r.priority, r.block_id) for r in rv.block_review_queue(blocks).collect()] == [(1, "b3"), (3, "b2")]
    assert rv.data_review_queue(blocks.limit(0), evidence, chunks, chapters).count() == 0


def test_corrections_take_the_first_reviewed_row(spark):
    blocks = spark.createDataFrame([("b1", 1, 1, "p", "old", "old", ["t"], [], "auto_draft"), ("b2", 1, 1, "p", "keep", "keep", ["t"], [], "auto_draft")], BLOCKS)
    reviews = spark.createDataFrame([(1, "b1", "Reviewed", "no", "", ""), (2, "b1", "reviewed", " new ", " a > b ", "n"), (3, "b1", "reviewed", "late", "", ""), (4, "b2", "reviewed", " ", "", "")], "n int, block_id string, review_status string, corrected_text string, corrected_title_path string, review_note string")
    got = {r.block_id: r for r in rv.apply_corrections(blocks, reviews, "n").collect()}
    assert (got["b1"].text, got["b1"].original_text, got["b1"].title_path, got["b1"].normalized_text, got["b1"].review_status) == ("new", "old", ["a", "b"], "old", "auto_draft")
    assert (got["b2"].text, got["b2"].correction_applied) == ("keep", None)
    r = rv.correction_report(rv.apply_corrections(blocks, reviews, "n"), reviews, output_file="o").first()
    assert (r.original_blocks, r.reviewed_items, r.corrections_applied, r.output_file) == (2, 3, 1, "o")


def found(problems):
    return sorted((r["check"], r["id"]) for r in problems.collect())


def test_dataset_validator(spark):
    questions, answers, evidence = inputs(spark)
    blocks = spark.createDataFrame([("b1",), ("b2",), ("b3",), ("b4",)], "block_id string")
    labels, cited = go.retrieval_labels(answers, evidence), go.cited_answers(answers, evidence)
    assert found(va.dev_dataset(questions, answers, cited, evidence, labels, blocks)) == []
    worse = va.dev_dataset(questions.union(questions.limit(1)), answers.where("question_id = 'q1'"), cited, evidence.withColumn("review_status", F.lit("new")), labels, blocks.where("block_id <> 'b4'"))
    names = {c for c, _ in found(worse)}
    assert names == {"duplicate_question_ids", "questions_without_answers", "cited_view_without_answers", "missing_source_block_ids", "non_reviewed_evidence"}
    report = va.report(worse, sorted(names | {"unreferenced_evidence_ids"}))
    assert {r["check"]: r.n for r in report.collect()}["unreferenced_evidence_ids"] == 0
    assert va.status(report).first().status == "fail"
    assert va.status(report.limit(0)).first().status == "pass"


def test_chunk_validators(spark):
    _, answers, evidence = inputs(spark)
    citation = (None, None, [1], None, None, ["b1", "b7"], "x")
    chunks = rows(spark, TOKEN_CHUNK, {"chunk_id": "c", "text": "x", "source_block_ids": ["b1", "b7"], "pdf_pages": [1], "citation": citation, "token_count": 2, "source_fragments": [("b1", 0, 2, 2, 1.0), ("b1", 0, 1, 2, 0.7), ("b8", 0, 1, 1, 1.0)]})
    blocks = spark.createDataFrame([("b1", " ab ")], "block_id string, text string")
    candidates = [("c", ["e1"], ["b1"], {}, {"e1": 0.3}, 1), ("zz", ["e1"], ["b2"], {}, {}, 1)]
    mapping = rows(spark, "question_id string, relevant_chunk_candidates array<struct<chunk_id:string,evidence_ids:array<string>,matched_source_block_ids:array<string>,source_fragment_coverage:map<string,double>,evidence_coverage:map<string,double>,proposed_relevance:int>>, mapping_status string", {"question_id": "q1", "relevant_chunk_candidates": candidates, "mapping_status": "done"})
    assert found(va.chunk_artifacts(chunks, blocks, mapping, evidence, answers)) == [
        ("incomplete_evidence_coverage", "q1:e1"),
        ("incomplete_evidence_coverage", "q1:e2:unmapped"),
        ("invalid_candidate_chunk_ids", "zz"),
        ("missing_source_block_ids", "b7"),
        ("non_draft_mappings", "q1"),
    ]
    hashes = spark.createDataFrame([("f", "a", "b")], "file string, sha256 string, expected string")
    assert found(va.chunk_matrix(chunks, blocks, mapping, hashes)) == [("hash_mismatches", "f"), ("invalid_source_fragments", "c:b1:invalid"), ("invalid_source_fragments", "c:b8:missing"), ("invalid_token_counts", "c")]


def test_comparison(spark):
    schema = "profile string, hit_at_1 double, hit_at_5 double, hit_at_10 double, mrr double"
    a = spark.createDataFrame([("p", 0.1, 0.2, 0.3, 0.5), ("o", 0.1, 0.2, 0.3, 0.5), ("only", 1.0, 1.0, 1.0, 1.0)], schema)
    b = spark.createDataFrame([("p", 0.0, 0.0, 0.0, 0.1), ("o", 0.0, 0.0, 0.0, 0.0)], schema)
    compared = ev.compare_methods({"BM25": a, "Vector": b})
    assert {(r.method, r.profile) for r in ev.best_profile(compared).collect()} == {("BM25", "o"), ("Vector", "p")}
    assert "| o | BM25 | 0.100 | 0.200 | 0.300 | 0.500 |" in ev.comparison_table(compared)
    assert ev.best_profile(compared.limit(0)).count() == 0


def test_checks_of_one_key_come_from_one_grouping(spark, tmp_path):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (5,)], "x int")
    b = spark.createDataFrame([("2",), ("3",), ("3",), (None,)], "y string")
    got = va.reconciled({"a": (a, "x"), "b": (b, "y")}, {"a": "repeated_a", "b": "repeated_b"}, {("a", "b"): "only_a", ("b", "a"): "only_b"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    alone = va.union([va.duplicates(a, "x", "repeated_a"), va.duplicates(b, "y", "repeated_b"), va.unmatched(a, "x", b, "y", "only_a"), va.unmatched(b, "y", a, "x", "only_b")])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, alone.collect()), key=str)


def test_several_tests_of_rows_take_one_scan(spark, tmp_path):
    spark.createDataFrame([(k, k % 3) for k in range(30)], "k int, r int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = va.failing_all(df, "k", {"zero": F.col("r") == 0, "big": F.col("k") > 27, "never": F.lit(None).cast("boolean")})
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, got.collect())) == sorted([("zero", str(k)) for k in range(0, 30, 3)] + [("big", "28"), ("big", "29")])


def test_problems_are_kept_as_a_table_and_the_report_stays_small(spark, tmp_path):
    ids = spark.range(200_000).select(F.lit("many").alias("check"), F.col("id").cast("string").alias("id"))
    few = spark.createDataFrame([("few", "b"), ("few", "a"), ("few", "b"), ("few", None)], "check string, id string")
    path = str(tmp_path / "problems")
    found = {r.check: tuple(r)[1:] for r in va.write_problems(ids.unionByName(few), ["many", "few", "none"], path).collect()}
    assert found == {"many": (200_000, 200_000, "0", f"{path}/check=many"), "few": (4, 2, "a", f"{path}/check=few"), "none": (0, 0, None, None)}
    assert spark.read.parquet(f"{path}/check=many").count() == 200_000
    assert va.status(va.summary(few, ["few"])).first().status == "fail"
