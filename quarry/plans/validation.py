"""Registered queries of the validators V1-V4: entities made of the documents' ids by rule, so that every check finds
something and no two find the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate as va
from ..operators.chunks import Tokens
from .base import LINES_SQL, line_blocks, ocr_pages, table


def _summary(problems: DataFrame, names: list[str]) -> DataFrame:
    """K2: per check how many rows and ids it found, and the first id."""
    return va.summary(problems, names).select("check", "n", F.col("n_ids").cast("int").alias("n_ids"), "first_id")


def _summary_sql(checks: dict[str, str]) -> str:
    """checks: per name a SELECT of one text column."""
    found = " UNION ALL ".join(f"SELECT '{name}' AS \"check\", id FROM ({sql}) t(id)" for name, sql in checks.items())
    names = ", ".join(f"('{n}')" for n in checks)
    return f'problems AS ({found}), names("check") AS (VALUES {names})\nSELECT "check", count(id) AS n, count(DISTINCT id)::INT AS n_ids, min(id) AS first_id FROM names LEFT JOIN problems USING ("check") GROUP BY "check"'


def _duplicates(t: str, key: str) -> str:
    return f"SELECT {key} FROM {t} GROUP BY {key} HAVING count(*) > 1"


def _unmatched(a: str, k: str, b: str, j: str) -> str:
    return f"SELECT DISTINCT {k} FROM {a} WHERE {k} NOT IN (SELECT {j} FROM {b})"


def _ids(spark: SparkSession, sf_dir: str, kept: Column, twice: Column) -> DataFrame:
    """i of the documents for which `kept` holds, some of them twice."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i")).where(kept)
    return ids.select("i", F.explode(F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("i")


def _ids_sql(kept: str, twice: str) -> str:
    return f"(SELECT i FROM ids WHERE {kept} UNION ALL SELECT i FROM ids WHERE ({kept}) AND {twice})"


IDS = "ids AS (SELECT doc_id AS i FROM documents)"


def _name(letter: str, further: int = 0) -> Column:
    return F.concat(F.lit(letter), (F.col("i") + further).cast("string"))


def _none(n: int) -> Column:
    return F.col("i") % n != 0


# V4: questions, answers, evidence, labels, the cited view and blocks.
DATASET_CHECKS = {
    "duplicate_question_ids": _duplicates("q", "id"),
    "duplicate_answer_question_ids": _duplicates("a", "question_id"),
    "duplicate_evidence_ids": _duplicates("e", "evidence_id"),
    "questions_without_answers": _unmatched("q", "id", "a", "question_id"),
    "answers_without_questions": _unmatched("a", "question_id", "q", "id"),
    "missing_evidence_ids": _unmatched("(SELECT unnest(evidence_ids) AS x FROM a)", "x", "e", "evidence_id"),
    "unreferenced_evidence_ids": "SELECT DISTINCT evidence_id FROM e WHERE evidence_id NOT IN (SELECT unnest(evidence_ids) FROM a)",
    "missing_source_block_ids": _unmatched("e", "block_id", "b", "block_id"),
    "questions_without_retrieval_labels": _unmatched("q", "id", "l", "question_id"),
    "retrieval_labels_without_questions": _unmatched("l", "question_id", "q", "id"),
    "duplicate_retrieval_question_ids": _duplicates("l", "question_id"),
    "missing_retrieval_evidence_ids": _unmatched("(SELECT unnest(ids) AS x FROM l)", "x", "e", "evidence_id"),
    "answer_label_disagreements": "SELECT question_id FROM a JOIN l USING (question_id) WHERE list_sort(evidence_ids) <> list_sort(ids)",
    "answers_without_cited_view": _unmatched("a", "question_id", "c", "question_id"),
    "cited_view_without_answers": _unmatched("c", "question_id", "a", "question_id"),
    "duplicate_cited_answer_ids": _duplicates("c", "question_id"),
    "invalid_expanded_citations": "SELECT question_id FROM c WHERE evidence_ids <> shown OR i % 10 = 0",
    "non_reviewed_answers": "SELECT question_id FROM a WHERE i % 13 = 0",
    "non_reviewed_evidence": "SELECT evidence_id FROM e WHERE i % 8 = 0",
}

DATASET_SQL = f"""WITH {IDS},
q AS (SELECT 'q' || i AS id FROM {_ids_sql("i % 7 <> 0", "i % 11 = 0")}),
a AS (SELECT i, 'q' || i AS question_id, ['e' || i, 'e' || (i + 1)] AS evidence_ids FROM {_ids_sql("i % 5 <> 0", "i % 17 = 0")}),
e AS (SELECT i, 'e' || i AS evidence_id, 'b' || i AS block_id FROM {_ids_sql("i % 6 <> 0", "i % 19 = 0")}),
l AS (SELECT 'q' || i AS question_id, CASE WHEN i % 9 = 0 THEN ['e' || i] ELSE ['e' || i, 'e' || (i + 1)] END AS ids FROM {_ids_sql("i % 4 <> 0", "i % 23 = 0")}),
c AS (SELECT i, 'q' || i AS question_id, ['e' || i, 'e' || (i + 1)] AS evidence_ids, CASE WHEN i % 14 = 0 THEN ['e' || (i + 1), 'e' || i] ELSE ['e' || i, 'e' || (i + 1)] END AS shown FROM {_ids_sql("i % 3 <> 0", "i % 29 = 0")}),
b AS (SELECT 'b' || i AS block_id FROM ids WHERE i % 10 <> 0),
{_summary_sql(DATASET_CHECKS)}"""


def validate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 with all its checks."""
    i = F.col("i")
    two = F.array(_name("e"), _name("e", 1))
    reviewed = lambda n: F.when(i % n == 0, "draft").otherwise("reviewed")
    questions = _ids(spark, sf_dir, _none(7), i % 11 == 0).select(_name("q").alias("id"))
    answers = _ids(spark, sf_dir, _none(5), i % 17 == 0).select(_name("q").alias("question_id"), two.alias("evidence_ids"), reviewed(13).alias("annotation_status"))
    evidence = _ids(spark, sf_dir, _none(6), i % 19 == 0).select(_name("e").alias("evidence_id"), F.array(_name("b")).alias("source_block_ids"), reviewed(8).alias("review_status"))
    item = lambda e: F.struct(e.alias("evidence_id"), F.lit(2).alias("relevance"))
    meant = F.when(i % 9 == 0, F.array(_name("e"))).otherwise(two)
    labels = _ids(spark, sf_dir, _none(4), i % 23 == 0).select(_name("q").alias("question_id"), F.transform(meant, item).alias("relevant_evidence"))
    shown = F.when(i % 14 == 0, F.reverse(two)).otherwise(two)
    cited = _ids(spark, sf_dir, _none(3), i % 29 == 0).select(_name("q").alias("question_id"), two.alias("evidence_ids"), F.transform(shown, lambda e: F.struct(e.alias("evidence_id"), reviewed(10).alias("review_status"))).alias("evidence"))
    blocks = _ids(spark, sf_dir, _none(10), F.lit(False)).select(_name("b").alias("block_id"))
    return _summary(va.dev_dataset(questions, answers, cited, evidence, labels, blocks), list(DATASET_CHECKS))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two blocks each; some repeat, are blank, or have a citation that differs."""
    i = F.col("i")
    text = F.when(i % 12 == 0, F.lit(" \t")).otherwise(F.concat(F.lit("text of "), i.cast("string")))
    pages = F.array((i % 50).cast("int"))
    base = _ids(spark, sf_dir, F.lit(True), i % 31 == 0).select("i", _name("c").alias("chunk_id"), text.alias("text"), F.array(_name("b"), _name("b", 1)).alias("source_block_ids"), pages.alias("pdf_pages"))
    quote, cited = F.when(i % 15 == 0, F.lit("other")).otherwise(F.col("text")), F.when(i % 21 == 0, F.array(F.lit(-1))).otherwise(F.col("pdf_pages"))
    return base.withColumn("citation", F.struct(quote.alias("quote"), "source_block_ids", cited.alias("pdf_pages")))


def _mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second question with one candidate chunk, of which some are unknown; some have none."""
    i = F.col("i")
    matched = F.when(i % 3 == 0, F.array(_name("b"), _name("b", 1))).otherwise(F.array(_name("b")))
    candidate = F.struct(F.when(i % 16 == 0, _name("x")).otherwise(_name("c")).alias("chunk_id"), F.array(_name("e")).alias("evidence_ids"), matched.alias("matched_source_block_ids"))
    rows = _ids(spark, sf_dir, i % 2 == 0, F.lit(False))
    return rows.select(
        _name("q").alias("question_id"),
        F.filter(F.array(candidate), lambda _: _none(18)).alias("relevant_chunk_candidates"),
        F.when(i % 20 == 0, "final").otherwise("draft_pending_human_review").alias("mapping_status"),
    )


CHUNK_TABLES = f"""{IDS},
c AS (SELECT i, 'c' || i AS chunk_id, CASE WHEN i % 12 = 0 THEN ' ' ELSE 'text of ' || i END AS text FROM {_ids_sql("true", "i % 31 = 0")}),
b AS (SELECT i, 'b' || i AS block_id FROM ids WHERE i % 10 <> 0),
m AS (SELECT i, 'q' || i AS question_id, i % 18 <> 0 AS has, CASE WHEN i % 16 = 0 THEN 'x' ELSE 'c' END || i AS chunk_id FROM ids WHERE i % 2 = 0)"""
CHUNK_CHECKS = {
    "duplicate_chunk_ids": _duplicates("c", "chunk_id"),
    "empty_chunks": "SELECT chunk_id FROM c WHERE trim(text) = ''",
    "invalid_citations": "SELECT chunk_id FROM c WHERE i % 15 = 0 OR i % 21 = 0",
    "questions_without_candidates": "SELECT question_id FROM m WHERE NOT has",
}
ARTIFACT_CHECKS = {
    **CHUNK_CHECKS,
    "missing_source_block_ids": "SELECT DISTINCT x FROM (SELECT 'b' || i AS x FROM c UNION ALL SELECT 'b' || (i + 1) FROM c) WHERE x NOT IN (SELECT block_id FROM b)",
    "invalid_candidate_chunk_ids": _unmatched("(SELECT * FROM m WHERE has)", "chunk_id", "c", "chunk_id"),
    "incomplete_evidence_coverage": """SELECT question_id || ':e' || i FROM m WHERE has AND i % 16 <> 0 AND i % 3 <> 0
        UNION ALL SELECT question_id || ':e' || i || ':unmapped' FROM m WHERE NOT (has AND i % 16 <> 0)
        UNION ALL SELECT question_id || ':e' || (i + 1) || ':unmapped' FROM m WHERE i % 22 = 0""",
    "non_draft_mappings": "SELECT question_id FROM m WHERE i % 20 = 0",
}

ARTIFACTS_SQL = f"WITH {CHUNK_TABLES},\n{_summary_sql(ARTIFACT_CHECKS)}"


def validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, A10."""
    i = F.col("i")
    every = lambda: _ids(spark, sf_dir, F.lit(True), F.lit(False))
    blocks = _ids(spark, sf_dir, _none(10), F.lit(False)).select(_name("b").alias("block_id"))
    evidence = every().select(_name("e").alias("evidence_id"), F.array(_name("b"), _name("b", 1)).alias("source_block_ids"))
    answers = every().select(_name("q").alias("question_id"), F.when(i % 22 == 0, F.array(_name("e"), _name("e", 1))).otherwise(F.array(_name("e"))).alias("evidence_ids"))
    return _summary(va.chunk_artifacts(_chunks(spark, sf_dir), blocks, _mappings(spark, sf_dir), evidence, answers), list(ARTIFACT_CHECKS))


MATRIX_CHECKS = {
    **CHUNK_CHECKS,
    "invalid_token_counts": "SELECT chunk_id FROM c WHERE i % 13 = 0",
    "invalid_source_fragments": "SELECT chunk_id || ':b' || i || CASE WHEN i % 10 = 0 THEN ':missing' ELSE ':invalid' END FROM c WHERE i % 10 = 0 OR i % 9 = 0 OR i % 14 = 0 OR i % 17 = 0 OR i % 19 = 0",
    "hash_mismatches": "SELECT 'f' || i FROM ids WHERE i % 25 = 0 OR i % 27 = 0",
}

MATRIX_SQL = f"WITH {CHUNK_TABLES},\n{_summary_sql(MATRIX_CHECKS)}"


def validate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: token counts, fragments' bounds and coverage, and files' hashes."""
    i = F.col("i")
    size = F.length(F.concat(F.lit("block "), i.cast("string")))
    count = F.when(i % 9 == 0, size + 1).otherwise(size)
    start, end = F.when(i % 19 == 0, -1).otherwise(1), F.when(i % 14 == 0, size + 2).otherwise(size)
    coverage = F.round((end - start) / count, 6) + F.when(i % 17 == 0, 0.001).otherwise(0.0)
    fragment = F.struct(_name("b").alias("block_id"), start.alias("block_character_start"), end.alias("block_character_end"), count.alias("block_character_count"), coverage.alias("coverage"))
    words = F.when(i % 12 == 0, 0).otherwise(3)
    chunks = _chunks(spark, sf_dir).withColumns({"token_count": F.when(i % 13 == 0, 99).otherwise(words), "source_fragments": F.array(fragment)})
    blocks = _ids(spark, sf_dir, _none(10), F.lit(False)).select(_name("b").alias("block_id"), F.concat(F.lit(" block "), i.cast("string"), F.lit("\n")).alias("text"))
    expected = F.when(i % 25 == 0, F.lit(None)).when(i % 27 == 0, F.lit("other")).otherwise(_name("s"))
    hashes = _ids(spark, sf_dir, F.lit(True), F.lit(False)).select(_name("f").alias("file"), _name("s").alias("sha256"), expected.alias("expected"))
    return _summary(va.chunk_matrix(chunks, blocks, _mappings(spark, sf_dir), hashes, Tokens(r"\S+")), list(MATRIX_CHECKS))


BLOCK_CHECKS = {
    "array_lengths_differ": "SELECT pdf_page::VARCHAR FROM pages WHERE doc_id % 70 = 0 AND pdf_page IN (SELECT page FROM wanted)",
    "missing_expected_tokens": "SELECT page || ':' || token FROM wanted LEFT JOIN pages ON pdf_page = page WHERE NOT coalesce(contains(whole, token), false)",
    "duplicate_block_ids": _duplicates("b", "block_id"),
    "duplicate_source_line_ids": _duplicates("held", "line_id"),
    "missing_source_line_ids": "SELECT line_id FROM x WHERE doc_id % 70 <> 0 AND line_id NOT IN (SELECT line_id FROM held)",
    "unexpected_source_line_ids": "SELECT DISTINCT line_id FROM held WHERE line_id NOT IN (SELECT line_id FROM x WHERE doc_id % 70 <> 0)",
    "invalid_printed_page_mappings": "SELECT block_id FROM b WHERE doc_id % 30 = 0",
    "empty_text_blocks": "SELECT block_id FROM b WHERE s % 50 = 0",
    "invalid_review_status": "SELECT block_id FROM b WHERE s % 55 = 0",
}
EXPECTED = [(1, "刀具"), (2, "FANUC数控编程手册"), (3, "nothing like this"), (200, "x")]

BLOCKS_SQL = f"""WITH {LINES_SQL},
wanted(page, token) AS (VALUES {", ".join(f"({p}, '{t}')" for p, t in EXPECTED)}),
pages AS (SELECT d.doc_id, (d.doc_id % 100 + 1)::INT AS pdf_page, whole FROM documents d LEFT JOIN (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_index) AS whole FROM raw_lines GROUP BY doc_id) USING (doc_id)),
x AS (SELECT *, doc_id + line_index AS s, format('{{}}_B{{:05d}}', document_id, line_index) AS block_id, format('{{}}_P{{:03d}}_L{{:03d}}', document_id, pdf_page, line_index) AS line_id FROM typed),
b AS (SELECT * FROM x WHERE s % 40 <> 0 UNION ALL SELECT * FROM x WHERE s % 40 <> 0 AND s % 45 = 0),
held AS (SELECT line_id FROM b UNION ALL SELECT 'ZZ' || block_id FROM b WHERE s % 60 = 0),
{_summary_sql(BLOCK_CHECKS)}"""


def validate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: blocks of one line each against the pages that they were made of."""
    pages = ocr_pages(spark, sf_dir)
    d, s = F.substring("document_id", 2, 20).cast("long"), F.col("s")
    shorter = F.transform("results", lambda r: r.withField("rec_scores", F.slice(r["rec_scores"], 1, F.size(r["rec_scores"]) - 1)))
    pages = pages.withColumn("results", F.when(d % 70 == 0, shorter).otherwise(F.col("results")))
    made = line_blocks(spark, sf_dir).withColumn("s", d + F.substring("block_id", -5, 5).cast("int")).where(s % 40 != 0)
    made = made.withColumn("again", F.explode(F.when(s % 45 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    blocks = made.select(
        "block_id",
        "pdf_page",
        (F.col("printed_page") + F.when(d % 30 == 0, 1).otherwise(0)).alias("printed_page"),
        F.when(s % 50 == 0, F.lit(" 　")).otherwise(F.col("text")).alias("text"),
        F.when(s % 60 == 0, F.concat("source_line_ids", F.array(F.concat(F.lit("ZZ"), "block_id")))).otherwise(F.col("source_line_ids")).alias("source_line_ids"),
        F.when(s % 55 == 0, "reviewed").otherwise("auto_draft").alias("review_status"),
    )
    expected = spark.createDataFrame(EXPECTED, "pdf_page int, token string")
    return _summary(va.ocr_blocks(pages, blocks, expected), list(BLOCK_CHECKS))


QUERIES = {
    "validate_blocks": (validate_blocks, BLOCKS_SQL),
    "validate_chunks": (validate_chunks, ARTIFACTS_SQL),
    "validate_matrix": (validate_matrix, MATRIX_SQL),
    "validate_dataset": (validate_dataset, DATASET_SQL),
}
