"""Whole runs: a corpus from page files, and retrieval experiments over it.

Each step reads what the step before has written, so a run can be resumed and its intermediate tables inspected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as bl
from ..operators import chunks as ch
from ..operators import evaluation as ev
from ..operators import gold as go
from ..operators import retrieval as re_
from ..operators import review as rv
from ..operators import validate as va
from ..sources.files import file_hashes
from ..sources.pages import BuildConfig, page_paths, page_ranges, ranges_table


@dataclass(frozen=True)
class Corpus:
    blocks: DataFrame
    chunks: DataFrame
    token_chunks: DataFrame
    reports: DataFrame
    review_queue: DataFrame


def build_corpus(spark: SparkSession, config: BuildConfig, pages_path: str, to: str, page_spec: str, title: str = "", tokens: ch.Tokens | None = None) -> Corpus:
    """Page files to blocks, to chunks of every profile, with their reports and the review queue, as Parquet under `to`."""
    pages = bl.read_ocr_pages(spark, pages_path)
    absent = bl.missing_pages(spark.createDataFrame([(p,) for p in config.pdf_pages], "pdf_page int"), pages)
    if missing := sorted(r.pdf_page for r in absent.limit(20).collect()):
        raise FileNotFoundError(f"no page files for pages {missing}")
    # A page without a configured path starts with none.
    paths = spark.createDataFrame([(p,) for p in config.pdf_pages], "pdf_page int").join(page_paths(spark, config.initial_title_paths), "pdf_page", "left")
    blocks = _written(bl.build_blocks(pages, paths, config.chapter_titles, config.batch_id, config.printed_page_offset), f"{to}/blocks")
    ranges = ranges_table(spark, page_ranges(page_spec))
    chunks = _written(ch.fixed_windows(blocks, ranges, title=title).unionByName(ch.structural_chunks(blocks, title=title)), f"{to}/chunks")
    profiles = [ch.fixed_token_windows(blocks, ranges, size, overlap, title=title, tokens=tokens) for size, overlap in ch.TOKEN_PROFILES]
    profiles.append(ch.structural_token_chunks(blocks, ranges, title=title, tokens=tokens))
    every = profiles[0]
    for p in profiles[1:]:
        every = every.unionByName(p)
    token_chunks = _written(every, f"{to}/token_chunks")
    reports = _written(ch.profile_report(token_chunks, "profile", tokens=True), f"{to}/reports")
    return Corpus(blocks, chunks, token_chunks, reports, _written(rv.block_review_queue(blocks), f"{to}/review_queue"))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def corpus_hashes(spark: SparkSession, to: str) -> DataFrame:
    """SHA-256 of every file of a built corpus."""
    return file_hashes(spark, to).where(F.col("file").endswith(".parquet"))


def gold_labels(questions: DataFrame, answers: DataFrame, evidence: DataFrame, chunks: DataFrame, by: str = "strategy", least_coverage: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Gold candidates per question, and the queue for reviewing them."""
    mapped = go.gold_mapping(questions, answers, evidence, chunks, by, least_coverage)
    return mapped, go.gold_review_queue(mapped, questions, chunks, by)


def bm25_experiment(corpus: DataFrame, questions: DataFrame, labels: DataFrame, id_col: str, text_field: str = "text", k: int = 10, k1: float = 1.5, b: float = 0.75, experiment_id: str = "bm25") -> tuple[DataFrame, DataFrame]:
    """(runs, metrics): every question ranked over the corpus, with its judgments, and the macro averages.

    An empty corpus fails; zero-score documents fill up to k as the ranking of all documents would have them, and scores
    are ranked unrounded.
    """
    if not corpus.take(1):
        raise ValueError("corpus must not be empty")
    asked = questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    ranked = re_.bm25(re_.select_text(corpus, text_field), asked, id_col, "text", k=k, k1=k1, b=b, digits=None)
    return _experiment(ranked, questions, labels, id_col, experiment_id)


def dense_experiment(corpus: DataFrame, questions: DataFrame, labels: DataFrame, id_col: str, vector: str, question_vector: str, k: int = 10, experiment_id: str = "dense") -> tuple[DataFrame, DataFrame]:
    """(runs, metrics) by cosine of vectors that an embedding model has put beside both tables."""
    asked = questions.select(F.col("id").alias("query_id"), F.col(question_vector).alias("query_vector"))
    return _experiment(re_.dense_top_k(corpus, asked, id_col, vector, k=k), questions, labels, id_col, experiment_id)


def overlap_experiment(corpus: DataFrame, questions: DataFrame, labels: DataFrame, id_col: str, text_field: str = "text", k: int = 10, experiment_id: str = "overlap") -> tuple[DataFrame, DataFrame]:
    """(runs, metrics) of the character-overlap ranker."""
    asked = questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    ranked = re_.character_overlap_top_k(re_.select_text(corpus, text_field), asked, id_col, "text", k=k)
    return _experiment(ranked, questions, labels, id_col, experiment_id)


def _experiment(ranked: DataFrame, questions: DataFrame, labels: DataFrame, id_col: str, experiment_id: str) -> tuple[DataFrame, DataFrame]:
    runs = questions.select(F.col("id").alias("question_id")).join(re_.graded_judgments(labels), "question_id").join(re_.as_runs(ranked, "query_id", id_col), "question_id", "left")
    runs = runs.withColumn("experiment_id", F.lit(experiment_id))
    return runs, ev.evaluate_retrieval(runs)


def validate_corpus(corpus: Corpus, pages: DataFrame, expected: DataFrame, page_offset: int = -8) -> DataFrame:
    """The block validator's report."""
    names = ["array_lengths_differ", "missing_expected_tokens", "duplicate_block_ids", "duplicate_source_line_ids", "missing_source_line_ids", "unexpected_source_line_ids", "invalid_printed_page_mappings", "empty_text_blocks", "invalid_review_status"]
    return va.report(va.ocr_blocks(pages, corpus.blocks, expected, page_offset), names)
