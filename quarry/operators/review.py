"""Human review: queues and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .intervals import with_ranges

# The urgency of issue flags.
ISSUE_PRIORITY = {"possible_ocr_confusion": 1, "table_layout_requires_review": 1, "inside_table_candidate": 2, "low_confidence": 3, "header_chapter_number_missing": 4}
OTHER_PRIORITY = 9
HIGH_RISK = ("suspicious_chapter_path", "short_structural_chunk", "ocr_or_structure_issue")


def block_review_queue(blocks: DataFrame) -> DataFrame:
    """Blocks with issues, most urgent first."""
    urgency = F.create_map(*[F.lit(x) for pair in ISSUE_PRIORITY.items() for x in pair])
    priority = F.array_min(F.transform("issues", lambda i: tx.lookup(urgency, i, F.lit(OTHER_PRIORITY))))
    rows = blocks.where(F.size("issues") > 0).select(
        priority.alias("priority"), "block_id", "pdf_page", "printed_page", "block_type", F.array_join("issues", "|").alias("issues"), "text", F.lit("pending").alias("review_status"), F.lit("").alias("corrected_text"), F.lit("").alias("review_note")
    )
    return rows.orderBy("priority", "pdf_page", "block_id")


def data_review_queue(blocks: DataFrame, evidence: DataFrame, chunks: DataFrame, chapters: DataFrame, short_tokens: int = 64, image_pattern: str = "page_%03d.png") -> DataFrame:
    """Blocks whose review can change chunks or gold labels, most urgent first.

    chapters (start_page, end_page, chapter) says which chapter a page should be in. Evidence and chunks are grouped by
    block before they meet the blocks.
    """
    used = evidence.select(F.explode("source_block_ids").alias("block_id"), "evidence_id").groupBy("block_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
    short = chunks.where(F.col("token_count") < short_tokens).select(F.explode("source_block_ids").alias("block_id"), "chunk_id")
    short = short.groupBy("block_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("short_chunk_ids"))
    expected = with_ranges(blocks, "pdf_page", chapters.select("start_page", "end_page", "chapter"), "start_page", "end_page", keep=True)  # F7
    joined = expected.join(used, "block_id", "left").join(short, "block_id", "left")
    path = F.coalesce("title_path", F.array().cast("array<string>"))
    named = F.transform(path, lambda s: F.nullif(F.regexp_extract(s, r"(?U)^第(\d+)章", 1), F.lit("")).cast("int"))
    observed = F.array_distinct(F.array_compact(named))  # F8
    suspicious = F.col("chapter").isNotNull() & (F.size(observed) > 0) & (F.size(F.array_except(observed, F.array("chapter"))) > 0)
    issues = F.coalesce("issues", F.array().cast("array<string>"))
    reasons = F.array_compact(
        F.array(
            F.when(suspicious, "suspicious_chapter_path"),
            F.when(F.col("short_chunk_ids").isNotNull(), "short_structural_chunk"),
            F.when(F.size(issues) > 0, "ocr_or_structure_issue"),
            F.when(F.col("evidence_ids").isNotNull(), "used_by_reviewed_evidence"),
        )
    )
    risky = F.arrays_overlap("r", F.array(*[F.lit(x) for x in HIGH_RISK]))
    rows = joined.withColumn("r", reasons).where(F.size("r") > 0)
    priority = F.when(risky & F.col("evidence_ids").isNotNull(), "P0").when(risky | F.col("evidence_ids").isNotNull(), "P1").otherwise("P2")  # F9
    cell = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return rows.select(
        priority.alias("priority"),
        "pdf_page",
        "printed_page",
        "block_id",
        "block_type",
        cell("r").alias("reasons"),
        cell(issues).alias("issues"),
        cell("evidence_ids").alias("evidence_ids"),
        cell("short_chunk_ids").alias("short_chunk_ids"),
        F.array_join(path, " > ").alias("title_path"),
        "text",
        F.format_string(image_pattern, "pdf_page").alias("page_image"),
        F.lit("pending").alias("review_status"),
        *[F.lit("").alias(c) for c in ("corrected_text", "corrected_title_path", "review_note")],
    ).orderBy("priority", "pdf_page", "block_id")


def priority_counts(queue: DataFrame) -> DataFrame:
    """A12."""
    return queue.groupBy("priority").agg(F.count("*").alias("items"))


def first_reviewed(reviews: DataFrame, key: str, order: str, status: str = "review_status", accepted: str = "reviewed") -> DataFrame:
    """The first row per key, in queue order, whose status is exactly `accepted`."""
    rows = reviews.where(F.col(status) == accepted)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def apply_corrections(blocks: DataFrame, reviews: DataFrame, order: str) -> DataFrame:
    """Blocks with corrected text and title path where the first reviewed row has them.

    normalized_text and review_status stay as they were. A corrected title path is split at " > ".
    """
    first = first_reviewed(reviews, "block_id", order).select("block_id", tx.strip(F.col("corrected_text")).alias("_text"), tx.strip(F.col("corrected_title_path")).alias("_path"), F.col("review_note").alias("_note"))
    joined = blocks.join(first, "block_id", "left")
    new, path = F.nullif("_text", F.lit("")), F.nullif("_path", F.lit(""))
    changed = {
        "correction_applied": F.when(new.isNotNull(), True),
        "original_text": F.when(new.isNotNull(), F.col("text")),
        "review_note": F.when(new.isNotNull(), F.coalesce("_note", F.lit(""))),
        "text": F.coalesce(new, "text"),
        "title_path": F.coalesce(F.split(path, " > "), "title_path"),
    }
    return joined.withColumns(changed).drop("_text", "_path", "_note")


def correction_report(corrected: DataFrame, reviews: DataFrame, blocks_file: str = "", reviews_file: str = "", output_file: str = "") -> DataFrame:
    """V5: one row."""
    blocks = corrected.agg(F.count("*").alias("original_blocks"), F.count_if("correction_applied").alias("corrections_applied"))
    items = reviews.agg(F.count_if(F.col("review_status") == "reviewed").alias("reviewed_items"))
    files = [F.lit(output_file).alias("output_file"), F.struct(F.lit(blocks_file).alias("blocks"), F.lit(reviews_file).alias("review_queue")).alias("input_files")]
    return blocks.crossJoin(items).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "original_blocks", "reviewed_items", "corrections_applied", *files)
