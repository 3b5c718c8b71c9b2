"""Gold labels: from answers and evidence to relevant chunks.

Overlap of block sets is an equi-join on block ids, so cost follows the matches, not questions x evidence x chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CANDIDATES


def last_by(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the last by `order` (or any, if rows of a key are alike)."""
    if order is None:
        return df.dropDuplicates([key])
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def required(value: Column, message: Column) -> Column:
    """The value, or a failing query where it is null."""
    return F.when(value.isNull(), F.raise_error(message)).otherwise(value)


def join_required(left: DataFrame, right: DataFrame, left_key: str, right_key: str, what: str) -> DataFrame:
    """An inner join in which a missing partner fails the query."""
    keyed = right.withColumn("_right", F.col(right_key))
    joined = left.join(keyed.drop(right_key) if left_key == right_key else keyed, left[left_key] == keyed["_right"], "left")
    return joined.withColumn("_right", F.when(F.col("_right").isNull(), F.raise_error(F.concat(F.lit(f"no {what} for "), left[left_key].cast("string")))).otherwise(F.col("_right").cast("string"))).where("_right is not null").drop("_right")


def expand_evidence(answers: DataFrame, evidence: DataFrame, fields: list[Column]) -> DataFrame:
    """(question_id, items): per answer its evidence in the answer's order; missing evidence fails the query."""
    each = answers.select("question_id", F.posexplode_outer("evidence_ids").alias("pos", "evidence_id"))
    item = F.when(F.col("e.evidence_id").isNull() & F.col("a.evidence_id").isNotNull(), F.raise_error(F.concat(F.lit("no evidence "), F.col("a.evidence_id"))).cast(_struct_type(evidence, fields))).otherwise(F.struct(*fields))
    joined = each.alias("a").join(evidence.alias("e"), F.col("a.evidence_id") == F.col("e.evidence_id"), "left").select("question_id", "pos", item.alias("item"))
    rows = joined.groupBy("question_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "item")))).alias("r"))
    return rows.select("question_id", F.transform("r", lambda x: x["item"]).alias("items"))


def _struct_type(evidence: DataFrame, fields: list[Column]):
    return evidence.alias("e").select(F.struct(*fields).alias("x")).schema["x"].dataType


def cited_answers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answers with their expanded evidence."""
    names = ("evidence_id", "document_id", "pdf_pages", "printed_pages", "title_path", "source_block_ids")
    fields = [*[F.col(f"e.{n}").alias(n) for n in names], F.col("e.text").alias("reference_text"), F.col("e.review_status").alias("review_status")]
    return answers.join(expand_evidence(answers, evidence, fields).withColumnRenamed("items", "evidence"), "question_id")


def retrieval_labels(answers: DataFrame, evidence: DataFrame, relevance: int = 2) -> DataFrame:
    """answers' evidence as graded labels."""
    fields = [F.col("e.evidence_id").alias("evidence_id"), F.lit(relevance).alias("relevance"), F.col("e.pdf_pages").alias("pdf_pages")]
    return expand_evidence(answers, evidence, fields).select("question_id", F.col("items").alias("relevant_evidence"), F.lit("reviewed").alias("annotation_status"))


def gold_mapping(questions: DataFrame, answers: DataFrame, evidence: DataFrame, chunks: DataFrame, by: str = "strategy", least_coverage: float | None = None, strategies: list[str] | None = None) -> DataFrame:
    """One row per question and strategy (or profile) with its candidate chunks.

    Without a list of the strategies, the chunks are gone through once more for it.

    A chunk is a candidate if it shares a block with the question's evidence; with least_coverage (in (0, 1]) only
    fragments that cover so much of their block count. Relevance is 2 if some evidence is covered by half, else 1.
    """
    if least_coverage is not None and not 0 < least_coverage <= 1:
        raise ValueError("the least coverage must be in (0, 1]")
    wanted = questions.select(F.col("id").alias("question_id")).join(answers.select("question_id", F.explode("evidence_ids").alias("evidence_id")).distinct(), "question_id")
    blocks = evidence.select("evidence_id", F.size(F.array_distinct("source_block_ids")).alias("gold"), F.explode(F.array_distinct("source_block_ids")).alias("block_id"))
    gold = wanted.join(blocks, "evidence_id")
    if least_coverage is None:
        held = chunks.select(by, "chunk_id", F.explode(F.array_distinct("source_block_ids")).alias("block_id")).withColumns({"coverage": F.lit(1.0), "counts": F.lit(True)})
    else:
        each = chunks.select(by, "chunk_id", F.posexplode("source_fragments").alias("pos", "f"))
        held = each.groupBy(by, "chunk_id", F.col("f.block_id").alias("block_id")).agg(F.max_by("f.coverage", "pos").alias("coverage"))
        held = held.withColumn("counts", F.col("coverage") >= least_coverage)
    met = gold.join(held, "block_id").groupBy(by, "question_id", "chunk_id", "evidence_id", "gold").agg(
        F.array_sort(F.collect_list(F.when(F.col("counts"), F.col("block_id")))).alias("matched"), F.collect_list(F.struct("block_id", "coverage")).alias("fragments")
    )
    met = met.where(F.size("matched") > 0).withColumn("share", F.size("matched") / F.col("gold"))
    fragments = F.array_sort(F.array_distinct(F.flatten(F.collect_list("fragments"))))
    pairs = met.groupBy(by, "question_id", "chunk_id").agg(
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("matched_source_block_ids"),
        (F.map_from_entries(fragments) if least_coverage is not None else F.expr("cast(map() as map<string,double>)")).alias("source_fragment_coverage"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("evidence_id", F.round("share", 4).alias("share"))))).alias("evidence_coverage"),
        F.max(F.when(F.col("share") >= 0.5, 2).otherwise(1)).alias("proposed_relevance"),
    )
    fields = ("chunk_id", "evidence_ids", "matched_source_block_ids", "source_fragment_coverage", "evidence_coverage", "proposed_relevance")
    ordered = F.row_number().over(Window.partitionBy(by, "question_id").orderBy(F.desc("proposed_relevance"), "chunk_id"))  # T4
    rows = pairs.withColumn("n", ordered).groupBy(by, "question_id").agg(F.collect_list(F.struct("n", F.struct(*fields).alias("c"))).alias("r"))
    in_order = F.array_sort("r", lambda a, b: a["n"] - b["n"])  # by the number alone: maps have no order
    listed = rows.select(by, "question_id", F.transform(in_order, lambda x: x["c"]).alias("relevant_chunk_candidates"))
    named = chunks.select(by).distinct() if strategies is None else questions.sparkSession.createDataFrame([(s,) for s in strategies], f"{by} string")
    every = questions.select(F.col("id").alias("question_id")).crossJoin(F.broadcast(named))  # strategies are a handful
    empty = F.expr(f"cast(array() as {CANDIDATES})")
    return every.join(listed, [by, "question_id"], "left").select("question_id", by, F.coalesce("relevant_chunk_candidates", empty).alias("relevant_chunk_candidates"), F.lit("draft_pending_human_review").alias("mapping_status"))


def gold_review_queue(mappings: DataFrame, questions: DataFrame, chunks: DataFrame, by: str = "strategy") -> DataFrame:
    """One row per candidate for human review, with H11 joins and the H13 JSON cell."""
    each = mappings.select(by, "question_id", F.explode("relevant_chunk_candidates").alias("c"))
    named = each.select(by, "question_id", "c.*").join(questions.select(F.col("id").alias("question_id"), "question"), "question_id").join(chunks.select(by, "chunk_id", F.col("text").alias("chunk_text")), [by, "chunk_id"])
    return named.select(
        by,
        "question_id",
        "chunk_id",
        F.array_join("evidence_ids", "|").alias("evidence_ids"),
        F.to_json("evidence_coverage").alias("evidence_coverage"),
        "proposed_relevance",
        F.lit("pending").alias("review_status"),
        F.lit("").alias("final_relevance"),
        "question",
        "chunk_text",
        F.lit("").alias("review_note"),
    )


def mapping_report(mappings: DataFrame, by: str = "strategy") -> DataFrame:
    n = F.size("relevant_chunk_candidates")
    return mappings.groupBy(by).agg(F.count("*").alias("questions"), F.sum(n).alias("candidate_pairs"), F.array_sort(F.collect_list(F.when(n == 0, F.col("question_id")))).alias("questions_without_candidates"))
