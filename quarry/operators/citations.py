"""User-facing citations from what was retrieved, and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import USER_CITATION


def user_citations(results: Column, cited: Column | None = None) -> Column:
    """Citations of an array of results (id, score, citation) for the ids cited, numbered in the order cited.

    Without cited ids, or with none, all results are cited. Of results with one id the last counts, at the first's
    place. An id that was not retrieved, and a result without citation metadata, fail the query.
    """
    retrieved = F.array_distinct(F.transform(results, lambda r: r["id"].cast("string")))
    asked = retrieved if cited is None else F.when(F.size(F.coalesce(cited, F.array().cast("array<string>"))) > 0, F.array_distinct(cited)).otherwise(retrieved)
    missing = F.array_except(asked, retrieved)

    def one(chunk_id: Column, i: Column) -> Column:
        row = F.element_at(F.filter(results, lambda r: r["id"].cast("string") == chunk_id), -1)
        source, number = row["citation"], (i + 1)
        section = F.get(source["title_paths"], F.lit(0))
        display = F.concat(
            F.lit("["), number.cast("string"), F.lit("]《"), F.coalesce(source["document_title"], F.lit("未知文档")), F.lit("》"), tx.page_label(source["printed_pages"]), F.coalesce(F.concat(F.lit("，"), section), F.lit(""))
        )
        made = F.struct(
            number.alias("citation_number"),
            chunk_id.alias("chunk_id"),
            source["document_id"].alias("document_id"),
            source["document_title"].alias("document_title"),
            section.alias("section"),
            F.coalesce(source["printed_pages"], F.array().cast("array<int>")).alias("printed_pages"),
            F.coalesce(source["pdf_pages"], F.array().cast("array<int>")).alias("pdf_pages"),
            source["quote"].alias("quote"),
            row["score"].cast("double").alias("retrieval_score"),
            display.alias("display"),
        )
        no_source = F.raise_error(F.concat(F.lit("retrieved chunk has no citation metadata: "), chunk_id))
        return F.when(source.isNull(), no_source.cast(USER_CITATION[6:-1])).otherwise(made)

    unknown = F.raise_error(F.concat(F.lit("citation ids were not retrieved: "), F.array_join(missing, ", ")))
    return F.when(F.size(missing) > 0, unknown.cast(USER_CITATION)).otherwise(F.transform(asked, one))


def attach_citations(runs: DataFrame, answer: str = "answer", results: str = "results", cited: str | None = "cited_chunk_ids") -> DataFrame:
    """Runs with the stripped answer and its citations; a blank answer fails the query."""
    text = tx.strip(F.col(answer))
    checked = F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("answer must not be empty")).cast("string")).otherwise(text)
    return runs.withColumns({answer: checked, "citations": user_citations(F.col(results), F.col(cited) if cited else None)})
