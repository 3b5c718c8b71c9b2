"""The corpus pipeline: stages over documents, each of which works on all that the one before it kept.

Toxic documents go, of equal and of nearly equal documents one stays, secrets in the texts are replaced by a mark, and
what is left is packed into sequences.

Defined results: null texts count as empty, are equal to one another and stay null; a null id sorts after every other;
rows that share an id but not a text are documents of their own, and are kept or dropped each for itself; of repeated
rows (same id and text) one stays; ties between equal documents go to the smallest id, between ids to the text (by its
hash); very long texts are used whole; an empty table gives empty results with the columns of the others; all stages
but the last return the columns of documents, whatever further ones it has.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import read_table, remove, shared_dir
from quarry.llm.exact_dedup import drop_exact_duplicates
from quarry.llm.packing import pack
from quarry.llm.secrets import redact
from quarry.llm.simhash import keep_one_of_each
from quarry.llm.toxicity import drop_toxic, fit_from


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labels of rows that are not held out, drop what is likelier toxic than not."""
    return drop_toxic(docs, fit_from(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With op2's contract: four-word shingles, at most 4 differing bits, expected at a similarity of 0.96."""
    return keep_one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=False)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Model scores and packings have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is a Parquet table in the shared folder, which goes once the
    next one is written. The last one is what is returned."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        here = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            remove(spark, before)
        before = here
    return docs
