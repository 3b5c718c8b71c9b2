"""Whole files: hashes, manifests, registry and PDF text (S6, S10, K6); folders for intermediate files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PDF_PAGE


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, as spark.checkpoint.dir names it.

    In local mode without that setting it is a temporary folder that goes with the process; a cluster is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named}/quarry-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="quarry-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"{made}/files"


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder, so that neither lost executors nor reuse recompute what is above."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or scratch_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files at path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def registry_entry(spark: SparkSession, path: str) -> DataFrame:
    """What a document register records of a file: its name, size in MB and SHA-256."""
    return file_hashes(spark, path).select("file", F.round(F.col("bytes") / (1024 * 1024), 2).alias("size_mb"), "sha256")


def manifest(profiles: DataFrame, hashes: DataFrame, source: DataFrame, tokenizer: DataFrame, version: str = "0.2-draft") -> DataFrame:
    """K6: one row with the source's and tokenizer's hash and each profile's file, hash and report.

    profiles: the profile report with columns profile and file; hashes, source and tokenizer: rows of file_hashes.
    """
    columns = [c for c in profiles.columns if c not in ("profile", "file")]
    entry = F.struct("file", "sha256", F.struct(*columns).alias("report"))
    each = profiles.join(hashes.select("file", "sha256"), "file", "left").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("profile", entry)))).alias("profiles"))
    one = lambda df, name: df.agg(F.first(F.struct("file", "sha256")).alias(name))
    return one(source, "source").crossJoin(one(tokenizer, "tokenizer")).crossJoin(each).select(F.lit("draft_not_for_final_thesis_experiment").alias("status"), F.lit(version).alias("version"), "source", "tokenizer", "profiles")


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(filename, page_number, text, blocks) of born-digital PDF files. Needs PyMuPDF on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pymupdf on the executors") from e
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: dict[str, list] = {"filename": [], "page_number": [], "text": [], "blocks": []}
                with pymupdf.open(stream=content, filetype="pdf") as pdf:
                    for number, page in enumerate(pdf, 1):
                        blocks = []
                        for block in page.get_text("dict")["blocks"]:
                            if block["type"] == 0:
                                spans = [s["text"] for line in block["lines"] for s in line["spans"]]
                                blocks.append({"type": "text", "bbox": [float(x) for x in block["bbox"]], "text": " ".join(spans)})
                        for column, value in zip(out.values(), (name, number, page.get_text(), blocks)):
                            column.append(value)
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    block = pa.struct([("type", pa.string()), ("bbox", pa.list_(pa.float64())), ("text", pa.string())])
    arrow = pa.schema([("filename", pa.string()), ("page_number", pa.int32()), ("text", pa.string()), ("blocks", pa.list_(block))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content").mapInArrow(run, PDF_PAGE)
