"""JSON lines, CSV and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEGACY_FOOTER = "Average score:"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: lenient; blank lines are skipped, a line that is no such object becomes a row of nulls."""
    return spark.read.schema(schema).json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: str, allow_legacy_footer: bool = False) -> DataFrame:
    """A line that is not a JSON object fails the query with file:line and the line's beginning."""
    bad = F.concat("file", F.lit(":"), F.col("line_number").cast("string"), F.lit(": expected a JSON object: "), F.substring("value", 1, 80))
    lines = _lines(spark, path, allow_legacy_footer)
    # The check is part of the row's value, so that no column pruning can drop it.
    parsed = lines.select(F.when(~_is_object(F.col("value")), F.raise_error(bad).cast(_struct(schema))).otherwise(F.from_json("value", schema)).alias("row"))
    return parsed.select("row.*")


def check_jsonl(spark: SparkSession, path: str, allow_legacy_footer: bool = False) -> DataFrame:
    """Columns (file, line_number, problem) of the lines that the strict reader refuses."""
    lines = _lines(spark, path, allow_legacy_footer)
    problem = F.when(~_is_json(F.col("value")), "invalid JSON").when(~_is_object(F.col("value")), "expected a JSON object")
    return lines.select("file", "line_number", problem.alias("problem")).where("problem is not null")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, value) of text files, which are read in splits: no file is a row or a task of its own.

    A first pass counts the lines of each split of each file; what is before a split in its file is a prefix sum of
    those counts, and a line's place within its split is that among the rows of its task. Both passes plan the same
    splits, as they read the same files.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(offsets, ["file", "split"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_number"), "value")


def _lines(spark: SparkSession, path: str, allow_legacy_footer: bool) -> DataFrame:
    lines = numbered_lines(spark, path).where(F.regexp_replace("value", r"(?U)\s+", "") != "")
    return lines.where(~F.ltrim("value").startswith(LEGACY_FOOTER)) if allow_legacy_footer else lines


def _is_json(value) -> F.Column:
    return F.is_valid_utf8(value) & F.try_parse_json(value).isNotNull()


def _is_object(value) -> F.Column:
    return _is_json(value) & F.ltrim(value).startswith("{")


def _struct(schema: str) -> T.DataType:
    return T.StructType.fromDDL(schema)


def write_jsonl(df: DataFrame, path: str, single_file: bool = False) -> None:
    """K1: one object per line, no footer. single_file is for exchange with other tools, not for large results."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """All strings, with or without a byte order mark before the header; empty cells are empty strings."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\0").csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("")


def write_review_csv(df: DataFrame, path: str, byte_order_mark: bool = True) -> None:
    """K3: a header and quoted cells, white space kept; the mark makes spreadsheet programs read UTF-8."""
    first, *rest = df.columns
    named = df.withColumnRenamed(first, f"﻿{first}") if byte_order_mark else df
    named.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(report: DataFrame, path: str) -> int:
    """K2: the checks as JSON; returns the exit code, 1 if any check has failed."""
    report.write.mode("overwrite").json(path)
    return int(report.where("n > 0").limit(1).count() > 0)
