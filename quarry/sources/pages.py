"""Page specifications and page ranges."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def requested_pages(spec: Column, strict: bool = True) -> Column:
    """The pages that a specification like "1,3,5-8" names, in its order, each once.

    strict (P1): a reversed range, a page below 1, and a specification without pages raise. Else (P2): a reversed range
    names nothing. Empty parts are skipped.
    """
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")

    def expand(part: Column) -> Column:
        start, end = F.split_part(part, F.lit("-"), F.lit(1)).cast("int"), F.when(part.contains("-"), F.split_part(part, F.lit("-"), F.lit(2))).otherwise(part).cast("int")
        up = F.when(start <= end, F.sequence(F.least(start, end), F.greatest(start, end))).otherwise(F.array().cast("array<int>"))
        wrong = (start < 1) | (end < start)
        return F.when(wrong, F.raise_error(F.concat(F.lit("invalid page range: "), part)).cast("array<int>")).otherwise(up) if strict else up

    pages = F.array_distinct(F.flatten(F.transform(parts, expand)))
    return F.when(F.size(pages) == 0, F.raise_error(F.lit("no pages are named")).cast("array<int>")).otherwise(pages) if strict else pages


def page_ranges(spec: str) -> list[tuple[int, int]]:
    """P3: "111-128,145" as (start, end) pairs. A specification is a parameter, so it is read on the driver."""
    found = []
    for item in spec.split(","):
        m = re.fullmatch(r"\s*(-?\d+)\s*(?:-\s*(-?\d+)\s*)?", item)
        if not m:
            raise ValueError(f"invalid page range: {item.strip()}")
        start, end = int(m[1]), int(m[2] or m[1])
        if start <= 0 or end < start:
            raise ValueError(f"invalid page range: {item.strip()}")
        found.append((start, end))
    return found


def ranges_table(spark: SparkSession, ranges: list[tuple[int, int]]) -> DataFrame:
    """A dimension table (range_index, start_page, end_page); as many rows as the specification has ranges."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(ranges)], "range_index int, start_page int, end_page int")


def page_paths(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    """{"112-113": path, "120": path} as one row (pdf_page, title_path) per page; later entries win."""
    rows = spark.createDataFrame([(k, *([int(x) for x in key.split("-", 1)] * 2)[:2], path) for k, (key, path) in enumerate(mapping.items())], "k int, a int, b int, title_path array<string>")
    each = rows.where("a <= b").select("k", F.explode(F.sequence("a", "b")).alias("pdf_page"), "title_path")
    return each.groupBy("pdf_page").agg(F.max_by("title_path", "k").alias("title_path"))


@dataclass(frozen=True)
class BuildConfig:
    """What building blocks needs besides the pages."""

    document_id: str
    batch_id: str
    pdf_pages: list[int]
    printed_page_offset: int = 0
    chapter_titles: dict[str, str] = field(default_factory=dict)
    initial_title_paths: dict[str, list[str]] = field(default_factory=dict)


def read_build_config(spark: SparkSession, path: str) -> BuildConfig:
    """Read a JSON configuration through Spark, so from any store that Spark reads; other fields are left alone."""
    values = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return BuildConfig(**{k: values[k] for k in BuildConfig.__dataclass_fields__ if k in values})
