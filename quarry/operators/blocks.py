"""From OCR pages to typed, traceable blocks.

A page is one row and every step works inside it: lines are an array, and the three sequential rules (table regions,
title paths, paragraph merging) are folds over that array that carry only small state. Building blocks is therefore one
map stage without a shuffle; arrays are bounded by what fits on a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import OCR_PAGE

TABLE_LINES = 30  # a table region ends after so many lines, its caption included
MERGED_CHARS = 260
REGION_STOPS = ("heading", "subheading", "exercise_heading", "caption")


def read_ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per page."""
    return spark.read.schema(OCR_PAGE).option("multiLine", True).json(path)


def missing_pages(requested: DataFrame, pages: DataFrame) -> DataFrame:
    """Requested pages (pdf_page) that have no file."""
    return requested.join(pages.select("pdf_page"), "pdf_page", "left_anti")


def with_lines(pages: DataFrame) -> DataFrame:
    """pages with `lines`: (line_index, source_line_id, text, score, box, type) of the lines that are not blank.

    The parallel arrays of a page must be equally long, or the query fails.
    """
    first = F.col("results")[0]
    texts, scores, boxes = first["rec_texts"], first["rec_scores"], first["rec_boxes"]
    uneven = (F.size(texts) != F.size(scores)) | (F.size(texts) != F.size(boxes))
    prefix = F.concat("document_id", F.format_string("_P%03d", "pdf_page"))
    zipped = F.when(uneven, F.raise_error(F.concat(F.lit("OCR arrays differ in length on "), prefix)).cast("array<struct<t:string,s:double,b:array<int>>>")).otherwise(
        F.arrays_zip(texts.alias("t"), scores.alias("s"), boxes.alias("b"))
    )
    numbered = F.transform(zipped, lambda x, i: F.struct((i + 1).alias("line_index"), tx.padded_id(prefix, "L", i + 1).alias("source_line_id"), tx.normalize(x["t"]).alias("text"), x["s"].alias("score"), x["b"].alias("box")))
    kept = F.filter(numbered, lambda x: F.coalesce(x["text"], F.lit("")) != "")
    return pages.withColumn("lines", F.transform(kept, lambda x: x.withField("type", tx.classify(x["text"], x["line_index"]))))


def table_regions(lines: Column) -> Column:
    """Per line, "table_candidate" or null.

    A table caption opens a region and counts as its first line; a heading of any kind, another caption or the length
    limit closes it.
    """
    start = F.struct(F.lit(False).alias("on"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        opens = (line["type"] == "caption") & line["text"].startswith("表")
        on = opens | (acc["on"] & ~line["type"].isin(*REGION_STOPS) & (acc["n"] < TABLE_LINES))
        n = F.when(opens, 1).when(on, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(on.alias("on"), n.alias("n"), F.array_append(acc["out"], F.when(on, "table_candidate")).alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def next_title_path(path: Column, heading: Column, chapters: Column) -> Column:
    """W2, one step: the title path after a numbered heading."""
    number = F.regexp_extract(heading, f"(?U){tx.SECTION}", 1)
    chapter = F.split_part(number, F.lit("."), F.lit(1))
    title = tx.lookup(chapters, chapter, F.concat(F.lit("第"), chapter, F.lit("章")))
    parent = F.regexp_replace(number, r"\.[^.]*$", "")
    named = F.get(F.filter(path, lambda p: p.startswith(F.concat(parent, F.lit(" ")))), F.lit(0))
    deep = F.size(F.split(number, r"\.")) > 2
    return F.when(deep, F.array(title, F.coalesce(named, parent), heading)).otherwise(F.array(title, heading))


def title_paths(lines: Column, initial: Column, chapters: Column) -> Column:
    """Per line, the title path that holds from it on; a page starts with its configured path."""
    start = F.struct(F.coalesce(initial, F.array().cast("array<string>")).alias("path"), F.array().cast("array<array<string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        path = F.when(line["type"] == "heading", next_title_path(acc["path"], line["text"], chapters)).otherwise(acc["path"])
        return F.struct(path.alias("path"), F.array_append(acc["out"], path).alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def block_numbers(lines: Column, most_chars: int = MERGED_CHARS) -> Column:
    """Per line, the 1-based number of its block; a paragraph line joins the paragraph before it unless that has
    ended a sentence or would grow beyond most_chars."""
    start = F.struct(F.lit(0).alias("no"), F.lit(False).alias("open"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        paragraph = line["type"] == "paragraph"
        joins = acc["open"] & paragraph & (acc["size"] + F.length(line["text"]) <= most_chars)
        no = F.when(joins, acc["no"]).otherwise(acc["no"] + 1)
        size = F.when(joins, acc["size"] + F.length(line["text"])).otherwise(F.length(line["text"]))
        ended = F.lit(False)
        for sign in tx.SENTENCE_ENDS:
            ended = ended | line["text"].endswith(sign)
        return F.struct(no.alias("no"), (paragraph & ~ended).alias("open"), size.alias("size"), F.array_append(acc["out"], no).alias("out"))

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def build_blocks(pages: DataFrame, initial_paths: DataFrame, chapters: dict[str, str], batch_id: str, page_offset: int = 0) -> DataFrame:
    """One row per block of the pages that initial_paths (pdf_page, title_path) names."""
    chapter_map = F.create_map(*[F.lit(x) for pair in chapters.items() for x in pair]) if chapters else F.expr("cast(map() as map<string,string>)")
    # The path table has a row per configured page; Spark broadcasts it if it is small.
    named = with_lines(pages).join(initial_paths.withColumnRenamed("title_path", "initial_path"), "pdf_page")
    folded = named.select("document_id", "pdf_page", "lines", table_regions(F.col("lines")).alias("region"), title_paths(F.col("lines"), F.col("initial_path"), chapter_map).alias("path"), block_numbers(F.col("lines")).alias("no"))

    def detail(line: Column, i: Column) -> Column:
        region = F.get(F.col("region"), i)
        return F.struct(
            F.get(F.col("no"), i).alias("no"),
            line.alias("line"),
            region.alias("region"),
            F.get(F.col("path"), i).alias("path"),
            tx.line_issues(line["text"], line["type"], line["score"], region).alias("issues"),
        )

    detailed = folded.select("document_id", "pdf_page", F.transform("lines", detail).alias("lines"))
    # A block's lines are next to each other, so blocks are slices between the places where the number changes.
    places = F.transform("lines", lambda x, i: F.when((i == 0) | (F.get(F.col("lines"), i - 1)["no"] != x["no"]), i + 1))
    begun = detailed.select("document_id", "pdf_page", "lines", F.array_append(F.array_compact(places), F.size("lines") + 1).alias("starts"))
    slices = F.transform(F.slice("starts", 1, F.size("starts") - 1), lambda s, j: F.slice("lines", s, F.get(F.col("starts"), j + 1) - s))
    grouped = begun.select("document_id", "pdf_page", F.explode(slices).alias("m"))
    head, lines = F.col("m")[0], F.transform("m", lambda x: x["line"])
    merged = F.size("m") > 1
    text = F.array_join(F.transform(lines, lambda x: x["text"]), "")
    scores = F.transform(lines, lambda x: F.round(x["score"], 6))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    flat = F.flatten(F.transform("m", lambda x: x["issues"]))
    return grouped.select(
        tx.padded_id(F.concat("document_id", F.format_string("_P%03d", "pdf_page")), "B", head["no"]).alias("block_id"),
        "document_id",
        F.lit(batch_id).alias("batch_id"),
        "pdf_page",
        (F.col("pdf_page") - 1).alias("pdf_index"),
        (F.col("pdf_page") + page_offset).alias("printed_page"),
        head["line"]["type"].alias("block_type"),
        F.try_element_at(F.array_compact(F.transform("m", lambda x: x["region"])), F.lit(-1)).alias("layout_region"),
        text.alias("text"),
        F.when(merged, tx.normalize(text)).otherwise(text).alias("normalized_text"),
        head["path"].alias("title_path"),
        F.transform(lines, lambda x: x["source_line_id"]).alias("source_line_ids"),
        F.transform(lines, lambda x: x["box"]).alias("source_boxes"),
        scores.alias("source_scores"),
        F.round(mean, 6).alias("average_confidence"),
        F.lit("auto_draft").alias("review_status"),
        F.when(merged, F.array_sort(F.array_distinct(flat))).otherwise(flat).alias("issues"),
    )


def page_report(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """A3: lines, blocks and flagged blocks per page."""
    lines = with_lines(pages).select("document_id", "pdf_page", F.size("lines").alias("ocr_lines"))
    per_page = blocks.groupBy("document_id", "pdf_page").agg(F.count("*").alias("blocks"), F.count_if(F.size("issues") > 0).alias("flagged_blocks"))
    return lines.join(per_page, ["document_id", "pdf_page"], "left").na.fill(0)


def ocr_page_summary(pages: DataFrame, low: float = 0.8) -> DataFrame:
    """A5: counts, confidences, codes and low-confidence lines per page.

    Texts and scores are paired before blank lines are left out; average and minimum are over all scores.
    """
    flat = lambda name: F.flatten(F.transform(F.coalesce("results", F.array()), lambda r: F.coalesce(r[name], F.array())))
    pairs = F.filter(F.arrays_zip(flat("rec_texts").alias("text"), flat("rec_scores").alias("score")), lambda x: ~tx.is_blank(x["text"]))
    base = pages.select("document_id", "pdf_page", "pdf_index", "elapsed_seconds", pairs.alias("pairs"), F.array_compact(flat("rec_scores")).alias("scores"))
    joined = F.array_join(F.transform("pairs", lambda x: x["text"]), "\n")
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    with_text = base.withColumn("joined", joined).withColumn("codes", tx.code_mentions(F.col("joined")))
    return with_text.select(
        "document_id",
        "pdf_page",
        "pdf_index",
        F.size("pairs").alias("line_count"),
        F.length("joined").alias("character_count"),
        F.round(F.try_divide(total, F.size("scores")), 4).alias("average_confidence"),
        F.round(F.array_min("scores"), 4).alias("minimum_confidence"),
        "elapsed_seconds",
        F.size("codes").alias("code_count"),
        "codes",
        F.transform(F.filter("pairs", lambda x: x["score"] < low), lambda x: F.struct(x["text"].alias("text"), F.round(x["score"], 4).alias("score"))).alias("low_confidence_lines"),
        (F.length("joined") - F.length(F.replace("joined", F.lit("�"), F.lit("")))).alias("replacement_character_count"),
    )


def ocr_batch_summary(summaries: DataFrame) -> DataFrame:
    """One row over all pages; the confidence is weighted by the lines of pages that have any."""
    lines = F.when(F.col("line_count") > 0, F.col("line_count"))
    weighted = F.sum(F.col("average_confidence") * lines)
    seconds = F.sum(F.coalesce("elapsed_seconds", F.lit(0.0)))
    return summaries.agg(
        F.count("*").alias("page_count"),
        F.array_sort(F.collect_list(F.when(F.col("line_count") == 0, F.col("pdf_page")))).alias("empty_pages"),
        F.coalesce(F.sum(lines), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum("character_count"), F.lit(0)).alias("total_characters"),
        F.coalesce(F.sum("code_count"), F.lit(0)).alias("total_unique_code_mentions_by_page"),
        F.round(F.try_divide(weighted, F.sum(lines)), 4).alias("weighted_average_confidence"),
        F.round(F.coalesce(seconds, F.lit(0.0)), 3).alias("total_elapsed_seconds"),
        F.round(F.try_divide(seconds, F.count("*")), 3).alias("average_elapsed_seconds_per_page"),
        F.coalesce(F.sum("replacement_character_count"), F.lit(0)).alias("replacement_character_count"),
    )
