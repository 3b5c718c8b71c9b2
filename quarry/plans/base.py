"""Views of the test tables as the library's entities, shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.partitioning import spread
from ..operators import blocks as bl
from ..schemas import OCR_RESULT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


#: What lines become by (31 x document + 5 x line) modulo 17, so that every kind of line, flag and region occurs.
HEADERS = ("112", "FANUC数控编程手册", "第章 程序 12")
ENDS = ("。", "！", "？", "；", "：")
LABELS = ("指令格式：", "各地址含义：", "注意：")
NUMERALS = ("一", "二", "3")


def page_line(t: Column, i: Column) -> Column:
    """Line i (from 0) of a document as a line of a manual: a heading, caption, code, label and so on by rule."""
    d, n = F.col("doc_id"), (i + 1).cast("string")
    pick = lambda of, k: F.element_at(F.array(*[F.lit(x) for x in of]), (F.pmod(k, F.lit(len(of))) + 1).cast("int"))
    chapter, part = (F.pmod(d, F.lit(9)) + 1).cast("string"), (F.pmod(i, F.lit(7)) + 1).cast("string")
    first = F.when(F.pmod(d, F.lit(5)) == 0, F.concat(F.lit("第"), chapter, F.lit("章 刀具 112"))).when(F.pmod(d, F.lit(5)) < 4, pick(HEADERS, d))
    made = [
        F.concat(chapter, F.lit("."), part, F.lit(" "), t),
        F.concat(chapter, F.lit("."), part, F.lit("."), (F.pmod(i, F.lit(4)) + 1).cast("string"), F.lit(" "), t),
        F.concat(F.lit("（"), pick(NUMERALS, i), F.lit("）"), t),
        F.concat(F.lit("表 2-"), n, F.lit(" "), t),
        F.concat(F.lit("图3-"), n, F.lit("所示 "), t),
        F.concat(F.lit("图 3-"), n, F.lit(" "), t),
        F.lit("练一练"),
        pick(LABELS, i),
        F.concat(F.lit("N10 G01 X"), n, F.lit(" 刀具")),
        F.concat(F.lit("G02 X"), n, F.lit(" 这里有五个汉字")),
        F.concat(t, pick(ENDS, i)),
        F.concat(F.lit("数控GOO编程"), t),
        F.concat(F.lit("2."), n, F.lit(" "), t),
        F.concat(F.lit(" \t"), t, F.lit(" \u3000")),
    ]
    rule = F.pmod(d * 31 + i * 5, F.lit(17))
    line = F.when(rule == 0, made[0])
    for k, m in enumerate(made[1:], 1):
        line = line.when(rule == k, m)
    return F.coalesce(F.when(i == 0, first), line.otherwise(t))


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as one-page OCR results: lines made of theirs by rule, with scores that follow from the ids."""
    lines = F.split("text", "\n")
    texts = F.transform(lines, page_line)
    scores = F.transform(lines, lambda t, i: F.pmod(F.col("doc_id") * 31 + i * 17, F.lit(1000)) / 1000)
    boxes = F.transform(lines, lambda t, i: F.array(F.lit(0), i, F.lit(100), i + 1))
    polys = F.expr("cast(null as array<array<array<int>>>)")
    result = F.struct(texts.alias("rec_texts"), scores.alias("rec_scores"), boxes.alias("rec_boxes"), polys.alias("rec_polys")).cast(OCR_RESULT)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), "doc_id").alias("document_id"),
        F.lit("").alias("source_pdf"),
        (F.pmod("doc_id", F.lit(100)) + 1).cast("int").alias("pdf_page"),
        F.pmod("doc_id", F.lit(100)).cast("int").alias("pdf_index"),
        F.lit(None).cast("int").alias("printed_page"),
        (F.pmod("doc_id", F.lit(7)) / 2).alias("elapsed_seconds"),
        F.lit(None).cast("int").alias("line_count"),
        F.array(result).alias("results"),
    )


def _each(pages: DataFrame, what: Column) -> DataFrame:
    """A row for each entry of an array. Outer, and the nulls left out behind it: before an inner one Spark infers a
    filter on the array's size, which computes the array a second time."""
    return pages.select("document_id", "pdf_page", F.explode_outer(what).alias("z")).where("z is not null")


def _ocr_lines(spark: SparkSession, sf_dir: str, folds: dict[str, Column]) -> DataFrame:
    """One row per line that is not blank, with the entry of each fold's array."""
    folded = bl.with_lines(ocr_pages(spark, sf_dir)).select("document_id", "pdf_page", "lines", *[c.alias(n) for n, c in folds.items()])
    zipped = F.arrays_zip("lines", *folds)
    return _each(folded, zipped).select("document_id", "pdf_page", "z.lines.*", *[f"z.{n}" for n in folds])


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line that is not blank, with type, region, title path and block number."""
    lines, chapters = F.col("lines"), F.create_map(F.lit("1"), F.lit("Chapter one"))
    folds = {"layout_region": bl.table_regions(lines), "title_path": bl.title_paths(lines, F.array(F.lit("start")), chapters), "block_number": bl.block_numbers(lines)}
    return _ocr_lines(spark, sf_dir, folds)


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a block of its own; block ids are sortable."""
    return as_blocks(_ocr_lines(spark, sf_dir, {"layout_region": bl.table_regions(F.col("lines"))}))


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line that is not blank, with what the page says of it alone."""
    return _each(bl.with_lines(ocr_pages(spark, sf_dir)), F.col("lines")).select("document_id", "pdf_page", "z.*")


def as_blocks(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.concat("document_id", F.format_string("_B%05d", "line_index")).alias("block_id"),
        "document_id",
        "pdf_page",
        (F.col("pdf_page") - 8).alias("printed_page"),
        F.col("type").alias("block_type"),
        "layout_region",
        "text",
        F.array(F.lit("start"), F.concat(F.lit("part "), F.floor(F.col("line_index") / 10).cast("string"))).alias("title_path"),
        F.array("source_line_id").alias("source_line_ids"),
        tx.line_issues(F.col("text"), F.col("type"), F.col("score"), F.col("layout_region")).alias("issues"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: What Unicode calls white space, for engines whose \s is ASCII only.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

def _list(of: tuple[str, ...], k: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in of) + f"][({k}) % {len(of)} + 1]"


LINES_SQL = rf"""
split_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line_index FROM documents),
raw_lines AS (
  SELECT doc_id, line_index, CASE
    WHEN line_index = 1 AND doc_id % 5 = 0 THEN '第' || (doc_id % 9 + 1) || '章 刀具 112'
    WHEN line_index = 1 AND doc_id % 5 < 4 THEN {_list(HEADERS, "doc_id")}
    ELSE CASE (doc_id * 31 + (line_index - 1) * 5) % 17
      WHEN 0 THEN (doc_id % 9 + 1) || '.' || ((line_index - 1) % 7 + 1) || ' ' || t
      WHEN 1 THEN (doc_id % 9 + 1) || '.' || ((line_index - 1) % 7 + 1) || '.' || ((line_index - 1) % 4 + 1) || ' ' || t
      WHEN 2 THEN '（' || {_list(NUMERALS, "line_index - 1")} || '）' || t
      WHEN 3 THEN '表 2-' || line_index || ' ' || t
      WHEN 4 THEN '图3-' || line_index || '所示 ' || t
      WHEN 5 THEN '图 3-' || line_index || ' ' || t
      WHEN 6 THEN '练一练'
      WHEN 7 THEN {_list(LABELS, "line_index - 1")}
      WHEN 8 THEN 'N10 G01 X' || line_index || ' 刀具'
      WHEN 9 THEN 'G02 X' || line_index || ' 这里有五个汉字'
      WHEN 10 THEN t || {_list(ENDS, "line_index - 1")}
      WHEN 11 THEN '数控GOO编程' || t
      WHEN 12 THEN '2.' || line_index || ' ' || t
      WHEN 13 THEN ' ' || chr(9) || t || ' ' || chr(12288)
      ELSE t END END AS raw
  FROM split_lines),
lines AS (
  SELECT doc_id, 'D' || doc_id AS document_id, (doc_id % 100 + 1)::INT AS pdf_page, line_index::INT AS line_index,
         trim(regexp_replace(raw, '{SPACE}+', ' ', 'g')) AS text, ((doc_id * 31 + (line_index - 1) * 17) % 1000) / 1000.0::DOUBLE AS score
  FROM raw_lines WHERE trim(regexp_replace(raw, '{SPACE}+', ' ', 'g')) <> ''),
typed AS (
  SELECT *, CASE
    WHEN line_index <= 2 AND regexp_matches(text, '^(?:第.*章.*\d{{2,3}}|\d{{1,3}}|FANUC数控编程手册)$') THEN 'header_footer'
    WHEN regexp_matches(text, '^(\d+(?:\.\d+){{1,2}})\s*(.+)?$') THEN 'heading'
    WHEN regexp_matches(text, '^（[0-9一二三四五六七八九十]+）') THEN 'subheading'
    WHEN regexp_matches(text, '^[图表]\s*\d+[-—]\d+') AND NOT regexp_matches(text, '^图\s*\d+[-—]\d+所示') THEN 'caption'
    WHEN text = '练一练' THEN 'exercise_heading'
    WHEN text IN ('指令格式：', '各地址含义：', '注意：') THEN 'label'
    WHEN regexp_matches(text, '(?i)(?:^|\s)(?:N\d+)?\s*(?:G\d{{1,3}}|M\d{{1,3}}|[XYZUWRIJKFPQSDT][-+]?\d)') AND len(regexp_extract_all(text, '[一-鿿]')) <= 4 THEN 'code'
    ELSE 'paragraph' END AS type
  FROM lines)
"""
