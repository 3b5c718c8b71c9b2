"""The sequential rules over rows (W1-W3, W6, W7): for pages and documents of any length.

`blocks` and `chunks` fold over a page's or document's array. Here a line or block stays a row: every rule is a greedy
segmentation (`segments`) and joins on numbers, so that no page or document is one row or one task, and hot ones are
dealt to slabs like all others. The results are those of the folds; a test holds them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.files import durable
from . import chunks as ch
from .blocks import MERGED_CHARS, REGION_STOPS, TABLE_LINES
from .segments import Rule, greedy_segments

PAGE = ["document_id", "pdf_page"]


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with `place`: numbers that go up by one in the order of group and order, over all rows. The rows are sorted by
    range, so a group may go over many tasks; only as many rows as there are partitions meet in one."""
    by = [*group, *order]
    sorted_ = durable(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()))
    part, within = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(upto, F.lit(0)).alias("__offset"))
    return sorted_.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("place", F.col("__offset") + within).drop("__id", "__part", "__offset")


def table_regions(lines: DataFrame) -> DataFrame:
    """Lines (document_id, pdf_page, line_index, type, text) with layout_region.

    Segments begin at captions and headings and have TABLE_LINES lines at most; those that a table caption begins are
    regions.
    """
    flags = {"__opens": (F.col("type") == "caption") & F.col("text").startswith("表"), "__stops": F.col("type").isin(*REGION_STOPS), "__one": F.lit(1)}
    cut = greedy_segments(lines.withColumns(flags), PAGE, "line_index", "__one", Rule(TABLE_LINES), starts="__stops")
    first = F.first("__opens").over(Window.partitionBy(*PAGE, "segment").orderBy("line_index"))
    return cut.withColumn("layout_region", F.when(first, "table_candidate")).drop("segment", *flags)


def title_paths(lines: DataFrame, initial: DataFrame | None, chapters: dict[str, str]) -> DataFrame:
    """Lines with title_path, the path that holds from each on.

    initial: (pdf_page, initial_path), a page's path before its first heading. A deep heading's path names its parent as the path
    before it does; along headings with one parent that is the same name, so it is found for the first of them.
    """
    flags = {"__heading": F.col("type") == "heading", "__zero": F.lit(0)}
    cut = greedy_segments(lines.withColumns(flags), PAGE, "line_index", "__zero", Rule(1), starts="__heading")
    chapter_map = F.create_map(*[F.lit(x) for pair in chapters.items() for x in pair]) if chapters else F.expr("cast(map() as map<string,string>)")
    number = F.regexp_extract("text", f"(?U){tx.SECTION}", 1)
    chapter = F.split_part(number, F.lit("."), F.lit(1))
    heads = cut.where("__heading").select(
        *PAGE,
        "segment",
        "text",
        tx.lookup(chapter_map, chapter, F.concat(F.lit("第"), chapter, F.lit("章"))).alias("title"),
        F.regexp_replace(number, r"\.[^.]*$", "").alias("parent"),
        (F.size(F.split(number, r"\.")) > 2).alias("deep"),
    )
    heads = durable(heads)
    before = heads.select(*PAGE, (F.col("segment") + 1).alias("segment"), F.array("title", "text").alias("old"), F.when(F.col("deep"), F.col("parent")).alias("old_parent"))
    met = heads.join(before, [*PAGE, "segment"], "left")
    start = initial.select("pdf_page", F.col("initial_path")) if initial is not None else None
    met = met.join(start, "pdf_page", "left") if start is not None else met.withColumn("initial_path", F.lit(None).cast("array<string>"))
    nothing = F.array().cast("array<string>")
    met = met.withColumn("old", F.coalesce("old", "initial_path", nothing)).withColumn("fresh", ~F.coalesce(F.col("deep") & (F.col("parent") == F.col("old_parent")), F.lit(False)))
    named = F.get(F.filter("old", lambda p: p.startswith(F.concat(F.col("parent"), F.lit(" ")))), F.lit(0))
    runs = greedy_segments(met.withColumn("named", named).withColumnRenamed("segment", "head").withColumn("zero", F.lit(0)).drop("old", "initial_path", "old_parent"), PAGE, "head", "zero", Rule(1), starts="fresh")
    runs = durable(runs)
    leads = runs.where("fresh").select(*PAGE, "segment", F.col("named").alias("lead"))
    own = F.when(F.col("title").startswith(F.concat(F.col("parent"), F.lit(" "))) & ~F.col("fresh"), F.col("title"))
    second = F.coalesce(own, "lead", "parent")
    path = F.when(F.col("deep"), F.array(F.col("title"), second, F.col("text"))).otherwise(F.array("title", "text"))
    paths = runs.join(leads, [*PAGE, "segment"], "left").select(*PAGE, F.col("head").alias("segment"), path.alias("title_path"))
    each = cut.join(paths, [*PAGE, "segment"], "left")
    each = each.join(start, "pdf_page", "left") if start is not None else each.withColumn("initial_path", F.lit(None).cast("array<string>"))
    return each.withColumn("title_path", F.coalesce("title_path", "initial_path", nothing)).drop("segment", "initial_path", *flags)


def paragraph_blocks(lines: DataFrame, most_chars: int = MERGED_CHARS) -> DataFrame:
    """A row per block of lines (document_id, pdf_page, line_index, source_line_id, type, text, score, box)."""
    paragraph = F.col("type") == "paragraph"
    ended = F.lit(False)
    for sign in tx.SENTENCE_ENDS:
        ended = ended | F.col("text").endswith(sign)
    flags = {"__size": F.length("text"), "__other": ~paragraph, "__closes": ~paragraph | ended}
    cut = greedy_segments(lines.withColumns(flags), PAGE, "line_index", "__size", Rule(most_chars), starts="__other", ends="__closes")
    # A block has some lines of most_chars characters together, or one.
    part = F.struct("line_index", "source_line_id", "type", "text", F.round("score", 6).alias("score"), "box")
    parts = cut.groupBy(*PAGE, "segment").agg(F.array_sort(F.collect_list(part)).alias("m"))
    text = F.array_join(F.transform("m", lambda x: x["text"]), "")
    scores = F.transform("m", lambda x: x["score"])
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    prefix = F.concat("document_id", F.format_string("_P%03d", "pdf_page"))
    return parts.select(
        tx.padded_id(prefix, "B", F.col("segment") + 1).alias("block_id"),
        *PAGE,
        F.col("m")[0]["type"].alias("block_type"),
        text.alias("text"),
        F.when(F.size("m") > 1, tx.normalize(text)).otherwise(text).alias("normalized_text"),
        F.transform("m", lambda x: x["source_line_id"]).alias("source_line_ids"),
        F.transform("m", lambda x: x["box"]).alias("source_boxes"),
        scores.alias("source_scores"),
        F.round(mean, 6).alias("average_confidence"),
    )


def _runs(units: DataFrame, order: list[str], weight: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): blocks (document_id, range_index, order, place, run, ...) in runs that end before a boundary and before they would
    outgrow `most`, and a row per run with its weight w, and its first block's same_path."""
    flat = units.select("document_id", "range_index", *order, "raw", "size", "region", F.col("part.block_id").alias("id"), F.col("part.block_type").isin(*tx.HEADINGS).alias("heading"), F.col("part.title_path").alias("path"))
    rows = durable(numbered(flat, ["document_id"], ["range_index", *order]))
    told = ("document_id", "range_index", "path", "region")
    old = rows.select((F.col("place") + 1).alias("place"), *[F.col(c).alias(f"old_{c}") for c in told])
    met = rows.join(old, "place", "left")
    there = F.col("document_id") == F.col("old_document_id")
    same_path = F.coalesce(there & F.col("path").eqNullSafe(F.col("old_path")), F.lit(False))
    same_range = F.coalesce(F.col("range_index") == F.col("old_range_index"), F.lit(False))
    met = met.withColumn("same_path", same_path).withColumn("boundary", F.col("heading") | ~F.col("same_path") | ~same_range | (F.col("region") != F.coalesce("old_region", F.lit(""))))
    met = met.withColumn("weight", weight).drop("path", *[f"old_{c}" for c in told])
    cut = durable(greedy_segments(met, ["document_id"], "place", "weight", Rule(most), starts="boundary").withColumnRenamed("segment", "run"))
    runs = cut.groupBy("document_id", "run").agg(F.sum(weight).alias("w"), F.every("heading").alias("headings"), F.min_by("same_path", "place").alias("same_path"))
    return cut, runs


def _parts(units: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(document_id, chunk, parts) from (document_id, run, chunk)."""
    numbers = rows.select("document_id", "range_index", "id", "place", "run").join(runs, ["document_id", "run"]).select("document_id", "range_index", F.col("id").alias("block"), "place", "chunk")
    texts = units.select("document_id", "range_index", "part", F.col("part.block_id").alias("block"))
    met = texts.join(numbers, ["document_id", "range_index", "block"])
    grouped = met.groupBy("document_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("some"))
    return grouped.select("document_id", "chunk", F.transform("some", lambda r: r["part"]).alias("parts"))


def structural_chunks(blocks: DataFrame, most: int = 600, least: int = 80, order: tuple[str, ...] = ch.ORDER, title: str = "", prefix: str = "STRUCT_V01") -> DataFrame:
    """W6 as `chunks.structural_chunks`; block ids must be unique in a document."""
    if most <= 0:
        raise ValueError("invalid chunk size")
    units = durable(ch._units(blocks, None, list(order), F.length("t")))  # read for their numbers and again for their texts
    # A line break between blocks: size and raw are with one, and what a run may hold is one more for its last.
    rows, runs = _runs(units, list(order), F.col("raw") + 1, most + 1)
    weighed = rows.groupBy("document_id", "run").agg(F.sum(F.col("size") + 1).alias("w"))
    held = durable(greedy_segments(weighed, ["document_id"], "run", "w", Rule(least, least=True)).withColumnRenamed("segment", "chunk"))
    sums = held.groupBy("document_id", "chunk").agg(F.sum("w").alias("w"))
    last = sums.groupBy("document_id").agg(F.max("chunk").alias("chunk"))
    small = last.join(sums, ["document_id", "chunk"]).where(F.col("w") < least)
    one_before = sums.select("document_id", (F.col("chunk") + 1).alias("chunk"), F.col("w").alias("w_before"))
    back = small.join(one_before, ["document_id", "chunk"]).where(F.col("w") + F.col("w_before") <= most).select("document_id", "chunk", F.lit(1).alias("less"))
    chunked = held.join(back, ["document_id", "chunk"], "left").select("document_id", "run", (F.col("chunk") - F.coalesce("less", F.lit(0))).alias("chunk"))
    parts = _parts(units, rows, chunked)
    texts = parts.withColumn("text", tx.strip(F.array_join(F.transform("parts", lambda p: p["t"]), "\n"))).withColumn("source_block_ids", F.transform("parts", lambda p: p["block_id"]))
    return ch._finish(texts, prefix, "structural", "0.1-draft", title, ["chunk"])


def structural_token_chunks(blocks: DataFrame, ranges: DataFrame | None = None, most: int = 512, least: int = 64, order: tuple[str, ...] = ch.ORDER, title: str = "", tokens: ch.Tokens | None = None) -> DataFrame:
    """W7 as `chunks.structural_token_chunks`, for tokens of a pattern; block ids must be unique in a document and range."""
    tokens = tokens or ch.Tokens()
    if tokens.file is not None:
        raise ValueError("a tokenizer file has to see texts together; use chunks.structural_token_chunks")
    units = durable(ch._units(blocks, ranges, list(order), tokens.count(F.col("t"))))  # read for their numbers and again for their texts
    rows, runs = _runs(units, list(order), F.col("size"), most)
    bridges = runs.withColumn("apart", ~((F.col("w") < least) & (F.col("same_path") | F.col("headings"))))
    joined = greedy_segments(bridges.select("document_id", "run", "w", "apart"), ["document_id"], "run", "w", Rule(most), starts="apart")
    parts = _parts(units, rows, joined.select("document_id", "run", F.col("segment").alias("chunk")))
    whole = F.transform("parts", lambda p: p.withField("lo", F.lit(0)).withField("hi", F.length(p["t"])).withField("n", F.length(p["t"])))
    texts = parts.withColumn("parts", whole).withColumn("text", tx.strip(F.array_join(F.transform("parts", lambda p: p["t"]), "\n")))
    return ch._token_chunks(texts, f"structural_t{most}", "structural_token", most, 0, title, ["chunk"], tokens)
