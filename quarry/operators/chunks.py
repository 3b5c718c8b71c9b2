"""From blocks to chunks: fixed windows and structural chunks, by characters or by tokens.

Windows have a fixed step, so the windows that a block touches follow from its place by arithmetic: blocks are exploded
to their windows and grouped, and no range join or whole-document string is made. Structural chunks are a sequential
fold over the blocks of a document; it runs over a few small numbers a block, and the texts stay in the JVM (a tokenizer
file, which has to see texts together, is the exception).

Blocks come in the order of ORDER: by page, then by the number in the block's id, which is longer if it is larger.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .intervals import with_ranges

SKIPPED = ("header_footer",)
ORDER = ("pdf_page", "block_digits", "block_id")
TOKEN_PROFILES = ((256, 51), (512, 102), (1024, 205))


@dataclass(frozen=True)
class Tokens:
    """What counts as a token: a context-free pattern, or a file of the `tokenizers` library.

    A pattern runs in the JVM. A file's tokens may depend on what is beside them, so its windows are cut from whole
    documents and shrink until the text by itself has no more tokens than it should; that runs in Python, document by
    document. Tokens without width do not count.
    """

    pattern: str | None = None
    file: str | None = None

    def count(self, text: Column) -> Column:
        if self.file is None:
            return tx.token_count(text, self.pattern)
        path = self.file

        @F.pandas_udf("int")
        def counted(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: len(file_offsets(path, t)), na_action="ignore")

        return counted(text)


_loaded: dict[str, object] = {}


def file_offsets(path: str, text: str) -> list[tuple[int, int]]:
    """[start, end) in code points of the tokens that a tokenizer file gives; one tokenizer per worker process."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return [(s, e) for s, e in _loaded[path].encode(text, add_special_tokens=False).offsets if e > s]


def usable_blocks(blocks: DataFrame) -> DataFrame:
    """without page headers and blank blocks; adds stripped text `t` and the length of the id."""
    kept = blocks.where(~F.col("block_type").isin(*SKIPPED))
    return kept.withColumns({"t": tx.strip(F.col("text")), "block_digits": F.length("block_id")}).where("t <> ''")


def in_ranges(blocks: DataFrame, ranges: DataFrame | None) -> DataFrame:
    """Blocks with the index of each page range they are in; all have index 0 without ranges.

    ranges: (range_index, start_page, end_page).
    """
    if ranges is None:
        return blocks.withColumn("range_index", F.lit(0))
    return with_ranges(blocks, "pdf_page", ranges.select("range_index", "start_page", "end_page"), "start_page", "end_page")


def _citation(title: str, ids: Column) -> Column:
    return F.struct("document_id", F.lit(title).alias("document_title"), "pdf_pages", "printed_pages", "title_paths", ids.alias("source_block_ids"), F.col("text").alias("quote"))


def _details(parts: Column, skip_empty_paths: bool) -> dict[str, Column]:
    """F12 over an ordered array of blocks: sorted distinct pages and issues, first-seen distinct paths, types, lines."""
    pick = lambda name: F.transform(parts, lambda b: b[name])
    with_path = F.filter(parts, lambda b: F.size(b["title_path"]) > 0) if skip_empty_paths else parts
    return {
        "pdf_pages": F.array_sort(F.array_distinct(pick("pdf_page"))),
        "printed_pages": F.array_sort(F.array_distinct(pick("printed_page"))),
        "title_paths": F.array_distinct(F.transform(with_path, lambda b: F.array_join(b["title_path"], " > "))),
        "block_types": F.array_distinct(pick("block_type")),
        "source_line_ids": F.array_distinct(F.flatten(pick("source_line_ids"))),
        "issues": F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda b: F.coalesce(b["issues"], F.array().cast("array<string>")))))),
    }


def retrieval_text(text: Column, title_paths: Column) -> Column:
    """the first title path above the text."""
    return F.when(F.size(title_paths) > 0, F.concat(title_paths[0], F.lit("\n"), text)).otherwise(text)


def _finish(chunks: DataFrame, prefix: str, strategy: str, version: str, title: str, order: list[str], tokens: dict[str, Column] | None = None) -> DataFrame:
    """chunks has document_id, parts, text, source_block_ids and the order columns; W8 numbers them per document."""
    out = chunks.withColumns(_details(F.col("parts"), tokens is not None))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy(*order))
    out = out.withColumn("retrieval_text", retrieval_text(F.col("text"), F.col("title_paths")))
    columns = [
        F.concat("document_id", F.lit(f"_{prefix}_C"), F.format_string("%04d", number)).alias("chunk_id"),
        F.col("document_id"),
        F.lit(strategy).alias("strategy"),
        F.lit(version).alias("version"),
        F.col("text"),
        F.col("retrieval_text"),
        F.length("text").alias("character_count"),
        *[F.col(c) for c in ("source_block_ids", "source_line_ids", "pdf_pages", "printed_pages", "title_paths", "block_types", "issues")],
        F.lit("draft_contains_auto_ocr").alias("review_status"),
        _citation(title, F.col("source_block_ids")).alias("citation"),
    ]
    return out.select(*columns, *[c.alias(k) for k, c in (tokens or {}).items()])


def _touched(left: Column, right: Column, total: Column, size: int, step: int) -> Column:
    """The numbers of the windows [k step, k step + size) that [left, right) overlaps, of those that start before
    one has reached the end."""
    windows = F.when(total <= size, F.lit(1)).otherwise(F.ceil((total - size) / step) + 1)
    lo = F.greatest(F.floor((left - size) / step) + 1, F.lit(0))
    hi = F.least(F.ceil(right / step) - 1, windows - 1)
    return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<bigint>"))


def _placed(blocks: DataFrame, ranges: DataFrame | None, order: list[str], size: Column) -> DataFrame:
    """Blocks with left, right and total of `size` within their document and range."""
    # By document alone, which serves the window here, the grouping by window behind it and the numbering at the end.
    units = in_ranges(usable_blocks(blocks), ranges).withColumn("size", size).repartition("document_id")
    group = Window.partitionBy("document_id", "range_index")
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return units.withColumns({"right": F.sum("size").over(upto), "total": F.sum("size").over(group), "place": F.row_number().over(group.orderBy(*order))}).withColumn("left", F.col("right") - F.col("size"))


PART = ("block_id", "pdf_page", "printed_page", "title_path", "block_type", "source_line_ids", "issues")


def fixed_windows(blocks: DataFrame, ranges: DataFrame | None = None, size: int = 350, overlap: int = 70, order: tuple[str, ...] = ORDER, title: str = "", prefix: str = "FIXED_V01") -> DataFrame:
    """Character windows over the blocks of a document and range, each block followed by a line break."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("invalid chunk size or overlap")
    step = size - overlap
    placed = _placed(blocks, ranges, list(order), F.length("t") + 1)
    each = placed.withColumn("k", F.explode(_touched(F.col("left"), F.col("right"), F.col("total"), size, step)))
    start, end = F.col("k") * step, F.col("k") * step + size
    lo = F.greatest(F.col("left"), start) - F.col("left")
    piece = F.substring(F.concat("t", F.lit("\n")), (lo + 1).cast("int"), (F.least(F.col("right"), end) - F.col("left") - lo).cast("int"))
    parts = each.withColumn("piece", piece).groupBy("document_id", "range_index", "k").agg(F.array_sort(F.collect_list(F.struct("place", "piece", *PART))).alias("parts"))
    texts = parts.withColumn("text", tx.strip(F.array_join(F.transform("parts", lambda p: p["piece"]), ""))).where("text <> ''")
    texts = texts.withColumn("source_block_ids", F.transform("parts", lambda p: p["block_id"]))
    return _finish(texts, prefix, "fixed", "0.1-draft", title, ["range_index", "k"])


def fixed_token_windows(blocks: DataFrame, ranges: DataFrame | None = None, size: int = 256, overlap: int = 51, order: tuple[str, ...] = ORDER, title: str = "", tokens: Tokens | None = None) -> DataFrame:
    """Token windows over the blocks of a document and range, blocks being parted by line breaks."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("invalid chunk size or overlap")
    tokens, step = tokens or Tokens(), size - overlap
    cut = _pattern_windows if tokens.file is None else _file_windows
    each = cut(blocks, ranges, size, step, list(order), tokens)
    part = F.struct("place", "lo", "hi", "n", "t", *PART)
    parts = each.groupBy("document_id", "range_index", "k").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = tx.strip(F.array_join(F.transform("parts", lambda p: F.substring(p["t"], p["lo"] + 1, p["hi"] - p["lo"])), "\n"))
    return _token_chunks(parts.withColumn("text", text), f"fixed_t{size}_o{overlap}", "fixed_token", size, overlap, title, ["range_index", "k"], tokens)


def _pattern_windows(blocks: DataFrame, ranges: DataFrame | None, size: int, step: int, order: list[str], tokens: Tokens) -> DataFrame:
    """(block columns, k, lo, hi, n): the part of each block in each window.

    Tokens of a pattern are the same by themselves as within their document, so a right edge never needs to shrink, and
    only a window's first and last token decide where it begins and ends in their blocks; they are looked up by number.
    """
    placed = _placed(blocks, ranges, order, tokens.count(F.col("t"))).withColumn("windows", _touched(F.col("left"), F.col("right"), F.col("total"), size, step))
    inner = F.col("size") - 1

    def edges(k: Column) -> tuple[Column, Column]:
        first, last = k * step - F.col("left"), k * step + size - F.col("left") - 1
        return F.when((first > 0) & (first <= inner), first).cast("int"), F.when((last >= 0) & (last < inner), last).cast("int")

    cut = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform("windows", lambda k: F.array(*edges(k)))))))
    with_cuts = placed.withColumn("cut", cut).withColumn("spans", tx.token_spans(F.col("t"), F.col("cut"), tokens.pattern))
    # Outer, and windows of none left out behind it: before an inner one Spark infers a filter that computes them again.
    each = with_cuts.withColumn("k", F.explode_outer("windows")).where("k is not null")
    first, last = edges(F.col("k"))
    span = lambda token: F.get("spans", (F.array_position("cut", token) - 1).cast("int"))
    n = F.length("t")
    return each.withColumns({"n": n, "lo": F.coalesce(span(first)["s"], F.lit(0)), "hi": F.coalesce(span(last)["e"], n)}).drop("windows", "cut", "spans")


def token_windows(offsets: list[tuple[int, int]], size: int, step: int, count: Callable[[int, int], int]) -> Iterator[tuple[int, int]]:
    """Character windows of `size` tokens, each shrunk until `count` finds no more in it; the last reaches the end."""
    for start in range(0, len(offsets), step):
        end = min(start + size, len(offsets))
        while end > start + 1 and count(offsets[start][0], offsets[end - 1][1]) > size:
            end -= 1
        yield offsets[start][0], offsets[end - 1][1]
        if end == len(offsets):
            return


def _file_windows(blocks: DataFrame, ranges: DataFrame | None, size: int, step: int, order: list[str], tokens: Tokens) -> DataFrame:
    """As _pattern_windows for a tokenizer file: one document and range at a time."""
    placed = _placed(blocks, ranges, order, F.length("t") + 1)
    path = tokens.file

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        places, texts, lefts = (rows.column(c).to_pylist() for c in ("place", "t", "left"))
        whole = "".join(t + "\n" for t in texts)
        out: dict[str, list] = {c: [] for c in ("document_id", "range_index", "place", "k", "lo", "hi")}
        shared = rows.column("document_id")[0].as_py(), rows.column("range_index")[0].as_py()
        found = token_windows(file_offsets(path, whole), size, step, lambda a, b: len(file_offsets(path, whole[a:b])))
        for k, (start, end) in enumerate(found):
            for at in range(max(0, bisect_right(lefts, start) - 1), bisect_left(lefts, end)):  # the blocks it can touch
                lo, hi = max(start - lefts[at], 0), min(end - lefts[at], len(texts[at]))
                if lo < hi:
                    for column, value in zip(out.values(), (*shared, places[at], k, lo, hi)):
                        column.append(value)
        return pa.table(out, schema=pa.schema([("document_id", pa.string()), ("range_index", pa.int32()), ("place", pa.int32()), ("k", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))

    narrow = placed.select("document_id", "range_index", "place", "t", "left")
    cut = narrow.groupBy("document_id", "range_index").applyInArrow(run, "document_id string, range_index int, place int, k long, lo int, hi int")
    return placed.withColumn("n", F.length("t")).join(cut, ["document_id", "range_index", "place"])


def _token_chunks(parts: DataFrame, profile: str, strategy: str, target: int, overlap: int, title: str, order: list[str], tokens: Tokens) -> DataFrame:
    fragments = F.transform(
        "parts",
        lambda p: F.struct(
            p["block_id"].alias("block_id"),
            p["lo"].alias("block_character_start"),
            p["hi"].alias("block_character_end"),
            p["n"].alias("block_character_count"),
            F.round((p["hi"] - p["lo"]) / F.greatest(p["n"], F.lit(1)), 6).alias("coverage"),
        ),
    )
    texts = parts.withColumn("source_block_ids", F.transform("parts", lambda p: p["block_id"]))
    return _finish(
        texts,
        f"{profile.upper().replace('-', '_')}_V02",
        strategy,
        "0.2-draft",
        title,
        order,
        {
            "profile": F.lit(profile),
            "token_count": tokens.count(F.col("text")),
            "retrieval_token_count": tokens.count(F.col("retrieval_text")),
            "target_tokens": F.lit(target),
            "overlap_tokens": F.lit(overlap),
            "source_fragments": fragments,
        },
    )


def by_characters(rows: list[dict], most: int, least: int) -> list[int]:
    """W6 over one document: the 0-based chunk of each block.

    A chunk ends before a boundary or before it would outgrow `most`; one below `least` is put before the next, and the
    last one behind the one before if both fit.
    """
    runs: list[list[int]] = []
    size = 0
    for k, r in enumerate(rows):
        if not runs or r["boundary"] or size + r["raw"] > most:
            runs.append([])
            size = 0
        runs[-1].append(k)
        size += r["raw"] + 1
    weigh = lambda run: sum(rows[k]["size"] + 1 for k in run)
    done: list[list[int]] = []
    held: list[int] = []
    for n, run in enumerate(runs, 1):
        held = held + run
        small = weigh(held) < least
        if small and n < len(runs):
            continue
        if small and done and weigh(done[-1]) + weigh(held) <= most:
            done[-1] += held
        else:
            done.append(held)
        held = []
    return _numbers(done, len(rows))


def by_tokens(rows: list[dict], most: int, least: int, weigh: Callable[[list[int]], int] | None = None) -> list[int]:
    """W7 over one document: as W6 but within page ranges, and a chunk below `least` goes behind the one before, if it
    continues its section or is headings only, and both fit.

    weigh counts the tokens of some blocks together; without it, the sum of the blocks' own counts.
    """
    upto = [0, *accumulate(r["size"] for r in rows)]
    weigh = weigh or (lambda run: upto[run[-1] + 1] - upto[run[0]])  # runs have no gaps
    runs: list[list[int]] = []
    for k, r in enumerate(rows):
        if not runs or r["boundary"] or r["range_index"] != rows[k - 1]["range_index"] or weigh([*runs[-1], k]) > most:
            runs.append([])
        runs[-1].append(k)
    done: list[list[int]] = []
    for run in runs:
        bridge = bool(done) and (rows[run[0]]["same_path"] or all(rows[k]["heading"] for k in run))
        if done and weigh(run) < least and bridge and weigh(done[-1] + run) <= most:
            done[-1] += run
        else:
            done.append(run)
    return _numbers(done, len(rows))


def _numbers(runs: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for number, run in enumerate(runs):
        for k in run:
            out[k] = number
    return out


def _folded(units: DataFrame, order: list[str], fold: Callable[[list[dict]], list[int]], with_text: bool = False) -> DataFrame:
    """(document_id, chunk, parts): the parts of each chunk in order.

    A document's blocks come together as one array, in the JVM; what the fold gets is an array of numbers for each, and
    the texts if asked for. Chunks have no gaps, so they are slices of the array.
    """
    asked = ["boundary", "raw", "size", "range_index", "same_path", "heading", *(["t"] if with_text else [])]

    @F.pandas_udf("array<int>")
    def numbers(*columns: pd.Series) -> pd.Series:
        return pd.Series([fold([dict(zip(asked, r)) for r in zip(*(c.tolist() for c in document))]) for document in zip(*columns)])

    docs = units.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("range_index", *order, "raw", "size", "region", "part"))).alias("rows"))
    flags = F.transform("rows", _flags)
    each = docs.select("document_id", "rows", flags.alias("flags"))
    number = numbers(*[F.col(f"flags.{c}") for c in asked])
    numbered = each.select("document_id", "rows", number.alias("numbers"))
    places = F.transform("numbers", lambda n, i: F.when((i == 0) | (F.get(F.col("numbers"), i - 1) != n), i + 1))
    begun = numbered.select("document_id", "rows", F.array_append(F.array_compact(places), F.size("rows") + 1).alias("starts"))
    slices = F.transform(F.slice("starts", 1, F.size("starts") - 1), lambda s, j: F.slice("rows", s, F.get(F.col("starts"), j + 1) - s))
    chunks = begun.select("document_id", F.posexplode(slices).alias("chunk", "some"))
    return chunks.select("document_id", "chunk", F.transform("some", lambda r: r["part"]).alias("parts"))


def _flags(row: Column, i: Column) -> Column:
    """What a fold asks of a block: its size, whether a boundary is before it in its range, and whether it has the title
    path of the block before it, which may be the last of the range before."""
    before = F.get(F.col("rows"), i - 1)
    heading = row["part"]["block_type"].isin(*tx.HEADINGS)
    same = (i > 0) & before["part"]["title_path"].eqNullSafe(row["part"]["title_path"])
    boundary = (i > 0) & (before["range_index"] == row["range_index"]) & (heading | ~same | (before["region"] != row["region"]))
    named = {"boundary": F.coalesce(boundary, F.lit(False)), "raw": row["raw"], "size": row["size"], "range_index": row["range_index"], "same_path": same, "heading": heading, "t": row["part"]["t"]}
    return F.struct(*[c.alias(n) for n, c in named.items()])


def _units(blocks: DataFrame, ranges: DataFrame | None, order: list[str], size: Column) -> DataFrame:
    units = in_ranges(usable_blocks(blocks), ranges)
    return units.select("document_id", "range_index", *order, F.length("text").alias("raw"), size.alias("size"), F.coalesce("layout_region", F.lit("")).alias("region"), F.struct("t", *PART).alias("part"))


def structural_chunks(blocks: DataFrame, most: int = 600, least: int = 80, order: tuple[str, ...] = ORDER, title: str = "", prefix: str = "STRUCT_V01") -> DataFrame:
    """Chunks along titles and layout, by characters."""
    if most <= 0:
        raise ValueError("invalid chunk size")
    parts = _folded(_units(blocks, None, list(order), F.length("t")), list(order), lambda rows: by_characters(rows, most, least))
    texts = parts.withColumn("text", tx.strip(F.array_join(F.transform("parts", lambda p: p["t"]), "\n"))).withColumn("source_block_ids", F.transform("parts", lambda p: p["block_id"]))
    return _finish(texts, prefix, "structural", "0.1-draft", title, ["chunk"])


def structural_token_chunks(blocks: DataFrame, ranges: DataFrame | None = None, most: int = 512, least: int = 64, order: tuple[str, ...] = ORDER, title: str = "", tokens: Tokens | None = None) -> DataFrame:
    """Chunks along titles and layout, by tokens, within page ranges."""
    tokens = tokens or Tokens()
    path = tokens.file

    def fold(rows: list[dict]) -> list[int]:
        weigh = None if path is None else lambda run: len(file_offsets(path, "\n".join(rows[k]["t"] for k in run)))
        return by_tokens(rows, most, least, weigh)

    size = tokens.count(F.col("t")) if path is None else F.lit(0)
    parts = _folded(_units(blocks, ranges, list(order), size), list(order), fold, path is not None)
    whole = F.transform("parts", lambda p: p.withField("lo", F.lit(0)).withField("hi", F.length(p["t"])).withField("n", F.length(p["t"])))
    texts = parts.withColumn("parts", whole).withColumn("text", tx.strip(F.array_join(F.transform("parts", lambda p: p["t"]), "\n")))
    return _token_chunks(texts, f"structural_t{most}", "structural_token", most, 0, title, ["chunk"], tokens)


def profile_report(chunks: DataFrame, by: str = "strategy", tokens: bool = False) -> DataFrame:
    """A4: one row per strategy or profile."""
    columns = [
        F.count("*").alias("chunk_count"),
        F.round(F.avg("character_count"), 2).alias("average_characters"),
        F.min("character_count").alias("minimum_characters"),
        F.max("character_count").alias("maximum_characters"),
        F.count_if(F.size("issues") > 0).alias("chunks_with_issues"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("pdf_pages")))).alias("page_coverage"),
    ]
    if tokens:
        columns += [
            F.round(F.avg("token_count"), 2).alias("average_tokens"),
            F.min("token_count").alias("minimum_tokens"),
            F.max("token_count").alias("maximum_tokens"),
            F.array_sort(F.collect_list(F.when(F.col("token_count") > F.col("target_tokens"), F.col("chunk_id")))).alias("chunks_over_target"),
        ]
    return chunks.groupBy(by).agg(*columns)
