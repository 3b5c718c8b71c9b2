"""Folds over rows against the folds over arrays, with slabs so small that documents go over many."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import blocks as bl
from quarry.operators import chunks as ch
from quarry.operators import row_folds as rf
from quarry.operators import segments as sg

CHAPTERS = {"1": "One", "2": "2.4 odd title", "3": "第三章"}
LINE = "array<struct<line_index:int,source_line_id:string,text:string,score:double,box:array<int>,type:string>>"


def text_of(rng):
    a, b, c = rng.randint(1, 3), rng.randint(1, 2), rng.randint(1, 3)
    return rng.choice(
        [f"{a}.{b} head", f"{a}.{b}.{c} deep", f"{a}.{b}.{c} deep", f"{a}.{b}", f"（{b}）sub", f"表 {a}-{b} table", f"图 {a}-{b} figure", "练一练", "注意：", "G01 X1", "words " * rng.randint(1, 20), "words " * rng.randint(1, 9), "ends。", "x" * 300]
    ).strip()


def lines_of(spark, seed):
    rng = random.Random(seed)
    rows = []
    for d, n in enumerate((0, 1, 3, 40, 90, 7, 60)):
        index, lines = 0, []
        for _ in range(n):
            index += rng.choice((1, 1, 1, 2, 9))
            lines.append((index, f"D{d}_L{index}", text_of(rng), rng.random(), [1, 2], None))
        rows.append((f"D{d}", d % 3 + 1, lines))
    pages = spark.createDataFrame(rows, f"document_id string, pdf_page int, lines {LINE}")
    return pages.withColumn("lines", F.transform("lines", lambda x: x.withField("type", tx.classify(x["text"], x["line_index"]))))


def rows_of(pages):
    return pages.select("document_id", "pdf_page", F.explode("lines").alias("l")).select("document_id", "pdf_page", "l.*")


def folded(pages, column):
    return sorted((r.document_id, r.line_index, r.value) for r in pages.select("document_id", "pdf_page", F.explode(F.arrays_zip(F.col("lines.line_index").alias("line_index"), column.alias("value"))).alias("z")).select("document_id", "z.*").collect())


@pytest.fixture(params=[4, 1 << 16])
def slab(request, monkeypatch):
    monkeypatch.setattr(sg, "SLAB", request.param)
    return request.param


def test_regions_paths_and_blocks_over_rows(spark, slab):
    pages = lines_of(spark, slab)
    lines = rows_of(pages)
    got = rf.table_regions(lines).select("document_id", "line_index", "layout_region").collect()
    assert sorted(map(tuple, got), key=str) == sorted(folded(pages, bl.table_regions(F.col("lines"))), key=str)
    chapter_map = F.create_map(*[F.lit(x) for pair in CHAPTERS.items() for x in pair])
    start = spark.createDataFrame([(1, ["2.1 before", "1.2 then"]), (2, [])], "pdf_page int, initial_path array<string>")
    for initial in (start, None):
        named = pages.join(initial, "pdf_page", "left") if initial is not None else pages.withColumn("initial_path", F.lit(None).cast("array<string>"))
        expected = folded(named, bl.title_paths(F.col("lines"), F.col("initial_path"), chapter_map))
        assert sorted((r.document_id, r.line_index, r.title_path) for r in rf.title_paths(lines, initial, CHAPTERS).collect()) == expected
    numbers = {(d, i): n for d, i, n in folded(pages, bl.block_numbers(F.col("lines")))}
    blocks = rf.paragraph_blocks(lines).collect()
    mine = {(b.document_id, int(x.split("_L")[1])): int(b.block_id.split("_B")[1]) for b in blocks for x in b.source_line_ids}
    assert mine == numbers


def blocks_of(spark, seed):
    rng = random.Random(seed)
    rows = []
    for d, n in enumerate((1, 2, 70, 30, 5)):
        for k in range(n):
            kind = rng.choice(["paragraph"] * 6 + ["heading", "subheading", "header_footer"])
            path = rng.choice([["a"], ["a"], ["a", "b"], [], None])
            rows.append((f"D{d}_B{k + 1:03d}", f"D{d}", k // 9 + 1, k // 9, kind, rng.choice([None, None, None, "table_candidate"]), rng.choice(["w " * rng.randint(1, 60), "tiny", " pad ", "x" * 700, " "]), path, [f"L{k}"], rng.choice([[], None, ["i"]])))
    return spark.createDataFrame(rows, "block_id string, document_id string, pdf_page int, printed_page int, block_type string, layout_region string, text string, title_path array<string>, source_line_ids array<string>, issues array<string>")


def test_chunks_over_rows(spark, slab):
    blocks = blocks_of(spark, slab)
    as_rows = lambda df: sorted(df.select("chunk_id", "text", "source_block_ids", "title_paths", "issues").collect(), key=lambda r: r.chunk_id)
    for most, least in ((600, 80), (150, 100), (40, 1)):
        assert as_rows(rf.structural_chunks(blocks, most, least)) == as_rows(ch.structural_chunks(blocks, most, least))
    ranges = spark.createDataFrame([(0, 1, 3), (1, 2, 4), (2, 6, 9)], "range_index int, start_page int, end_page int")
    tokens = ch.Tokens(r"\S+")
    for some, most, least in ((None, 64, 16), (ranges, 100, 64)):
        one, two = (f(blocks, some, most, least, tokens=tokens) for f in (rf.structural_token_chunks, ch.structural_token_chunks))
        assert as_rows(one) == as_rows(two)


def test_numbers_follow_the_order_over_partitions(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 3001).alias("o")).repartition(5)
    got = sorted((r.place, r.g, r.o) for r in rf.numbered(rows, ["g"], ["o"]).collect())
    assert [p for p, *_ in got] == list(range(3000)) and [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_structural_chunks_compute_the_blocks_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    made = [(f"B{n:03d}", "D", 1, 1, "paragraph", None, f"text {n}", ["a"], [f"L{n}"], []) for n in range(20)]
    blocks = spark.createDataFrame(made, "block_id string, document_id string, pdf_page int, printed_page int, block_type string, layout_region string, text string, title_path array<string>, source_line_ids array<string>, issues array<string>")
    for chunks in (rf.structural_chunks, lambda b: rf.structural_token_chunks(b, tokens=ch.Tokens(r"\S+"))):
        rows.value = 0
        (chunk,) = chunks(blocks.mapInArrow(counted, blocks.schema)).collect()
        assert chunk.source_block_ids == [r[0] for r in made] and rows.value == 20


FOLDS = {
    "paragraph_blocks": rf.paragraph_blocks,
    "title_paths": lambda lines: rf.title_paths(lines, None, CHAPTERS),
    "table_regions": rf.table_regions,
}


@pytest.mark.parametrize("fold", FOLDS)
def test_lines_are_computed_once(spark, fold):
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        met.add(1)
        return text

    lines = rows_of(lines_of(spark, 1)).localCheckpoint()
    FOLDS[fold](lines.withColumn("text", seen.asNondeterministic()("text"))).write.format("noop").mode("overwrite").save()
    assert met.value == lines.count()


def test_texts_do_not_go_through_python(spark):
    lines = rows_of(lines_of(spark, 1)).withColumns({"size": F.length("text"), "opens": F.col("type") == "heading"})
    cut = sg.greedy_segments(lines, rf.PAGE, "line_index", "size", sg.Rule(260), starts="opens")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [run(document_id" in plan and "MapInArrow" not in plan
    assert "text" not in plan.split("ArrowEvalPython [")[1].split("]")[0]
