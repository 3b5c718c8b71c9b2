import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import blocks as bl
from quarry.operators import validate as va
from quarry.sources import files, jsonl
from quarry.sources.pages import page_paths, page_ranges, requested_pages
from quarry.streaming.blocks import arriving_confidence, stream_blocks, stream_pages


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_jsonl(spark, tmp_path):
    good = write(tmp_path, "a.jsonl", '{"a": 1}\n\n  \n{"a": 2, "b": 3}\n')
    assert sorted(r.a for r in jsonl.read_jsonl_strict(spark, good, "a int").collect()) == [1, 2]
    for bad in ("[1]", "{bad", "Average score: 1", "3"):
        path = write(tmp_path, "b.jsonl", '{"a": 1}\n' + bad + "\n")
        with pytest.raises(Exception, match="expected a JSON object"):
            jsonl.read_jsonl_strict(spark, path, "a int").collect()
    footer = write(tmp_path, "c.jsonl", '{"a": 1}\nAverage score: 1\n')
    assert jsonl.read_jsonl_strict(spark, footer, "a int", allow_legacy_footer=True).count() == 1
    problems = jsonl.check_jsonl(spark, write(tmp_path, "d.jsonl", '{"a": 1}\n\n[1]\n{x\n')).orderBy("line_number").collect()
    assert [(r.line_number, r.problem) for r in problems] == [(3, "expected a JSON object"), (4, "invalid JSON")]


def test_line_numbers_over_splits(spark, tmp_path):
    """A file is read in many splits, whose lines are of all lengths, blank ones among them."""
    lines = [json.dumps({"a": k, "b": "x" * (k * 37 % 211)}) if k % 7 else "" for k in range(1, 3001)]
    lines[1700] = "[1]"
    (tmp_path / "many").mkdir()
    big = write(tmp_path / "many", "big.jsonl", "\n".join(lines) + "\n")
    write(tmp_path / "many", "small.jsonl", '{"a": 1}\n{x\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        assert spark.read.text(big).rdd.getNumPartitions() > 50
        got = {(r.file.split("/")[-1], r.line_number): r.value for r in jsonl.numbered_lines(spark, str(tmp_path / "many")).collect()}
        assert got == {**{("big.jsonl", k): x for k, x in enumerate(lines, 1)}, ("small.jsonl", 1): '{"a": 1}', ("small.jsonl", 2): "{x"}
        problems = sorted((r.file.split("/")[-1], r.line_number, r.problem) for r in jsonl.check_jsonl(spark, str(tmp_path / "many")).collect())
        assert problems == [("big.jsonl", 1701, "expected a JSON object"), ("small.jsonl", 2, "invalid JSON")]
        with pytest.raises(Exception, match="big.jsonl:1701: expected a JSON object"):
            jsonl.read_jsonl_strict(spark, big, "a int").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("刀", None), ("b", 1)], "t string, n int")
    jsonl.write_jsonl(df, str(tmp_path / "out"), single_file=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert sorted(map(json.loads, part.read_text(encoding="utf-8").splitlines()), key=str) == sorted([{"t": "刀", "n": None}, {"t": "b", "n": 1}], key=str)
    assert jsonl.read_jsonl(spark, str(tmp_path / "out"), "t string, n int").count() == 2


def test_review_csv_with_and_without_mark(spark, tmp_path):
    for mark in ("﻿", ""):
        path = write(tmp_path, f"q{len(mark)}.csv", mark + 'block_id,text\nb1,"a, ""q""\nsecond"\nb2,\n')
        got = jsonl.read_review_csv(spark, path).orderBy("block_id").collect()
        assert [(r.block_id, r.text) for r in got] == [("b1", 'a, "q"\nsecond'), ("b2", "")]
    df = spark.createDataFrame([("b", 'x "y"', "")], "block_id string, text string, note string")
    jsonl.write_review_csv(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in jsonl.read_review_csv(spark, str(tmp_path / "csv")).collect()] == [("b", 'x "y"', "")]


def test_page_specifications(spark):
    pages = lambda spec, strict: spark.range(1).select(requested_pages(F.lit(spec), strict).alias("p")).first().p
    assert pages("3,1-2,2", True) == [3, 1, 2]
    assert pages("20, 10-12,,", True) == [20, 10, 11, 12]
    assert pages("5-4", False) == []
    for bad in ("5-4", "0", ""):
        with pytest.raises(Exception, match="invalid page range|no pages"):
            pages(bad, True)
    assert page_ranges("111-128, 145") == [(111, 128), (145, 145)]
    for bad in ("0-3", "5-4", "x"):
        with pytest.raises(ValueError):
            page_ranges(bad)
    paths = {r.pdf_page: r.title_path for r in page_paths(spark, {"1-3": ["a"], "2": ["b"]}).collect()}
    assert paths == {1: ["a"], 2: ["b"], 3: ["a"]}


def test_hashes_manifest_and_registry(spark, tmp_path):
    write(tmp_path, "x.bin", "abc")
    h = files.file_hashes(spark, str(tmp_path))
    assert h.first().sha256 == hashlib.sha256(b"abc").hexdigest()
    assert files.registry_entry(spark, str(tmp_path)).first().size_mb == 0.0
    profiles = spark.createDataFrame([("p", "x.bin", 3)], "profile string, file string, chunk_count int")
    m = files.manifest(profiles, h, h, h).first()
    assert m.profiles["p"].sha256 == h.first().sha256 and m.profiles["p"].report.chunk_count == 3


def page_file(folder, page, texts):
    folder.mkdir(exist_ok=True)
    data = {"document_id": "D", "pdf_page": page, "pdf_index": page - 1, "elapsed_seconds": 1.0, "results": [{"rec_texts": texts, "rec_scores": [0.9] * len(texts), "rec_boxes": [[0, 0, 1, 1]] * len(texts)}]}
    (folder / f"page_{page:03d}_ocr.json").write_text(json.dumps(data, ensure_ascii=False, indent=1), encoding="utf-8")


def test_page_files_and_validator(spark, tmp_path):
    folder = tmp_path / "pages"
    page_file(folder, 1, ["G90 a", "b。"])
    page_file(folder, 2, ["c"])
    pages = bl.read_ocr_pages(spark, str(folder))
    requested = spark.createDataFrame([(1,), (2,), (3,)], "pdf_page int")
    assert [r.pdf_page for r in bl.missing_pages(requested, pages).collect()] == [3]
    blocks = bl.build_blocks(pages, page_paths(spark, {"1-2": ["c"]}), {}, "b", -8)
    expected = spark.createDataFrame([(1, "G90"), (1, "zz"), (9, "x")], "pdf_page int, token string")
    problems = sorted((r["check"], r["id"]) for r in va.ocr_blocks(pages, blocks, expected).collect())
    assert problems == [("missing_expected_tokens", "1:zz"), ("missing_expected_tokens", "9:x")]
    assert [tuple(r)[2:] for r in bl.page_report(pages, blocks).orderBy("pdf_page").collect()] == [(2, 2, 0), (1, 1, 0)]


def test_block_checks_compute_the_blocks_once_and_pages_do_not_shuffle(spark, tmp_path):
    page_file(tmp_path / "pages", 1, ["a", "b。"])
    pages = bl.read_ocr_pages(spark, str(tmp_path / "pages"))
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    made = bl.build_blocks(pages, page_paths(spark, {"1": ["c"]}), {}, "b", -8).select("block_id", "pdf_page", "printed_page", "text", "source_line_ids", "review_status")
    blocks = made.unionByName(made.withColumn("printed_page", F.lit(0)))
    expected = spark.createDataFrame([(1, "a"), (1, "zz"), (None, "x")], "pdf_page int, token string")
    found = va.ocr_blocks(pages, blocks.mapInArrow(counted, blocks.schema), expected)
    problems = sorted((r["check"], r["id"]) for r in found.collect())
    one = "D_P001_B001"
    assert problems == [("duplicate_block_ids", one), ("duplicate_source_line_ids", "D_P001_L001"), ("duplicate_source_line_ids", "D_P001_L002"), ("invalid_printed_page_mappings", one), ("missing_expected_tokens", "1:zz"), ("missing_expected_tokens", "x")]
    assert rows.value == 2


def test_streamed_blocks_equal_batch_blocks(spark, tmp_path):
    folder = tmp_path / "pages"
    for page in (1, 2):
        page_file(folder, page, ["a", "b。", "2.1 H"])
    paths = page_paths(spark, {"1-2": ["c"]})
    query = stream_blocks(stream_pages(spark, str(folder), 1), paths, {}, "b", 0, str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    query.awaitTermination(120)
    batch = bl.build_blocks(bl.read_ocr_pages(spark, str(folder)), paths, {}, "b", 0)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_arriving_confidence(spark):
    lines = spark.createDataFrame([("2024-01-01 00:10:00", 0.5), ("2024-01-01 00:50:00", 1.0), ("2024-01-01 01:10:00", 0.2)], "t string, score double").withColumn("t", F.to_timestamp("t"))
    got = arriving_confidence(lines, "t").orderBy("start").collect()
    assert [(r.lines, r.mean_score) for r in got] == [(2, 0.75), (1, 0.2)]


def test_pdf_reading_is_optional(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    with pytest.raises(Exception, match="pymupdf|PDF|Failed"):
        files.read_pdf_pages(spark, str(tmp_path)).collect()
