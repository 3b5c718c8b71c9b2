import pytest
from pyspark.sql import functions as F

from quarry.operators import blocks as bl
from quarry.schemas import OCR_PAGE
from quarry.sources.pages import page_paths


def pages(spark, *texts, scores=None, page=1):
    rows = [("D", None, page, page - 1, None, 2.0, None, [(list(texts), scores or [0.9] * len(texts), [[0, 0, 1, 1]] * len(texts), None)])]
    return spark.createDataFrame(rows, OCR_PAGE)


def build(spark, *texts, path=("c",), scores=None):
    blocks = bl.build_blocks(pages(spark, *texts, scores=scores), page_paths(spark, {"1-2": list(path)}), {"2": "第2章 x"}, "b", -8)
    return blocks.orderBy("block_id").collect()


def test_paragraphs_merge_up_to_a_sentence_end(spark):
    assert [b.text for b in build(spark, "abc", "def。", "gh", "", "ij")] == ["abcdef。", "ghij"]


def test_paragraphs_do_not_outgrow_the_limit(spark):
    assert [len(b.text) for b in build(spark, "a" * 200, "b" * 60, "c")] == [260, 1]


def test_titles(spark):
    got = build(spark, "x", "y", "2.4.1 A", "2.5.1 B", "2.4.2 C", "2.6 D", path=("c", "2.4 S"))
    paths = {b.text: b.title_path for b in got}
    assert paths["2.4.1 A"] == ["第2章 x", "2.4 S", "2.4.1 A"]
    assert paths["2.5.1 B"] == ["第2章 x", "2.5", "2.5.1 B"]
    assert paths["2.4.2 C"] == ["第2章 x", "2.4", "2.4.2 C"]
    assert paths["2.6 D"] == ["第2章 x", "2.6 D"]


def test_table_region_ends_after_thirty_lines(spark):
    lines = ["表2-1 t"] + [f"行{k}。" for k in range(31)]
    got = build(spark, *lines)
    assert [b.layout_region for b in got] == ["table_candidate"] * 30 + [None, None]
    assert got[0].issues == ["table_layout_requires_review"] and got[1].issues == ["inside_table_candidate"]


def test_table_region_ends_at_a_heading_and_restarts(spark):
    got = build(spark, "x", "y", "表2-1 t", "a。", "2.1 H", "b。", "表2-2 u", "图2-1 v", "c。")
    assert [b.layout_region for b in got if b.text != "xy"] == ["table_candidate", "table_candidate", None, None, "table_candidate", None, None]


def test_issues_confidence_and_ids(spark):
    (b, *_) = build(spark, "GOO a", "b", scores=[0.5, 0.7])
    assert (b.block_id, b.source_line_ids, b.average_confidence, b.printed_page) == ("D_P001_B001", ["D_P001_L001", "D_P001_L002"], 0.6, -7)
    assert b.issues == ["low_confidence", "possible_ocr_confusion"]


def test_uneven_arrays_fail(spark):
    bad = spark.createDataFrame([("D", None, 1, 0, None, 0.0, None, [(["a"], [0.1, 0.2], [[1]], None)])], OCR_PAGE)
    with pytest.raises(Exception, match="differ in length"):
        bl.with_lines(bad).collect()


def test_summary_pairs_scores_before_blank_lines_go(spark):
    df = bl.ocr_page_summary(pages(spark, "G01 x", " ", "low", scores=[0.9, 0.1, 0.5]))
    r = df.first()
    assert (r.line_count, r.character_count, r.average_confidence, r.minimum_confidence, r.codes) == (2, 9, 0.5, 0.1, ["G01"])
    assert [(x.text, x.score) for x in r.low_confidence_lines] == [("low", 0.5)]
    batch = bl.ocr_batch_summary(df).first()
    assert (batch.page_count, batch.total_lines, batch.weighted_average_confidence, batch.total_elapsed_seconds) == (1, 2, 0.5, 2.0)
    assert bl.ocr_batch_summary(df.limit(0)).first().weighted_average_confidence is None


def test_no_line_is_lost_or_doubled(spark):
    texts = ["a", "2.1 H", "b。", "c", "", "表1-1 t", "d"] * 5
    got = build(spark, *texts)
    ids = [i for b in got for i in b.source_line_ids]
    assert sorted(ids) == sorted(f"D_P001_L{k + 1:03d}" for k, t in enumerate(texts) if t) and len(set(ids)) == len(ids)


def test_blocks_need_no_shuffle(spark, capsys):
    df = bl.build_blocks(pages(spark, "a"), page_paths(spark, {"1": ["c"]}), {}, "b")
    bl.with_lines(pages(spark, "a")).select(F.explode("lines")).explain()
    assert "Exchange" not in capsys.readouterr().out
    assert df.count() == 1
