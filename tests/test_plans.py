"""The registered queries' data reach the rules that they are there for."""

import hashlib
from itertools import product

import duckdb
from pyspark.sql import functions as F

from quarry.plans import base, documents, retrieval

SMALL = "/root/testdata/sf0.001"


def test_every_kind_of_line_flag_and_region_occurs(spark):
    kinds = {r.type for r in documents.line_classify(spark, SMALL).select("type").distinct().collect()}
    assert kinds == {"header_footer", "heading", "subheading", "caption", "exercise_heading", "label", "code", "paragraph"}
    assert {r.issue for r in documents.line_issues(spark, SMALL).collect()} == {"low_confidence", "possible_ocr_confusion", "table_layout_requires_review", "inside_table_candidate", "header_chapter_number_missing"}
    assert documents.table_region(spark, SMALL).agg(F.sum("inside")).first()[0] > 0
    depths = {r.n for r in base.ocr_lines(spark, SMALL).select(F.size("title_path").alias("n")).distinct().collect()}
    assert depths == {1, 2, 3}


def test_selected_text_and_its_sql_on_null_and_empty_values(spark, tmp_path):
    """A title that a null source leaves null falls back to the text, and an empty text stays one."""
    values = list(product(("en", "fr", "de", "", None), ("src0", "", None), ("a", "", None)))
    rows = [(k, text, lang, source) for k, (lang, source, text) in enumerate(values)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def plain(text, lang, source):
        title = {"en": "", "fr": None}.get(lang, None if source is None or text is None else f"{source}: {text}")
        chosen = title or text
        return None if chosen is None else hashlib.md5(chosen.encode()).hexdigest()

    expected = [(k, plain(*row)) for k, *row in rows]
    assert sorted(map(tuple, retrieval.selected_text(spark, str(tmp_path)).collect())) == expected
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(db.execute(retrieval.SELECTED_SQL).fetchall()) == expected
