import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<int>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_tokens_keep_codes_and_full_width_digits(spark):
    assert one(spark, tx.tokens(F.col("t")), t="G01 X１２3 刀具补偿 f0.5 10.5mm") == ["g01", "x1２3", "f0.5", "10.5", "mm", "刀", "具", "补", "偿", "刀具", "具补", "补偿"]
    assert one(spark, tx.tokens(F.col("t")), t="刀 x") == ["x", "刀"]
    assert one(spark, tx.tokens(F.col("t")), t="") == []


def test_code_mentions(spark):
    assert one(spark, tx.code_mentions(F.col("t")), t="G01X20 AG02 g 3.5\nM\n03 Z-1") == sorted(["G01", "X20", "g3.5", "M\n03", "Z-1"])


@pytest.mark.parametrize(
    ("text", "index", "kind"),
    [
        ("12", 1, "header_footer"),
        ("12", 5, "paragraph"),
        ("图2-1 x", 4, "caption"),
        ("图2-1所示 x", 4, "paragraph"),
        ("2.4.1 A", 4, "heading"),
        ("2.5", 4, "heading"),
        ("（一）x", 4, "subheading"),
        ("练一练", 4, "exercise_heading"),
        ("注意：", 4, "label"),
        ("N10 G01 X20", 4, "code"),
        ("使用指令 G01 进行加工", 4, "paragraph"),
    ],
)
def test_classify(spark, text, index, kind):
    assert one(spark, tx.classify(F.col("t"), F.col("i")), t=text, i=index) == kind


def test_normalize_takes_every_white_space(spark):
    assert one(spark, tx.normalize(F.col("t")), t="　 a \t b\n") == "a b"
    assert one(spark, tx.strip(F.col("t")), t="　 a  b\n") == "a  b"


@pytest.mark.parametrize(("pages", "label"), [([], "页码未知"), ([5], "第5页"), ([5, 6, 7], "第5—7页"), ([7, 5], "第7—5页"), ([5, 5], "第5页")])
def test_page_label(spark, pages, label):
    assert one(spark, tx.page_label(F.col("p")), p=pages) == label


def test_first_filled_and_lookup(spark):
    assert one(spark, tx.first_filled(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert one(spark, tx.lookup(F.create_map(F.lit("a"), F.lit(1)), F.col("a"), F.lit(9)), a="z") == 9


@pytest.mark.parametrize(("values", "chosen"), [(("", ""), ""), ((None, ""), ""), (("", None), None), (("x", ""), "x"), (("", None, ""), "")])
def test_first_filled_ends_with_the_last_as_it_is(spark, values, chosen):
    columns = [F.lit(v).cast("string") for v in values]
    assert spark.range(1).select(tx.first_filled(*columns).alias("x")).first()["x"] == chosen


def test_token_rows_and_count_agree(spark):
    df = spark.createDataFrame([(1, "ab 刀具, x"), (2, ""), (3, "😀 a")], "k int, t string")
    rows = {(r.k, r.token): (r.s, r.e) for r in tx.token_rows(df, ["k"], "t").collect()}
    assert rows == {(1, 0): (0, 2), (1, 1): (3, 4), (1, 2): (4, 5), (1, 3): (5, 6), (1, 4): (7, 8), (3, 0): (0, 1), (3, 1): (2, 3)}
    assert [r[0] for r in df.orderBy("k").select(tx.token_count(F.col("t"))).collect()] == [5, 0, 2]


def test_character_overlap(spark):
    assert one(spark, tx.character_overlap(F.col("a"), F.col("b")), a="aab😀", b="b😀c") == 2


def test_letters_that_fold_to_latin_ones_and_digits_of_all_kinds_are_tokens(spark):
    assert one(spark, tx.tokens(F.col("t")), t="ıſx3.4 K7 É0 x٣.٤ ０１.１") == ["ıſx3.4", "k7", "0", "x٣.٤", "01.1"]


def test_token_spans_are_those_of_token_rows(spark):
    texts = ["", " ", "a", " bb  刀具 c\u3000d ", "𝄞x y", "、。 G01 X-1.5 " * 40]
    asked = {k: [j for j in range(200) if j % (k + 1) == 0] for k in range(len(texts))}
    for pattern in (None, r"\S+", r"[a-z]*"):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        rows = {(r.k, r.token): (r.s, r.e) for r in tx.token_rows(df, ["k"], "t", pattern).collect()}
        counts = {r.k: r.n for r in df.select("k", F.size(F.regexp_extract_all("t", F.lit(f"(?U)({pattern or tx.DEFAULT_TOKEN})"), F.lit(1))).alias("n")).collect()}
        some = {k: [j for j in asked[k] if j < counts[k]] for k in asked}
        with_asked = spark.createDataFrame([(k, t, some[k]) for k, t in enumerate(texts)], "k int, t string, asked array<int>")
        for r in with_asked.select("k", tx.token_spans(F.col("t"), F.col("asked"), pattern).alias("spans")).collect():
            assert [None if x is None else (x.s, x.e) for x in r.spans] == [rows.get((r.k, j)) for j in some[r.k]]
