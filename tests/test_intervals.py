import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunks as ch
from quarry.operators import intervals as iv


def spans(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a = rng.randint(-300, 300)
        rows.append((k, rng.choice("ab"), a, a + int(longest ** rng.random()) - 1))
    return [*rows, (n, "a", None, 5), (n + 1, "a", 5, None), (n + 2, "b", 7, 3), (n + 3, None, 0, 9), (0, *rows[0][1:]), (n + 4, "a", -(2**40), 2**40), (n + 5, "b", 0, 0)]


@pytest.mark.parametrize("seed, long_left, long_right", [(1, 1, 200), (2, 200, 1), (3, 100, 100), (4, 1, 1)])
@pytest.mark.parametrize("on", [(), ("g",)])
def test_pairs_that_overlap(spark, seed, long_left, long_right, on):
    one, two = spans(seed, 150, long_left), spans(seed + 50, 150, long_right)
    schema = "id int, g string, lo long, hi long"
    got = iv.interval_join(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), ("lo", "hi"), ("lo", "hi"), on)
    sound = lambda r: None not in r[2:] and r[2] <= r[3]
    expected = [(a, b) for a in filter(sound, one) for b in filter(sound, two) if a[2] <= b[3] and b[2] <= a[3] and (not on or (a[1] == b[1] and a[1]))]
    assert sorted(((tuple(r.left), tuple(r.right)) for r in got.collect()), key=str) == sorted(expected, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_ranges_do_not_meet_row_by_row(spark, monkeypatch):
    blocks = spark.range(1000).select((F.col("id") % 300).cast("int").alias("pdf_page"), "id")
    ranges = spark.range(1_000_000).select(F.col("id").cast("int").alias("range_index"), (F.col("id") * 2).cast("int").alias("start_page"), (F.col("id") * 2 + F.col("id") % 3).cast("int").alias("end_page"))
    got = ch.in_ranges(blocks, ranges)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    expected = sum(1 for page in [k % 300 for k in range(1000)] for r in range(160) if 2 * r <= page <= 2 * r + r % 3)
    assert got.count() == expected


@pytest.mark.parametrize("few", [1000, 1])
def test_rows_in_no_range_stay_if_asked(spark, monkeypatch, few):
    monkeypatch.setattr(iv, "FEW", few)
    rows = spark.createDataFrame([(1, 5), (2, 50), (3, None), (4, 7), (4, 7)], "id int, page int")
    ranges = spark.createDataFrame([("x", 1, 6), ("y", 4, 10), ("z", 9, 2)], "name string, a int, b int")
    got = sorted(((r.id, r.page, r.name) for r in iv.with_ranges(rows, "page", ranges, "a", "b", keep=True).collect()), key=str)
    assert got == [(1, 5, "x"), (1, 5, "y"), (2, 50, None), (3, None, None), (4, 7, "y"), (4, 7, "y")]
    assert iv.with_ranges(rows, "page", ranges, "a", "b").count() == 4
