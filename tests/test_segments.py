import random

import numpy as np
import pytest

from quarry.operators import segments as sg


def walked(rows, rule):
    """rows (place, weight, starts, ends) of one group, in order; the segment of each."""
    out, number, held = [], -1, None
    for _, w, starts, ends in rows:
        if held is None or starts or (not rule.least and held + w > rule.limit):
            number, held = number + 1, 0
        held += w
        out.append(number)
        if ends or (rule.least and held >= rule.limit):
            held = None
    return out


def groups(seed, sizes, heavy=12):
    rng = random.Random(seed)
    out = {}
    for g, n in enumerate(sizes):
        places = sorted(rng.sample(range(3 * n), n))
        some = rng.choice((0.0, 0.02, 0.3))
        out[g if g % 5 else None if g == 0 else g] = [(p, rng.randint(0, heavy), rng.random() < some, rng.random() < some) for p in places]
    return out


@pytest.mark.parametrize("rule", [sg.Rule(20), sg.Rule(1), sg.Rule(20, least=True), sg.Rule(0, least=True), sg.Rule(300)])
@pytest.mark.parametrize("slab, rows", [(1 << 16, 1 << 17), (16, 40), (3, 1)])
def test_segments_are_those_of_a_walk(spark, monkeypatch, rule, slab, rows):
    monkeypatch.setattr(sg, "SLAB", slab)
    monkeypatch.setattr(sg, "ROWS", rows)
    made = groups(slab + rule.limit, [1, 2, 5, 30, 60, 200, 1, 90])
    data = [(g, p, w, s, e, f"x{p}") for g, some in made.items() for p, w, s, e in some]
    df = spark.createDataFrame(data, "g int, p int, w int, s boolean, e boolean, more string").repartition(3)
    got = sg.greedy_segments(df, ["g"], "p", "w", rule, "s", "e").collect()
    assert {(r.g, r.p): r.segment for r in got} == {(g, r[0]): k for g, some in made.items() for r, k in zip(some, walked(some, rule))}
    assert len(got) == len(data) and all(r.more == f"x{r.p}" for r in got)


def test_marking_by_doubling():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100, 1000):
        after = np.minimum(np.arange(n) + rng.integers(1, 4, n), n)
        expected, at = set(), 0
        while at < n:
            expected.add(at)
            at = after[at]
        assert set(np.flatnonzero(sg.marked(after, np.array([0])))) == expected
        last, count = sg.last_and_count(after)
        assert last[0] == max(expected) and count[0] == len(expected)


def test_a_long_group_goes_over_many_tasks(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("'d' as g", "id as p", "id % 7 as w", "id % 5003 = 0 as s")
    found = sg.greedy_segments(df, ["g"], "p", "w", sg.Rule(50), "s")
    got = found.groupBy("segment").agg({"w": "sum", "p": "count"}).collect()
    rows = [(k, k % 7, k % 5003 == 0, False) for k in range(n)]
    assert len(got) == walked(rows, sg.Rule(50))[-1] + 1 and max(r["sum(w)"] for r in got) <= 50


def test_no_rows(spark):
    assert sg.greedy_segments(spark.createDataFrame([], "g int, p int, w int"), ["g"], "p", "w", sg.Rule(3)).count() == 0
