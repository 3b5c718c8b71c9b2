"""Line views compute a page's lines once."""

import pytest

from quarry.plans import base, documents

DATA = "/root/testdata/sf0.001"


def test_lines_are_not_computed_again_by_an_inferred_filter(spark):
    for view in (base.line_rows, base.line_blocks):
        plan = view(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("OCR arrays differ in length") == 1


def test_line_blocks_do_not_fold_title_paths(spark):
    plan = base.line_blocks(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Chapter one" not in plan


@pytest.mark.parametrize("query", ["data_review_queue", "gold_review_queue", "gold_mapping", "fragment_gold_mapping", "cited_answers"])
def test_blocks_that_are_met_several_times_are_written_once(spark, query):
    plan = documents.QUERIES[query][0](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "OCR arrays differ in length" not in plan
