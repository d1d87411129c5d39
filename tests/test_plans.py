"""Physical plans: what must reach the scan, and what must not be there."""

import pytest

from twinfold.plans.catalog import queries

QUERIES = queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["near_dup_pairs", "text_best_match", "hamming_pairs", "video_pairs", "cross_user_pairs", "exact_dup_alerts"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize(
    "name,pushed",
    [
        ("search_dates", "GreaterThanOrEqual(download_time"),
        ("date_week", "LessThan(download_time"),
        ("search_size_range", "LessThanOrEqual(file_size"),
        ("find_by_hash", "EqualTo(file_hash"),
    ],
)
def test_filters_reach_the_scan(spark, sf_dir, name, pushed):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert pushed in plan


def test_searches_read_no_texts(spark, sf_dir):
    for name in ("list_all", "search_type", "search_dates", "stats"):
        assert "extracted_text" not in _plan(QUERIES[name](spark, sf_dir))


def test_labels_need_no_shuffle(spark, sf_dir):
    plan = _plan(QUERIES["utterance_routed"](spark, sf_dir))
    assert plan.count("Exchange") <= 1  # spreading a table of one split
    assert "Python" not in plan and "Pandas" not in plan
