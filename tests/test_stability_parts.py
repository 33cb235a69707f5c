"""Stability of views: what a task holds does not grow with the input."""

import pytest

from strandlake.operators import metrics


def test_stability_deals_rows_by_their_number(spark, monkeypatch):
    rows = spark.createDataFrame([(r, k) for r in (None, *range(40)) for k in (None, 1, 2)], "record int, key int")
    a, b = rows.filter("key is null or key = 1"), rows.filter("record is null or record % 2 = 0")
    whole = metrics.stability(a, b, "record", "key")
    monkeypatch.setattr(metrics, "TASK_ROWS", 10)
    dealt = metrics.stability(a, b, "record", "key")
    parts = -(-(a.count() + b.count()) // 10)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {parts}), REPARTITION_BY_NUM") == 2
    assert tuple(dealt.first()) == pytest.approx(tuple(whole.first())) and whole.first().records == 41
