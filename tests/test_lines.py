"""Lines of orders: tasks grow in number with the table, not in size."""

from __future__ import annotations

from math import ceil

import pytest

from ragmill.plans import QUERIES, base


@pytest.mark.parametrize("name", ["posterior_mixture", "mixture_loss", "balanced_passages"])
def test_tasks_by_rows(spark, sf_dir, name, monkeypatch):
    rows = base.read(spark, sf_dir, "lineitem").count()
    for most in (rows // 30, rows // 60):
        monkeypatch.setattr(base, "TASK_ROWS", most)
        assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == ceil(rows / most)
