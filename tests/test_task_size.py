"""Tasks hold a bounded number of rows, however well those compress."""

import pytest
from pyspark.sql import functions as F

from tidemark import shared
from tidemark.operators import graph, history
from tidemark.plans import architecture, bindings, cards, more, queries  # noqa: F401 (they register theirs)
from tidemark.policy import HistoryPolicy

#: Queries over the orders' changes.
ORDERED = ["pair_evidence", "change_amplification", "file_churn", "package_churn", "history_counters", "ownership", "history_cards", "scope_amplification", "eligible_change_coupling"]


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 200)


def test_changes_are_dealt_by_commit(spark, small, small_tasks):
    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()
    c = bindings.order_changes(spark, small).withColumn("task", F.spark_partition_id())
    assert c.count() == rows and c.groupBy("task").count().agg(F.max("count")).first()[0] <= 600
    assert c.select("commit", "task").distinct().count() == c.select("commit").distinct().count()


def test_few_rows_are_left_to_the_session(spark, small):
    li = spark.read.parquet(f"{small}/lineitem.parquet")
    assert shared.dealt(li, li, "l_orderkey") is li


@pytest.mark.parametrize("name", ORDERED)
def test_query_deals_its_changes(spark, small, small_tasks, name):
    plan = queries.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan


def test_file_pairs_deal_rows_once(spark, tmp_path, monkeypatch):
    """Rows that are dealt by commit are listed where they are; a file that a commit names again counts once."""
    rows = [(k, f"d{i % 3}/f{i}", "primary", "trusted") for k in range(40) for i in [0, 1, 1, 2, *([3, 4, 5, 5] if k % 2 else [])]]
    c = spark.createDataFrame(rows, "commit long, path string, role string, trust string").repartition(7, "commit")
    plans, plain = [], history.written
    monkeypatch.setattr(history, "written", lambda d, name: plans.append(d._jdf.queryExecution().executedPlan().toString()) or plain(d, name))
    got = history.file_coupling(c, HistoryPolicy(bulk_files=4, file_permille=0)).select("left", "right", "shared").collect()
    assert sorted(map(tuple, got)) == [("d0/f0", "d1/f1", 20), ("d0/f0", "d2/f2", 20), ("d1/f1", "d2/f2", 20)]
    assert plans[0].count("Exchange hashpartitioning") == 1


def test_large_graphs_are_not_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)], "src long, dst long")
    plans, plain = [], graph.written
    monkeypatch.setattr(graph, "BROADCAST_NODES", 3)
    monkeypatch.setattr(graph, "written", lambda d, name: plans.append(d._jdf.queryExecution().executedPlan().toString()) or plain(d, name))
    got = graph.strong_components(edges)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
