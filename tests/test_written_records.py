"""Records that a query writes to read them back are compressed, and arrive whole."""

from pathlib import Path

import pytest

from paperloom.plans import queries_sources as Q
from paperloom.plans import views as V


@pytest.fixture
def orders(spark, tmp_path):
    rows = [(i, i % 50, "1995-03-01", "5-LOW") for i in range(1, 601)]
    made = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string")
    made.selectExpr("o_orderkey", "o_custkey", "to_date(o_orderdate) AS o_orderdate", "o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def check(spark, orders, monkeypatch, run, label):
    monkeypatch.setattr(Q, "new_table_path", lambda _, name: f"{orders}/{name}")
    got = sorted(map(tuple, run(spark, orders).collect()))
    assert got == sorted((f"W{i}", 1995, 1 + i % 3) for i in range(1, 601))
    plain = sum(len(r["json"]) for r in V.works_json(spark, orders).collect())
    written = sum(f.stat().st_size for f in Path(orders, label).rglob("*") if f.is_file() and not f.name.startswith((".", "_")))
    assert 0 < 4 * written < plain


def test_lines_are_compressed(spark, orders, monkeypatch):
    check(spark, orders, monkeypatch, Q.src01, "jsonl")


def test_tree_is_compressed_and_made_without_an_exchange(spark, orders, monkeypatch):
    monkeypatch.setattr(Q, "TREE_FILE", 64)
    check(spark, orders, monkeypatch, Q.src02, "tree")
    sizes = [r["n"] for r in spark.read.json(f"{orders}/tree").selectExpr("size(results) AS n").collect()]
    assert sum(sizes) == 600 and max(sizes) <= 64
    made = Q.W.bundles(spark.range(10).selectExpr("CAST(id AS STRING) AS json"), 3)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(x for r in made.collect() for x in eval(r["list"])) == list(range(10))


def test_digests_of_the_drops_are_not_broadcast(spark, orders, monkeypatch):
    monkeypatch.setattr(Q, "new_table_path", lambda _, name: f"{orders}/{name}")
    assert "Broadcast" not in Q.src11(spark, orders)._jdf.queryExecution().executedPlan().toString()
