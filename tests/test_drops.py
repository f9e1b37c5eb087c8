"""Dropped records are compressed, and arrive whole."""

from pathlib import Path

from paperloom.plans import queries_sources as Q
from paperloom.plans import views as V


def test_drops_are_compressed(spark, tmp_path, monkeypatch):
    rows = [(i, i % 50, "1995-03-01", "5-LOW") for i in range(1, 601)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string")
    orders.selectExpr("o_orderkey", "o_custkey", "to_date(o_orderdate) AS o_orderdate", "o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(Q, "new_table_path", lambda _, label: f"{tmp_path}/{label}")
    got = Q.src11(spark, str(tmp_path)).collect()
    assert len(got) == 600 and all(r["copies"] == 1 and r["whole"] for r in got)
    plain = sum(len(r["json"]) for r in V.works_json(spark, str(tmp_path)).collect())
    dropped = sum(f.stat().st_size for f in Path(tmp_path, "drop").iterdir())
    assert 0 < 4 * dropped < plain
