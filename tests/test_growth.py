"""What queries must not do as their tables grow; each test builds its own rows."""

import datetime

import pytest

from paperloom.plans import load_all
from tests.conftest import rows

QUERIES = load_all()[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """A folder with ``orders`` of 300 keys, 30 customers."""
    path = tmp_path_factory.mktemp("tables")
    made = [(i, i % 30, "O", 1.0, datetime.datetime(1995, 1 + i % 12, 1 + i % 28), "1-URGENT") for i in range(300)]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(made, kinds).write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_work_defaults_hold_no_side_in_the_driver(spark, orders):
    got = QUERIES["cln10_work_defaults"](spark, orders)
    assert "Broadcast" not in plan(got)
    assert rows(got, "work_id", "pdf") == sorted(
        ((f"W{i}", f"https://doi.org/10.5/{i}") for i in range(300) if i % 20), key=repr
    )


def test_tree_files_stay_small(spark, orders, monkeypatch):
    import paperloom.plans.queries_sources as S

    monkeypatch.setattr(S, "TREE_FILE", 20)
    seen = []
    read = S.W.read_works_tree
    monkeypatch.setattr(S.W, "read_works_tree", lambda spark, path: seen.append(path) or read(spark, path))
    got = QUERIES["src02_tree"](spark, orders)
    assert sorted(r["work_id"] for r in got.collect()) == sorted(f"W{i}" for i in range(300))
    sizes = [r["n"] for r in spark.read.json(seen[0]).selectExpr("size(results) n").collect()]
    assert sum(sizes) == 300 and max(sizes) <= 20


def test_nodes_are_made_once_for_counts_and_edges(spark, orders, monkeypatch):
    from paperloom.operators import graph as G

    made = []
    vertices = G.typed_vertices
    monkeypatch.setattr(G, "typed_vertices", lambda tables: made.append(1) or vertices(tables))
    got = {(r["kind"], r["type"]): r["n"] for r in QUERIES["agg11_type_counts"](spark, orders).collect()}
    assert len(made) == 1
    assert got["node", "Paper"] == got["edge", "PUBLISHED_IN"] == got["edge", "HAS_TYPE"] == 300 and got["node", "WorkType"] == 3


def test_contents_are_hashed_once(spark, tmp_path):
    from paperloom.sources import tables as T

    spark.createDataFrame([(i, str(i % 7)) for i in range(40)], "k long, value string").write.partitionBy("k").text(str(tmp_path / "t"))
    store, links = T.store_binaries(spark, str(tmp_path / "t"), "*.txt")
    assert len(T.subfolders(spark, str(tmp_path / "t"))) == 40 and T.subfolders(spark, str(tmp_path / "t" / "k=1"))[0].endswith("k=1")
    assert "binaryFile" not in plan(links)  # from the kept digests
    assert links.count() == 40 and links.select("sha256").distinct().count() == 7
    assert sorted(bytes(r["content"]).decode().strip() for r in store.collect()) == [str(i) for i in range(7)]


def test_terms_are_found_as_by_substring_tests(spark):
    from paperloom.operators import news as N

    terms = ["ab", "abc", "b", "cab", "債務", "務", "x\U0001f600"]
    texts = ["", "a", "abcab", "ca", "b債", "務x\U0001f600", None, "債務cab", "x", "\U0001f600ab"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(1)
    got = {r["id"]: r["f"] for r in d.select("id", N.found_terms(d["t"], terms).alias("f")).collect()}
    assert got == {i: None if t is None else [n for n, x in enumerate(terms) if x in t] for i, t in enumerate(texts)}


def test_an_index_reads_its_chunks_once(spark):
    from pyspark.sql import functions as F

    from paperloom.operators import news as N

    seen = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda x: seen.add(1) or x, "long")
    chunks = spark.range(50).select(mark("id").alias("id"))
    assert sorted(r["embedding_row"] for r in N.embedding_index(chunks, ["id"]).collect()) == list(range(50))
    assert seen.value == 50


def test_a_search_sorts_few_rows_and_makes_no_offsets(spark):
    from paperloom.operators import chunks as K

    docs = [(i, " ".join(f"Sentence {i} number {j} speaks of graphs and of water." for j in range(9))) for i in range(40)]
    children = K.child_chunks(spark.createDataFrame(docs, "work_id long, text string"), buckets=64)
    got = K.search_evidence(children, ["graphs and water", "number 3"], 4)
    assert "instr" not in plan(got)
    once = K.batch_best(children.select("child_id", "buckets").coalesce(1), K.query_vectors(spark, ["graphs", "water"]), 4)
    assert once.count() == 8 and got.count() == 8
    assert "instr" not in plan(K.child_chunks(spark.createDataFrame(docs, "work_id long, text string")).select("child_id", "text"))
