"""Graph results against plain Python, and operators under one hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import communities as C
from paperloom.operators import corpus as K
from paperloom.operators import graph as G
from paperloom.operators import skew as S
from tests.conftest import rows


def plain_pagerank(nodes, edges, rounds=30, d=0.85):
    rank = {n: 1 / len(nodes) for n in nodes}
    out = {n: sum(1 for s, _ in edges if s == n) for n in nodes}
    for _ in range(rounds):
        lost = sum(rank[n] for n in nodes if not out[n])
        nxt = {n: (1 - d) / len(nodes) + d * lost / len(nodes) for n in nodes}
        for s, t in edges:
            nxt[t] += d * rank[s] / out[s]
        rank = nxt
    return rank


def graph(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("edges", [
    [(1, 2), (2, 3), (3, 1), (4, 1), (4, 1)],           # cycle, parallel edges
    [(i, 0) for i in range(1, 12)] + [(0, 12)],          # a hub
    [(1, 2)],                                            # mostly dangling
])
def test_pagerank(spark, edges):
    nodes = list(range(14))
    v, e = graph(spark, nodes, edges)
    got = dict(rows(G.pagerank(v, e), "id", "pagerank"))
    want = plain_pagerank(nodes, edges)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.0)
    salted = dict(rows(G.pagerank(v, e, hot_rows=1), "id", "pagerank"))
    assert salted == pytest.approx(want)


def test_pagerank_without_edges(spark):
    v, e = graph(spark, [1, 2], [])
    assert dict(rows(G.pagerank(v, e), "id", "pagerank")) == pytest.approx({1: 0.5, 2: 0.5})


def test_components_of_a_long_chain(spark):
    n = 3000
    edges = [(i, i - 1) for i in range(1, n)] + [(n + 1, n)]
    v, e = graph(spark, range(n + 3), edges)
    got = dict(rows(G.connected_components(v, e), "id", "component"))
    assert all(got[i] == 0 for i in range(n))
    assert got[n] == got[n + 1] == n and got[n + 2] == n + 2


def test_bridge_and_labels(spark):
    two = [(1, 2), (2, 3), (1, 3), (11, 12), (12, 13), (11, 13), (3, 11)]
    v, e = graph(spark, [1, 2, 3, 11, 12, 13], two)
    comm = spark.createDataFrame([(i, 1 if i < 10 else 2) for i in (1, 2, 3, 11, 12, 13)], "id long, community int")
    assert rows(G.bridge_scores(e, comm)) == [(11, 1.0), (3, 1.0)]
    labels = G.label_propagation(v, e, 5)
    moved = C.louvain(v, e, labels)
    m = lambda c: G.modularity(e, c).first()["modularity"]
    assert m(moved) >= m(labels)


def test_key_papers_with_no_citations(spark):
    p = spark.createDataFrame([(1, "a", 2023, 0), (2, "b", 2010, 0)], "id long, title string, publication_year int, cited_by_count long")
    v, e = graph(spark, [1, 2], [(1, 2)])
    top = G.field_structure(p, e, 5)["key_papers"].collect()
    assert {r["work_id"]: r["role"] for r in top} == {1: "recent_representative", 2: "community_representative"}
    assert all(r["score"] < 0.7 for r in top)


def test_paths_do_not_repeat_an_edge(spark):
    _, e = graph(spark, [], [(1, 2), (2, 1), (2, 3)])
    start = spark.createDataFrame([(1,)], "id long")
    got = rows(G.citation_paths(e, start, 3).select(F.array_join("path", ">").alias("p")))
    assert got == [("1>2",), ("1>2>1",), ("1>2>3",)]


def test_influence(spark):
    _, e = graph(spark, [], [(2, 1), (3, 2), (4, 3), (1, 4)])
    w = spark.createDataFrame([(1,)], "id long")
    assert rows(G.influence(e, w, 5)) == [(1, 4), (2, 1), (3, 2), (4, 3)]


@pytest.fixture(scope="module")
def hot(spark):
    """A third of 6,000 rows on one key."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("k"),
        (F.xxhash64("id")).alias("o"), "id",
    )


def test_numbered_equals_a_window(hot):
    want = hot.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
    assert rows(S.numbered(hot, ["o"], ["k"])) == rows(want)
    total = hot.withColumn("rn", F.row_number().over(Window.orderBy("o")).cast("long"))
    assert rows(S.numbered(hot, ["o"])) == rows(total)


def test_lagged_pairs_equal_a_window(hot):
    w = Window.partitionBy("k").orderBy("id")
    want = hot.select("id", *[F.lag("id", j).over(w).alias(f"l{j}") for j in (1, 2)])
    want = want.select(F.col("id").alias("src"), F.explode(F.array("l1", "l2")).alias("dst")).filter("dst IS NOT NULL")
    assert rows(S.lagged_pairs(hot, ["k"], "id", 2)) == rows(want)


def test_top_n_limits_before_the_exchange(hot, capsys):
    top = S.top_n(hot, ["k"], ["o"], 3)
    top.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    assert top.filter("k = 0").count() == 3


@pytest.mark.parametrize("block", [3, 20, 1000])
def test_pair_counts_of_large_groups_in_blocks(spark, block):
    rng = random.Random(4)
    links = [(g, f"m{rng.randrange(60):02d}") for g in (1, None, 2) for _ in range(90)]  # most links are in three groups
    links += [(g, f"m{rng.randrange(8):02d}") for g in range(10, 40) for _ in range(3)] + [(1, None), (3, "m01")]
    want = {}
    for g in {g for g, _ in links}:
        own = sorted({m for h, m in links if h == g and m is not None})
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                want[x, y] = want.get((x, y), 0) + 1
    got = G.pair_counts(spark.createDataFrame(links, "w long, t string"), "w", "t", block=block).collect()
    assert {(r["a"], r["b"]): r["n_groups"] for r in got} == want and len(got) == len(want)


def test_pair_counts_under_a_hot_group(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "a"), (2, "a"), (2, "b"), (3, "a")], "w long, t string")
    assert rows(G.pair_counts(links, "w", "t")) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


# --- expansion ------------------------------------------------------------------------------


def refs_of(spark, graph):
    return spark.createDataFrame([(w, i, r) for w, rs in graph.items() for i, r in enumerate(rs)], "work_id long, pos int, ref_id long")


def works_of(spark, ids):
    return spark.createDataFrame([(i, float(i)) for i in ids], "work_id long, score double")


BOTH = {1: [2, 3], 2: [4], 3: [4], 5: [1], 6: [2]}


def test_expansion_goes_both_ways(spark):
    seeds = spark.createDataFrame([(1,)], "work_id long")
    st = K.layered_bfs(refs_of(spark, BOTH), works_of(spark, range(1, 7)), seeds, max_depth=2, reference_fanout=0, citing_fanout=0)
    got = rows(st.all("layer").filter("held"), "work_id", "depth")
    assert got == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 1), (6, 2)]
    assert st.all("edges").count() >= 5
    stats = K.crawl_statistics(st).orderBy("depth").collect()
    assert [r["works"] for r in stats] == [1, 3, 2]


def test_expansion_caps(spark):
    seeds = spark.createDataFrame([(1,)], "work_id long")
    g = {1: [2, 3, 4]}
    st = K.layered_bfs(refs_of(spark, g), works_of(spark, range(1, 5)), seeds, max_depth=1, reference_fanout=1)
    assert rows(st.all("layer"), "work_id") == [(1,), (2,)]
    st = K.layered_bfs(refs_of(spark, g), works_of(spark, range(1, 5)), seeds, max_depth=2, target=3)
    assert st.all("layer").filter("held").count() == 3
    st = K.layered_bfs(refs_of(spark, g), works_of(spark, range(1, 5)), seeds, max_depth=1, max_frontier=2)
    assert rows(st.all("layer").filter("depth = 1"), "work_id") == [(3,), (4,)]


def test_expansion_counts_missing_works(spark):
    seeds = spark.createDataFrame([(1,)], "work_id long")
    st = K.layered_bfs(refs_of(spark, {1: [2, 9]}), works_of(spark, [1, 2]), seeds, max_depth=1)
    assert rows(st.all("layer"), "work_id", "held") == [(1, True), (2, True), (9, False)]


def test_expansion_resumes(spark, tmp_path):
    seeds = spark.createDataFrame([(1,)], "work_id long")
    g, w = refs_of(spark, BOTH), works_of(spark, range(1, 7))
    where = str(tmp_path / "state")
    first = K.layered_bfs(g, w, seeds, max_depth=1, reference_fanout=0, citing_fanout=0, state_dir=where)
    assert first.all("layer").count() == 4
    again = K.layered_bfs(g, w, seeds, max_depth=2, reference_fanout=0, citing_fanout=0, state_dir=where)
    assert again.all("layer").count() == 6


def test_lineage_order_and_labels(spark):
    out = K.seed_lineage(refs_of(spark, BOTH), works_of(spark, range(1, 7)), 1, 2)
    got = [(r["work_id"], r["source"]) for r in out.collect()]
    assert got == [(1, "seed"), (2, "reference_depth_1"), (3, "reference_depth_1"), (5, "citing_depth_1"),
                   (4, "reference_depth_2"), (6, "citing_depth_2")]


def test_loop_joins_do_not_exchange_the_edges(spark, capsys):
    _, e = graph(spark, [], [(1, 2), (2, 3)])
    layout = G.EdgeLayout(e, "src", "dst")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layout.meet(spark.range(4).withColumn("v", F.lit(1.0))).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        layout.close()
    plan = capsys.readouterr().out.split("InMemoryRelation")[0]
    assert "InMemoryTableScan" in plan and "Exchange" not in plan


def test_sampling_is_repeatable_and_bounded(spark):
    v, e = graph(spark, range(20), [(i, j) for i in range(20) for j in range(20) if i != j])
    e = e.withColumn("type", F.lit("CITES"))
    a, b = (rows(G.sample_neighbourhood(v, e, 3, {"CITES": 4}, salt=7)) for _ in range(2))
    assert a == b and len(a) == 12 and len({r[0] for r in a}) == 3
    assert {(r[0], r[1]) for r in a} <= {(i, j) for i in range(20) for j in range(20)}


def test_typed_edges_need_both_ends(spark):
    def frame(values, names):
        return spark.createDataFrame(values, names)

    tables = {
        "works": frame([("W1", "t", "article", 1), ("W2", "t", None, 2)], "work_id string, title string, type_name string, x int"),
        "authors": frame([("A1", "Ann"), (None, "None")], "author_id string, display_name string"),
        "institutions": frame([("I1", "One", "US"), ("I2", "Two", "NL")], "institution_id string, display_name string, country_code string"),
        "countries": frame([("US",)], "country_code string"), "work_types": frame([("article",)], "type_name string"),
        "concepts": frame([("C1", "Topic")], "concept_id string, display_name string"),
        "citations": frame([("W1", "W2"), ("W2", "W9")], "citing_work_id string, cited_work_id string"),
        "work_authors": frame([("W1", "A1"), ("W1", "A9"), ("W2", None)], "work_id string, author_id string"),
        "work_venues": frame([("W1", "V1")], "work_id string, venue_id string"),  # and no table of venues
        "work_concepts": frame([("W1", "C1", 0.2), ("W2", "C1", 0.0)], "work_id string, concept_id string, score double"),
        "author_institutions": frame([("A1", "I1")], "author_id string, institution_id string"),
        "work_institutions": frame([("W1", "I3")], "work_id string, institution_id string"),
        "work_author_affiliations": frame([("W1", "A1", "I1")], "work_id string, author_id string, institution_id string"),
    }
    got = G.typed_edges(tables).select("src", "dst", "type").collect()
    assert sorted(tuple(r) for r in got) == [
        ("Author:A1", "Institution:I1", "AFFILIATED_IN_WORK"), ("Author:A1", "Institution:I1", "AFFILIATED_WITH"),
        ("Author:A1", "Paper:W1", "AUTHORED"), ("Institution:I1", "Country:US", "LOCATED_IN"),
        ("Paper:W1", "Concept:C1", "ABOUT"), ("Paper:W1", "Paper:W2", "CITES"), ("Paper:W1", "WorkType:article", "HAS_TYPE"),
    ]
