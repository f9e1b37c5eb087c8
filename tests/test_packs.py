"""Whole components worked on in tasks give what the distributed rounds give."""

import random
from itertools import product

import pytest

from paperloom.operators import communities as C
from paperloom.operators import graph as G
from tests.test_communities import plain_score


def mixed(spark):
    """Chains, dense groups, loops, parallel edges, ends that are no vertex or null, a vertex given twice, one component of 60 nodes."""
    rng = random.Random(3)
    pairs = [(100 + i, 100 + i + rng.randrange(1, 4)) for i in range(57)]
    for s in range(0, 90, 9):
        pairs += [(s + rng.randrange(9), s + rng.randrange(9)) for _ in range(rng.randrange(4, 25))]
    pairs += [(0, 0), (0, 1), (0, 1), (3, 1000), (1000, 4), (1001, 1002), (5, None), (None, 6), (200, 200)]
    ids = [*range(90), *range(100, 160), 5, 5, 17, 200, 300, None]
    v = spark.createDataFrame([(i,) for i in ids], "id long")
    return v, spark.createDataFrame(pairs, "src long, dst long"), ids, pairs


@pytest.mark.parametrize("most", [0, 25, 1 << 15])
def test_packs_rank_and_label_as_the_rounds(spark, most):
    v, e, ids, _ = mixed(spark)
    p = G.packed(v, e, most=most)
    assert (p.rest_edges is None) == (most > 1000)
    want = {r["id"]: r["pagerank"] for r in G.pagerank(v, e).collect()}
    got = G.pagerank(v, e, packs=p).collect()
    assert len(got) == len(want) == len(set(ids)) and {r["id"]: r["pagerank"] for r in got} == pytest.approx(want, abs=1e-13)
    key = lambda r: (r["id"], r["community"])
    assert sorted(map(key, G.settled_labels(v, e, p).collect())) == sorted(map(key, G.settled_labels(v, e).collect()))


@pytest.mark.parametrize("most", [25, 1 << 15])
def test_no_move_gains_whatever_is_packed(spark, most):
    _, _, _, pairs = mixed(spark)
    pairs = [(a, b) for a, b in pairs if a is not None and b is not None and max(a, b) < 160]
    v, e = spark.range(160), spark.createDataFrame(pairs, "src long, dst long")
    start = spark.range(160).selectExpr("id", "id % 7 AS community")  # its communities lie in many components
    found = C.louvain(v, e, start, most)
    label = {r["id"]: r["community"] for r in found.collect()}
    assert len(label) == found.count() == 160
    best = plain_score(160, pairs, label)
    assert best >= plain_score(160, pairs, {i: i % 7 for i in range(160)})
    links = {i: {b for a, b in [*pairs, *((y, x) for x, y in pairs)] if a == i} for i in range(160)}
    for i, c in product(range(160), set(label.values())):
        if any(label[j] == c for j in links[i]):
            assert plain_score(160, pairs, label | {i: c}) <= best
    assert all(label[c] == c == min(i for i in label if label[i] == c) for c in set(label.values()))


def test_rounds_of_small_components_need_no_job_each(spark, monkeypatch):
    """Many small components take as many written tables as a few do."""
    written = []
    write = C.cut
    monkeypatch.setattr(C, "cut", lambda df, label="cut": written.append(label) or write(df, label))
    n = 4000
    chain = spark.range(n).selectExpr("id AS src", "explode(array(id + 1, id + 2, id + 3)) AS dst").filter("src div 10 = dst div 10")
    found = C.louvain(spark.range(n), chain, spark.range(n).selectExpr("id", "id AS community"))
    report = {r["metric"]: r["n"] for r in C.fixed_point_report(spark.range(n), chain, spark.range(n).selectExpr("id", "id AS community"), found).collect()}
    assert report == {"nodes": n, "labelled": n, "node_moves": 0, "community_moves": 0, "worse_than_start": 0}
    assert "moves" not in written


def test_text_ids_pack_and_others_do_not(spark):
    e = spark.createDataFrame([("a", "é"), ("b", "c"), ("c", "d")], "src string, dst string")
    v = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "é", "z")], "id string")
    p = G.packed(v, e)
    assert p.rest is None
    assert sorted(map(tuple, G.settled_labels(v, e, p).collect())) == sorted(map(tuple, G.settled_labels(v, e).collect()))
    v, e = v.selectExpr("binary(id) AS id"), e.selectExpr("binary(src) AS src", "binary(dst) AS dst")
    p = G.packed(v, e)
    assert p.packs.isEmpty() and p.rest.count() == 6


def chains(spark):
    e = spark.range(600).selectExpr("id AS src", "explode(array(id + 1, id + 2, id + 3)) AS dst").filter("src div 10 = dst div 10")
    return spark.range(600).selectExpr("id", "'t' AS title", "2000 AS publication_year", "id % 5 AS cited_by_count"), e


def test_key_papers_of_small_components_take_no_rounds(spark, monkeypatch):
    written = []
    write = G.cut
    monkeypatch.setattr(G, "cut", lambda df, label="cut": written.append(label) or write(df, label))
    papers, e = chains(spark)
    got = G.field_structure(papers, e, 30)["key_papers"].collect()
    assert not {"label-wants", "label-moves", "full-buckets"} & set(written)
    ranks, labels = G.pagerank(papers, e), write(G.settled_labels(papers, e))
    want = G.rank_key_papers(papers, ranks, labels, G.bridge_scores(e, labels), 30).collect()
    assert got == want


def test_field_counts_of_small_components_take_no_rounds(spark, monkeypatch):
    written = []
    write = G.cut
    monkeypatch.setattr(G, "cut", lambda df, label="cut": written.append(label) or write(df, label))
    papers, e = chains(spark)
    found = G.field_structure(papers, e)
    assert not {"label-wants", "label-moves", "full-buckets"} & set(written)
    got = {r["metric"]: r["n"] for r in found["counts"].collect()}
    assert got == {"nodes": 600, "edges": 60 * 24, "communities": G.settled_labels(papers, e).select("community").distinct().count()}
    assert [tuple(r) for r in found["yearly"].collect()] == [(2000, 600)]
