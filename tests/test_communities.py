"""Modularity communities at a fixed point."""

import random
from itertools import product

from paperloom.operators import communities as C
from paperloom.operators import graph as G


def frames(spark, n, pairs):
    return spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(pairs, "src long, dst long")


def plain_score(n, pairs, label):
    links = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    k = [sum(i in p for p in links) for i in range(n)]
    inner = sum(2 for a, b in links if label[a] == label[b])
    tot = {}
    for i in range(n):
        tot[label[i]] = tot.get(label[i], 0) + k[i]
    return 2 * len(links) * inner - sum(t * t for t in tot.values())


def check(spark, n, pairs, start=None):
    v, e = frames(spark, n, pairs)
    label = {r["id"]: r["community"] for r in C.louvain(v, e, start).collect()}
    assert set(label) == set(range(n))
    best = plain_score(n, pairs, label)
    for i, c in product(range(n), set(label.values())):
        assert plain_score(n, pairs, label | {i: c}) <= best
    for a, b in product(set(label.values()), repeat=2):
        assert plain_score(n, pairs, {i: b if c == a else c for i, c in label.items()}) <= best
    assert all(label[c] == c == min(i for i in label if label[i] == c) for c in set(label.values()))
    return label, best


def test_two_cliques_and_a_bridge(spark):
    pairs = [(a + s, b + s) for s in (0, 5) for a in range(5) for b in range(a)] + [(0, 5), (0, 0), (1, 0)]
    label, _ = check(spark, 11, pairs)
    assert len({label[i] for i in range(5)}) == len({label[i] for i in range(5, 10)}) == 1
    assert label[0] != label[5] and label[10] == 10


def test_random_graph_no_move_gains(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
    v, e = frames(spark, 40, pairs)
    start = G.label_propagation(v, e, 3)
    _, best = check(spark, 40, pairs, start)
    assert best >= plain_score(40, pairs, {r["id"]: r["community"] for r in start.collect()})


def test_long_chain(spark):
    n = 200
    v, e = frames(spark, n, [(i, i + 1) for i in range(n - 1)])
    found = C.louvain(v, e)
    report = {r["metric"]: r["n"] for r in C.fixed_point_report(v, e, v.selectExpr("id", "id AS community"), found).collect()}
    assert report == {"nodes": n, "labelled": n, "node_moves": 0, "community_moves": 0, "worse_than_start": 0}
    sizes = [r["count"] for r in found.groupBy("community").count().collect()]
    assert sum(sizes) == n and 8 < len(sizes) < 40


def test_no_edges(spark):
    v, e = frames(spark, 3, [(0, 0)])
    assert sorted(map(tuple, C.louvain(v, e.limit(0)).collect())) == [(0, 0), (1, 1), (2, 2)]
