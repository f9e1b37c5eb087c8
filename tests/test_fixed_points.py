"""Label propagation and hubs to their fixed points."""

import random

import numpy as np

from paperloom.operators import graph as G


def frames(spark, n, pairs):
    return spark.range(n), spark.createDataFrame(pairs, "src long, dst long")


def no_move_left(spark, n, pairs):
    v, e = frames(spark, n, pairs)
    label = {r["id"]: r["community"] for r in G.settled_labels(v, e).collect()}
    assert set(label) == set(range(n))
    around = {i: set() for i in range(n)}
    for a, b in pairs:
        if a != b:
            around[a].add(b)
            around[b].add(a)
    for i, near in around.items():
        votes = [label[j] for j in near]
        assert all(votes.count(c) <= votes.count(label[i]) for c in set(votes))
    assert all(c == min(i for i in label if label[i] == c) for c in set(label.values()))
    return label


def test_labels_settle(spark):
    assert set(no_move_left(spark, 3, [(0, 1), (1, 1)]).items()) == {(0, 0), (1, 0), (2, 2)}  # a lone edge agrees
    star = no_move_left(spark, 30, [(0, i) for i in range(1, 30)] + [(1, 0)])
    assert len(set(star.values())) == 1
    rng = random.Random(3)
    no_move_left(spark, 60, [(rng.randrange(60), rng.randrange(60)) for _ in range(140)])


def test_labels_settle_on_a_long_chain(spark):
    n = 10_000
    v, e = spark.range(n), spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")
    label = dict(sorted((r["id"], r["community"]) for r in G.settled_labels(v, e).collect()))
    for i in range(n):
        near = [label[j] for j in (i - 1, i + 1) if 0 <= j < n]
        assert label[i] in near  # nobody is left alone, so no neighbour's label has more


def test_labels_of_nothing(spark):
    v, e = frames(spark, 3, [(0, 0)])
    assert sorted(map(tuple, G.settled_labels(v, e.limit(0)).collect())) == [(0, 0), (1, 1), (2, 2)]
    assert G.settled_labels(v.limit(0), e.limit(0)).count() == 0


def test_hubs_reach_the_singular_vectors(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 12, (50, 2))] + [(0, i) for i in range(12)]
    m = np.zeros((13, 13))
    for a, b in pairs:
        m[a, b] += 1
    u, _, vt = np.linalg.svd(m)
    v, e = frames(spark, 13, pairs)
    got = sorted((r["id"], r["hub"], r["authority"]) for r in G.hits(v, e).collect())
    assert np.allclose([g[1] for g in got], np.abs(u[:, 0]), atol=1e-5)
    assert np.allclose([g[2] for g in got], np.abs(vt[0]), atol=1e-5)
    assert [tuple(r)[1:] for r in G.hits(v, e.limit(0)).collect()] == [(0.0, 0.0)] * 13
