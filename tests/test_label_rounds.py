"""Label propagation to its fixed point: the rounds of the definition, and what a round costs."""

import random
from collections import Counter
from hashlib import md5

import pytest

from paperloom.operators import graph as G


def plain_labels(ids, pairs):
    """Synchronous rounds over lists; a vertex given twice votes twice, an end that is no vertex never."""
    times = Counter(ids)
    near = {i: set() for i in times}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            if x != y and x in near and y in near:
                near[x].add(y)
    label = {i: i for i in times}
    rank = {i: md5(str(i).encode()).hexdigest() for i in times}
    while True:
        want = {}
        for i, others in near.items():
            votes = Counter()
            for j in others:
                votes[label[j]] += times[j]
            if votes:
                n, c = min((-n, c) for c, n in votes.items())
                if -n > votes[label[i]]:
                    want[i] = c
        if not want:
            break
        for i, c in want.items():
            if all(rank[i] < rank[j] for j in near[i] if j in want):
                label[i] = c
    return sorted((i, min(j for j in label if label[j] == label[i])) for i in ids)


@pytest.mark.parametrize("hot_rows", [G.HOT_ROWS, 3])
def test_labels_follow_the_rounds(spark, monkeypatch, hot_rows):
    layout = G.EdgeLayout
    monkeypatch.setattr(G, "EdgeLayout", lambda e, k, o, **c: layout(e, k, o, hot_rows, **c))
    rng = random.Random(8)
    ids = list(range(60)) + [5, 5, 17]
    pairs = [(rng.randrange(66), rng.randrange(66)) for _ in range(150)] + [(0, i) for i in range(1, 20)]
    v, e = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(pairs, "src long, dst long")
    got = sorted((r["id"], r["community"]) for r in G.settled_labels(v, e).collect())
    assert got == plain_labels(ids, pairs)


def test_many_rounds_merge_their_changes(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST_LOGS", 2)
    ids, pairs = range(120), [(i, i + 1) for i in range(119)]
    v, e = spark.range(120), spark.createDataFrame(pairs, "src long, dst long")
    got = sorted((r["id"], r["community"]) for r in G.settled_labels(v, e).collect())
    assert got == plain_labels(ids, pairs)


def test_a_round_writes_what_moves(spark, monkeypatch):
    """A few nodes move for many rounds; nodes that have settled are not written again."""
    written = []
    write = G.cut

    def counted(df, label="cut"):
        out = write(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(G, "cut", counted)
    n = 3000
    G.settled_labels(spark.range(n), spark.range(n).selectExpr("id AS src", "explode(array(id + 1, id + 2, id + 3)) AS dst").filter(f"dst < {n}"))
    rounds = sum(label == "label-moves" for label, _ in written)
    assert rounds > 7 and sum(rows for label, rows in written if label == "labels") == n
    assert [rows for label, rows in written if label == "label-wants"][-1] == 0
