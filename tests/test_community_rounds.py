"""A round of local moves asks the nodes that the last moves reached; its gain is exact."""

import random

from paperloom.operators import communities as C
from paperloom.session import cut


def test_gain_of_moves_is_the_change_of_the_score(spark):
    rng = random.Random(4)
    e = spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(60)], "src long, dst long")
    links = cut(C.weighted(e))
    k = {r["src"]: r["n"] for r in links.groupBy("src").sum("w").withColumnRenamed("sum(w)", "n").collect()}
    nodes = spark.createDataFrame([(i, k.get(i, 0), 0) for i in range(30)], "id long, k long, loops long")
    before = {i: rng.randrange(6) for i in range(30)}
    moves = [(i, c, to) for i, c in before.items() if (to := rng.randrange(6)) != c and rng.random() < 0.5]
    after = before | {i: to for i, _, to in moves}
    old, new = (spark.createDataFrame(list(x.items()), "id long, community long") for x in (before, after))
    two_m = sum(k.values())
    chosen = spark.createDataFrame(moves, "id long, community long, to long")
    got = C.gained(links, C.with_tot(nodes, old), chosen, two_m)
    assert got == C.score(links, nodes, new, two_m) - C.score(links, nodes, old, two_m)


def test_a_round_asks_what_the_moves_reached(spark, monkeypatch):
    asked = []
    write = C.cut

    def counted(df, label="cut"):
        out = write(df, label)
        if label == "reached":
            asked.append(out.count())
        return out

    monkeypatch.setattr(C, "cut", counted)
    n = 600  # pairs that agree, and one chain that has to be sorted out
    pairs = [(i, i + 1) for i in range(40, n, 2)] + [(i, i + 1) for i in range(39)]
    links = cut(C.weighted(spark.createDataFrame(pairs, "src long, dst long")))
    k = links.groupBy("src").sum("w").toDF("id", "k")
    nodes = cut(spark.range(n).join(k, "id", "left").selectExpr("id", "coalesce(k, 0L) AS k", "0L AS loops"))
    start = spark.range(n).selectExpr("id", "if(id < 40, id, id - id % 2) AS community")
    C.local_moves(links, nodes, start, 2 * len(pairs))
    assert asked and max(asked) <= 40
