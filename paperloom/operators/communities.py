"""Modularity communities by local moves and graph contraction (GRA-04).

All scores are exact integers. With m edges and a community of degree ``tot`` that
holds ``inner`` edge ends of its own, modularity is the sum of 2m * inner - tot^2 over
all communities, divided by (2m)^2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paperloom.operators import packs as P
from paperloom.operators.graph import keep_partitioned, label_propagation, packed, undirected
from paperloom.session import cut

MAX_STEPS = 1_000  # of moves and contractions; no fixed point by then is an error


FEW = 32  # with fewer movers than this part of the nodes, none is left to chance


def exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of an undirected graph: both directions of each edge, without loops."""
    return undirected(edges).withColumn("w", F.lit(1).cast("long"))


def score(links: DataFrame, nodes: DataFrame, labels: DataFrame, two_m: int) -> int:
    """Modularity times (2m)^2 of ``labels`` on a level's graph; ``nodes(id, k, loops)``."""
    a = labels.select(F.col("id").alias("src"), F.col("community").alias("a"))
    b = labels.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    inner = links.join(a, "src").join(b, "dst").filter("a = b").agg(F.sum("w").alias("n")).first()["n"] or 0
    tot = nodes.join(labels, "id").groupBy("community").agg(F.sum("k").alias("tot"), F.sum("loops").alias("loops"))
    row = tot.agg(F.sum(exact(F.col("tot")) * exact(F.col("tot"))).alias("squares"), F.sum("loops").alias("loops")).first()
    return two_m * (inner + int(row["loops"] or 0)) - int(row["squares"] or 0)


def with_tot(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, community, k, tot): each node with the degree of its community."""
    own = nodes.join(labels, "id").select("id", "community", "k")
    return own.join(own.groupBy("community").agg(F.sum("k").alias("tot")), "community").select("id", "community", "k", "tot")


def improving_moves(
    links: DataFrame, nodes: DataFrame, labels: DataFrame, two_m: int, state: DataFrame | None = None, only: DataFrame | None = None, few: bool = False
) -> DataFrame:
    """(id, community, to, gain): of each node the best move to a neighbour's community, if it gains anything.

    ``gain`` is exact: the score grows by twice as much if no other node of the two
    communities moves. Ties go to the smallest community. ``state`` is ``with_tot`` of the
    labels, ``only(id)`` the nodes that are asked, ``few`` tells that these are few.
    """
    if state is None:
        state = with_tot(nodes, labels)
        near = labels.join(state.groupBy("community").agg(F.max("tot").alias("tot")), "community")
    else:
        near = state
    stay = (state if only is None else state.join(only, "id", "left_semi")).dropDuplicates(["id"])
    near = near.select(F.col("id").alias("src"), F.col("community").alias("to"), F.col("tot").alias("to_tot"))
    asked = stay.select(F.col("id").alias("dst"), "community", "k", "tot")
    # The links of few nodes are picked first; else the labels meet the links where these lie, and one exchange takes them to the nodes.
    options = links.join(asked, "dst").join(near, "src") if few else links.join(near, "src").join(asked, "dst")
    options = options.groupBy(F.col("dst").alias("id"), "to", "community", "k", "tot", "to_tot").agg(F.sum("w").alias("w"))
    here = F.col("to") == F.col("community")
    rest = exact(F.col("to_tot") - F.when(here, F.col("k")).otherwise(0))
    value = F.lit(two_m).cast("decimal(19,0)") * exact(F.col("w")) - exact(F.col("k")) * rest
    # A node without a link into its own community still counts that community's degree.
    alone = -exact(F.col("k")) * exact(F.col("tot") - F.col("k"))
    best = options.withColumn("value", value).groupBy("id", "community").agg(
        F.min(F.when(~here, F.struct((-F.col("value")).alias("v"), F.col("to").alias("to")))).alias("best"),
        F.coalesce(F.max(F.when(here, F.col("value"))), F.first(alone)).alias("stay"),
    )
    gain = -F.col("best.v") - F.col("stay")
    return best.select("id", "community", F.col("best.to").alias("to"), gain.alias("gain")).filter("gain > 0")


def gained(links: DataFrame, state: DataFrame, chosen: DataFrame, two_m: int) -> int:
    """What all moves ``chosen(id, community, to)`` together add to the score of the labels in ``state``, from the links of the movers."""
    a = chosen.select(F.col("id").alias("src"), F.col("community").alias("a"), F.col("to").alias("new_a"))
    moved = links.join(a, "src")
    b = state.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    new_b = chosen.select(F.col("id").alias("dst"), F.col("to").alias("new_b"))
    ends = moved.join(b, "dst").join(new_b, "dst", "left")
    # A link between a mover and a node that stays is met from one of its ends only.
    sides = F.when(F.col("new_b").isNull(), 2).otherwise(1)
    same = (F.col("new_a") == F.coalesce("new_b", "b")).cast("int") - (F.col("a") == F.col("b")).cast("int")
    inner = ends.agg(F.sum(F.col("w") * sides * same)).first()[0] or 0
    k = chosen.select("id", "to").join(state.select("id", "community", "k"), "id")
    change = k.select(F.inline(F.array(
        F.struct(F.col("community").alias("c"), (-F.col("k")).alias("dk")), F.struct(F.col("to").alias("c"), F.col("k").alias("dk")),
    ))).groupBy("c").agg(F.sum("dk").alias("dk"))
    tot = state.groupBy(F.col("community").alias("c")).agg(F.max("tot").alias("tot"))
    # A community that is new has no degree yet.
    grown = change.join(tot, "c", "left").select("dk", F.coalesce("tot", F.lit(0).cast("long")).alias("tot"))
    squares = grown.agg(F.sum(exact(F.col("dk")) * exact(2 * F.col("tot") + F.col("dk")))).first()[0]
    return two_m * int(inner) - int(squares or 0)


def apart(moves: DataFrame) -> DataFrame:
    """The moves that have the best gain in both of their communities: together they gain what each gains alone."""
    rank = F.struct((-F.col("gain")).alias("g"), F.col("id").alias("id"))
    ends = moves.select("id", "gain", F.explode(F.array("community", "to")).alias("c"))
    first = ends.groupBy("c").agg(F.min(rank).alias("best")).select(F.col("best.id").alias("id"))
    both = first.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    return moves.join(both, "id", "left_semi")


def reached(links: DataFrame, labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id): nodes whose options the moves may have changed: members of their communities, and the neighbours of these."""
    changed = chosen.select(F.explode(F.array("community", "to")).alias("community")).distinct()
    members = labels.join(changed, "community", "left_semi").select("id")
    around = links.join(members.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"))
    return members.unionByName(around).distinct()


def local_moves(links: DataFrame, nodes: DataFrame, labels: DataFrame, two_m: int) -> tuple[DataFrame, bool]:
    """(labels, moved): nodes move until no single move gains anything.

    In a round the nodes of every second hash move at once, unless that lowers the
    score or few want to move; then the moves that do not touch each other are taken,
    which raise it by what they gain. So the rounds end. A round asks only the nodes that the
    last moves reached; what the others want stays as it was.
    """
    moved, failed, size = False, False, nodes.count()
    links = keep_partitioned(links, ["src"])
    moves, only, few = None, None, False
    count = F.count(F.lit(1)).alias("n")
    try:
        for step in range(MAX_STEPS):
            if not failed:
                state = cut(with_tot(nodes, labels), "degrees")
                new, seen = improving_moves(links, nodes, labels, two_m, state, only, few), Observation()
                if moves is not None:
                    new = new.unionByName(moves.join(only, "id", "left_anti"))
                moves = cut(new.observe(seen, count), "moves")
                wanting = seen.get["n"]
            if not wanting:
                return labels, moved
            careful = failed or FEW * wanting < size
            chosen = apart(moves) if careful else moves.filter(F.pmod(F.xxhash64("id", F.lit(step)), F.lit(2)) == 0)
            chosen = cut(chosen, "chosen")
            # Moves apart gain what each gains alone.
            failed = not careful and gained(links, state, chosen, two_m) <= 0
            if failed:
                continue
            to = chosen.select("id", F.col("to").alias("_to"))
            labels = cut(labels.join(to, "id", "left").select("id", F.coalesce("_to", "community").alias("community")), "moved")
            moved, asked = True, Observation()
            only = cut(reached(links, labels, chosen).observe(asked, count), "reached")
            few = FEW * asked.get["n"] < size
        raise RuntimeError(f"no fixed point after {MAX_STEPS} rounds")
    finally:
        links.unpersist()


def contracted(links: DataFrame, nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, nodes) with each community as one node; links inside it become its loops."""
    a = labels.select(F.col("id").alias("src"), F.col("community").alias("a"))
    b = labels.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    joined = links.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.sum("w").alias("w"))
    joined = cut(joined, "contracted")
    between = joined.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    inner = joined.filter("a = b").select(F.col("a").alias("id"), F.col("w").alias("inner"))
    sums = nodes.join(labels, "id").groupBy(F.col("community").alias("id")).agg(F.sum("k").alias("k"), F.sum("loops").alias("loops"))
    merged = sums.join(inner, "id", "left").select("id", "k", (F.col("loops") + F.coalesce("inner", F.lit(0))).alias("loops"))
    return between, cut(merged, "contracted-nodes")


def louvain(vertices: DataFrame, edges: DataFrame, start: DataFrame | None = None, most: int = P.MOST) -> DataFrame:
    """(id, community) at a fixed point: neither a move of a node nor of a whole community raises modularity.

    Moves on the graph itself and on its contractions, level by level, follow each
    other until a pass over all levels changes nothing. ``start(id, community)`` defaults to
    label propagation with own votes; the result is never worse. A community is named by its
    smallest member. Nodes without edges, also loops, stay alone.

    No move leaves a component, and of the others only the number of their links counts.
    So a task works on whole components of up to ``most`` rows; larger ones go through
    distributed rounds. A community of ``start`` in several components is taken as several.
    """
    if start is None:
        start = label_propagation(vertices, edges, own_vote=True)
    parts = packed(vertices, edges, start, most)
    two_m = parts.packs.agg(F.sum("links")).first()[0] or 0
    if parts.rest_edges is None:
        return P.modular(parts, two_m)
    links = cut(weighted(parts.rest_edges), "links")
    two_m += links.agg(F.sum("w")).first()[0] or 0
    rest = parts.rest.filter("id is not null")
    found = distributed_louvain(rest.select("id").distinct(), links, rest.select("id", F.coalesce("label", "id").alias("community")).distinct(), two_m)
    return P.modular(parts, two_m).unionByName(rest.select("id").join(found, "id"))


def distributed_louvain(vertices: DataFrame, links: DataFrame, start: DataFrame, two_m: int) -> DataFrame:
    """``louvain`` of ``links(src, dst, w)`` by rounds over the whole graph, which has ``two_m`` link ends with those of its other parts."""
    degree = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    nodes = vertices.join(degree, "id", "left")
    nodes = cut(nodes.select("id", F.coalesce("k", F.lit(0).cast("long")).alias("k"), F.lit(0).cast("long").alias("loops")), "nodes")
    labels = cut(start, "start")
    for _ in range(MAX_STEPS):
        labels, changed = local_moves(links, nodes, labels, two_m)
        level_links, level_nodes = links, nodes
        step = labels  # from the level's nodes to their communities
        while True:
            level_links, level_nodes = contracted(level_links, level_nodes, step)
            same = level_nodes.select("id", F.col("id").alias("community"))
            step, merged = local_moves(level_links, level_nodes, same, two_m)
            if not merged:
                break
            up = step.select(F.col("id").alias("community"), F.col("community").alias("_up"))
            labels = cut(labels.join(up, "community").select("id", F.col("_up").alias("community")), "level")
            changed = True
        if not changed:
            break
    else:
        raise RuntimeError(f"no fixed point after {MAX_STEPS} passes")
    names = labels.groupBy("community").agg(F.min("id").alias("name"))
    return labels.join(names, "community").select("id", F.col("name").alias("community"))


def fixed_point_report(vertices: DataFrame, edges: DataFrame, start: DataFrame, found: DataFrame) -> DataFrame:
    """(metric, n): nodes, labelled nodes, and moves of nodes or whole communities that would still gain; whether ``found`` is worse than ``start``."""
    links = cut(weighted(edges), "links")
    degree = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    nodes = vertices.select("id").join(degree, "id", "left")
    nodes = nodes.select("id", F.coalesce("k", F.lit(0).cast("long")).alias("k"), F.lit(0).cast("long").alias("loops"))
    two_m = links.agg(F.sum("w")).first()[0] or 0
    count = F.count(F.lit(1)).alias("n")
    merged_links, merged_nodes = contracted(links, nodes, found)
    merges = improving_moves(merged_links, merged_nodes, merged_nodes.select("id", F.col("id").alias("community")), two_m)
    worse = int(score(links, nodes, found, two_m) < score(links, nodes, start, two_m))
    parts = [
        vertices.agg(F.lit("nodes").alias("metric"), count),
        found.agg(F.lit("labelled").alias("metric"), F.count_distinct("id").alias("n")),
        improving_moves(links, nodes, found, two_m).agg(F.lit("node_moves").alias("metric"), count),
        merges.agg(F.lit("community_moves").alias("metric"), count),
        vertices.agg(F.lit("worse_than_start").alias("metric"), F.lit(worse).cast("long").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
