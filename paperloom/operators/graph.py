"""Graph operators over vertices(id, ...) and edges(src, dst, ...) (GRA-*)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from paperloom.functions.text import stable_hash
from paperloom.operators import packs as P
from paperloom.operators.skew import numbered, top_n
from paperloom.session import cut, new_table_path

# --- fixed values: ranking weights -------------------------------------------
KEY_PAPER_WEIGHTS = {"pagerank": 0.45, "citations": 0.30, "representative": 0.15, "bridge": 0.10}
RECENT_FROM_YEAR = 2022

MAX_ROUNDS = 1_000  # of an iteration to a fixed point or a tolerance; more is an error
HOT_ROWS = 1_000_000  # edges of one node that one task may hold
HOT_BUCKETS = 1 << 16  # of the first count for nodes with more
MOST_LOGS = 8  # tables of changes that a round reads; more are merged


def keep_partitioned(df: DataFrame, keys: list[str], then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Persist ``df`` hash-partitioned, in a form whose partitioning later joins see.

    An adaptive cached plan does not promise its partitioning, and every join
    would exchange it again; so this one plan is static. ``then`` works on the
    partitions before they are kept.
    """
    spark = df.sparkSession
    adaptive = "spark.sql.adaptive.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.repartition(n, *keys)
        return (then(rows) if then else rows).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        spark.conf.set(adaptive, before)


class EdgeLayout:
    """Edges laid out once by one end, for the joins of an iterative job.

    The edges are the large side of every round. Hash-partitioned, sorted and persisted,
    they are not exchanged or sorted again; only node values travel. A node with more than
    ``hot_rows`` edges is split into salted parts by its other ends, and its value
    is sent to each part. Lost partitions are rebuilt from ``edges``, which should be a
    written table. ``degree`` adds the number of edges of the key end, ``computed``
    further columns of the two ends.
    """

    def __init__(
        self, edges: DataFrame, key: str, other: str, hot_rows: int = HOT_ROWS, degree: bool = False, **computed: Column
    ) -> None:
        # Parallel edges become one row with a multiplicity: (key, other) is unique.
        edges = edges.select(key, other)
        self.key = key
        hot = self._hot(edges, key, other, hot_rows)
        self.salted = hot is not None

        def merged(rows: DataFrame) -> DataFrame:
            return rows.groupBy(key, other).agg(F.count(F.lit(1)).alias("times"))

        def finished(rows: DataFrame) -> DataFrame:
            return rows.withColumns(computed).sortWithinPartitions(key, other) if computed else rows.sortWithinPartitions(key, other)

        if not self.salted:
            def within(rows: DataFrame) -> DataFrame:
                rows = merged(rows)
                if degree:
                    rows = rows.withColumn("degree", F.sum("times").over(Window.partitionBy(key)))
                return finished(rows)

            self.rows = keep_partitioned(edges, [key], within)
            return
        self.hot = hot
        rows = cut(merged(edges), "edges-once")
        if degree:
            total = rows.groupBy(key).agg(F.sum("times").alias("degree"))
            # Written first, so that the join may be re-planned around skew.
            rows = cut(rows.join(cut(total, "degrees"), key), "edges-laid-out")
        salt = F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1))).cast("int")
        rows = rows.join(F.broadcast(hot), rows[key] == hot["_hot"], "left").withColumn("_salt", salt).drop("_hot", "_parts")
        self.rows = keep_partitioned(rows, [key, "_salt"], finished)

    @staticmethod
    def _hot(edges: DataFrame, key: str, other: str, hot_rows: int) -> DataFrame | None:
        """(_hot, _parts): nodes with more than ``hot_rows`` different other ends; None without one.

        A hot node fills a hash bucket alone, so only the nodes of overfull buckets are counted.
        """
        bucket = F.pmod(F.xxhash64(key), F.lit(HOT_BUCKETS)).alias("_bucket")
        full = cut(edges.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows), "full-buckets")
        if full.isEmpty():
            return None
        some = edges.select(key, other, bucket).join(full, "_bucket", "left_semi").select(key, other).distinct()
        parts = F.ceil(F.count(F.lit(1)) / hot_rows).cast("int")
        hot = cut(some.groupBy(F.col(key).alias("_hot")).agg(parts.alias("_parts")).filter("_parts > 1"), "hot-nodes")
        return None if hot.isEmpty() else hot

    def meet(self, values: DataFrame) -> DataFrame:
        """Each edge with the value row (id, ...) of its key end."""
        if not self.salted:
            return self.rows.join(values, self.rows[self.key] == values["id"])
        spread = values.join(self.hot, values["id"] == self.hot["_hot"], "left").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        )
        on = (self.rows[self.key] == spread["id"]) & (self.rows["_salt"] == spread["_part"])
        return self.rows.join(spread, on).drop("_hot", "_parts", "_part", "_salt")

    def close(self) -> None:
        self.rows.unpersist()


# --- snapshot ----------------------------------------------------------------


def name_key(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def snapshot_edges(papers: DataFrame, max_edges: int = 0) -> DataFrame:
    """GRA-01 edges of papers(work_id, authors, topics, referenced_works, seq).

    Ids carry the node type, so an author and a topic of one name stay apart.
    ``max_edges`` keeps the first edges in emission order: paper order, then
    authors, topics, citations, each in list order (WIN-10).
    """
    def side(kind: str, values: Column, prefix: str, rank: int) -> DataFrame:
        rows = papers.select("seq", "work_id", F.posexplode(values).alias("pos", "v"))
        target = F.col("v") if prefix == "paper" else name_key(F.col("v"))
        return rows.select(
            "seq", F.lit(rank).alias("kind"), "pos",
            F.concat(F.lit("paper:"), "work_id").alias("src"),
            F.concat(F.lit(prefix + ":"), target).alias("dst"),
            F.lit(kind).alias("type"),
        )

    held = papers.select(F.concat(F.lit("paper:"), "work_id").alias("dst"))
    cites = side("CITES", F.col("referenced_works"), "paper", 2).join(held, "dst", "left_semi")
    edges = (
        side("AUTHORED_BY", F.col("authors"), "author", 0)
        .unionByName(side("HAS_TOPIC", F.slice("topics", 1, 10), "topic", 1))
        .unionByName(cites)
    )
    if max_edges > 0:
        edges = numbered(edges, ["seq", "kind", "pos"], name="nth", label="edge-cap").filter(
            F.col("nth") <= max_edges
        )
    return edges.select("src", "dst", "type")


def snapshot_vertices(papers: DataFrame) -> DataFrame:
    """GRA-01 nodes; paper_count counts every occurrence, also past an edge cap."""
    own = papers.select(
        F.concat(F.lit("paper:"), "work_id").alias("id"), F.lit("paper").alias("type"),
        F.col("title").alias("label"), F.lit(None).cast("long").alias("paper_count"),
    )

    def named(values: Column, kind: str) -> DataFrame:
        rows = papers.select("seq", F.posexplode(values).alias("pos", "v"))
        rows = rows.withColumn("id", F.concat(F.lit(kind + ":"), name_key(F.col("v"))))
        # min_by keeps the first spelling seen; partial aggregation bounds a hot name.
        return rows.groupBy("id").agg(
            F.min_by("v", F.struct("seq", "pos")).alias("label"), F.count(F.lit(1)).alias("paper_count")
        ).select("id", F.lit(kind).alias("type"), "label", "paper_count")

    return own.unionByName(named(F.col("authors"), "author")).unionByName(
        named(F.slice("topics", 1, 10), "topic")
    )


def snapshot_record(corpus_id: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRA-15: id hash and counts of a snapshot, one row."""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    both = n.select("node_count", e.select("edge_count").scalar().alias("edge_count"))
    key = stable_hash(
        {"corpus": f'"{corpus_id}"', "nodes": F.col("node_count").cast("string"),
         "edges": F.col("edge_count").cast("string")}, 12,
    )
    return both.select(
        F.concat(F.lit("graph_"), key).alias("graph_snapshot_id"), F.lit(corpus_id).alias("corpus_id"),
        "node_count", "edge_count",
    )


def algorithm_record(snapshot_id: str, at: str, algorithm: str, parameters: str, results: str) -> Column:
    """GRA-15: one algorithm-run record as a struct."""
    run = stable_hash({"snapshot": f'"{snapshot_id}"', "ts": f'"{at}"'}, 12)
    return F.struct(
        F.concat(F.lit("algo_"), run).alias("algo_run_id"), F.lit(snapshot_id).alias("graph_snapshot_id"),
        F.lit(algorithm).alias("algorithm"), F.lit(parameters).alias("parameters"), F.lit(results).alias("results"),
    )


# --- packs -----------------------------------------------------------------------


def packed(vertices: DataFrame, edges: DataFrame, start: DataFrame | None = None, most: int = P.MOST) -> P.Packed:
    """The components of a graph of up to ``most`` rows in packs, the larger ones apart; ``start(id, community)`` labels the vertices."""
    kind = vertices.schema["id"].dataType
    nodes = vertices.select("id", F.lit(1).alias("times"), F.lit(None).cast(kind).alias("label"))
    if start is not None:
        nodes = nodes.unionByName(start.select("id", F.lit(0).alias("times"), F.col("community").alias("label")))
    nodes = nodes.groupBy("id").agg(F.sum("times").alias("times"), F.min("label").alias("label")).filter("times > 0")
    return P.packed(nodes, edges, component_roots(edges), most)


# --- PageRank ------------------------------------------------------------------


def pagerank(
    vertices: DataFrame, edges: DataFrame, iterations: int = 30, damping: float = 0.85, hot_rows: int = HOT_ROWS,
    packs: P.Packed | None = None,
) -> DataFrame:
    """GRA-02: (id, pagerank); dangling rank is shared evenly, the sum is 1.

    Uniform teleport and uniform dangling share mean that each round adds a
    multiple of the start vector v0 = 1/N. So r_T = sum_j a_j v_j, with
    v_j = (d A)^j v0 and a_j computed from the masses of the v_j alone. One
    round is then one join on the laid-out edges and one partial-aggregated sum on
    the target, with no second join to the vertices and no dangling scan; nodes
    nobody cites leave v_j on their own, and an empty v_j ends the loop early
    with the exact result. With ``packs`` of the graph only what is not packed
    goes through these rounds; the masses are those of both.
    """
    spark = vertices.sparkSession
    nodes = cut(vertices.select("id").distinct(), "rank-nodes")
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("pagerank", F.lit(0.0))
    if packs is not None:
        packed_masses = P.rank_masses(packs, 1.0 / n, damping, iterations)
        if packs.rest_edges is None:
            coefficients = _coefficients(packed_masses)
            ranks = P.ranks(packs, 1.0 / n, damping, coefficients)
            if packs.rest is None:
                return ranks
            # Vertices without an id have no edges.
            return ranks.unionByName(packs.rest.select("id").distinct().withColumn("pagerank", F.lit(coefficients[0] / n)))
        nodes, edges = packs.rest.select("id").distinct(), packs.rest_edges
    layout = EdgeLayout(edges, "src", "dst", hot_rows, degree=True)
    base = new_table_path(spark, "rank-terms")
    kind = nodes.schema["id"].dataType.simpleString()
    current = nodes.select("id", F.lit(1.0 / n).alias("v"))
    masses: list[float] = []
    share = F.col("v") * (F.col("times") * damping / F.col("degree"))
    for step in range(1, iterations + 1):
        seen = Observation()
        path = f"{base}/step={step}"
        (
            layout.meet(current).groupBy(F.col("dst").alias("id")).agg(F.sum(share).alias("v"))
            .observe(seen, F.sum("v").alias("mass")).write.parquet(path)
        )
        mass = seen.get["mass"]
        masses.append(mass or 0.0)
        if not mass:
            break
        current = spark.read.schema(f"id {kind}, v double").parquet(path)
    layout.close()
    masses += [0.0] * (iterations - len(masses))
    if packs is not None:
        masses = [a + b for a, b in zip(masses, packed_masses)]
    coefficients = _coefficients(masses)
    scale = F.element_at(F.array(*[F.lit(a) for a in coefficients[1:]]), F.col("step"))
    terms = spark.read.schema(f"id {kind}, v double, step int").parquet(base)
    tail = terms.groupBy("id").agg(F.sum(F.col("v") * scale).alias("_tail"))
    ranks = nodes.join(tail, "id", "left").select(
        "id", (F.lit(coefficients[0] / n) + F.coalesce("_tail", F.lit(0.0))).alias("pagerank")
    )
    return ranks if packs is None else ranks.unionByName(P.ranks(packs, 1.0 / n, damping, coefficients))


def _coefficients(masses: list[float]) -> list[float]:
    """a_0 .. a_T of PageRank from the masses of its terms."""
    coefficients = [1.0]
    for _ in masses:
        first = 1.0 - sum(a * masses[j] for j, a in enumerate(coefficients))
        coefficients = [first] + coefficients
    return coefficients


# --- components and communities ------------------------------------------------


def both_ways(edges: DataFrame) -> DataFrame:
    """Both directions, no self loops."""
    e = edges.select("src", "dst").filter("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, no self loops, no repeats."""
    return both_ways(edges).distinct()


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """GRA-03: (id, component), component = smallest id; isolated nodes kept."""
    links = component_roots(edges, max_rounds)
    return vertices.select("id").join(
        links.select(F.col("u").alias("id"), F.col("v").alias("_root")), "id", "left"
    ).select("id", F.coalesce("_root", "id").alias("component"))


def component_roots(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v): each node that is not the smallest of its component with the one that is.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the
    number of rounds grows with the logarithm of the size, also on long chains,
    and each round only takes a minimum per node and joins it back.
    """
    def kept(df: DataFrame, label: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
        out = cut(df.observe(seen, *sums), label)
        return out, (seen.get["n"], seen.get["h"])

    links, before = kept(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .filter("u <> v").distinct(),
        "links",
    )
    for _ in range(max_rounds):
        # Large star: larger neighbours move to the least of the neighbourhood.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = cut(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")),
            "large-star",
        )
        # Small star: smaller neighbours and the node itself move to the least one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        links, after = kept(
            large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "small-star",
        )
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return links


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 3, own_vote: bool = False) -> DataFrame:
    """GRA-04: (id, community) by synchronous label propagation.

    A node takes the most frequent label around it, ties to the smallest label.
    Labels are counted per (node, label) before the choice, so a hub never sends
    its whole neighbourhood to one task. With ``own_vote`` a node's own label counts
    once, so that the ends of a lone edge agree instead of trading labels.
    """
    links = both_ways(edges)
    if own_vote:
        links = links.unionByName(vertices.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    layout = EdgeLayout(links, "src", "dst")
    labels = vertices.select("id", F.col("id").alias("community"))
    for _ in range(rounds):
        votes = layout.meet(labels).groupBy(F.col("dst").alias("_n"), "community").agg(F.count(F.lit(1)).alias("_c"))
        # Spark orders structs by field, so the negated count puts most votes first.
        best = votes.groupBy("_n").agg(
            F.min(F.struct((-F.col("_c")).alias("c"), F.col("community").alias("l"))).alias("_b")
        )
        labels = cut(
            labels.join(best, labels["id"] == best["_n"], "left").select(
                "id", F.coalesce("_b.l", "community").alias("community")
            ),
            "labels",
        )
    layout.close()
    return labels


def settled_labels(vertices: DataFrame, edges: DataFrame, packs: P.Packed | None = None) -> DataFrame:
    """GRA-04: (id, community) by label propagation to its fixed point.

    At the end no node has more neighbours with another label than with its own. In
    a round the nodes that have want to move to the most frequent label around
    them, ties to the smallest; those whose hash is the least among such neighbours do.
    No two movers are adjacent, so each move adds links inside communities,
    the rounds end, and labels never swap for ever. A community is named by its
    smallest member; nodes without links stay alone. With ``packs`` of the graph only
    what is not packed goes through rounds of exchanges.
    """
    if packs is not None:
        found = P.settled(packs)
        return found if packs.rest_edges is None else found.unionByName(settled_labels(packs.rest.select("id"), packs.rest_edges))
    md5 = [F.md5(F.col(c).cast("string")) for c in ("src", "dst")]
    layout = EdgeLayout(both_ways(edges), "src", "dst", _before=md5[0] < md5[1])
    # The state is a log of rows (_n, _c, votes, own): votes that label _c gains or loses at node
    # _n, and how often _n itself has it. Kept by node, it is not exchanged again; a round sends
    # what moved, and looks again at the nodes this reaches.
    def kept(rows: DataFrame, label: str) -> DataFrame:
        return cut(rows, label) if layout.salted else keep_partitioned(rows, ["_n"])

    def entry(label: str, votes: Column, own: Column) -> Column:
        return F.struct(F.col(label).alias("_c"), votes.cast("long").alias("votes"), own.cast("long").alias("own"))

    none = F.lit(0)
    nodes = cut(vertices.groupBy("id").agg(F.count(F.lit(1)).alias("_times")), "label-nodes")
    # At first each neighbour votes for its own id, once; an end that is no vertex, or is one more than once, votes 0 or more times.
    ends = layout.rows.select(F.col("src").alias("id")).distinct()
    odd = ends.join(nodes, "id", "left").select("id", (F.coalesce("_times", F.lit(0)) - 1).alias("_more")).filter("_more <> 0")
    odd = cut(odd, "label-odd-ends")
    start = kept(nodes.select(F.col("id").alias("_n"), F.col("id").alias("_c"), none.cast("long").alias("votes"), F.col("_times").alias("own")), "label-start")
    logs = [layout.rows.select(F.col("src").alias("_n"), F.col("dst").alias("_c"), F.lit(1).cast("long").alias("votes"), none.cast("long").alias("own")), start]
    held = [start]
    if not odd.isEmpty():
        more = kept(layout.meet(odd).select(F.col("dst").alias("_n"), F.col("src").alias("_c"), F.col("_more").alias("votes")), "label-odd")
        logs.append(more.select("_n", "_c", "votes", none.cast("long").alias("own")))
        held.append(more)
    touched, want, all_moves = None, None, []
    for step in range(MAX_ROUNDS):
        rows = reduce(DataFrame.unionByName, logs)
        if touched is not None:
            rows = rows.join(touched.hint("shuffle_hash"), "_n")
        # Counted per (node, label) before the choice, so a hub never sends all its neighbours to one task.
        sums = rows.groupBy("_n", "_c").agg(F.sum("votes").alias("votes"), F.sum("own").alias("own"))
        mine = F.col("own") > 0
        chosen = sums.groupBy("_n").agg(
            F.min(F.when(F.col("votes") > 0, F.struct((-F.col("votes")).alias("c"), F.col("_c").alias("l")))).alias("_b"),
            F.max(F.when(mine, F.col("votes"))).alias("_stay"), F.max(F.when(mine, F.col("_c"))).alias("_from"),
            F.max("own").alias("_times"),
        )
        found = chosen.filter(-F.col("_b.c") > F.col("_stay")).select(F.col("_n").alias("id"), "_from", F.col("_b.l").alias("_to"), "_times")
        if want is not None:
            found = found.unionByName(want.join(touched, want["id"] == touched["_n"], "left_anti"))
        seen = Observation()
        want = cut(found.observe(seen, F.count(F.lit(1)).alias("n")), "label-wants")
        if not seen.get["n"]:
            break
        blocked = layout.meet(want.select("id")).filter("_before").select(F.col("dst").alias("_n")).distinct()
        moves = cut(want.join(blocked, want["id"] == blocked["_n"], "left_anti").withColumn("_step", F.lit(step)), "label-moves")
        all_moves.append(moves)
        what = ["_from", "_to", "_times"]
        sent = layout.meet(moves).select(F.col("dst").alias("_n"), *what, F.lit(False).alias("_self"))
        sent = kept(sent.unionByName(moves.select(F.col("id").alias("_n"), *what, F.lit(True).alias("_self"))), "label-sent")
        votes, own = F.when(~F.col("_self"), F.col("_times")).otherwise(0), F.when(F.col("_self"), F.col("_times")).otherwise(0)
        logs.append(sent.select("_n", F.inline(F.array(entry("_from", -votes, -own), entry("_to", votes, own)))))
        held.append(sent)
        touched = sent.select("_n").distinct()
        if len(logs) > MOST_LOGS:
            changes = reduce(DataFrame.unionByName, logs[1:]).groupBy("_n", "_c").agg(F.sum("votes").alias("votes"), F.sum("own").alias("own"))
            merged = kept(cut(changes.filter("votes <> 0 or own <> 0"), "label-changes"), "label-log")
            touched = cut(touched, "label-touched")
            for h in held:
                h.unpersist()
            logs, held = [logs[0], merged], [merged]
    else:
        raise RuntimeError(f"labels still move after {MAX_ROUNDS} rounds")
    for h in held:
        h.unpersist()
    layout.close()
    labels = vertices.select("id", F.col("id").alias("community"))
    if all_moves:
        last = reduce(DataFrame.unionByName, all_moves).groupBy("id").agg(F.max_by("_to", "_step").alias("_to"))
        labels = cut(labels.join(last, "id", "left").select("id", F.coalesce("_to", "community").alias("community")), "labels")
    names = labels.groupBy("community").agg(F.min("id").alias("_name"))
    return labels.join(names, "community").select("id", F.col("_name").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """GRA-04: one row, the modularity of a labelling on the undirected graph."""
    links = undirected(edges)
    a = communities.select(F.col("id").alias("src"), F.col("community").alias("_cs"))
    b = communities.select(F.col("id").alias("dst"), F.col("community").alias("_cd"))
    per = (
        links.join(a, "src").join(b, "dst")
        .groupBy("_cs").agg(F.count(F.lit(1)).alias("deg"), F.count_if(F.col("_cs") == F.col("_cd")).alias("inner"))
    )
    return per.agg(
        (
            F.sum("inner") / F.sum("deg")
            - F.sum(F.col("deg").cast("double") * F.col("deg")) / (F.sum("deg").cast("double") * F.sum("deg"))
        ).alias("modularity")
    )


# --- scores -------------------------------------------------------------------


def bridge_scores(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """GRA-05: (id, bridge_score): edges of the node that leave its community."""
    a = communities.select(F.col("id").alias("src"), F.col("community").alias("_cs"))
    b = communities.select(F.col("id").alias("dst"), F.col("community").alias("_cd"))
    crossing = edges.select("src", "dst").join(a, "src").join(b, "dst").filter("_cs <> _cd")
    # Both ends from one pass, added up before the exchange.
    return crossing.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).cast("double").alias("bridge_score")
    )


def representatives(papers: DataFrame, communities: DataFrame, ranks: DataFrame) -> DataFrame:
    """WIN-05: the paper with the highest PageRank of each community; ties to the smallest id."""
    rows = papers.select("id").join(communities, "id").join(ranks, "id")
    return rows.groupBy("community").agg(
        F.min(F.struct((-F.round("pagerank", 12)).alias("r"), F.col("id").alias("id"))).alias("_b")
    ).select("community", F.col("_b.id").alias("id"))


def rank_key_papers(
    papers: DataFrame, ranks: DataFrame, communities: DataFrame, bridges: DataFrame, limit: int = 10
) -> DataFrame:
    """GRA-06: top papers of papers(id, title, publication_year, cited_by_count)."""
    best = representatives(papers, communities, ranks).select("id", F.lit(True).alias("_rep"))
    most = papers.agg(F.max("cited_by_count").cast("double").alias("m")).scalar()
    rows = (
        papers.join(ranks, "id", "left").join(communities, "id", "left")
        .join(bridges, "id", "left").join(best, "id", "left")
        .withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
        .withColumn("bridge_score", F.coalesce("bridge_score", F.lit(0.0)))
        .withColumn("_rep", F.coalesce("_rep", F.lit(False)))
        .withColumn("_max", most)
    )
    w = KEY_PAPER_WEIGHTS
    score = (
        w["pagerank"] * F.col("pagerank")
        + w["citations"] * F.when(F.col("_max") > 0, F.col("cited_by_count") / F.col("_max")).otherwise(0.0)
        + w["representative"] * F.when(F.col("_rep"), 1.0).otherwise(0.0)
        + w["bridge"] * F.least(F.lit(1.0), F.col("bridge_score") / 3.0)
    )
    role = (
        F.when(F.col("publication_year") >= RECENT_FROM_YEAR, "recent_representative")
        .when(F.col("bridge_score") > 0, "bridge_paper")
        .when(F.col("_rep"), "community_representative")
        .otherwise("influential_paper")
    )
    return (
        rows.select(
            F.col("id").alias("work_id"), "title", F.round(score, 6).alias("score"), role.alias("role"),
            F.round("pagerank", 6).alias("pagerank"), "community", "bridge_score",
            "cited_by_count", "publication_year",
        )
        .orderBy(F.desc("score"), F.asc("work_id"))
        .limit(limit)
    )


def field_structure(
    papers: DataFrame, edges: DataFrame, limit: int = 10, method: str = "labels", topics: DataFrame | None = None
) -> dict[str, DataFrame]:
    """GRA-07: every metric of one corpus, sharing the intermediate tables.

    ``method`` names the communities: "labels" (label propagation to its fixed point), "modularity"
    or "components"; no edge leaves a component, so with those no paper is a bridge.
    ``topics(id, topic)`` adds the topic counts.
    """
    packs = packed(papers, edges)
    ranks = cut(pagerank(papers, edges, packs=packs), "ranks")
    if method == "labels":
        found = settled_labels(papers, edges, packs)
    elif method == "modularity":
        from paperloom.operators.communities import louvain  # which builds on this module

        found = louvain(papers, edges)
    elif method == "components":
        found = connected_components(papers, edges).withColumnRenamed("component", "community")
    else:
        raise ValueError(f"unknown community method {method}")
    communities = cut(found, "communities")
    bridges = cut(bridge_scores(edges, communities), "bridges")
    count = F.count(F.lit(1))
    parts = [papers.agg(F.lit("nodes").alias("metric"), count.alias("n")), edges.agg(F.lit("edges").alias("metric"), count.alias("n"))]
    parts.append(communities.agg(F.lit("communities").alias("metric"), F.count_distinct("community").alias("n")))
    out = {
        "pagerank": ranks, "communities": communities, "bridge": bridges,
        "key_papers": rank_key_papers(papers, ranks, communities, bridges, limit),
        "yearly": papers.groupBy("publication_year").agg(count.alias("n_papers")),
        "counts": reduce(DataFrame.unionByName, parts),
    }
    if topics is not None:
        out["topics"] = topics.groupBy("topic").agg(F.count_distinct("id").alias("n_papers"))
    return out


# --- typed graph ----------------------------------------------------------------


def typed_vertices(tables: dict[str, DataFrame]) -> DataFrame:
    """GRA-08: (id, type, label) from the entity tables that are present."""
    spec = [
        ("countries", "country_code", "Country", "country_code"),
        ("institutions", "institution_id", "Institution", "display_name"),
        ("authors", "author_id", "Author", "display_name"),
        ("venues", "venue_id", "Venue", "display_name"),
        ("concepts", "concept_id", "Concept", "display_name"),
        ("works", "work_id", "Paper", "title"),
        ("work_types", "type_name", "WorkType", "type_name"),
    ]
    parts = [
        tables[t].select(
            F.concat(F.lit(kind + ":"), F.col(k)).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label")
        )
        for t, k, kind, label in spec if t in tables
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def typed_edges(tables: dict[str, DataFrame], vertices: DataFrame | None = None) -> DataFrame:
    """GRA-09: (src, dst, type, weight); both ends must exist as nodes. ``vertices(id, ...)`` are the nodes of the tables, where they are written already.

    Affiliation in a work (JN-08) links the author to the institution, once per
    work and position.
    """
    t = tables

    def edge(df: DataFrame, kind: str | Column, src: tuple[str, str], dst: tuple[str, str], weight: Column | None = None) -> DataFrame:
        return df.select(
            F.concat(F.lit(src[0] + ":"), F.col(src[1])).alias("src"),
            F.concat(F.lit(dst[0] + ":"), F.col(dst[1])).alias("dst"),
            (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
            (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"),
        )

    # Both kinds of subject edges from one look at the table.
    subject = t["work_concepts"].filter("score > 0").select("work_id", "concept_id", F.inline(F.filter(
        F.array(
            F.struct(F.lit("ABOUT").alias("kind"), F.col("score").cast("double").alias("weight"), F.lit(True).alias("_is")),
            F.struct(F.lit("HAS_TOPIC").alias("kind"), F.lit(1.0).alias("weight"), (F.col("score") > 0.3).alias("_is")),
        ),
        lambda e: e["_is"],
    )))
    in_work = t["work_author_affiliations"].select("work_id", "author_id", "institution_id").distinct()
    parts = [
        edge(t["citations"], "CITES", ("Paper", "citing_work_id"), ("Paper", "cited_work_id")),
        edge(t["work_authors"], "AUTHORED", ("Author", "author_id"), ("Paper", "work_id")),
        edge(t["work_venues"], "PUBLISHED_IN", ("Paper", "work_id"), ("Venue", "venue_id")),
        edge(subject, F.col("kind"), ("Paper", "work_id"), ("Concept", "concept_id"), F.col("weight")),
        edge(t["author_institutions"], "AFFILIATED_WITH", ("Author", "author_id"), ("Institution", "institution_id")),
        edge(t["work_institutions"], "ASSOCIATED_WITH", ("Paper", "work_id"), ("Institution", "institution_id")),
        edge(in_work, "AFFILIATED_IN_WORK", ("Author", "author_id"), ("Institution", "institution_id")),
        edge(
            t["institutions"].filter("country_code IS NOT NULL"), "LOCATED_IN",
            ("Institution", "institution_id"), ("Country", "country_code"),
        ),
        edge(t["works"].filter("type_name IS NOT NULL"), "HAS_TYPE", ("Paper", "work_id"), ("WorkType", "type_name")),
    ]
    nodes = cut(typed_vertices(t).select("id"), "node-ids") if vertices is None else vertices.select("id")
    return (
        reduce(lambda a, b: a.unionByName(b), parts)
        .join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
        .join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    )


def type_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-11: nodes per label and edges per type."""
    n = vertices.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    e = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "type", "n")
    return n.unionByName(e)


# --- paths and neighbourhoods ----------------------------------------------------


def collaborators(work_authors: DataFrame, author: object) -> DataFrame:
    """GRA-10 / JN-09: co-authors of one author with the number of shared works.

    Only works of that author are kept before the join back, so no pairs of
    other authors are built.
    """
    links = work_authors.select("work_id", "author_id").distinct()
    own = links.filter(F.col("author_id") == F.lit(author)).select("work_id")
    return (
        links.join(own, "work_id", "left_semi").filter(F.col("author_id") != F.lit(author))
        .groupBy("author_id").agg(F.count(F.lit(1)).alias("shared_works"))
    )


def citation_paths(edges: DataFrame, start: DataFrame, max_hops: int = 3) -> DataFrame:
    """GRA-11: every path of 1..max_hops edges from the start ids; no edge twice."""
    links = edges.select("src", "dst").distinct()
    walk = start.select(F.array("id").alias("path"), F.col("id").alias("_end"))
    found = []
    for _ in range(max_hops):
        nxt = walk.join(links, walk["_end"] == links["src"])
        used = F.exists(
            F.arrays_zip(
                F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("a"),
                F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))).alias("b"),
            ),
            lambda e: (e["a"] == F.col("src")) & (e["b"] == F.col("dst")),
        )
        walk = nxt.filter(~used).select(
            F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("_end")
        )
        found.append(walk)
    return reduce(lambda a, b: a.unionByName(b), found).select(
        "path", (F.size("path") - 1).alias("hops"), F.col("_end").alias("end_id")
    )


def influence(edges: DataFrame, works: DataFrame, max_hops: int = 5) -> DataFrame:
    """GRA-12: works that reach the given works in 1..max_hops citations: (id, hops).

    The frontier is deduplicated and new ids only, so the cost follows the
    number of reached works, not of paths. A given work counts as well when it
    reaches another given one.
    """
    links = edges.select("src", "dst").distinct()
    frontier = works.select("id")
    reached: DataFrame | None = None
    for hop in range(1, max_hops + 1):
        step = (
            links.join(frontier, links["dst"] == frontier["id"], "left_semi")
            .select(F.col("src").alias("id")).distinct()
        )
        if reached is not None:
            step = step.join(reached, "id", "left_anti")
        step = cut(step.withColumn("hops", F.lit(hop)), "influence")
        frontier = step.select("id")
        reached = step if reached is None else reached.unionByName(step)
    return reached


def sample_neighbourhood(
    vertices: DataFrame, edges: DataFrame, seeds: int, per_kind: dict[str, int], salt: int = 0
) -> DataFrame:
    """GRA-13 / WIN-13: repeatable random seeds, then k random edges per seed and kind."""
    chosen = vertices.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(seeds).select(F.col("id").alias("seed"))
    ends = edges.select(F.col("src").alias("seed"), F.col("dst").alias("other"), "type").unionByName(
        edges.select(F.col("dst").alias("seed"), F.col("src").alias("other"), "type")
    )
    rows = ends.filter(F.col("type").isin(list(per_kind))).join(chosen, "seed", "left_semi")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in per_kind.items() for x in kv]), F.col("type"))
    picked = top_n(
        rows, ["seed", "type"], [F.xxhash64("seed", "other", F.lit(salt)), F.col("other")],
        max(per_kind.values()), "_rn",
    )
    return picked.filter(F.col("_rn") <= limit).select("seed", "other", "type")


PAIR_BLOCK = 1_024  # members of a group that one list holds, about


def pair_counts(
    links: DataFrame, group: str, member: str, a: str = "a", b: str = "b", block: int = PAIR_BLOCK
) -> DataFrame:
    """GRA-14 / DSN-05: groups in which two members meet, a < b. Null members and repeated links count nothing.

    Small groups with the same member set are counted first, and pairs are built
    once per distinct set, so repeated groups add no pairs. A group of more than
    ``block`` links is cut into blocks by a hash of the member; each pair of blocks
    is a row of its own, so no list grows with the group.
    """
    links = links.select(F.col(group).alias("_g"), F.col(member).alias("_m")).filter("_m is not null")
    large = links.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")).filter("_blocks > 1")
    large = cut(large, "large-groups")
    some = not large.isEmpty()
    small = links.join(large, links["_g"].eqNullSafe(large["_g"]), "left_anti") if some else links
    sets = (
        small.groupBy("_g").agg(F.array_sort(F.collect_set("_m")).alias("_set"))
        .filter(F.size("_set") > 1).groupBy("_set").agg(F.count(F.lit(1)).alias("_n"))
    )
    left = sets.select("_set", "_n", F.posexplode("_set").alias("_i", a))
    right = F.slice("_set", F.col("_i") + 2, F.size("_set"))
    pairs = left.select(a, "_n", F.explode(right).alias(b))
    if some:
        dealt = links.join(large.withColumnRenamed("_g", "_l"), links["_g"].eqNullSafe(F.col("_l")))
        own = F.pmod(F.xxhash64("_m"), F.col("_blocks")).cast("int").alias("_i")
        lists = cut(dealt.groupBy("_g", own).agg(F.collect_set("_m").alias("_set")), "member-blocks")
        other = lists.select(F.col("_g").alias("_o"), F.col("_i").alias("_j"), F.col("_set").alias("_with"))
        met = lists.join(other, lists["_g"].eqNullSafe(other["_o"]) & (F.col("_i") <= F.col("_j")))
        met = met.select("_i", "_j", "_with", F.explode("_set").alias("_x"))
        met = met.select("_x", F.explode(F.filter("_with", lambda y: (F.col("_i") < F.col("_j")) | (y > F.col("_x")))).alias("_y"))
        crossed = met.select(F.least("_x", "_y").alias(a), F.lit(1).cast("long").alias("_n"), F.greatest("_x", "_y").alias(b))
        pairs = pairs.unionByName(crossed)
    return pairs.groupBy(a, b).agg(F.sum("_n").alias("n_groups"))


def hits(vertices: DataFrame, edges: DataFrame, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """DSN-04: (id, hub, authority), L2-normalised.

    Rounds go on until the hubs turn by less than ``tolerance``, which takes the longer
    the closer the two largest singular values are; ``rounds`` ends them earlier.

    One exchange per half round. The angle between two rounds needs no join: the
    inner product of the hubs before and after is the squared norm of the authorities
    between them, so three sums that the rounds collect anyway tell it.
    """
    by_src, by_dst = EdgeLayout(edges, "src", "dst"), EdgeLayout(edges, "dst", "src")
    hub = vertices.select("id", F.lit(1.0).alias("x"))
    squares = F.sum(F.col("x") * F.col("x")).alias("s")
    value = F.sum(F.col("x") * F.col("times")).alias("x")
    norm = vertices.count() ** 0.5
    for step in range(1, MAX_ROUNDS + 1):
        seen_a, seen_h = Observation(), Observation()
        hub = hub.select("id", (F.col("x") / F.lit(norm or 1.0)).alias("x"))
        auth = cut(by_src.meet(hub).groupBy(F.col("dst").alias("id")).agg(value).observe(seen_a, squares), "hits-auth")
        hub = cut(by_dst.meet(auth).groupBy(F.col("src").alias("id")).agg(value).observe(seen_h, squares), "hits-hub")
        met, norm = seen_a.get["s"] or 0.0, (seen_h.get["s"] or 0.0) ** 0.5
        if not norm or step == rounds or 2 * (1 - met / norm) <= tolerance**2:
            break
    else:
        raise RuntimeError(f"hubs still turn after {MAX_ROUNDS} rounds")
    by_src.close()
    by_dst.close()
    a = auth.select("id", (F.col("x") / F.lit(met**0.5 or 1.0)).alias("a"))
    h = hub.select("id", (F.col("x") / F.lit(norm or 1.0)).alias("h"))
    return vertices.select("id").join(h, "id", "left").join(a, "id", "left").select(
        "id", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("authority")
    )
