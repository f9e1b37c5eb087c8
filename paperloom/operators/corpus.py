"""Corpus building and expansion over the citation graph (CRP-*, BFS-*).

Reference lists come as rows (work_id, pos, ref_id). Layer state is written as
tables, one folder per depth, so a run can resume and no plan grows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import stable_hash
from paperloom.operators.sets import first_non_empty
from paperloom.operators.skew import head_numbered, numbered, top_n
from paperloom.session import cut, new_table_path, path_exists

# --- fixed values: expansion limits and frontier weights ------------------------------
MAX_REFERENCES, MAX_CITERS = 50, 25
LINEAGE_DEPTH, LINEAGE_SIZE = 2, 2000
TITLE_BONUS, TOPIC_BONUS = 100.0, 50.0


# --- search ------------------------------------------------------------------------


def term_score(text: Column, question: str) -> Column:
    """CRP-01: how many distinct query terms occur in the text."""
    terms = sorted(set(question.lower().split()))
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in terms], F.lit(0))


def search_works(works: DataFrame, question: str, k: int) -> DataFrame:
    """CRP-01: best matching works; zero scores fill up the list."""
    score = term_score(F.concat_ws(" ", "title", "abstract"), question)
    return works.withColumn("score", score).orderBy(
        F.desc("score"), F.desc("cited_by_count"), F.asc("work_id")
    ).limit(k)


def field_corpus(works: DataFrame, question: str, alternates: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """CRP-02: (corpus row, membership) of the first query that finds works."""
    queries = [question, *[q for q in alternates if q and q != question]]
    hits = first_non_empty([search_works(works, q, k).select("work_id", "score") for q in queries])
    used = F.get(F.array(*[F.lit(q) for q in queries]), F.col("variant"))
    hits = cut(hits, "corpus")
    digest = F.substring(F.sha2(F.lit(f'"{question}|{k}"'), 256), 1, 32)
    corpus_id = F.concat(F.lit("field_"), F.substring(digest, 1, 12))
    row = hits.groupBy(used.alias("query")).agg(F.count(F.lit(1)).alias("n_works")).select(
        corpus_id.alias("corpus_id"), digest.alias("query_hash"), "query", "n_works"
    )
    members = hits.select(corpus_id.alias("corpus_id"), "work_id", F.lit("field_query").alias("membership_source"))
    return row, members


def get_work(works: DataFrame, work: object) -> DataFrame:
    """CRP-05 / BFS-04: one work by key; the filter reaches the scan."""
    return works.filter(F.col("work_id") == F.lit(work))


def expand_references(refs: DataFrame, works: DataFrame, seeds: DataFrame, n: int = MAX_REFERENCES) -> DataFrame:
    """CRP-03: of the first n references of each seed, those that are held."""
    first = refs.filter(F.col("pos") < n).join(seeds.select("work_id").distinct(), "work_id", "left_semi")
    return first.join(works.select(F.col("work_id").alias("ref_id")), "ref_id", "left_semi").select("work_id", "pos", "ref_id")


def citing_works(refs: DataFrame, seeds: DataFrame, n: int = MAX_CITERS) -> DataFrame:
    """CRP-04: up to n citing works of each seed, smallest ids first; n <= 0 keeps all."""
    cited = refs.select(F.col("ref_id").alias("seed"), F.col("work_id").alias("citing_id")).join(
        seeds.select(F.col("work_id").alias("seed")).distinct(), "seed", "left_semi"
    ).distinct()
    if n <= 0:
        return numbered(cited, ["citing_id"], ["seed"], "position", "citers")
    return top_n(cited, ["seed"], ["citing_id"], n, "position")


def frontier_score(cited: Column, title: Column, topics: Column, question: str) -> Column:
    """BFS-03: citations, a title match, and the weight of matching topics."""
    terms = sorted({t.lower() for t in question.replace("-", " ").split() if t.strip()})

    def hit(c: Column) -> Column:
        low = F.lower(F.coalesce(c, F.lit("")))
        return reduce(lambda a, b: a | b, [low.contains(t) for t in terms], F.lit(False))

    def weight(t: Column) -> Column:
        score = F.coalesce(F.nullif(t["score"], F.lit(0.0)), F.lit(1.0))
        return F.when(hit(t["display_name"]), TOPIC_BONUS * score).otherwise(0.0)

    return (
        F.coalesce(cited, F.lit(0)).cast("double")
        + F.when(hit(title), TITLE_BONUS).otherwise(0.0)
        + F.aggregate(F.coalesce(F.transform(topics, weight), F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + x)
    )


# --- seed lineage --------------------------------------------------------------------


def seed_lineage(
    refs: DataFrame, works: DataFrame, seed: object, depth: int = LINEAGE_DEPTH,
    size: int | None = None, max_references: int | None = None, max_citers: int | None = None,
) -> DataFrame:
    """CRP-06: (work_id, depth, source, path) in queue order of a breadth-first walk.

    ``path`` is the queue position as an array: per level the kind (reference or
    citer) and the place in its list. Arrays compare element by element, which is
    exactly queue order, so no counter runs over the queue. The walk is whole
    unless a fan-out or the size is limited.
    """
    held = works.select("work_id")
    layer = held.filter(F.col("work_id") == F.lit(seed)).select(
        "work_id", F.lit(0).alias("depth"), F.lit("seed").alias("source"), F.array().cast("array<bigint>").alias("path")
    )
    seen = cut(layer, "lineage")
    layer = seen
    for d in range(1, depth + 1):
        listed = refs if max_references is None else refs.filter(F.col("pos") < max_references)
        down = listed.join(layer.select("work_id", "path"), "work_id").select(
            F.col("ref_id").alias("work_id"), F.lit(0).alias("kind"), F.col("pos").cast("long").alias("p"), "path"
        )
        up = citing_works(refs, layer, max_citers or 0).join(layer.select(F.col("work_id").alias("seed"), "path"), "seed").select(
            F.col("citing_id").alias("work_id"), F.lit(1).alias("kind"), F.col("position").cast("long").alias("p"), "path"
        )
        found = (
            down.unionByName(up)
            .withColumn("path", F.concat("path", F.array(F.col("kind").cast("long"), "p")))
            .groupBy("work_id").agg(F.min(F.struct("path", "kind")).alias("f"))
            .join(seen.select("work_id"), "work_id", "left_anti").join(held, "work_id", "left_semi")
        )
        label = F.when(F.col("f.kind") == 0, f"reference_depth_{d}").otherwise(f"citing_depth_{d}")
        layer = cut(
            found.select("work_id", F.lit(d).alias("depth"), label.alias("source"), F.col("f.path").alias("path")), "lineage"
        )
        seen = seen.unionByName(layer)
    return seen if size is None else seen.orderBy("depth", "path").limit(size)


# --- layered expansion -------------------------------------------------------------------


class LayerStore:
    """Tables of one expansion run: <root>/<name>/depth=<d>."""

    def __init__(self, spark: SparkSession, root: str | None) -> None:
        self.spark = spark
        self.root = root or new_table_path(spark, "layers")

    def path(self, name: str, depth: int) -> str:
        return f"{self.root}/{name}/depth={depth}"

    def has(self, name: str, depth: int) -> bool:
        return path_exists(self.spark, self.path(name, depth) + "/_SUCCESS")

    def put(self, df: DataFrame, name: str, depth: int) -> tuple[DataFrame, int]:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(self.path(name, depth))
        return self.spark.read.schema(df.schema).parquet(self.path(name, depth)), int(seen.get["n"])

    def get(self, name: str, depth: int) -> DataFrame:
        return self.spark.read.parquet(self.path(name, depth))

    def all(self, name: str) -> DataFrame:
        """Every depth of one table; depth comes back as a column."""
        return self.spark.read.parquet(f"{self.root}/{name}")


def layered_bfs(
    refs: DataFrame,
    works: DataFrame,
    seeds: DataFrame,
    max_depth: int = 1,
    reference_fanout: int = 50,
    citing_fanout: int = 50,
    target: int = 5000,
    batch: int = 50,
    max_frontier: int = 1000,
    state_dir: str | None = None,
) -> LayerStore:
    """BFS-01/02/05: layers, edges and frontiers of a bounded expansion.

    works(work_id, score) gives held works with their frontier score (BFS-03);
    seeds(work_id) start in key order. Limits of 0 or less mean none. A work
    once a candidate is never a candidate again, even if pruned. With a
    ``state_dir`` that holds finished depths, the run goes on from there.

    Tables: layer (work_id, nth, held), known (work_id, nth), frontier where one
    was pruned (work_id, nth), edges (src, dst, type, ...).
    """
    store = LayerStore(refs.sparkSession, state_dir)

    def start_of(depth: int) -> DataFrame | None:
        """The frontier of a depth, or None if the depth before is not finished."""
        if not store.has("known", depth):
            return None
        if store.has("frontier", depth):
            return store.get("frontier", depth)
        found = store.get("known", depth)
        return found if depth == 0 or max_frontier <= 0 or found.count() <= max_frontier else None

    depth = 0
    frontier = start_of(0)
    if frontier is None:
        ordered = numbered(seeds.select("work_id").distinct(), ["work_id"], name="nth", label="seeds")
        frontier, _ = store.put(ordered, "known", 0)
    else:
        while (nxt := start_of(depth + 1)) is not None:
            frontier, depth = nxt, depth + 1
    processed = sum(store.get("layer", d).filter("held").count() for d in range(depth))
    ids = works.select("work_id", F.lit(True).alias("_held"))
    while depth <= max_depth:
        if target > 0:
            frontier = frontier.filter(F.col("nth") <= target - processed)
        seen = Observation()
        rows = frontier.join(ids, "work_id", "left").select("work_id", "nth", F.coalesce("_held", F.lit(False)).alias("held"))
        rows, _ = store.put(rows.observe(seen, F.count_if("held").alias("held")), "layer", depth)
        layer, n = rows.filter("held").select("work_id", "nth"), int(seen.get["held"])
        processed += n
        if n == 0 or depth >= max_depth or (target > 0 and processed >= target):
            break
        down = refs.join(layer, "work_id")
        if reference_fanout > 0:
            down = down.filter(F.col("pos") < reference_fanout)
        up = citing_works(refs, layer, citing_fanout).join(
            layer.select(F.col("work_id").alias("seed"), "nth"), "seed"
        )

        def step(df: DataFrame, src: str, dst: str, kind: str, nxt: str, rank: int, pos: str) -> DataFrame:
            group = F.floor((F.col("nth") - 1) / batch)
            place = F.struct(group.alias("b"), F.lit(rank).alias("k"), "nth", F.col(pos).cast("long").alias("p"))
            return df.select(
                F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"),
                F.col(nxt).alias("_next"), place.alias("_at"),
            )

        steps = step(down, "work_id", "ref_id", "references", "ref_id", 0, "pos").unionByName(
            step(up, "citing_id", "seed", "cites", "citing_id", 1, "position")
        )
        steps, _ = store.put(steps, "edges", depth)
        known = reduce(lambda a, b: a.unionByName(b), [store.get("known", d).select("work_id") for d in range(depth + 1)])
        fresh = (
            steps.groupBy(F.col("_next").alias("work_id")).agg(F.min("_at").alias("_at"))
            .join(known, "work_id", "left_anti")
        )
        if target > 0:
            found = head_numbered(fresh, ["_at"], target - processed, "nth")
        else:
            found = numbered(fresh, ["_at"], name="nth", label="candidates")
        found = found.select("work_id", "nth")
        frontier, n_found = store.put(found, "known", depth + 1)
        if 0 < max_frontier < n_found:
            ranked = frontier.join(works.select("work_id", "score"), "work_id", "left").select(
                "work_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("nth").alias("_was")
            )
            order = [F.desc("score"), F.asc("_was")]
            nxt = head_numbered(ranked, order, max_frontier, "nth").select("work_id", "nth")
            frontier, _ = store.put(nxt, "frontier", depth + 1)
        depth += 1
    return store


def crawl_statistics(store: LayerStore) -> DataFrame:
    """BFS-07: per depth the works, missing works and edges by type."""
    layers = out = store.all("layer").groupBy("depth").agg(
        F.count_if("held").alias("works"), F.count_if(~F.col("held")).alias("missing")
    )
    if path_exists(store.spark, f"{store.root}/edges"):
        edges = store.all("edges").groupBy("depth").agg(
            F.count_if(F.col("type") == "references").alias("reference_edges"), F.count_if(F.col("type") == "cites").alias("citing_edges")
        )
    else:
        edges = layers.select("depth", F.lit(0).cast("long").alias("reference_edges"), F.lit(0).cast("long").alias("citing_edges")).limit(0)
    zero = F.lit(0).cast("long")
    return out.join(edges, "depth", "left").select(
        "depth", "works", *[F.coalesce(c, zero).alias(c) for c in ("missing", "reference_edges", "citing_edges")]
    )


def citation_fill(
    citations: DataFrame, universe: DataFrame, held: DataFrame, depth: int = 1, max_per_work: int = 50
) -> DataFrame:
    """BFS-06: (work_id, level): works added by filling missing citations, level 0 = held.

    Per level at most ``max_per_work`` times the held works are fetched, smallest
    ids first.
    """
    ids = universe.select("work_id")
    have = cut(held.select("work_id").distinct().withColumn("level", F.lit(0)), "fill")
    n_have = have.count()
    for level in range(1, depth + 1):
        cites = citations.join(have.select(F.col("work_id").alias("citing_work_id")), "citing_work_id", "left_semi")
        missing = cites.select(F.col("cited_work_id").alias("work_id")).distinct().join(have.select("work_id"), "work_id", "left_anti")
        limited = numbered(missing, ["work_id"], name="_n", label="missing").filter(F.col("_n") <= max_per_work * n_have)
        new = cut(limited.select("work_id").join(ids, "work_id", "left_semi").withColumn("level", F.lit(level)), "fill")
        added = new.count()
        if added == 0:
            break
        have = have.unionByName(new)
        n_have += added
    return have


def fill_statistics(citations: DataFrame, filled: DataFrame) -> DataFrame:
    """BFS-06: total and resolved citations, counted at the end, and works added."""
    ids = filled.select("work_id")
    cites = citations.join(ids.toDF("citing_work_id"), "citing_work_id", "left_semi")
    known = ids.select(F.col("work_id").alias("cited_work_id"), F.lit(1).alias("_k"))
    totals = cites.join(known, "cited_work_id", "left").agg(
        F.count(F.lit(1)).alias("total_citations"), F.count("_k").alias("resolved_citations")
    )
    added = filled.agg(F.count_if(F.col("level") > 0).alias("n")).scalar()
    return totals.withColumn("works_from_citations", added)


def lineage_id(seed: str, depth: int) -> Column:
    return F.concat(F.lit("lineage_"), stable_hash({"seed": f'"{seed}"', "depth": str(depth)}, 12))
