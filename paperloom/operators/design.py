"""Operators the design notes describe (DSN-*); HITS and topic pairs are in graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: frontier weights, ingest prices -----------------------------------
FRONTIER_WEIGHTS = {"topic": 0.35, "title": 0.25, "citation": 0.20, "recency": 0.10, "source": 0.10}
PAGE_SIZE, FILTER_CREDITS, SEARCH_CREDITS, CREDITS_PER_USD = 100, 1, 10, 10_000


def frontier_scores(works: DataFrame, topic: Column, title: Column, cited: Column, year: Column, source: Column) -> DataFrame:
    """DSN-01: five parts, each scaled to 0..1 by the maximum of the layer.

    The maxima come from one aggregate used as scalars, not from a window over the
    whole layer.
    """
    raw = {"topic": topic, "title": title, "citation": F.log1p(cited), "recency": year, "source": source}
    rows = works.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{k}") for k, c in raw.items()])
    lo = rows.agg(F.min("_recency").alias("m")).scalar()
    rows = rows.withColumn("_first", lo).withColumn("_recency", F.col("_recency") - F.col("_first")).drop("_first")
    top = rows.agg(F.struct(*[F.max(f"_{k}").alias(k) for k in raw]).alias("m")).scalar()
    rows = rows.withColumn("_max", top)
    score = F.lit(0.0)
    for k, w in FRONTIER_WEIGHTS.items():
        score = score + w * F.coalesce(F.try_divide(F.col(f"_{k}"), F.col(f"_max.{k}")), F.lit(0.0))
    return rows.withColumn("frontier_score", F.round(score, 6)).select(*works.columns, "frontier_score")


def topic_triage(topics: DataFrame, question: str, must: float, keep: float) -> DataFrame:
    """DSN-02: topics(name, weight) to must_include, candidate or exclude.

    Frequent topics that share a word with the question must be in; rare topics
    without one are out.
    """
    words = F.array(*[F.lit(w) for w in sorted(set(question.lower().split()))])
    hit = F.size(F.array_intersect(F.split(F.lower("name"), r"\s+"), words)) > 0
    return topics.withColumn(
        "triage",
        F.when(hit & (F.col("weight") >= must), "must_include")
        .when(hit | (F.col("weight") >= keep), "candidate").otherwise("exclude"),
    )


def corpus_quality(works: DataFrame, citations: DataFrame, selected: Column) -> DataFrame:
    """DSN-03: one row: topic purity, citation density, year coverage.

    works(id, publication_year, ...) and citations(src, dst) inside the corpus.
    """
    edges = citations.agg(F.count(F.lit(1)).alias("e")).scalar()
    base = works.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(selected).alias("hit"), F.countDistinct("publication_year").alias("years"),
        (F.max("publication_year") - F.min("publication_year") + 1).alias("span"),
    )
    return base.select(
        F.round(F.col("hit") / F.col("n"), 6).alias("topic_purity"), F.round(edges / F.col("n"), 6).alias("citation_density"),
        F.round(F.col("years") / F.col("span"), 6).alias("year_coverage"),
    )


def topic_drift(links: DataFrame) -> DataFrame:
    """DSN-06: share of each topic per year and its change on the year before.

    links(year, topic). The window runs over (topic, year) counts: one row per
    year and topic, whatever the number of works.
    """
    n = links.groupBy("year", "topic").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("year").agg(F.sum("n").alias("_all"))
    share = n.join(total, "year").withColumn("share", F.col("n") / F.col("_all"))
    before = F.lag(F.struct("year", "share")).over(Window.partitionBy("topic").orderBy("year"))
    rows = share.withColumn("_p", before)
    change = F.when(F.col("_p.year") == F.col("year") - 1, F.col("share") - F.col("_p.share"))
    return rows.select("year", "topic", "n", F.round("share", 9).alias("share"), F.round(change, 9).alias("change"))


def ingest_budget(plan: DataFrame, works: str = "n_works", mode: str = "mode") -> DataFrame:
    """DSN-07: pages, credits and dollars of a fetch plan."""
    pages = F.ceil(F.col(works) / PAGE_SIZE)
    price = F.when(F.col(mode) == "search", SEARCH_CREDITS).otherwise(FILTER_CREDITS)
    return plan.select(
        "*", pages.alias("pages"), (pages * price).alias("credits"), (pages * price / CREDITS_PER_USD).alias("usd")
    )
