"""Aggregations (AGG-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.clean import entity_id, normalize_id
from paperloom.operators.skew import top_n

# --- fixed values: download plan ------------------------------------------------
PLAN_FIRST_YEAR = 2012
PLAN_LAST_YEAR = 2026
PLAN_TYPE = "article"


def yearly_trend(works: DataFrame, year: str = "publication_year") -> DataFrame:
    """AGG-01"""
    return (
        works.filter(F.coalesce(F.col(year), F.lit(0)) != 0)
        .groupBy(F.col(year).alias("year")).agg(F.count(F.lit(1)).alias("n_works"))
    )


def topic_counts(links: DataFrame, topic: str = "topic", k: int = 20) -> DataFrame:
    """AGG-02: most frequent topics, ties by name."""
    return (
        links.groupBy(F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("n_works"))
        .orderBy(F.desc("n_works"), "topic").limit(k)
    )


def weighted_topics(raw: DataFrame) -> DataFrame:
    """AGG-03: (topic_id, name, weight); a missing score counts 1, the last name wins."""
    chosen = F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.col("concepts"))
    rows = raw.select("seq", F.posexplode(chosen).alias("pos", "t")).select(
        "seq", "pos", entity_id(F.col("t.id")).alias("topic_id"), F.col("t.display_name").alias("name"),
        F.coalesce("t.score", F.lit(1.0)).alias("score"),
    ).filter("topic_id IS NOT NULL")
    return rows.groupBy("topic_id").agg(
        F.coalesce(F.max_by("name", F.struct("seq", "pos")), F.first("topic_id")).alias("name"),
        F.sum("score").alias("weight"),
    )


def layer_statistics(raw: DataFrame) -> DataFrame:
    """AGG-04: (kind, value, n) for years, sources and topics, in one pass.

    All three histograms come from one exploded frame and one exchange.
    """
    chosen = F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.col("concepts"))

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    source = F.col("primary_location.source")
    named = F.transform(
        F.coalesce(chosen, F.array().cast(raw.schema["concepts"].dataType)),
        lambda t: entry("topic", entity_id(F.coalesce(t["id"], t["display_name"]))),
    )
    rows = F.concat(
        F.array(
            entry("year", F.nullif("publication_year", F.lit(0))),
            entry("source", entity_id(F.coalesce(source["id"], source["display_name"]))),
        ),
        named,
    )
    return (
        raw.select(F.inline(rows)).filter("value IS NOT NULL")
        .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def sample_summary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-05: per sample; a NULL label is its own group."""
    return cells.groupBy(*keys).agg(
        F.count("news_col").alias("non_empty_news_count"),
        F.countDistinct("text_hash").alias("unique_news_count"),
        F.sum("char_len").alias("total_chars"),
        F.avg("char_len").alias("mean_chars_per_news"),
        F.max("char_len").alias("max_chars_single_news"),
    )


def unique_texts(cells: DataFrame, preview: int = 120) -> DataFrame:
    """AGG-06: distinct texts with their number of occurrences."""
    return cells.groupBy("text_hash").agg(
        F.max("char_len").alias("char_len"),
        F.min(F.substring("raw_text", 1, preview)).alias("text_preview"),
        F.count(F.lit(1)).alias("occurrence_count"),
    )


def cited_by(works: DataFrame, citations: DataFrame) -> DataFrame:
    """AGG-09: works with the number of citations they receive."""
    n = citations.groupBy(F.col("cited_work_id").alias("work_id")).agg(F.count(F.lit(1)).alias("cited_by_count"))
    return works.drop("cited_by_count").join(n, "work_id", "left").withColumn(
        "cited_by_count", F.coalesce("cited_by_count", F.lit(0))
    )


def author_counts(work_authors: DataFrame, citations: DataFrame, reference_counts: bool = False) -> DataFrame:
    """AGG-07: works and citations per author.

    Citations are counted per work before they meet the author links. With
    ``reference_counts`` an author listed twice on a work counts its citations
    twice.
    """
    n = citations.groupBy(F.col("cited_work_id").alias("work_id")).agg(F.count(F.lit(1)).alias("_c"))
    links = work_authors.groupBy("author_id", "work_id").agg(F.count(F.lit(1)).alias("_times"))
    times = F.col("_times") if reference_counts else F.lit(1)
    return links.join(n, "work_id", "left").groupBy("author_id").agg(
        F.count(F.lit(1)).alias("works_count"),
        F.coalesce(F.sum(F.col("_c") * times), F.lit(0)).alias("cited_by_count"),
    )


def venue_counts(venues: DataFrame, work_venues: DataFrame) -> DataFrame:
    """AGG-08"""
    n = work_venues.groupBy("venue_id").agg(F.countDistinct("work_id").alias("works_count"))
    return venues.join(n, "venue_id", "left").withColumn("works_count", F.coalesce("works_count", F.lit(0)))


def institution_counts(institutions: DataFrame, links: DataFrame) -> DataFrame:
    """AGG-08: works and authors per institution.

    Two separate distinct counts, each pre-aggregated on (institution, value), so
    a hot institution is spread over its values first.
    """
    w = links.groupBy("institution_id").agg(F.countDistinct("work_id").alias("works_count"))
    a = links.groupBy("institution_id").agg(F.countDistinct("author_id").alias("authors_count"))
    out = institutions.join(w, "institution_id", "left").join(a, "institution_id", "left")
    return out.withColumn("works_count", F.coalesce("works_count", F.lit(0))).withColumn(
        "authors_count", F.coalesce("authors_count", F.lit(0))
    )


def research_areas(work_authors: DataFrame, work_concepts: DataFrame, k: int = 10) -> DataFrame:
    """AGG-10: per author the k concepts with the highest summed score."""
    links = work_authors.select("author_id", "work_id").distinct()
    sums = links.join(work_concepts, "work_id").groupBy("author_id", "concept").agg(F.sum("score").alias("total_score"))
    return top_n(sums, ["author_id"], [F.desc("total_score"), F.asc("concept")], k, "rank")


def pipeline_counters(docs: DataFrame) -> DataFrame:
    """AGG-13: kept and dropped documents by reason."""
    return docs.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("raw_len").alias("raw_chars"), F.sum("clean_len").alias("clean_chars"),
    )


def run_metrics(trace: DataFrame, run: str) -> DataFrame:
    """AGG-14: tool calls, failed calls and events of each run."""
    return trace.groupBy(run).agg(
        F.count_if(F.col("type") == "tool_call").alias("tool_calls"),
        F.count_if((F.col("type") == "tool_call") & (F.col("status") == "failed")).alias("failed_calls"),
        F.count(F.lit(1)).alias("events"),
    )


def download_plan(raw: DataFrame, k: int = 10, min_weight: float = 5.0) -> DataFrame:
    """AGG-15: one row: topic ids, year range, filter text, first seed ids.

    The top k topics are taken first, then those below the weight are dropped.
    """
    weights = weighted_topics(raw)
    top = (
        weights.orderBy(F.desc("weight"), "topic_id").limit(max(1, k)).filter(F.col("weight") >= min_weight)
    )
    topics = top.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "topic_id"))), lambda x: x["topic_id"]), "|",
        ).alias("topic_expr")
    )
    years = raw.agg(F.min("publication_year").alias("lo"), F.max("publication_year").alias("hi")).select(
        F.greatest(F.lit(PLAN_FIRST_YEAR), F.coalesce("lo", F.lit(PLAN_FIRST_YEAR))).alias("start_year"),
        F.coalesce("hi", F.lit(PLAN_LAST_YEAR)).alias("end_year"),
    )
    ids = raw.select(normalize_id(F.col("id")).alias("work_id"), "seq").filter("work_id <> ''")
    seeds = ids.groupBy("work_id").agg(F.min("seq").alias("seq")).orderBy("seq").limit(10).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "work_id"))), lambda x: x["work_id"]), "|").alias("seed_ids")
    )
    text = F.concat(
        F.when(F.col("topic_expr") != "", F.concat(F.lit("topics.id:"), "topic_expr", F.lit(","))).otherwise(""),
        F.lit("publication_year:"), "start_year", F.lit("-"), "end_year", F.lit(f",type:{PLAN_TYPE}"),
    )
    return years.select(
        "start_year", "end_year", topics.scalar().alias("topic_expr"), seeds.scalar().alias("seed_ids"),
    ).withColumn("recommended_filter", text)


def throughput(log: DataFrame) -> DataFrame:
    """AGG-16: records per second; 0 where no time has passed."""
    return log.withColumn(
        "records_per_second",
        F.when(F.col("elapsed") > 0, F.col("records") / F.col("elapsed")).otherwise(0.0),
    )
