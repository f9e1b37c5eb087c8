"""Denormalised search documents and ranked search (IDX-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paperloom.functions.text import tokens
from paperloom.operators.aggregates import author_counts, institution_counts, research_areas, venue_counts
from paperloom.operators.skew import sort_columns, top_n
from paperloom.session import cut

# --- fixed values: BM25; boosts ------------
BM25_K1, BM25_B = 1.2, 0.75
BOOSTS = {"title": 3.0, "abstract": 1.0, "concepts": 2.0}


def nested(child: DataFrame, parent: str, order: Sequence[str | Column], n: int | None, fields: list[str], name: str) -> DataFrame:
    """(parent, array of structs): the children in order, the first n where n is given.

    A cap works before the exchange, so no parent gathers more than n rows.
    Without one a parent's list is as long as its record.
    """
    if n is None:
        keys = [F.row_number().over(Window.partitionBy(parent).orderBy(*sort_columns(order))).alias("_rn")]
        rows = child.select("*", *keys)
    else:
        rows = top_n(child, [parent], sort_columns(order), n, "_rn")
    return rows.groupBy(parent).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rn", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])
        ).alias(name)
    )


def work_documents(
    works: DataFrame, authors: DataFrame, concepts: DataFrame, institutions: DataFrame, venues: DataFrame,
    max_authors: int | None = None, max_concepts: int | None = None, max_institutions: int | None = None, max_venues: int | None = None,
) -> DataFrame:
    """IDX-01: scalars, nested lists (empty, never null), and the full text.

    The child frames carry work_id and their display fields. Lists are whole
    unless a cap is given.
    """
    parts = {
        "authors": nested(authors, "work_id", ["author_order", "author_id"], max_authors, ["author_id", "name"], "authors"),
        "concepts": nested(concepts, "work_id", [F.desc("score"), F.asc("concept")], max_concepts, ["concept", "score"], "concepts"),
        "institutions": nested(institutions, "work_id", ["name", "institution_id"], max_institutions, ["institution_id", "name"], "institutions"),
        "venues": nested(venues, "work_id", [F.desc("is_primary"), F.asc("name")], max_venues, ["name", "is_primary"], "venues"),
    }
    out = works
    for name, part in parts.items():
        kind = part.schema[name].dataType
        out = out.join(part, "work_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out.withColumn("full_text", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.nullif("abstract", F.lit("")))).withColumn(
        "is_deleted", F.lit(False)
    )


def author_documents(
    authors: DataFrame, work_authors: DataFrame, citations: DataFrame, work_concepts: DataFrame, affiliations: DataFrame
) -> DataFrame:
    """IDX-02: counts, current institution, research areas."""
    counts = author_counts(work_authors, citations)
    areas = nested(
        research_areas(work_authors, work_concepts).drop("rank"), "author_id",
        [F.desc("total_score"), F.asc("concept")], 10, ["concept"], "_areas",
    ).select("author_id", F.col("_areas.concept").alias("research_areas"))
    current = affiliations.filter("is_current").groupBy("author_id").agg(F.min("institution_id").alias("current_institution"))
    return (
        authors.join(counts, "author_id", "left").join(current, "author_id", "left").join(areas, "author_id", "left")
        .withColumn("works_count", F.coalesce("works_count", F.lit(0)))
        .withColumn("cited_by_count", F.coalesce("cited_by_count", F.lit(0)))
        .withColumn("research_areas", F.coalesce("research_areas", F.array().cast("array<string>")))
    )


def venue_documents(venues: DataFrame, work_venues: DataFrame) -> DataFrame:
    """IDX-03"""
    return venue_counts(venues, work_venues).withColumn("is_deleted", F.lit(False))


def institution_documents(institutions: DataFrame, links: DataFrame, countries: DataFrame) -> DataFrame:
    """IDX-04"""
    return institution_counts(institutions, links).join(countries, "country_code", "left").withColumn("is_deleted", F.lit(False))


def sync_documents(
    docs: DataFrame, path: str, key: str, since: tuple[str, str] | None = None, members: DataFrame | None = None, batch: str = "0"
) -> dict:
    """IDX-05: full, incremental or by-corpus load, with success and failure counts.

    Each batch has a folder of its own; a repeated batch replaces itself, so a
    sync that is run again changes nothing. ``synced_documents`` reads the index.
    """
    if since:
        docs = docs.filter(F.col(since[0]) > F.lit(since[1]).cast(docs.schema[since[0]].dataType))
    if members is not None:
        docs = docs.join(members.select(key).distinct(), key, "left_semi")
    ok = F.col(key).isNotNull()
    seen = Observation()
    docs.observe(seen, F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed")).filter(ok).write.mode("overwrite").json(f"{path}/batch={batch}")
    return {k: int(v) for k, v in seen.get.items()}


def synced_documents(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """IDX-05: the documents of an index; of a key in several batches the last batch counts.

    Numbered batches go by their number; other names (time stamps, say) sort as text,
    before numbers.
    """
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", StringType())])).json(path)
    number = F.when(F.col("batch").rlike("^[0-9]{1,38}$"), F.col("batch").cast("decimal(38,0)"))
    order = F.struct(number.alias("number"), F.col("batch").alias("name"))
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in schema.fieldNames() if c != key]), order).alias("_d"))
    return last.select(*[F.col(c) if c == key else F.col(f"_d.{c}").alias(c) for c in schema.fieldNames()])


def analysed(c: Column, stop_words: list[str]) -> Column:
    """IDX-07: lower-case tokens without stop words; CJK by character."""
    if not stop_words:
        return tokens(c)
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(tokens(c), lambda t: ~F.array_contains(stop, t))


def occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25_search(
    docs: DataFrame, key: str, fields: dict[str, float], query: str, k: int, stop_words: list[str] | None = None
) -> DataFrame:
    """IDX-06: best boosted field by BM25.

    The query is known, so only its terms are counted: no inverted index is
    shuffled. One pass keeps (key, lengths, term counts), one aggregate gives the
    collection statistics, and scoring is a projection.
    """
    stop = stop_words or []
    spark = docs.sparkSession
    terms = [
        t for t in spark.range(1).select(F.array_distinct(analysed(F.lit(query), stop)).alias("t")).first()["t"]
    ]
    cols = [F.col(key)]
    for f in fields:
        words = F.col(f"_w_{f}")
        cols.append(F.size(words).alias(f"len_{f}"))
        cols += [occurrences(words, t).alias(f"tf_{f}_{i}") for i, t in enumerate(terms)]
    counted = cut(
        docs.select(key, *[analysed(F.col(f), stop).alias(f"_w_{f}") for f in fields]).select(*cols), "term-counts"
    )
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields],
        *[F.count_if(F.col(f"tf_{f}_{i}") > 0).alias(f"df_{f}_{i}") for f in fields for i in range(len(terms))],
    ).first()
    n = stats["n"]

    def field_score(f: str) -> Column:
        total = F.lit(0.0)
        for i in range(len(terms)):
            df = stats[f"df_{f}_{i}"]
            tf = F.col(f"tf_{f}_{i}").cast("double")
            norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col(f"len_{f}") / F.lit(float(stats[f"avg_{f}"] or 1.0)))
            idf = F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (F.lit(float(df)) + 0.5))
            total = total + idf * tf * (BM25_K1 + 1) / (tf + norm)
        return total * fields[f]

    scores = [field_score(f) for f in fields]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (
        counted.select(key, F.round(best, 6).alias("score")).filter("score > 0")
        .orderBy(F.desc("score"), F.asc(key)).limit(k)
    )
