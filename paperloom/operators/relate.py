"""Joins between entity, link and corpus tables (JN-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.skew import top_n


def resolve_links(link: DataFrame, parents: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """JN-01: links whose parents all exist, and per missing parent the skipped rows.

    ``parents`` maps a link column to a one-column frame of known ids.
    """
    rows = link
    for column, ids in parents.items():
        known = ids.toDF(column).distinct().withColumn(f"_has_{column}", F.lit(True))
        rows = rows.join(known, column, "left")
    missing = F.concat_ws("+", *[F.when(F.col(f"_has_{c}").isNull(), F.lit(c)) for c in parents])
    rows = rows.withColumn("_missing", missing).drop(*[f"_has_{c}" for c in parents])
    resolved = rows.filter("_missing = ''").select(*link.columns)
    skipped = rows.filter("_missing <> ''").groupBy(F.col("_missing").alias("missing")).agg(
        F.count(F.lit(1)).alias("skipped")
    )
    return resolved, skipped


def citations_with_target(citations: DataFrame, works: DataFrame) -> DataFrame:
    """JN-02: every citation; the target key is NULL if the work is not held."""
    held = works.select(F.col("work_id").alias("cited_work_id"), F.col("work_id").alias("cited_key"))
    return citations.join(held, "cited_work_id", "left").select("citing_work_id", "cited_work_id", "cited_key")


def internal_citations(citations: DataFrame, works: DataFrame) -> DataFrame:
    """JN-03 / JN-10: citations with both ends held."""
    ids = works.select("work_id")
    return citations.join(ids.toDF("citing_work_id"), "citing_work_id", "left_semi").join(
        ids.toDF("cited_work_id"), "cited_work_id", "left_semi"
    ).select("citing_work_id", "cited_work_id")


def external_refs(citations: DataFrame, works: DataFrame) -> DataFrame:
    """JN-04: works cited but not held; first seen from the smallest citing id."""
    ids = works.select(F.col("work_id").alias("cited_work_id"))
    return (
        citations.join(ids, "cited_work_id", "left_anti")
        .groupBy(F.col("cited_work_id").alias("external_work_id"))
        .agg(F.min("citing_work_id").alias("first_seen_from"), F.count(F.lit(1)).alias("n_citing"))
    )


def in_corpus(works: DataFrame, members: DataFrame, key: str = "work_id") -> DataFrame:
    """JN-05: rows whose work belongs to the corpus."""
    return works.join(members.select(F.col("work_id").alias(key)).distinct(), key, "left_semi")


def corpus_citations(citations: DataFrame, members: DataFrame) -> DataFrame:
    """JN-06: citations made by corpus works, wherever they point."""
    return in_corpus(citations, members, "citing_work_id")


def lookup(facts: DataFrame, dimension: DataFrame, key: str, how: str = "left") -> DataFrame:
    """JN-07: attributes of one entity. Spark broadcasts the dimension if its
    measured size allows, and otherwise shuffles with skew handling."""
    return facts.join(dimension, key, how)


def affiliation_in_work(work_authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """JN-08: (author, institution, work, order)."""
    pairs = affiliations.select("work_id", "author_id", "institution_id").distinct()
    return work_authors.select("work_id", "author_id", "author_order").join(pairs, ["work_id", "author_id"])


def not_held(citations: DataFrame, works: DataFrame) -> DataFrame:
    """JN-12: distinct cited works still to be fetched."""
    ids = works.select(F.col("work_id").alias("cited_work_id"))
    return citations.select("cited_work_id").distinct().join(ids, "cited_work_id", "left_anti")


def papers_with_evidence(key_papers: DataFrame, evidence: DataFrame, works: DataFrame) -> DataFrame:
    """JN-11: key papers with their best evidence record and their work row."""
    best = top_n(evidence, ["work_id"], [F.desc("retrieval_score"), F.asc("child_id")], 1, "_rn").drop("_rn")
    return key_papers.join(
        best.select("work_id", "child_id", "child_text", "retrieval_score"), "work_id", "left"
    ).join(works.select("work_id", F.col("abstract").alias("work_abstract")), "work_id", "left")


def join_samples(index: DataFrame, samples: DataFrame, id_column: str) -> DataFrame:
    """JN-13: an index frame with its sample rows, by a column named at run time."""
    return index.join(samples, id_column, "left")
