"""Keyed upserts and incremental state on plain tables (UPS-*).

Parquet has no MERGE, so a new table state is one aggregation over old and new
rows. It combines on the map side: a key with many versions sends one row per
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.skew import numbered


def upsert(
    old: DataFrame, new: DataFrame, keys: list[str], update: list[str], version: str, created: str | None = None
) -> DataFrame:
    """UPS-01 / UPS-09: listed columns from the newest version, creation time kept.

    An incoming row older than the stored version is ignored, and the same batch
    applied twice changes nothing. On equal versions the incoming row wins.
    """
    cols = [*keys, *update, version, *([created] if created else [])]
    rows = old.select(*cols).withColumn("_in", F.lit(0)).unionByName(new.select(*cols).withColumn("_in", F.lit(1)))
    order = F.struct(version, "_in", *update)  # equal versions: the greatest row, in any run
    aggs = [F.max_by(F.struct(*update, version), order).alias("_v")]
    if created:
        aggs.append(F.min(created).alias(created))
    out = rows.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in [*update, version]], *([created] if created else []))


def assign_keys(known: DataFrame, incoming: DataFrame, natural: str, key: str) -> DataFrame:
    """UPS-02: dense surrogate keys; known ids keep theirs, new ones continue."""
    fresh = incoming.select(natural).distinct().join(known.select(natural), natural, "left_anti")
    top = known.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("m")).scalar()
    given = numbered(fresh, [natural], name="_n", label="keys").select(natural, (F.col("_n") + top).alias(key))
    return known.select(natural, F.col(key).cast("long").alias(key)).unionByName(given)


def seen_range(old: DataFrame, observed: DataFrame, keys: list[str], at: str) -> DataFrame:
    """UPS-03: first_seen and last_seen after new observations."""
    rows = old.select(*keys, "first_seen", "last_seen").unionByName(
        observed.select(*keys, F.col(at).alias("first_seen"), F.col(at).alias("last_seen"))
    )
    return rows.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def frontier_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """UPS-04: the smallest depth wins; a stored status stays."""
    rows = old.select(*keys, "depth", "status").unionByName(new.select(*keys, "depth", F.lit(None).cast("string").alias("status")))
    return rows.groupBy(*keys).agg(
        F.min("depth").alias("depth"), F.coalesce(F.max("status"), F.lit("pending")).alias("status")
    )


def frontier_transition(frontier: DataFrame, done: DataFrame, key: str, status: str) -> DataFrame:
    """UPS-05: set the status of the given works."""
    hit = done.select(key).distinct().withColumn("_hit", F.lit(True))
    return frontier.join(hit, key, "left").withColumn(
        "status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))
    ).drop("_hit")


def pending(frontier: DataFrame, key: str, limit: int) -> DataFrame:
    """UPS-05: pending works, shallow ones first."""
    return frontier.filter("status = 'pending'").orderBy("depth", key).limit(limit)


def doi_mapping(works: DataFrame, work: str, doi: str) -> DataFrame:
    """UPS-06: every work with the work that holds its DOI (the smallest id).

    Works without a DOI name themselves and are not exchanged.
    """
    held = works.filter(F.col(doi).isNotNull())
    holder = held.groupBy(doi).agg(F.min(work).alias("canonical_id"))
    alone = works.filter(F.col(doi).isNull()).select(work, F.col(work).alias("canonical_id"))
    return held.select(work, doi).join(holder, doi).select(work, "canonical_id").unionByName(alone)


def soft_delete(rows: DataFrame, gone: DataFrame, keys: list[str], at: str) -> DataFrame:
    """UPS-07: mark rows as deleted at the time of the delete event."""
    marks = gone.groupBy(*keys).agg(F.max(at).alias("deleted_at"))
    return rows.join(marks, keys, "left").withColumn("is_deleted", F.col("deleted_at").isNotNull())


def live(rows: DataFrame) -> DataFrame:
    return rows.filter("NOT is_deleted")


def reusable_corpus(corpora: DataFrame, membership: DataFrame, query_hash: str, limit: int) -> DataFrame:
    """UPS-08: a stored corpus of the same query with at least 80 % of the limit."""
    sizes = membership.groupBy("corpus_id").agg(F.countDistinct("work_id").alias("n_works"))
    return corpora.filter(F.col("query_hash") == query_hash).join(sizes, "corpus_id").filter(
        F.col("n_works") >= 0.8 * limit
    )


def changed_content(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """UPS-10: rows whose (key, content_hash) is not stored yet."""
    return rows.join(stored.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")
