"""Set operations (SET-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.skew import first_per_key
from paperloom.session import cut


def merge_batches(batches: list[DataFrame], key: list[str]) -> DataFrame:
    """SET-01: union of entity batches; the earliest batch wins per key."""
    marked = [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)]
    rows = reduce(lambda a, b: a.unionByName(b), marked)
    rest = [c for c in batches[0].columns if c not in key]
    return first_per_key(rows, key, ["_batch", *rest], rest)


def ordered_union(parts: list[DataFrame], key: str, position: str) -> DataFrame:
    """SET-02: distinct keys in order of first appearance over the parts."""
    marked = [p.select(key, F.struct(F.lit(i).alias("part"), F.col(position).alias("at")).alias("_at")) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b), marked).groupBy(key).agg(F.min("_at").alias("_at"))
    return rows.select(key, F.col("_at.part").alias("part"), F.col("_at.at").alias("at"))


def minus(known: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    """SET-03"""
    return known.select(key).distinct().join(visited.select(key), key, "left_anti")


def overlap(a: Column, b: Column) -> Column:
    """SET-04: shared distinct terms over the distinct terms of ``a``."""
    left = F.array_distinct(a)
    return F.size(F.array_intersect(left, b)) / F.greatest(F.size(left), F.lit(1))


def first_non_empty(variants: list[DataFrame]) -> DataFrame:
    """SET-05: the rows of the first variant that has any."""
    rows = reduce(
        lambda a, b: a.unionByName(b), [v.withColumn("variant", F.lit(i)) for i, v in enumerate(variants)]
    )
    rows = cut(rows, "variants")
    return rows.filter(F.col("variant") == rows.agg(F.min("variant").alias("v")).scalar())
