"""Ranking, paging, capping and sampling (WIN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.skew import numbered, sort_columns, top_n

DRIVER_PAGE = 10_000  # rows a sorted take may hold at once


def candidate_papers(works: DataFrame, limit: int = 20) -> DataFrame:
    """WIN-01: most cited first, then newest; an unknown year counts as 0."""
    return works.orderBy(
        F.desc("cited_by_count"), F.desc(F.coalesce("publication_year", F.lit(0))), F.asc("work_id")
    ).limit(limit)


def capped_children(links: DataFrame, parent: str, order: list[str | Column], n: int) -> DataFrame:
    """WIN-04 / WIN-09: the first n children of every parent."""
    return top_n(links, [parent], order, n, "position")


def prune_frontier(frontier: DataFrame, score: str, position: str, k: int) -> DataFrame:
    """WIN-08: highest score first, input order on ties; k <= 0 keeps all."""
    return frontier if k <= 0 else frontier.orderBy(F.desc(score), F.asc(position)).limit(k)


def global_cap(rows: DataFrame, order: list[str | Column], cap: int) -> DataFrame:
    """WIN-10: the first ``cap`` rows in emission order, with their number.

    The number comes from a range exchange and per-partition offsets; a global
    window would pull the table into one task.
    """
    return numbered(rows, order, name="nth", label="cap").filter(F.col("nth") <= cap)


def page(rows: DataFrame, order: list[str | Column], offset: int, limit: int) -> DataFrame:
    """WIN-11: one page of a total order; a deep page is cut out by row number."""
    if offset + limit <= DRIVER_PAGE:
        return rows.orderBy(*sort_columns(order)).offset(offset).limit(limit)
    return numbered(rows, order, name="_nth", label="page").filter(
        (F.col("_nth") > offset) & (F.col("_nth") <= offset + limit)
    ).drop("_nth")


def call_log(calls: DataFrame, at: str, tie: str) -> DataFrame:
    """WIN-12: tool calls in time order; the sort is a range exchange."""
    return calls.orderBy(at, tie)
