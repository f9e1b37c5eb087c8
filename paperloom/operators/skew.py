"""Ranking and numbering that never bring a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut

PARTITION_BITS = 33  # monotonically_increasing_id = partition << 33 | row


def sort_columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def numbered(
    df: DataFrame,
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    name: str = "rn",
    label: str = "numbered",
) -> DataFrame:
    """Exact 1-based row number per group, for groups of any size.

    A window would send each group, or without a group the whole table, to one
    task. Here a range exchange sorts the table by group and order, each
    partition numbers its own rows, and one small table of
    (partition, group) counts supplies the offsets. ``order`` must be total.
    """
    group = list(group)
    keys = [F.col(c).asc() for c in group] + sort_columns(order)
    rows = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()),
        label,
    ).withColumn("_part", F.shiftright("_at", PARTITION_BITS))
    counts = rows.groupBy("_part", *group).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # At most one row per (partition, group): the window below is small.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    ).select("_part", *[F.col(c).alias(f"_g_{c}") for c in group], "_first", "_before")
    on = rows["_part"] == offsets["_part"]
    for c in group:
        on = on & rows[c].eqNullSafe(offsets[f"_g_{c}"])
    return (
        rows.join(offsets, on)
        .withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long"))
        .select(*df.columns, name)
    )


SMALL_HEAD = 10_000  # rows a sorted take may hold in one place


def head_numbered(df: DataFrame, order: Sequence[str | Column], n: int, name: str = "rn") -> DataFrame:
    """The first n rows of a total order, numbered from 1.

    A small head is a sorted take (n rows per task) with a window over those n
    rows; a large one is cut out of the distributed numbering.
    """
    if n > SMALL_HEAD:
        return numbered(df, order, name=name, label="head").filter(F.col(name) <= n)
    keys = sort_columns(order)
    return df.orderBy(*keys).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long"))


def top_n(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int, name: str = "rn"
) -> DataFrame:
    """The first ``n`` rows per group, with their rank.

    Spark turns ``row_number() <= n`` into a partial limit before the exchange
    (``WindowGroupLimit``), so a hot group sends n rows per map task, not all. It does
    so up to a threshold; a larger n is cut out of the distributed numbering, for
    which ``order`` must be total.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit >= 0:
        return numbered(df, order, group, name, "top").filter(F.col(name) <= n)
    w = Window.partitionBy(*group).orderBy(*sort_columns(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def first_per_key(
    df: DataFrame, key: Sequence[str], order: Sequence[str | Column], keep: Sequence[str] | None = None
) -> DataFrame:
    """One row per key, the first in ``order``.

    An order of plain columns is an aggregation: rows of one key combine before the
    exchange, and a reader of the keys alone gets a hash aggregation without a sort. Any
    other order is top_n with n = 1.
    """
    keep = list(keep) if keep is not None else [c for c in df.columns if c not in key]
    if not all(isinstance(c, str) for c in order):
        return top_n(df, key, order, 1, "_rank").select(*key, *keep)
    if not keep:
        return df.select(*key).distinct()
    least = F.min_by(F.struct(*keep), F.struct(*order)).alias("_first")
    return df.groupBy(*key).agg(least).select(*key, *[F.col(f"_first.`{c}`") for c in keep])


def lagged_pairs(
    df: DataFrame, group: Sequence[str], order: str, steps: int, src: str = "src", dst: str = "dst"
) -> DataFrame:
    """(row, k-th previous row of its group) for k = 1..steps.

    The join is on (group, position), so the rows of a hot group spread over
    all tasks; a ``lag`` window would keep them in one.
    """
    group = list(group)
    rows = numbered(df.select(*group, order), [F.col(order).asc()], group, "_rn", "lag")
    rows = cut(rows, "lag-positions")
    later = rows.withColumn(
        "_back", F.explode(F.sequence(F.lit(1), F.lit(steps)))
    ).select(
        *[F.col(c).alias(f"_l_{c}") for c in group],
        (F.col("_rn") - F.col("_back")).alias("_want"),
        F.col(order).alias(src),
    ).filter("_want >= 1")
    on = later["_want"] == rows["_rn"]
    for c in group:
        on = on & (later[f"_l_{c}"] == rows[c])
    return later.join(rows, on).select(src, F.col(order).alias(dst))
