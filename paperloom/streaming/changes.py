"""Change events and live aggregates (STR-*).

Changes go to a log with the file sink, or batch by batch into a state table in hash
buckets, of which a batch rewrites only those it touches. States are combined by
maxima over event times, so late and repeated events change nothing. Results of
streaming aggregates are written in update mode, by batch number: a repeated batch
overwrites its own rows, and no result passes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from paperloom.schemas import CHANGE, MAXWELL
from paperloom.session import cut, path_exists

# --- fixed values: budgets of one run ---------------------------------------------------
MAX_TOOL_CALLS, MAX_RETRIES, MAX_ITERATIONS = 80, 2, 15

OPERATIONS = ["INSERT", "UPDATE", "DELETE"]


def parse_changes(lines: DataFrame, column: str = "value", form: str = "native") -> DataFrame:
    """STR-01: JSON text to (operation, table, data, old_data, ts, ok).

    Forms: native, maxwell, debezium. ``ok`` is false for a broken record or an
    unknown operation.
    """
    if form == "native":
        e = lines.select(F.from_json(column, CHANGE).alias("e"))
        parts = (F.upper("e.operation"), F.col("e.table"), F.col("e.data"), F.col("e.old_data"), F.col("e.timestamp"))
    elif form == "maxwell":
        e = lines.select(F.from_json(column, MAXWELL).alias("e"))
        parts = (F.upper("e.type"), F.col("e.table"), F.col("e.data"), F.col("e.old"), F.timestamp_seconds("e.ts"))
    elif form == "debezium":
        v = F.try_parse_json(column)
        e = lines.select(v.alias("e"))
        code = F.try_variant_get("e", "$.op", "string")
        op = F.when(code.isin("c", "r"), "INSERT").when(code == "u", "UPDATE").when(code == "d", "DELETE")
        after, before = F.try_variant_get("e", "$.after", "variant"), F.try_variant_get("e", "$.before", "variant")
        parts = (
            op, F.try_variant_get("e", "$.source.table", "string"), F.when(op == "DELETE", before).otherwise(after), before,
            F.timestamp_millis(F.try_variant_get("e", "$.ts_ms", "long")),
        )
    else:
        raise ValueError(f"unknown change form {form}")
    op, table, data, old, ts = parts
    rows = e.select(
        op.alias("operation"), table.alias("table"), data.alias("data"), old.alias("old_data"), ts.alias("ts")
    )
    ok = F.col("operation").isin(OPERATIONS) & F.col("table").isNotNull() & F.col("data").isNotNull()
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def without_repeats(changes: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Drop repeated events inside the watermark."""
    return changes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def append_log(changes: DataFrame, path: str, checkpoint: str, by: str | None = None) -> StreamingQuery:
    """STR-02 / STR-05: run what is available into the log and stop; the checkpoint
    remembers where the next call starts."""
    writer = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if by:
        writer = writer.partitionBy(by)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def place_of(ts: str, order: Column | None) -> Column:
    return F.struct(F.col(ts).alias("t"), (order if order is not None else F.lit(0)).alias("o"))


def summaries(log: DataFrame, keys: list[str], values: list[str], ts: str = "ts", order: Column | None = None) -> DataFrame:
    """What the state of each key needs of its changes: the last one, the last values, the last that were no delete, the first time."""
    place, alive = place_of(ts, order), F.col("operation") != "DELETE"
    own = F.struct(*values)
    return log.groupBy(*keys).agg(
        F.max(F.struct(place.alias("at"), F.col("operation").alias("operation"))).alias("last"),
        F.max(F.struct(place.alias("at"), own.alias("row"))).alias("any"),
        F.max(F.when(alive, F.struct(place.alias("at"), own.alias("row")))).alias("alive"),
        F.min(ts).alias("created_at"),
    )


def combined(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of the same keys as one; any order, any grouping and repeats give the same."""
    return parts.groupBy(*keys).agg(
        F.max("last").alias("last"), F.max("any").alias("any"), F.max("alive").alias("alive"), F.min("created_at").alias("created_at")
    )


def state_of(summary: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    gone = F.col("last.operation") == "DELETE"
    row = F.coalesce("alive.row", "any.row")
    return summary.select(
        *keys, *[row[v].alias(v) for v in values], "created_at", F.col("last.at.t").alias("updated_at"),
        gone.alias("is_deleted"), F.when(gone, F.col("last.at.t")).alias("deleted_at"),
    )


def current_state(log: DataFrame, keys: list[str], values: list[str], ts: str = "ts", order: Column | None = None) -> DataFrame:
    """STR-02: state after all changes: last values, creation time, soft delete.

    A delete keeps the last values and marks the row; a later insert revives it.
    ``order`` breaks ties of equal times; of changes equal in both the one with the
    greatest values counts.
    """
    return state_of(summaries(log, keys, values, ts, order), keys, values)


class StateTable:
    """STR-02 / STR-05: the state of all keys in ``folder``, kept by increments.

    Summaries lie in ``buckets`` hash buckets of their keys. A batch of changes reads
    and rewrites only the buckets of its keys, into a folder of its own, and then
    commits: a small table says which batch wrote each of these buckets. What a batch
    wrote before it broke off is never read, and a committed batch is not applied
    again. Changes are summed up per key before the exchange. Values must be of types
    that can be ordered.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], values: list[str], ts: str = "ts", order: str | None = None, buckets: int = 64) -> None:
        self.spark, self.folder, self.keys, self.values, self.ts, self.order, self.buckets = spark, folder, keys, values, ts, order, buckets

    def versions(self) -> dict[int, str]:
        """The data folder of each bucket, as of the last commit; at most ``buckets`` entries."""
        if not path_exists(self.spark, f"{self.folder}/commits"):
            return {}
        commits = self.spark.read.schema("bucket int, data string, batch long").option("pathGlobFilter", "*.parquet")
        done = commits.option("recursiveFileLookup", "true").parquet(f"{self.folder}/commits")
        last = done.groupBy("bucket").agg(F.max_by("data", "batch").alias("data"))
        return {r["bucket"]: r["data"] for r in last.collect()}

    def apply(self, changes: DataFrame, batch: int) -> None:
        commit = f"{self.folder}/commits/{batch}"
        if path_exists(self.spark, f"{commit}/_SUCCESS"):
            return
        order = F.col(self.order) if self.order else None
        new = summaries(changes, self.keys, self.values, self.ts, order)
        new = cut(new.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")), "increment")
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        if not touched:
            return
        now = self.versions()
        old = [f"{now[b]}/bucket={b}" for b in touched if b in now]
        rows = new.drop("bucket")
        if old:
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(*old))
        data = f"{self.folder}/data/{batch}-{uuid.uuid4().hex}"
        merged = combined(rows, self.keys).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(data)
        done = self.spark.createDataFrame([(b, data, batch) for b in touched], "bucket int, data string, batch long")
        done.coalesce(1).write.mode("overwrite").parquet(commit)

    def state(self) -> DataFrame | None:
        """The state after all committed batches; None before the first."""
        now = self.versions()
        if not now:
            return None
        rows = self.spark.read.parquet(*[f"{data}/bucket={b}" for b, data in sorted(now.items())])
        return state_of(rows, self.keys, self.values)

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply what a stream of changes has available; the checkpoint remembers where the next call starts."""
        writer = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query


def fan_out(changes: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """STR-03: each batch goes to every sink; it is computed once. A sink gets the
    batch number so that a repeated batch can overwrite its own output."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks.values():
                sink(batch, number)
        finally:
            batch.unpersist()

    query = (
        changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def handler_counts(changes: DataFrame) -> DataFrame:
    """STR-04: processed and failed events per table."""
    return changes.groupBy("table").agg(
        F.count_if("ok").alias("processed"), F.count_if(~F.col("ok")).alias("failed")
    )


def live_counts(trace: DataFrame, kind: str = "type") -> DataFrame:
    """STR-06: events per type so far."""
    return trace.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def window_counts(trace: DataFrame, kind: str, width: str, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Tumbling windows per type; with a delay, closed windows can be appended."""
    rows = trace.withWatermark(ts, delay) if delay else trace
    return rows.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), kind, "n"
    )


def budget_state(trace: DataFrame, run: str, kind: str = "type", limits: dict[str, int] | None = None) -> DataFrame:
    """STR-07: per run the counted events and whether a limit is passed.

    A count per run is all the guard needs, so the built-in state of a streaming
    aggregation holds it, combined before the exchange for a hot run.
    """
    limits = limits or {"tool_call": MAX_TOOL_CALLS, "retry": MAX_RETRIES, "iteration": MAX_ITERATIONS}
    counts = trace.groupBy(run).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in limits])
    over = [F.when(F.col(k) > n, F.lit(k)) for k, n in limits.items()]
    return counts.withColumn("exceeded", F.concat_ws(",", *over))


def run_to_table(result: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """The rows of a streaming aggregate over what is available, from a written table.

    Update mode: a batch writes the rows of the groups it changed to a folder of its
    number, which a repeated batch overwrites; the newest row of a group counts. A
    later call with the same folders goes on from there.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/{number}")

    query = result.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in result.columns if c not in keys]
    schema = StructType([*result.schema.fields, StructField("_batch", LongType())])
    spark = result.sparkSession
    if not path_exists(spark, path):  # no batch yet
        return spark.createDataFrame([], result.schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
    return last.select(*[F.col(f"_last.{c}").alias(c) if c in rest else F.col(c) for c in result.columns])


def parquet_stream(spark: SparkSession, folder: str, glob: str, schema: object, files: int = 100) -> DataFrame:
    """Stream the parquet files of one table out of a shared folder."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)
    )
