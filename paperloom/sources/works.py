"""Sources of work records (SRC-01, 02, 11, 13)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paperloom.schemas import WORK
from paperloom.session import path_exists


def parse_works(df: DataFrame, json_column: str = "json", seq: str = "seq") -> DataFrame:
    """Work JSON text to the declared schema; ``seq`` keeps the input order.

    The generator keeps later filters above the parse: pushed below it, each
    one would parse the record once more.
    """
    parsed = F.array(F.from_json(json_column, WORK))
    return df.select(seq, F.inline(parsed))


def parse_works_checked(df: DataFrame, json_column: str = "json", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """LNK-09: (works, rejects) of a batch of JSON texts.

    Rejects are (seq, reason, raw): "malformed" where the text is no record of the
    declared schema, "missing id" where it has no id. No record is in neither.
    """
    schema = StructType([*WORK.fields, StructField("_corrupt", StringType())])
    parsed = F.from_json(json_column, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    rows = df.select(seq, F.col(json_column).alias("_raw"), F.inline(F.array(parsed)))
    reason = (
        F.when(F.col("_raw").isNull() | F.col("_corrupt").isNotNull(), "malformed")
        .when(F.coalesce("id", F.lit("")) == "", "missing id")
    )
    rows = rows.withColumn("_reason", reason)
    works = rows.filter("_reason IS NULL").drop("_raw", "_corrupt", "_reason")
    rejects = rows.filter("_reason IS NOT NULL").select(seq, F.col("_reason").alias("reason"), F.col("_raw").alias("raw"))
    return works, rejects


def read_works_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: one record per line; a broken line fails the read.

    ``seq`` orders records by file, split and line.
    """
    df = spark.read.schema(WORK).option("mode", "FAILFAST").json(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return df.select("*", place.alias("seq"))


def read_works_tree(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """SRC-02: recursive JSON files, plain or gzip, each an object, a list, or {"results": [...]}.

    Malformed files and records without an id are skipped. Order is by file path
    and position in the file.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{json,json.gz}")
        .option("wholetext", "true")
        .text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
        .filter("v IS NOT NULL")
    )
    many = F.coalesce(
        F.try_variant_get("v", "$.results", "array<variant>"),
        F.try_variant_get("v", "$", "array<variant>"),
        F.array("v"),
    )
    records = (
        files.select("path", F.posexplode(many).alias("pos", "v"))
        .filter(F.coalesce(F.try_variant_get("v", "$.id", "string"), F.lit("")) != "")
        .select("path", "pos", F.to_json("v").alias("json"))
    )
    if limit > 0:
        records = records.orderBy("path", "pos").limit(limit)
    parsed = records.select(F.struct("path", "pos").alias("seq"), "json")
    return parse_works(parsed)


def bundles(texts: DataFrame, size: int, json_column: str = "json") -> DataFrame:
    """(part, list): JSON texts joined to JSON lists of ``size`` at most, in the tasks that have them, without an exchange."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, part = [], 0, None

        def joined() -> pa.RecordBatch:
            values = pa.concat_arrays(held).cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            text = pc.binary_join_element_wise("[", pc.binary_join(lists, ","), "]", "")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), text], names=["part", "list"])

        for b in batches:
            rows = b.column(1).drop_null()
            if part is None and len(rows):
                part = b.column(0)[0].as_py() << 33
            at = 0
            while at < len(rows):
                some = rows.slice(at, size - n)
                held.append(some)
                at, n = at + len(some), n + len(some)
                if n == size:
                    yield joined()
                    held, n, part = [], 0, part + 1
        if n:
            yield joined()

    # A filter on the texts would make them once more, below the exchange that may deal their rows.
    rows = texts.select(F.spark_partition_id().cast("long").alias("p"), json_column)
    return rows.mapInArrow(run, "part long, list string")


def works_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """SRC-11: a growing folder of JSON lines; the stream checkpoint is the cursor."""
    return (
        spark.readStream.schema(WORK)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("mode", "FAILFAST")
        .json(path)
        .withColumn("seq", F.col("_metadata.file_path"))
    )


def ingest_new_works(spark: SparkSession, path: str, table: str, checkpoint: str) -> int:
    """SRC-11: append what arrived since the last call, whole records; returns the rows added.

    The count is that of the sink, from its footers, however many batches ran.
    """
    def rows() -> int:
        return spark.read.parquet(table).count() if path_exists(spark, f"{table}/_spark_metadata") else 0

    before = rows()
    query = (
        works_stream(spark, path).select(*WORK.fieldNames())
        .writeStream.format("parquet").option("path", table)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return rows() - before


def select_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """SRC-13: column pruning; the scan reads only these."""
    return df.select(*fields)
