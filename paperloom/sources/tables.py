"""Table sources and sinks (SRC-03..10, 12)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import cut, path_exists

TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.StructType, T.MapType, T.ArrayType, T.VariantType)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: whole-table scan, no arbitrary limit."""
    return spark.read.parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, **options: str
) -> DataFrame:
    """SRC-03 from a database: range-partitioned on a numeric key."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1],
        numPartitions=parts, **options,
    ).load()


def read_wide_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """SRC-04: a wide news sheet; quoted cells may span lines.

    Spark takes encodings such as GBK only with the Java character sets switched
    on; the setting stays on because the read runs later.
    """
    if encoding.upper() not in ("UTF-8", "UTF-16", "ISO-8859-1", "US-ASCII"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.csv(path, header=True, encoding=encoding, multiLine=True, escape='"')
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns})


def csv_values(df: DataFrame) -> DataFrame:
    """SRC-05 value rules: every column as the text the export writes."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            # ISO text; the fraction appears only when there is one.
            c = F.concat(
                F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
                F.when(F.date_format(c, "SSSSSS") != "000000", F.date_format(c, ".SSSSSS")).otherwise(F.lit("")),
            )
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.BinaryType):
            c = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.lower(F.hex(c)))
        elif isinstance(kind, NESTED):
            c = F.to_json(c)
        else:
            c = c.cast("string")
        out.append(F.coalesce(c, F.lit("")).alias(f.name))
    return df.select(*out)


def export_csv(tables: dict[str, DataFrame], out_dir: str) -> DataFrame:
    """SRC-05: CSV per table; returns the manifest (table, rows, columns, total)."""
    rows = []
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        seen = Observation()
        csv_values(df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").csv(
            f"{out_dir}/{name}", header=True
        )
        rows.append((name, int(seen.get["n"]), list(df.columns)))
    manifest = spark.createDataFrame(rows, "table_name string, row_count long, columns array<string>")
    total = sum(r[1] for r in rows)
    return manifest.withColumn("total_rows", F.lit(total).cast("long"))


def data_dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """SRC-06: one row per column, from the schemas alone."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), f.nullable)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        rows, "table_name string, position int, column_name string, data_type string, nullable boolean"
    )


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(column, rows, nulls, low, high) of each row group of the parquet files below ``path``, from their footers.

    Tasks read the footers, no data. ``low`` and ``high`` are given for numbers;
    statistics that a file does not have are null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        for b in batches:
            for name in b.column("path").to_pylist():
                # Spark writes file:/place, the reader wants file:///place.
                local = name.startswith("file:/") and not name.startswith("file://")
                system, place = fs.FileSystem.from_uri("file://" + name.removeprefix("file:") if local else name)
                with system.open_input_file(place) as f:
                    meta = parquet.ParquetFile(f).metadata
                out = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    out.append((None, group.num_rows, None, None, None))
                    for c in range(group.num_columns):
                        column, stats = group.column(c), group.column(c).statistics
                        if "." in column.path_in_schema:  # counts of a nested column are not those of its rows
                            continue
                        number = stats is not None and stats.has_min_max and isinstance(stats.min, int | float)
                        low, high = (float(stats.min), float(stats.max)) if number else (None, None)
                        nulls = stats.null_count if stats is not None and stats.has_null_count else None
                        out.append((column.path_in_schema, None, nulls, low, high))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                cols = [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=["column", "rows", "nulls", "low", "high"])

    return files.load(path).select("path").mapInArrow(run, "column string, rows long, nulls long, low double, high double")


def stored_dictionary(
    spark: SparkSession, paths: dict[str, str], tables: dict[str, str] | None = None, columns: dict[str, str] | None = None
) -> DataFrame:
    """SRC-06: one row per column of the parquet tables in ``paths``, and one per table that is not there.

    Row counts, null counts and ranges come from the footers, without a scan of the
    data. ``tables`` and ``columns`` hold descriptions by name. A table without a file has
    no column, and the reason why it was skipped.
    """
    tables, columns = tables or {}, columns or {}
    parts = []
    schema = (
        "table_name string, position int, column_name string, data_type string, nullable boolean,"
        " table_description string, column_description string, skipped string"
    )
    numbers = {"row_count": "long", "null_count": "long", "low": "double", "high": "double"}
    for name, path in paths.items():
        there, about = path_exists(spark, path), tables.get(name)
        fields = spark.read.parquet(path).schema.fields if there else []
        rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable, about, columns.get(f.name), None) for i, f in enumerate(fields)]
        listed = spark.createDataFrame(rows or [(name, None, None, None, None, about, None, "not found")], schema)
        if not there:
            parts.append(listed.withColumns({c: F.lit(None).cast(kind) for c, kind in numbers.items()}))
            continue
        found = footers(spark, path).groupBy("column").agg(
            F.sum("rows").alias("row_count"), F.when(F.count("nulls") == F.count(F.lit(1)), F.sum("nulls")).alias("null_count"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        )
        found = cut(found, "footers")
        total = found.filter("column is null").agg(F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count")).scalar()
        facts = found.filter("column is not null").select(F.col("column").alias("column_name"), "null_count", "low", "high")
        parts.append(listed.join(facts, "column_name", "left").withColumn("row_count", total))
    order = [*(c.split()[0] for c in schema.split(",")), *numbers]
    return reduce(DataFrame.unionByName, [p.select(*order) for p in parts])


def write_artifact(df: DataFrame, root: str, run_id: str, name: str, form: str = "json") -> DataFrame:
    """SRC-07: run-scoped artifact; returns (run_id, artifact, rows)."""
    path = f"{root}/run_id={run_id}/{name}"
    seen = Observation()
    out = df.select(*sorted(df.columns)) if form == "csv" else df
    if form == "csv":
        out = csv_values(out)
    elif form == "text":
        out = out.select(F.to_json(F.struct(*out.columns)).alias("value")) if len(out.columns) > 1 else out
    writer = out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    if form == "csv":
        writer.csv(path, header=True)
    else:
        writer.format("json" if form == "jsonl" else form).save(path)
    return df.sparkSession.createDataFrame(
        [(run_id, name, int(seen.get["n"]))], "run_id string, artifact string, row_count long"
    )


def union_records(parts: list[DataFrame]) -> DataFrame:
    """SRC-07: frames with different columns, header = union of all."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def write_documents(df: DataFrame, path: str, key: str) -> dict[str, int]:
    """SRC-08: search documents as a table; keyless rows count as failures."""
    seen = Observation()
    ok = F.col(key).isNotNull()
    (
        df.observe(seen, F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))
        .filter(ok).write.mode("overwrite").json(path)
    )
    return {k: int(v) for k, v in seen.get.items()}


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """SRC-09: nodes before edges, one folder per type."""
    vertices.write.mode("overwrite").partitionBy("type").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def write_vectors(df: DataFrame, path: str) -> None:
    """SRC-10: vector rows appended to their collection."""
    df.write.mode("append").partitionBy("collection").parquet(path)


def read_vectors(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """SRC-10: one collection; the filter prunes to its folder."""
    return spark.read.parquet(path).filter(F.col("collection") == collection)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The folders in ``path`` if it holds nothing else, else ``path``: many roots are listed by tasks, one by the driver."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    seen = [f for f in found if not f.getPath().getName().startswith(("_", "."))]
    return [f.getPath().toString() for f in seen] if seen and all(f.isDirectory() for f in seen) else [path]


def store_binaries(spark: SparkSession, path: str, glob: str = "*.pdf") -> tuple[DataFrame, DataFrame]:
    """SRC-12: (content store, file links); equal content is stored once.

    One path is chosen per digest; only paths and digests are exchanged and kept, and the
    chosen files are read where they are. Each file is hashed once, whatever is asked of the two.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .load(subfolders(spark, path))
    )
    key = F.concat(F.lit("pdfs/"), F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256"), F.lit(".pdf"))
    found = cut(files.select("path", F.sha2("content", 256).alias("sha256"), "length"), "contents")
    links = found.select("path", "sha256", "length", key.alias("object_key"))
    chosen = found.groupBy("sha256").agg(F.min("path").alias("path"))
    return files.select("path", "content").join(chosen, "path").select("sha256", key.alias("object_key"), "content"), links
