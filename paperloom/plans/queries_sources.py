"""Source and sink queries (SRC-*): written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from paperloom.functions import clean as C
from paperloom.plans import views as V
from paperloom.plans.registry import query
from paperloom.schemas import WORK
from paperloom.session import cut, new_table_path
from paperloom.sources import tables as T
from paperloom.sources import works as W


PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}  # of written records


@query("src01_jsonl", """
  SELECT 'W' || o_orderkey AS work_id, year(o_orderdate)::INTEGER AS publication_year, (1 + o_orderkey % 3)::INTEGER AS n_authors FROM orders""")
def src01(spark, sf):
    path = new_table_path(spark, "jsonl")
    # Compressed, as a plain copy is ten times the table.
    V.works_json(spark, sf).select("json").write.options(**PACKED).text(path)
    w = W.select_fields(W.read_works_jsonl(spark, path), ["id", "publication_year", "authorships"])
    return w.select(C.normalize_id(F.col("id")).alias("work_id"), "publication_year", F.size("authorships").alias("n_authors"))


TREE_FILE = 2_000  # works in a file; a file is read as one value


@query("src02_tree", """
  SELECT 'W' || o_orderkey AS work_id, year(o_orderdate)::INTEGER AS publication_year, (1 + o_orderkey % 3)::INTEGER AS n_authors FROM orders""")
def src02(spark, sf):
    """A folder tree of files, each one object with a list of results."""
    path = new_table_path(spark, "tree")
    # Each part is one file of its own folder, of so many works at most: the files grow in number, not in size.
    # It is made in the task that has its records, and compressed: neither plain files nor an exchange of parsed works fill the disk.
    grouped = W.bundles(V.works_json(spark, sf), TREE_FILE).sortWithinPartitions("part")
    grouped.select("part", F.from_json("list", ArrayType(WORK)).alias("results")).write.options(**PACKED).partitionBy("part").json(path)
    w = W.read_works_tree(spark, path)
    return w.select(C.normalize_id(F.col("id")).alias("work_id"), "publication_year", F.size("authorships").alias("n_authors"))


@query("src03_table_scan", "SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def src03(spark, sf):
    return T.read_table(spark, f"{sf}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("src05_csv_export", """
  SELECT event_id::VARCHAR AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type, '["' || event_type || '",null]' AS tags, '' AS nothing FROM events""")
def src05(spark, sf):
    e = V.table(spark, sf, "events").select(
        "event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), F.encode("event_type", "UTF-8").alias("event_type"),
        F.array("event_type", F.lit(None)).alias("tags"), F.lit(None).cast("string").alias("nothing"))
    path = new_table_path(spark, "csv")
    T.export_csv({"events": e}, path)
    back = spark.read.csv(f"{path}/events", header=True, escape="\\")
    return back.na.fill("")


@query("src05_manifest", """
  SELECT 'nation' AS table_name, count(*) AS row_count, 3 AS n_columns, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS total_rows FROM nation
  UNION ALL SELECT 'supplier', count(*), 4, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) FROM supplier""")
def src05m(spark, sf):
    m = T.export_csv({n: V.table(spark, sf, n) for n in ("nation", "supplier")}, new_table_path(spark, "csv"))
    return m.select("table_name", "row_count", F.size("columns").alias("n_columns"), "total_rows")


@query("src07_artifacts", """
  SELECT 'r1' AS run_id, 'papers' AS artifact, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS row_count""")
def src07(spark, sf):
    rows = T.union_records([
        V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")),
        V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
    ])
    return T.write_artifact(rows, new_table_path(spark, "artifacts"), "r1", "papers", "csv")


@query("src08_documents", """
  SELECT count(*) FILTER (doc_id % 10 <> 0) AS written, count(*) FILTER (doc_id % 10 = 0) AS failed FROM documents""")
def src08(spark, sf):
    d = V.table(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("id"), F.struct("source", "lang").alias("meta"), "text")
    path = new_table_path(spark, "documents")
    counts = T.write_documents(d, path, "id")
    back = spark.read.schema("id long, meta struct<source:string,lang:string>, text string").json(path)
    return back.agg(F.count("id").alias("written")).withColumn("failed", F.lit(counts["failed"]).cast("long"))


@query("src09_graph", V.with_graph("""
  SELECT 'vertex' AS kind, o_orderstatus AS type, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'edge', 'CITES', count(*) FROM citations"""))
def src09(spark, sf):
    path = new_table_path(spark, "graph")
    nodes = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"))
    T.write_graph(nodes, V.citations(spark, sf).withColumn("type", F.lit("CITES")), path)
    v, e = spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")
    return v.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("vertex").alias("kind"), "type", "n").unionByName(
        e.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


@query("src10_vectors", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE label = 3")
def src10(spark, sf):
    path = new_table_path(spark, "vectors")
    T.write_vectors(V.table(spark, sf, "embeddings").withColumnRenamed("label", "collection"), path)
    return T.read_vectors(spark, path, 3).select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("src11_resumable", """
  SELECT 'W' || o_orderkey AS work_id, 1 AS copies, year(o_orderdate)::INTEGER AS publication_year, (1 + o_orderkey % 3)::INTEGER AS n_authors, true AS whole
  FROM orders""")
def src11(spark, sf):
    """Two drops, two runs; the second run takes only what is new. Every field of a record arrives as it was sent."""
    drop, table, check = (new_table_path(spark, n) for n in ("drop", "table", "checkpoint"))
    # Made again where they are read, and compressed where they are dropped: a plain copy is ten times the table.
    lines = V.works_json(spark, sf)
    for rest in (0, 1):
        lines.filter(F.col("seq") % 2 == rest).select("json").write.mode("append").option("compression", "gzip").text(drop)
        W.ingest_new_works(spark, drop, table, check)
    fields = WORK.fieldNames()
    digest = F.unhex(F.sha2(F.to_json(F.struct(*fields)), 256))
    sent = W.parse_works(lines).select(F.col("id").alias("sent_id"), digest.alias("sent"))
    got = spark.read.parquet(table).select(
        C.normalize_id(F.col("id")).alias("work_id"), "id", "publication_year", F.size("authorships").alias("n_authors"), digest.alias("arrived"))
    # As long as the table itself, though a guess from the few columns left calls it small: no side is sent to the driver.
    same = got.join(sent.hint("merge"), got["id"] == sent["sent_id"])
    return same.groupBy("work_id", "publication_year", "n_authors").agg(
        F.count(F.lit(1)).cast("int").alias("copies"), F.bool_and(F.col("sent") == F.col("arrived")).alias("whole"))


FOLDERS = 96  # above the files' own; tasks list them, not the driver


@query("src12_content_store", """
  SELECT sha256(s_nationkey || chr(10)) AS sha256, count(*) AS n_files, 1 AS n_stored FROM supplier GROUP BY 1""")
def src12(spark, sf):
    """One file per supplier, written first; equal contents are stored once, every file keeps its link."""
    path = new_table_path(spark, "files")
    files = V.table(spark, sf, "supplier").select(
        "s_suppkey", F.col("s_nationkey").cast("string").alias("value"), F.pmod(F.xxhash64("s_suppkey"), F.lit(FOLDERS)).alias("folder"))
    # Dealt to all tasks, which move their files to their place themselves.
    files.repartition(FOLDERS, "folder").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("folder", "s_suppkey").text(path)
    store, links = T.store_binaries(spark, path, "*.txt")
    n = links.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_files"))
    return n.join(store.groupBy("sha256").agg(F.count(F.lit(1)).cast("int").alias("n_stored")), "sha256")


# Tables of the dictionary, with their columns' types; numbers also have ranges.
LISTED = {
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
}
DESCRIBED = {"supplier": "Authors of the derived works", "documents": "Texts"}


def dictionary_sql() -> str:
    parts = ["SELECT 'absent' AS table_name, NULL::INTEGER AS position, NULL AS column_name, NULL AS data_type, NULL AS description, 'not found' AS skipped,"
             " NULL::BIGINT AS row_count, NULL::BIGINT AS null_count, NULL::DOUBLE AS low, NULL::DOUBLE AS high"]
    for name, columns in LISTED.items():
        about = f"'{DESCRIBED[name]}'" if name in DESCRIBED else "NULL"
        for i, (c, kind) in enumerate(columns.items()):
            ends = "NULL, NULL" if kind == "string" else f"min({c})::DOUBLE, max({c})::DOUBLE"
            parts.append(f"SELECT '{name}', {i}, '{c}', '{kind}', {about}, NULL, count(*), count(*) - count({c}), {ends} FROM {name}")
    return " UNION ALL ".join(parts)


@query("src06_dictionary", dictionary_sql())
def src06(spark, sf):
    """Counts and ranges of the given tables from their footers; one table is not there."""
    d = T.stored_dictionary(spark, {name: f"{sf}/{name}.parquet" for name in [*LISTED, "absent"]}, DESCRIBED)
    return d.select("table_name", "position", "column_name", "data_type", F.col("table_description").alias("description"), "skipped", "row_count", "null_count", "low", "high")
