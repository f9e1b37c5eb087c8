"""Streaming queries (STR-*) on the events table, and design-note queries (DSN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import aggregates as A
from paperloom.operators import design as D
from paperloom.plans import views as V
from paperloom.plans.registry import query
from paperloom.session import new_table_path
from paperloom.streaming import changes as S


def event_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    e = S.parquet_stream(spark, sf, "events.parquet", schema)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def change_stream(spark, sf):
    """Events as native change records in JSON, parsed back by STR-01."""
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").when(
        F.col("event_type") == "view", "read").otherwise("update")
    data = F.struct("user_id", "event_id", "value", "props")
    lines = event_stream(spark, sf).select(
        F.to_json(F.struct(op.alias("operation"), F.lit("users").alias("table"), data.alias("data"), F.col("ts").alias("timestamp"))).alias("value"))
    return S.parse_changes(lines)


def change_log(spark, sf):
    path, check = new_table_path(spark, "change-log"), new_table_path(spark, "checkpoint")
    c = change_stream(spark, sf).filter("ok").select(
        "operation", "ts", F.try_variant_get("data", "$.user_id", "long").alias("user_id"),
        F.try_variant_get("data", "$.event_id", "long").alias("event_id"), F.try_variant_get("data", "$.value", "double").alias("value"))
    S.append_log(c, path, check)
    return spark.read.schema(c.schema).parquet(path)


STATE_SQL = """
  WITH c AS (SELECT * FROM events WHERE event_type <> 'view')
  SELECT user_id, coalesce(arg_max(event_id, {order}) FILTER (event_type <> 'error'), arg_max(event_id, {order})) AS event_id,
    coalesce(arg_max(value, {order}) FILTER (event_type <> 'error'), arg_max(value, {order})) AS value,
    arg_max(event_type, {order}) = 'error' AS is_deleted FROM c GROUP BY 1""".replace("{order}", "(date_trunc('millisecond', ts), event_id)")


@query("str02_apply_changes", STATE_SQL)
def str02(spark, sf):
    state = S.current_state(change_log(spark, sf), ["user_id"], ["event_id", "value"], order=F.col("event_id"))
    return state.select("user_id", "event_id", "value", "is_deleted")


@query("str05_increment", STATE_SQL)
def str05(spark, sf):
    """Two increments of the log, the later half of the events first, and the first once more."""
    log = change_log(spark, sf)
    table = S.StateTable(spark, new_table_path(spark, "state"), ["user_id"], ["event_id", "value"], order="event_id")
    middle = log.agg(F.avg("event_id").alias("m")).scalar()
    later = F.col("event_id") >= middle
    for batch, part in enumerate((later, ~later, later)):
        table.apply(log.filter(part), batch)
    return table.state().select("user_id", "event_id", "value", "is_deleted")


def written(spark, result, keys):
    return S.run_to_table(result, keys, new_table_path(spark, "updates"), new_table_path(spark, "checkpoint"))


@query("str04_counters", """
  SELECT 'users' AS "table", count(*) FILTER (event_type <> 'view') AS processed, count(*) FILTER (event_type = 'view') AS failed FROM events""")
def str04(spark, sf):
    return written(spark, S.handler_counts(change_stream(spark, sf)), ["table"])


@query("str06_live_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def str06(spark, sf):
    return written(spark, S.live_counts(event_stream(spark, sf), "event_type"), ["event_type"])


@query("str06_daily_windows", """
  SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def str06w(spark, sf):
    w = written(spark, S.window_counts(event_stream(spark, sf), "event_type", "1 day"), ["window_start", "event_type"])
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("str07_budget", """
  SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
    concat_ws(',', CASE WHEN count(*) FILTER (event_type = 'click') > 15 THEN 'click' END, CASE WHEN count(*) FILTER (event_type = 'error') > 12 THEN 'error' END) AS exceeded
  FROM events GROUP BY 1""")
def str07(spark, sf):
    return written(spark, S.budget_state(event_stream(spark, sf), "user_id", "event_type", {"click": 15, "error": 12}), ["user_id"])


CHANGES_SQL = """SELECT event_id, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' WHEN 'view' THEN {unknown} ELSE 'UPDATE' END AS operation,
  'users' AS "table", user_id, epoch_ms(date_trunc('{unit}', ts)) AS at_ms, event_type <> 'view' AS ok FROM events"""


def parsed_changes(lines, form):
    return S.parse_changes(lines, form=form).select(
        F.try_variant_get("data", "$.event_id", "long").alias("event_id"), "operation", "table",
        F.try_variant_get("data", "$.user_id", "long").alias("user_id"), F.unix_millis("ts").alias("at_ms"), "ok")


@query("str01_maxwell", CHANGES_SQL.replace("{unknown}", "'BOOTSTRAP-START'").replace("{unit}", "second"))
def str01_maxwell(spark, sf):
    kind = F.col("event_type")
    op = F.when(kind == "signup", "insert").when(kind == "error", "delete").when(kind == "view", "bootstrap-start").otherwise("update")
    data = F.struct("user_id", "event_id", "value")
    lines = V.table(spark, sf, "events").withColumn("ts", F.unix_seconds(F.col("ts").cast("timestamp"))).select(F.to_json(F.struct(
        F.lit("library").alias("database"), F.lit("users").alias("table"), op.alias("type"), F.col("ts"), data.alias("data"))).alias("value"))
    return parsed_changes(lines, "maxwell")


@query("str01_debezium", CHANGES_SQL.replace("{unknown}", "NULL").replace("{unit}", "millisecond"))
def str01_debezium(spark, sf):
    kind = F.col("event_type")
    op = F.when(kind == "signup", "c").when(kind == "error", "d").when(kind == "view", "m").otherwise("u")
    data, gone = F.struct("user_id", "event_id", "value"), kind == "error"
    lines = V.table(spark, sf, "events").select(F.to_json(F.struct(
        op.alias("op"), F.struct(F.lit("users").alias("table")).alias("source"), F.when(~gone, data).alias("after"),
        F.when(gone, data).alias("before"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))).alias("value"))
    return parsed_changes(lines, "debezium")


@query("str03_fan_out", """
  SELECT 'deletes' AS sink, count(*) FILTER (event_type = 'error') AS n, sum(event_id) FILTER (event_type = 'error')::BIGINT AS ids FROM events
  UNION ALL SELECT 'all', count(*), sum(event_id)::BIGINT FROM events""")
def str03(spark, sf):
    """Every batch of the stream in two sinks, each of which overwrites its own batch."""
    rows = event_stream(spark, sf).select("event_id", "event_type")
    paths = {"deletes": new_table_path(spark, "sink"), "all": new_table_path(spark, "sink")}

    def sink(name, keep):
        return lambda batch, n: batch.filter(keep).write.mode("overwrite").parquet(f"{paths[name]}/{n}")

    S.fan_out(rows, {"deletes": sink("deletes", "event_type = 'error'"), "all": sink("all", "true")}, new_table_path(spark, "checkpoint"))
    parts = [
        spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path).agg(
            F.lit(name).alias("sink"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
        for name, path in paths.items()
    ]
    return parts[0].unionByName(parts[1])


# --- design notes ----------------------------------------------------------------------


@query("dsn01_score", """
  WITH b AS (SELECT o_orderkey AS id, (o_custkey % 7)::DOUBLE AS topic, (o_orderkey % 3)::DOUBLE AS title, ln(1 + o_totalprice) AS cit,
      (year(o_orderdate) - min(year(o_orderdate)) OVER ())::DOUBLE AS rec, (o_custkey % 2)::DOUBLE AS src FROM orders)
  SELECT id, round(0.35 * topic / max(topic) OVER () + 0.25 * title / max(title) OVER () + 0.20 * cit / max(cit) OVER () + 0.10 * rec / max(rec) OVER () + 0.10 * src / max(src) OVER (), 6) AS frontier_score FROM b""")
def dsn01(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    s = D.frontier_scores(o, F.col("o_custkey") % 7, F.col("id") % 3, F.col("o_totalprice"), F.col("y"), F.col("o_custkey") % 2)
    return s.select("id", "frontier_score")


@query("dsn02_triage", """
  SELECT name, weight, CASE WHEN hit AND weight >= 20 THEN 'must_include' WHEN hit OR weight >= 40 THEN 'candidate' ELSE 'exclude' END AS triage FROM (
    SELECT p_name AS name, count(*) AS weight, len(list_intersect(string_split(lower(p_name), ' '), ['blue', 'ring'])) > 0 AS hit FROM part GROUP BY 1)""")
def dsn02(spark, sf):
    t = V.table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("weight"))
    return D.topic_triage(t, "blue ring", 20, 40)


@query("dsn03_quality", V.with_graph("""
  SELECT round(count(*) FILTER (publication_year >= 1998) / count(*), 6) AS topic_purity, round((SELECT count(*) FROM citations) / count(*), 6) AS citation_density,
    round(count(DISTINCT publication_year) / (max(publication_year) - min(publication_year) + 1), 6) AS year_coverage FROM papers""", True))
def dsn03(spark, sf):
    cites = V.citations(spark, sf)
    return D.corpus_quality(V.papers(spark, sf, cites), cites, F.col("publication_year") >= 1998)


@query("dsn06_topic_drift", """
  WITH n AS (SELECT year(l_shipdate)::INTEGER AS year, p_brand AS topic, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
  s AS (SELECT *, n / sum(n) OVER (PARTITION BY year) AS share FROM n)
  SELECT year, topic, n, round(share, 9) AS share, round(CASE WHEN lag(year) OVER w = year - 1 THEN share - lag(share) OVER w END, 9) AS change FROM s WINDOW w AS (PARTITION BY topic ORDER BY year)""")
def dsn06(spark, sf):
    rows = V.table(spark, sf, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year")).join(
        V.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("topic")), F.col("l_partkey") == F.col("p_partkey"))
    return D.topic_drift(rows)


@query("dsn07_budget", """
  SELECT source, mode, n_works, pages::BIGINT AS pages, (pages * CASE WHEN mode = 'search' THEN 10 ELSE 1 END)::BIGINT AS credits, pages * CASE WHEN mode = 'search' THEN 10 ELSE 1 END / 10000.0::DOUBLE AS usd FROM (
    SELECT source, CASE WHEN source = 'src3' THEN 'search' ELSE 'filter' END AS mode, sum(n_chars)::BIGINT AS n_works, ceil(sum(n_chars) / 100) AS pages FROM documents GROUP BY 1, 2)""")
def dsn07(spark, sf):
    p = V.table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("n_works"))
    return D.ingest_budget(p.withColumn("mode", F.when(F.col("source") == "src3", "search").otherwise("filter")))
