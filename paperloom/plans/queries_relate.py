"""Join, aggregate, ranking, set, upsert and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import aggregates as A
from paperloom.operators import documents as D
from paperloom.operators import graph as G
from paperloom.operators import ranking as R
from paperloom.operators import relate as J
from paperloom.operators import sets as S
from paperloom.operators import upsert as U
from paperloom.operators import entities as E
from paperloom.plans import views as V
from paperloom.plans.registry import query
from paperloom.session import cut, new_table_path, spread

# --- joins -----------------------------------------------------------------------
# Held works: orders that are not pending. Citations: the flat reference lists of the records.


def held(spark, sf):
    return V.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("W"), "o_orderkey").alias("work_id"))


def refs(spark, sf):
    return cut(E.citations(V.raw_works(spark, sf)), "refs")


HELD = "h AS (SELECT 'W' || o_orderkey AS work_id FROM orders WHERE o_orderstatus <> 'P')"
REFS = V.with_flat("", "fc").rstrip() + ", " + HELD


@query("jn01_fk_resolution", """
  WITH r AS (SELECT l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW') AS ok_w,
               l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 2000) AS ok_a FROM lineitem)
  SELECT CASE WHEN ok_w AND ok_a THEN 'resolved' ELSE concat_ws('+', CASE WHEN NOT ok_w THEN 'l_orderkey' END, CASE WHEN NOT ok_a THEN 'l_suppkey' END) END AS outcome,
    count(*) AS n FROM r GROUP BY 1""")
def jn01(spark, sf):
    link = V.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    works = V.table(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'").select("o_orderkey")
    authors = V.table(spark, sf, "supplier").filter("s_acctbal >= 2000").select("s_suppkey")
    ok, skipped = J.resolve_links(link, {"l_orderkey": works, "l_suppkey": authors})
    return ok.agg(F.count(F.lit(1)).alias("n")).select(F.lit("resolved").alias("outcome"), "n").unionByName(
        skipped.select(F.col("missing").alias("outcome"), F.col("skipped").alias("n"))
    )


@query("jn02_citations_left", REFS + " SELECT citing_work_id, cited_work_id, work_id AS cited_key FROM fc LEFT JOIN h ON work_id = cited_work_id")
def jn02(spark, sf):
    return J.citations_with_target(E.citations(V.raw_works(spark, sf)), held(spark, sf))


@query("jn03_citations_inner", REFS + """
  SELECT citing_work_id, cited_work_id FROM fc WHERE citing_work_id IN (FROM h) AND cited_work_id IN (FROM h)""")
def jn03(spark, sf):
    return J.internal_citations(refs(spark, sf), cut(held(spark, sf), "held"))


@query("jn04_external_refs", REFS + """
  SELECT cited_work_id AS external_work_id, min(citing_work_id) AS first_seen_from, count(*) AS n_citing FROM fc
  WHERE cited_work_id NOT IN (FROM h) GROUP BY 1""")
def jn04(spark, sf):
    return J.external_refs(E.citations(V.raw_works(spark, sf)), held(spark, sf))


MEMBERS = "(SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)"


def members(spark, sf):
    return V.table(spark, sf, "lineitem").filter("l_suppkey = 7").select(F.col("l_orderkey").alias("work_id"))


@query("jn05_corpus_semi", f"SELECT o_orderkey AS work_id, o_totalprice AS price FROM orders WHERE o_orderkey IN {MEMBERS}")
def jn05(spark, sf):
    w = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_totalprice").alias("price"))
    return J.in_corpus(w, members(spark, sf))


@query("jn06_corpus_citations", V.with_graph(f"SELECT src AS citing_work_id, dst AS cited_work_id FROM citations WHERE src IN {MEMBERS}"))
def jn06(spark, sf):
    cites = V.citations(spark, sf).toDF("citing_work_id", "cited_work_id")
    return J.corpus_citations(cites, members(spark, sf))


@query("jn07_lookups", """
  SELECT l_orderkey AS work_id, count(DISTINCT s_name) AS n_authors, min(n_name) AS first_institution, max(r_name) AS last_country, count(p_brand) AS n_brands
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def jn07(spark, sf):
    t = lambda n: V.table(spark, sf, n)
    rows = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    rows = J.lookup(rows, t("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey")), "s_suppkey", "inner")
    rows = J.lookup(rows, t("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey")
    rows = J.lookup(rows, t("region"), "r_regionkey")
    rows = J.lookup(rows, t("part").select("p_partkey", "p_brand"), "p_partkey")
    return rows.groupBy(F.col("l_orderkey").alias("work_id")).agg(
        F.countDistinct("s_name").alias("n_authors"), F.min("n_name").alias("first_institution"),
        F.max("r_name").alias("last_country"), F.count("p_brand").alias("n_brands"),
    )


@query("jn08_affiliation_in_work", f"""
  WITH wa AS ({V.WORK_AUTHORS_SQL})
  SELECT DISTINCT wa.work_id, wa.author_id, author_order, s_nationkey::INTEGER AS institution_id FROM wa JOIN supplier ON s_suppkey = wa.author_id""")
def jn08(spark, sf):
    wa = V.work_authors(spark, sf)
    aff = wa.join(V.table(spark, sf, "supplier"), F.col("author_id") == F.col("s_suppkey")).select(
        "work_id", "author_id", F.col("s_nationkey").alias("institution_id")
    )
    return J.affiliation_in_work(wa, aff)


@query("jn12_fetch_set", REFS + " SELECT DISTINCT cited_work_id FROM fc WHERE cited_work_id NOT IN (FROM h)")
def jn12(spark, sf):
    return J.not_held(E.citations(V.raw_works(spark, sf)), held(spark, sf))


@query("jn13_sample_join", """
  SELECT d.doc_id, n_chars, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def jn13(spark, sf):
    index = V.table(spark, sf, "documents").select("doc_id", "n_chars")
    return J.join_samples(index, V.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


# --- aggregates -----------------------------------------------------------------------


@query("agg01_yearly", "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n_works FROM orders GROUP BY 1")
def agg01(spark, sf):
    return A.yearly_trend(V.table(spark, sf, "orders").select(F.year("o_orderdate").alias("publication_year")))


@query("agg02_topics", """
  SELECT p_brand AS topic, count(*) AS n_works FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def agg02(spark, sf):
    rows = V.table(spark, sf, "lineitem").select("l_partkey").join(
        V.table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return A.topic_counts(rows, "p_brand")


@query("agg03_weighted_topics", V.with_flat("""
  SELECT concept_id AS topic_id, any_value(t_name) AS name, round(sum(score), 6)::DOUBLE AS weight FROM (
    SELECT * FROM ft UNION ALL
    SELECT o_orderkey, 3, 'T' || (o_custkey + 15) % 60, 'Topic ' || (o_custkey + 15) % 60, 0, ((o_orderkey + 3) % 10) / 10.0, 'concepts'
    FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0) GROUP BY 1""", "ft"))
def agg03(spark, sf):
    w = A.weighted_topics(V.raw_works(spark, sf))
    return w.select("topic_id", "name", F.round("weight", 6).alias("weight"))


@query("agg04_layer_stats", V.with_flat("""
  SELECT 'year' AS kind, year(o_orderdate)::VARCHAR AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL
  SELECT 'source', 'V' || (o_custkey % 40), count(*) FROM orders GROUP BY 2 UNION ALL
  SELECT 'topic', t, count(*) FROM (SELECT concept_id AS t FROM ft UNION ALL
    SELECT 'T' || (o_custkey + 15) % 60 FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0) GROUP BY 2""", "ft"))
def agg04(spark, sf):
    return A.layer_statistics(V.raw_works(spark, sf))


@query("agg05_sample_summary", """
  SELECT source, quality, count(*) AS non_empty_news_count, count(DISTINCT md5(text)) AS unique_news_count, sum(n_chars)::BIGINT AS total_chars,
    round(avg(n_chars), 6) AS mean_chars_per_news, max(n_chars) AS max_chars_single_news
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def agg05(spark, sf):
    cells = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select(
        "source", "quality", F.col("lang").alias("news_col"), F.md5("text").alias("text_hash"), F.col("n_chars").alias("char_len"))
    s = A.sample_summary(cells, ["source", "quality"])
    return s.withColumn("mean_chars_per_news", F.round("mean_chars_per_news", 6))


@query("agg06_unique_texts", """
  SELECT sha1(text) AS text_hash, max(length(text))::INTEGER AS char_len, any_value(left(text, 120)) AS text_preview, count(*) AS occurrence_count
  FROM documents GROUP BY 1""")
def agg06(spark, sf):
    d = V.table(spark, sf, "documents").select(F.sha1("text").alias("text_hash"), F.length("text").alias("char_len"), F.substring("text", 1, 120).alias("raw_text"))
    return A.unique_texts(d)


def cites_named(spark, sf):
    return V.citations(spark, sf).toDF("citing_work_id", "cited_work_id")


@query("agg07_author_counts", V.with_graph(f"""
  , wa AS (SELECT author_id, work_id, count(*) AS k FROM ({V.WORK_AUTHORS_SQL}) GROUP BY 1, 2),
    n AS (SELECT dst, count(*) AS c FROM citations GROUP BY 1)
  SELECT author_id, count(*) AS works_count, coalesce(sum(c), 0)::BIGINT AS cited_by_count, coalesce(sum(c * k), 0)::BIGINT AS cited_by_reference
  FROM wa LEFT JOIN n ON dst = work_id GROUP BY 1"""))
def agg07(spark, sf):
    wa, c = V.work_authors(spark, sf), cites_named(spark, sf)
    ref = A.author_counts(wa, c, True).select("author_id", F.col("cited_by_count").alias("cited_by_reference"))
    return A.author_counts(wa, c).join(ref, "author_id")


@query("agg08_venue_counts", """
  SELECT c_mktsegment AS venue_id, count(DISTINCT o_orderkey) AS works_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def agg08(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("venue_id"))
    links = V.table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("venue_id", F.col("o_orderkey").alias("work_id"))
    return A.venue_counts(c.select("venue_id").distinct(), links)


@query("agg08_institution_counts", """
  SELECT n_nationkey AS institution_id, count(DISTINCT l_orderkey) AS works_count, count(DISTINCT l_suppkey) AS authors_count
  FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def agg08b(spark, sf):
    inst = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("institution_id"))
    return A.institution_counts(inst, inst_links(spark, sf))


def inst_links(spark, sf):
    s = V.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("institution_id"))
    return V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("author_id")).join(
        s, F.col("author_id") == F.col("s_suppkey")).drop("s_suppkey")


@query("agg09_cited_by", V.with_graph("""
  SELECT o_orderkey AS work_id, coalesce(n, 0) AS cited_by_count FROM orders LEFT JOIN (SELECT dst, count(*) AS n FROM citations GROUP BY 1) ON dst = o_orderkey"""))
def agg09(spark, sf):
    return A.cited_by(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("work_id")), cites_named(spark, sf))


AREAS_SQL = f"""
  SELECT author_id, concept, s AS total_score, rn::INTEGER AS rank FROM (
    SELECT author_id, concept, sum(score)::BIGINT AS s, row_number() OVER (PARTITION BY author_id ORDER BY sum(score) DESC, concept) AS rn
    FROM (SELECT DISTINCT author_id, work_id FROM ({V.WORK_AUTHORS_SQL})) JOIN ({V.WORK_CONCEPTS_SQL}) USING (work_id) GROUP BY 1, 2) WHERE rn <= 10
"""


@query("agg10_research_areas", AREAS_SQL)
def agg10(spark, sf):
    return A.research_areas(V.work_authors(spark, sf), V.work_concepts(spark, sf))


@query("agg14_run_metrics", """
  SELECT user_id, count(*) FILTER (event_type IN ('click', 'error')) AS tool_calls, count(*) FILTER (event_type = 'error') AS failed_calls, count(*) AS events
  FROM events GROUP BY 1""")
def agg14(spark, sf):
    e = V.table(spark, sf, "events").select(
        "user_id", F.when(F.col("event_type").isin("click", "error"), "tool_call").otherwise("note").alias("type"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    return A.run_metrics(e, "user_id")


@query("agg15_plan", V.with_flat("""
  , t AS (SELECT concept_id AS id, sum(score) AS w FROM (
    SELECT concept_id, score FROM ft UNION ALL
    SELECT 'T' || (o_custkey + 15) % 60, ((o_orderkey + 3) % 10) / 10.0 FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0) GROUP BY 1
    ORDER BY w DESC, id LIMIT 10),
  x AS (SELECT string_agg(id, '|' ORDER BY w DESC, id) AS topic_expr FROM t WHERE w >= 5),
  y AS (SELECT greatest(2012, min(year(o_orderdate)))::INTEGER AS start_year, max(year(o_orderdate))::INTEGER AS end_year FROM orders)
  SELECT start_year, end_year, topic_expr, (SELECT string_agg('W' || k, '|' ORDER BY k) FROM (SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 10)) AS seed_ids,
    'topics.id:' || topic_expr || ',publication_year:' || start_year || '-' || end_year || ',type:article' AS recommended_filter FROM x, y""", "ft"))
def agg15(spark, sf):
    return A.download_plan(cut(V.raw_works(spark, sf).select("id", "seq", "publication_year", "topics", "concepts"), "plan-works"))


@query("agg16_throughput", """
  SELECT user_id, count(*) AS records, round(epoch(max(ts)) - epoch(min(ts)), 3) AS elapsed,
    CASE WHEN max(ts) > min(ts) THEN round(count(*) / round(epoch(max(ts)) - epoch(min(ts)), 3), 6) ELSE 0 END AS records_per_second FROM events GROUP BY 1""")
def agg16(spark, sf):
    t = F.col("ts").cast("timestamp").cast("double")
    log = V.table(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("records"), F.round(F.max(t) - F.min(t), 3).alias("elapsed"))
    out = A.throughput(log)
    return out.withColumn("records_per_second", F.round("records_per_second", 6))


# --- ranking ---------------------------------------------------------------------------


@query("win01_candidates", V.with_graph("""
  SELECT id AS work_id, publication_year::INTEGER AS publication_year, cited_by_count FROM papers ORDER BY cited_by_count DESC, publication_year DESC, id LIMIT 20""", True))
def win01(spark, sf):
    p = V.papers(spark, sf, V.citations(spark, sf)).select(F.col("id").alias("work_id"), "publication_year", "cited_by_count")
    return R.candidate_papers(p)


@query("win04_capped_children", """
  SELECT work_id, concept, score, position::INTEGER AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, concept) AS position FROM (""" + V.WORK_CONCEPTS_SQL + """)) WHERE position <= 2""")
def win04(spark, sf):
    return R.capped_children(V.work_concepts(spark, sf), "work_id", [F.desc("score"), F.asc("concept")], 2)


@query("win05_representatives", """
  SELECT c_mktsegment AS community, o_orderkey AS id FROM (
    SELECT c_mktsegment, o_orderkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rn
    FROM orders JOIN customer ON c_custkey = o_custkey) WHERE rn = 1""")
def win05(spark, sf):
    o = cut(V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("community"), F.col("o_totalprice").alias("pagerank")), "segments")
    return G.representatives(o.select("id"), o.select("id", "community"), o.select("id", "pagerank"))


@query("win08_prune", "SELECT o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def win08(spark, sf):
    return R.prune_frontier(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), "score", "id", 1000)


@query("win10_edge_cap", V.with_graph("""
  SELECT src, dst, nth FROM (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS nth FROM citations) WHERE nth <= 12000"""))
def win10(spark, sf):
    return R.global_cap(V.citations(spark, sf), ["src", "dst"], 12000)


@query("win11_page", "SELECT event_id, ts::VARCHAR AS ts_text FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 400")
def win11(spark, sf):
    p = R.page(V.table(spark, sf, "events").select("event_id", "ts"), [F.desc("ts"), F.asc("event_id")], 400, 50)
    return p.select("event_id", F.col("ts").cast("string").alias("ts_text"))


@query("win12_call_log", "SELECT user_id, event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts, event_id")
def win12(spark, sf):
    e = V.table(spark, sf, "events").filter("event_type = 'error'").select("user_id", "event_id", "event_type", "ts")
    return R.call_log(e, "ts", "event_id").drop("ts")


@query("win13_sample")
def win13(spark, sf):
    """GRA-13: hash-random neighbourhoods; the hash has no SQL twin."""
    cites = V.citations(spark, sf).select("src", "dst", F.lit("CITES").alias("type"))
    ids = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return G.sample_neighbourhood(ids, cites, 5, {"CITES": 5})


# --- sets ---------------------------------------------------------------------------


@query("set01_merge", """
  SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b, name) AS rn FROM (
    SELECT s_suppkey AS id, s_name AS name, 0 AS b FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer)) WHERE rn = 1""")
def set01(spark, sf):
    return S.merge_batches([
        V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
    ], ["id"])


@query("set02_ordered_union", """
  SELECT id, list_extract(min(x), 1)::INTEGER AS part, list_extract(min(x), 2)::BIGINT AS "at" FROM (
    SELECT l_suppkey AS id, [0, l_orderkey] AS x FROM lineitem UNION ALL SELECT o_custkey, [1, o_orderkey] FROM orders) GROUP BY 1""")
def set02(spark, sf):
    return S.ordered_union([
        V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("at")),
        V.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at")),
    ], "id", "at")


@query("set03_unvisited", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT l_suppkey FROM lineitem)")
def set03(spark, sf):
    return S.minus(V.table(spark, sf, "orders"), V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("o_custkey")), "o_custkey")


@query("set05_fallback", "SELECT o_orderkey AS id, 1 AS variant FROM orders WHERE o_orderstatus = 'P'")
def set05(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return S.first_non_empty([o.filter(f"o_orderstatus = '{s}'").select("id") for s in ("X", "P", "F")])


# --- upserts --------------------------------------------------------------------------
# A user state kept from events: stored before the 15th, updated by the later ones.

SPLIT = "2024-01-15 00:00:00"


def user_versions(spark, sf, later: bool):
    e = V.table(spark, sf, "events")
    cond = F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz")
    return e.filter(cond if later else ~cond).select("user_id", "event_type", "value", F.col("ts").alias("updated_at"), F.col("ts").alias("created_at"))


@query("ups01_upsert", """
  SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value, max(ts)::VARCHAR AS updated_at, min(ts)::VARCHAR AS created_at FROM events GROUP BY 1""")
def ups01(spark, sf):
    old = U.upsert(user_versions(spark, sf, False).limit(0), user_versions(spark, sf, False), ["user_id"], ["event_type", "value"], "updated_at", "created_at")
    new = U.upsert(old, user_versions(spark, sf, True), ["user_id"], ["event_type", "value"], "updated_at", "created_at")
    return new.select("user_id", "event_type", "value", F.col("updated_at").cast("string").alias("updated_at"), F.col("created_at").cast("string").alias("created_at"))


@query("ups02_keys", """
  WITH k AS (SELECT s_name AS name, row_number() OVER (ORDER BY s_name) AS id FROM supplier)
  SELECT name, id FROM k UNION ALL SELECT c_name, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY c_name) FROM customer""")
def ups02(spark, sf):
    none = V.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit(0).cast("long").alias("id")).limit(0)
    known = cut(U.assign_keys(none, V.table(spark, sf, "supplier").select(F.col("s_name").alias("name")), "name", "id"), "keys")
    return U.assign_keys(known, V.table(spark, sf, "customer").select(F.col("c_name").alias("name")), "name", "id")


@query("ups03_seen_range", "SELECT user_id, min(ts)::VARCHAR AS first_seen, max(ts)::VARCHAR AS last_seen FROM events GROUP BY 1")
def ups03(spark, sf):
    old = user_versions(spark, sf, False).groupBy("user_id").agg(F.min("updated_at").alias("first_seen"), F.max("updated_at").alias("last_seen"))
    out = U.seen_range(old, user_versions(spark, sf, True), ["user_id"], "updated_at")
    return out.select("user_id", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))


FRONTIER = """
  SELECT id, min(depth)::INTEGER AS depth, coalesce(max(status), 'pending') AS status FROM (
    SELECT l_suppkey AS id, l_linenumber AS depth, 'completed' AS status FROM lineitem WHERE l_linenumber > 3
    UNION ALL SELECT o_custkey, 2, NULL FROM orders) GROUP BY 1
"""


def frontier(spark, sf):
    old = V.table(spark, sf, "lineitem").filter("l_linenumber > 3").select(
        F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("depth"), F.lit("completed").alias("status"))
    new = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit(2).alias("depth"))
    return U.frontier_upsert(old, new, ["id"])


@query("ups04_frontier_min", FRONTIER)
def ups04(spark, sf):
    return frontier(spark, sf)


@query("ups05_pending", f"""
  SELECT id, depth, CASE WHEN id IN (SELECT s_suppkey FROM supplier) THEN 'failed' ELSE status END AS status FROM ({FRONTIER})
  WHERE status = 'pending' AND id NOT IN (SELECT s_suppkey FROM supplier) ORDER BY depth, id LIMIT 100""")
def ups05(spark, sf):
    done = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return U.pending(U.frontier_transition(frontier(spark, sf), done, "id", "failed"), "id", 100)


@query("ups06_doi_dedup", """
  SELECT doc_id, coalesce(min(doc_id) OVER (PARTITION BY md5(text)), doc_id) AS canonical_id FROM documents""")
def ups06(spark, sf):
    return U.doi_mapping(V.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("doi")), "doc_id", "doi")


@query("ups07_soft_delete", """
  SELECT c_custkey, max(ts)::VARCHAR AS deleted_at, max(ts) IS NOT NULL AS is_deleted FROM customer
  LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') ON user_id = c_custkey GROUP BY 1""")
def ups07(spark, sf):
    gone = V.table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey"), "ts")
    out = U.soft_delete(V.table(spark, sf, "customer").select("c_custkey"), gone, ["c_custkey"], "ts")
    return out.select("c_custkey", F.col("deleted_at").cast("string").alias("deleted_at"), "is_deleted")


@query("ups08_reuse", """
  SELECT source AS corpus_id, count(DISTINCT doc_id) AS n_works FROM documents WHERE source = 'src3' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 0.8 * 10""")
def ups08(spark, sf):
    d = V.table(spark, sf, "documents")
    corpora = d.select(F.col("source").alias("corpus_id")).distinct().withColumn("query_hash", F.substring(F.sha2("corpus_id", 256), 1, 32))
    import hashlib

    wanted = hashlib.sha256(b"src3").hexdigest()[:32]
    out = U.reusable_corpus(corpora, d.select(F.col("source").alias("corpus_id"), F.col("doc_id").alias("work_id")), wanted, 10)
    return out.select("corpus_id", "n_works")


@query("ups10_skip_unchanged", """
  SELECT doc_id, left(sha256(text), 32) AS content_hash FROM documents WHERE lang IS DISTINCT FROM 'en'""")
def ups10(spark, sf):
    """English texts are stored as they are, French ones in an older form, others not at all."""
    d = V.table(spark, sf, "documents")
    now = d.select("doc_id", F.substring(F.sha2("text", 256), 1, 32).alias("content_hash"))
    older = F.when(F.col("lang") == "fr", F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    stored = d.filter("lang IN ('en', 'fr')").select("doc_id", F.substring(F.sha2(older, 256), 1, 32).alias("content_hash"))
    return U.changed_content(now, stored, ["doc_id"])


# --- search documents -----------------------------------------------------------------


WORK_DOCS_SQL = f"""
  WITH au AS (SELECT work_id, string_agg(author_id::VARCHAR, ',' ORDER BY author_order, author_id) AS a, count(*) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY author_order, author_id) AS rn FROM ({V.WORK_AUTHORS_SQL})) WHERE rn <= [authors] GROUP BY 1),
    co AS (SELECT work_id, string_agg(concept || ':' || score, ',' ORDER BY score DESC, concept) AS c FROM (
        SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, concept) AS rn FROM ({V.WORK_CONCEPTS_SQL})) WHERE rn <= [concepts] GROUP BY 1),
    ii AS (SELECT work_id, string_agg(n_name, ',' ORDER BY n_name, n_nationkey) AS i FROM (
        SELECT DISTINCT l_orderkey AS work_id, n_nationkey, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) GROUP BY 1)
  SELECT o_orderkey AS work_id, coalesce(a, '') AS authors, coalesce(n, 0)::INTEGER AS n_authors, coalesce(c, '') AS concepts, coalesce(i, '') AS institutions,
    c_mktsegment AS venues, 'Order ' || o_orderkey || ' ' || o_orderpriority AS full_text
  FROM orders LEFT JOIN au ON au.work_id = o_orderkey LEFT JOIN co ON co.work_id = o_orderkey LEFT JOIN ii ON ii.work_id = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey"""


def work_docs(spark, sf, **caps):
    t = lambda n: V.table(spark, sf, n)
    works = t("orders").select(F.col("o_orderkey").alias("work_id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.col("o_orderpriority").alias("abstract"))
    authors = V.work_authors(spark, sf).withColumn("name", F.col("author_id").cast("string"))
    inst = inst_links(spark, sf).select("work_id", "institution_id").distinct().join(
        t("nation").select(F.col("n_nationkey").alias("institution_id"), F.col("n_name").alias("name")), "institution_id")
    venues = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("work_id"), F.col("c_mktsegment").alias("name"), F.lit(True).alias("is_primary"))
    d = D.work_documents(works, authors, V.work_concepts(spark, sf), inst, venues, **caps)
    return d.select(
        "work_id", F.array_join("authors.name", ",").alias("authors"), F.size("authors").alias("n_authors"),
        F.array_join(F.transform("concepts", lambda c: F.concat_ws(":", c["concept"], c["score"])), ",").alias("concepts"),
        F.array_join("institutions.name", ",").alias("institutions"), F.array_join("venues.name", ",").alias("venues"), "full_text",
    )


@query("idx01_work_docs", WORK_DOCS_SQL.replace("rn <= [authors]", "true").replace("rn <= [concepts]", "true"))
def idx01(spark, sf):
    return work_docs(spark, sf)


@query("idx01_capped", WORK_DOCS_SQL.replace("[authors]", "2").replace("[concepts]", "20"))
def idx01_capped(spark, sf):
    """The lists cut as a search index may want them."""
    return work_docs(spark, sf, max_authors=2, max_concepts=20)


@query("idx02_author_docs", V.with_graph(f"""
  , wa AS (SELECT DISTINCT author_id, work_id FROM ({V.WORK_AUTHORS_SQL})), n AS (SELECT dst, count(*) AS c FROM citations GROUP BY 1),
    k AS (SELECT author_id, count(*) AS w, coalesce(sum(c), 0)::BIGINT AS c FROM wa LEFT JOIN n ON dst = work_id GROUP BY 1),
    ar AS (SELECT author_id, string_agg(concept, ',' ORDER BY total_score DESC, concept) AS a FROM ({AREAS_SQL}) GROUP BY 1)
  SELECT s_suppkey AS author_id, s_name AS name, coalesce(w, 0) AS works_count, coalesce(c, 0) AS cited_by_count, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey END AS current_institution,
    coalesce(a, '') AS research_areas FROM supplier LEFT JOIN k ON k.author_id = s_suppkey LEFT JOIN ar ON ar.author_id = s_suppkey"""))
def idx02(spark, sf):
    s = V.table(spark, sf, "supplier")
    aff = s.select(F.col("s_suppkey").alias("author_id"), F.col("s_nationkey").alias("institution_id"), (F.col("s_suppkey") % 3 == 0).alias("is_current"))
    d = D.author_documents(s.select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name")), V.work_authors(spark, sf),
                           cites_named(spark, sf), V.work_concepts(spark, sf), aff)
    return d.withColumn("research_areas", F.array_join("research_areas", ","))


@query("idx03_venue_docs", """
  SELECT c_mktsegment AS venue_id, count(DISTINCT o_orderkey) AS works_count, false AS is_deleted FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def idx03(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("venue_id"))
    links = V.table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("venue_id", F.col("o_orderkey").alias("work_id"))
    return D.venue_documents(c.select("venue_id").distinct(), links)


@query("idx04_institution_docs", """
  SELECT n_nationkey AS institution_id, n_name AS name, n_regionkey AS country_code, r_name AS country, count(DISTINCT l_orderkey) AS works_count,
    count(DISTINCT l_suppkey) AS authors_count, false AS is_deleted
  FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4""")
def idx04(spark, sf):
    inst = V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("institution_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("country_code"))
    country = V.table(spark, sf, "region").select(F.col("r_regionkey").alias("country_code"), F.col("r_name").alias("country"))
    return D.institution_documents(inst, inst_links(spark, sf), country)


def bm25_sql(terms: list[str], fields: dict[str, tuple[str, float]], key: str, source: str, k: int) -> str:
    parts = []
    for f, (expr, boost) in fields.items():
        for t in terms:
            parts.append(
                f"SELECT {key}, '{f}' AS f, {boost} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgl)) AS s FROM ("
                f"SELECT {key}, len, tf, count(*) OVER () AS n, count(*) FILTER (tf > 0) OVER () AS df, avg(len) OVER () AS avgl FROM ("
                f"SELECT {key}, len(tk) AS len, len(list_filter(tk, lambda x: x = '{t}')) AS tf FROM (SELECT {key}, regexp_extract_all(lower({expr}), '[A-Za-z0-9_]+|[一-鿿]') AS tk FROM {source})))"
            )
    union = " UNION ALL ".join(parts)
    return (f"SELECT {key}, round(max(s), 6) AS score FROM (SELECT {key}, f, sum(s) AS s FROM ({union}) GROUP BY 1, 2) GROUP BY 1"
            f" HAVING round(max(s), 6) > 0 ORDER BY score DESC, {key} LIMIT {k}")


@query("idx06_search", bm25_sql(["the", "question", "le", "de", "src3", "fr"], {"title": ("source", 3.0), "abstract": ("text", 1.0), "concepts": ("lang", 2.0)}, "doc_id", "documents", 50))
def idx06(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("concepts"))
    return D.bm25_search(spread(d), "doc_id", D.BOOSTS, "The question le de src3 fr", 50)


@query("idx05_sync", """
  SELECT o_orderkey AS work_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new ' ELSE 'old ' END || o_orderpriority AS title, true AS same FROM orders WHERE o_orderkey % 2 = 0""")
def idx05(spark, sf):
    """Two batches, the second synced twice: the index holds each document once, in its last form."""
    path = new_table_path(spark, "index")
    orders = V.table(spark, sf, "orders")
    form = lambda w, n: orders.filter(n).select(F.col("o_orderkey").alias("work_id"), F.concat(F.lit(w), "o_orderpriority").alias("title"))
    first, second = form("old ", "o_orderkey % 2 = 0"), form("new ", "o_orderkey % 4 = 0")
    D.sync_documents(first, path, "work_id", batch="9")
    counts = [D.sync_documents(second, path, "work_id", batch="10") for _ in range(2)]
    return D.synced_documents(spark, path, first.schema, "work_id").withColumn("same", F.lit(counts[0] == counts[1]))
