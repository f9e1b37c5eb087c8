"""Entity and link queries (ENT-*, LNK-*): nested records read back, checked on flat rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import clean as C
from paperloom.operators import batch as B
from paperloom.operators import entities as E
from paperloom.plans import views as V
from paperloom.plans.registry import query
from paperloom.session import cut
from paperloom.sources.works import parse_works_checked


@query("ent01_works", """
  SELECT 'W' || o_orderkey AS work_id, CASE WHEN o_orderkey % 20 <> 0 THEN 'Order ' || o_orderkey ELSE '(untitled)' END AS title,
    'order of order ' || o_orderpriority AS abstract, year(o_orderdate)::INTEGER AS publication_year,
    (o_orderkey % 100)::INTEGER AS cited_by_count, 'https://doi.org/10.5/' || o_orderkey AS doi,
    CASE o_orderkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'review' ELSE 'posted-content' END AS type_name FROM orders""")
def ent01(spark, sf):
    return E.works(V.raw_works(spark, sf)).select(
        "work_id", "title", "abstract", "publication_year", "cited_by_count", "doi", "type_name"
    )


@query("ent02_authors", V.with_flat("""
  SELECT author_id, 'Author ' || any_value(a) AS display_name,
    CASE WHEN any_value(a) % 4 = 0 THEN 'https://orcid.org/0000-0001-' || lpad((any_value(a) % 10000)::VARCHAR, 4, '0') || '-000X' END AS orcid
  FROM fa WHERE a_name IS NOT NULL GROUP BY author_id""", "fa"))
def ent02(spark, sf):
    return E.authors(V.raw_works(spark, sf))


@query("ent03_institutions", V.with_flat(
    "SELECT DISTINCT institution_id, i_name AS display_name, 'education' AS type, country_code, NULL::VARCHAR AS ror FROM fi", "fi"))
def ent03(spark, sf):
    return E.institutions(V.raw_works(spark, sf))


@query("ent04_concepts", V.with_flat("""
  SELECT concept_id, t_name AS display_name, level::INTEGER AS level, score::DOUBLE AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY o, pos) AS rn FROM ft) WHERE rn = 1""", "ft"))
def ent04(spark, sf):
    return E.concepts(V.raw_works(spark, sf))


@query("ent05_venues", """
  SELECT DISTINCT 'V' || v AS venue_id, 'Venue ' || v AS display_name, NULL::VARCHAR AS issn_l, '1234-' || lpad(v::VARCHAR, 4, '0') AS issn_print,
    v % 2 = 0 AS is_open_access FROM (SELECT o_custkey % 40 AS v FROM orders)""")
def ent05(spark, sf):
    return E.venues(V.raw_works(spark, sf)).select("venue_id", "display_name", "issn_l", "issn_print", "is_open_access")


@query("ent06_countries", V.with_flat("SELECT DISTINCT country_code FROM fi WHERE country_code IS NOT NULL", "fi"))
def ent06(spark, sf):
    return E.countries(V.raw_works(spark, sf), with_venues=True)


@query("ent07_work_types", "SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'review' ELSE 'posted-content' END AS type_name FROM orders")
def ent07(spark, sf):
    return E.work_types(V.raw_works(spark, sf))


@query("lnk01_work_authors", V.with_flat("""
  SELECT 'W' || o AS work_id, author_id, j::INTEGER AS author_order, j = 0 AS is_corresponding,
    CASE WHEN j = 0 THEN 'first' ELSE 'middle' END AS author_position FROM fa WHERE a_name IS NOT NULL""", "fa"))
def lnk01(spark, sf):
    return E.work_authors(V.raw_works(spark, sf))


@query("lnk02_author_inst", V.with_flat("SELECT DISTINCT author_id, institution_id FROM fi", "fi"))
def lnk02(spark, sf):
    return E.author_institutions(V.raw_works(spark, sf))


@query("lnk03_work_inst", V.with_flat("SELECT DISTINCT 'W' || o AS work_id, institution_id FROM fi", "fi"))
def lnk03(spark, sf):
    return E.work_institutions(V.raw_works(spark, sf))


@query("lnk04_affiliations", V.with_flat("""
  , s AS (SELECT *, CASE WHEN a % 5 <> 0 THEN 'Dept ' || (a % 7) END AS s1,
                 CASE WHEN a % 10 = 1 THEN 'Dept ' || (a % 7) ELSE 'Lab ' || (a % 3) END AS s2 FROM fi)
  SELECT 'W' || o AS work_id, author_id, institution_id, raw AS raw_affiliation_string, min(j)::INTEGER AS author_order
  FROM (SELECT o, author_id, institution_id, j, s1 AS raw FROM s WHERE s1 IS NOT NULL UNION ALL SELECT o, author_id, institution_id, j, s2 FROM s)
  GROUP BY 1, 2, 3, 4""", "fi").replace(") \n  , s AS", "), s AS").replace(")  \n  , s AS", "), s AS"))
def lnk04(spark, sf):
    return E.work_author_affiliations(V.raw_works(spark, sf))


@query("lnk05_work_concepts", V.with_flat(
    "SELECT 'W' || o AS work_id, concept_id, score::DOUBLE AS score, source FROM ft", "ft"))
def lnk05(spark, sf):
    return E.work_concepts(V.raw_works(spark, sf))


@query("lnk06_work_venues", """
  SELECT 'W' || o_orderkey AS work_id, 'V' || (o_custkey % 40) AS venue_id, true AS is_primary,
    'Vol.' || (o_orderkey % 9) || CASE WHEN o_orderkey % 2 = 0 THEN ', No.' || (o_orderkey % 4) ELSE '' END AS volume_issue,
    (o_orderkey % 300) || '-' || (o_orderkey % 300 + 8) AS pages FROM orders""")
def lnk06(spark, sf):
    return E.work_venues(V.raw_works(spark, sf)).select("work_id", "venue_id", "is_primary", "volume_issue", "pages")


@query("lnk07_citations", V.with_flat("SELECT * FROM fc", "fc"))
def lnk07(spark, sf):
    return E.citations(V.raw_works(spark, sf))


@query("lnk08_three_way", V.with_flat("""
  SELECT DISTINCT 'W' || o AS work_id, author_id, institution_id, (j + 1)::INTEGER AS author_order, j = 0 AS is_corresponding FROM fi""", "fi"))
def lnk08(spark, sf):
    return E.work_author_institutions(V.raw_works(spark, sf))


BATCH_COUNTS = V.with_flat("""
  SELECT 'works' AS table_name, count(*) AS row_count FROM orders UNION ALL
  SELECT 'authors', count(DISTINCT author_id) FROM fa WHERE a_name IS NOT NULL UNION ALL
  SELECT 'institutions', count(DISTINCT institution_id) FROM fi UNION ALL
  SELECT 'concepts', count(DISTINCT concept_id) FROM ft UNION ALL
  SELECT 'venues', count(DISTINCT o_custkey % 40) FROM orders UNION ALL
  SELECT 'countries', count(DISTINCT country_code) FROM fi UNION ALL
  SELECT 'work_types', count(DISTINCT o_orderkey % 3) FROM orders UNION ALL
  SELECT 'work_authors', count(*) FROM fa WHERE a_name IS NOT NULL UNION ALL
  SELECT 'author_institutions', count(*) FROM (SELECT DISTINCT author_id, institution_id FROM fi) UNION ALL
  SELECT 'work_institutions', count(*) FROM (SELECT DISTINCT o, institution_id FROM fi) UNION ALL
  SELECT 'work_author_affiliations', count(*) FROM (
    SELECT DISTINCT o, author_id, institution_id, CASE WHEN k = 0 THEN CASE WHEN a % 5 <> 0 THEN 'Dept ' || (a % 7) END
        WHEN a % 10 = 1 THEN 'Dept ' || (a % 7) ELSE 'Lab ' || (a % 3) END AS s
    FROM fi, (SELECT unnest([0, 1]) AS k)) WHERE s IS NOT NULL UNION ALL
  SELECT 'work_concepts', count(*) FROM ft UNION ALL
  SELECT 'work_venues', count(*) FROM orders UNION ALL
  SELECT 'citations', count(*) FROM fc""", "fa", "fi", "ft", "fc")


@query("lnk09_batch_counts", BATCH_COUNTS)
def lnk09(spark, sf):
    return B.batch_counts(V.raw_works(spark, sf))


@query("lnk09_stored_batch", BATCH_COUNTS)
def lnk09_stored(spark, sf):
    """Stored by one job; the rows of the tables as they are read back."""
    return E.batch_counts(B.store_batch(V.raw_works(spark, sf))[0])


@query("cln13_topic_rules", V.with_flat("""
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 THEN 'T' || ((o_custkey + 15) % 60)
      ELSE 'T' || (o_custkey % 60) END AS first5_topic,
    CASE WHEN o_orderkey % 17 = 0 THEN 1 WHEN o_orderkey % 13 = 0 THEN 0 ELSE 2 END AS n_key_present FROM orders""", "ft"))
def cln13(spark, sf):
    w = V.raw_works(spark, sf)
    first = C.topic_source(F.col("topics"), F.col("concepts"), "first5")
    present = C.topic_source(F.col("topics"), F.col("concepts"), "key_present")
    return w.select(
        F.col("seq").alias("id"), C.entity_id(F.get(first, F.lit(0))["id"]).alias("first5_topic"),
        F.size(present).alias("n_key_present"),
    )


@query("cln10_work_defaults", """
  SELECT 'W' || o_orderkey AS work_id, 'Order ' || o_orderkey AS title, '10.5/' || o_orderkey AS doi,
    strftime(o_orderdate, '%Y-%m-%d') AS day, 'https://doi.org/10.5/' || o_orderkey AS pdf FROM orders WHERE o_orderkey % 20 <> 0""")
def cln10(spark, sf):
    raw = V.raw_works(spark, sf)
    urls = E.with_work_id(raw).select("work_id", C.pdf_url(F.col("open_access.oa_url"), F.col("pdf_url"), F.col("doi")).alias("pdf"))
    rows = E.demo_work_row(raw).select("work_id", C.clean_string(F.col("title")).alias("title"), "doi", F.date_format("publication_date", "yyyy-MM-dd").alias("day"))
    # Sizes estimated from the compressed keys would have the driver hold one whole side.
    return rows.join(urls.hint("merge"), "work_id")


@query("lnk09_rejects", """
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN 'malformed' WHEN o_orderkey % 13 = 0 THEN 'missing id' ELSE 'work' END AS state FROM orders""")
def lnk09_rejects(spark, sf):
    """Records broken on purpose: each is a work or a reject with its reason."""
    lines = V.works_json(spark, sf).select("seq", "json")
    broken = (
        F.when(F.col("seq") % 11 == 0, F.expr("left(json, length(json) - 5)"))
        .when(F.col("seq") % 13 == 0, F.regexp_replace("json", '"id":"[^"]*W[0-9]+",', ""))
        .otherwise(F.col("json"))
    )
    works, rejects = parse_works_checked(cut(lines.select("seq", broken.alias("json")), "broken-lines"))
    return works.select("seq", F.lit("work").alias("state")).unionByName(rejects.select("seq", F.col("reason").alias("state")))
