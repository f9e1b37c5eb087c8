"""Cleaning-rule queries (CLN-*, FLT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import clean as C
from paperloom.functions import fixed
from paperloom.functions import text as X
from paperloom.plans import views as V
from paperloom.plans.registry import query

BLANKS = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


@query("cln01_ids", """
  SELECT page_id, regexp_extract(regexp_replace(trim(url), '/+$', ''), '[^/]*$') AS tail_id,
         nullif(regexp_extract(url, '[^/]*$'), '') AS loose_id FROM pages""")
def cln01(spark, sf):
    url = F.concat(F.lit(" "), "url", F.lit("/ "))
    return V.table(spark, sf, "pages").select(
        "page_id", C.normalize_id(url).alias("tail_id"), C.entity_id(F.col("url"), False).alias("loose_id")
    )


@query("cln03_strings", f"""
  SELECT doc_id, left(nullif({strip_sql("text")}, ''), 256) AS short_text,
         nullif({strip_sql("CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END")}, '') AS source FROM documents""")
def cln03(spark, sf):
    src = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("source"))
    return V.table(spark, sf, "documents").select(
        "doc_id", C.clean_string(F.col("text"), C.LENGTHS["author"]).alias("short_text"),
        C.clean_string(src).alias("source"),
    )


@query("cln04_identifiers", """
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'https://orcid.org/0000-0001-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '-123X' END AS orcid_url,
    CASE WHEN o_orderkey % 3 <> 0 THEN '0000-0001-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '-123X' END AS orcid,
    '10.1/' || o_custkey AS doi,
    CASE o_orderkey % 2 WHEN 0 THEN '1234-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') ELSE 'ISSN ' || (o_orderkey % 100) END AS issn,
    left(upper(o_orderpriority), 2) AS country
  FROM orders""")
def cln04(spark, sf):
    o = F.col("o_orderkey")
    four = F.lpad((o % 10000).cast("string"), 4, "0")
    orcid = F.when(o % 3 != 0, F.concat(F.lit(" see orcid.org/0000-0001-"), four, F.lit("-123X ")))
    prefix = F.when(o % 4 == 0, "https://DOI.org/").when(o % 4 == 1, "doi:").when(o % 4 == 2, "http://doi.org/").otherwise("")
    issn = F.when(o % 2 == 0, F.concat(F.lit("1234 "), four)).otherwise(F.concat(F.lit("issn "), o % 100))
    return V.table(spark, sf, "orders").select(
        o.alias("id"), C.clean_orcid(orcid).alias("orcid_url"), C.clean_orcid(orcid, "bare").alias("orcid"),
        C.clean_doi(F.concat(prefix, F.lit("10.1/"), "o_custkey")).alias("doi"),
        C.clean_issn(issn).alias("issn"), C.country2(F.lower("o_orderpriority")).alias("country"),
    )


@query("cln06_dates", """
  SELECT o_orderkey AS id, CASE o_orderkey % 4
      WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01')
      WHEN 2 THEN strftime(o_orderdate, '%Y-01-01') END AS day FROM orders""")
def cln06(spark, sf):
    o = F.col("o_orderkey")
    text = (
        F.when(o % 4 == 0, F.date_format("o_orderdate", "yyyy-M-d")).when(o % 4 == 1, F.date_format("o_orderdate", "yyyy-MM"))
        .when(o % 4 == 2, F.date_format("o_orderdate", "yyyy")).otherwise("soon")
    )
    return V.table(spark, sf, "orders").select(
        o.alias("id"), F.date_format(C.parse_partial_date(text), "yyyy-MM-dd").alias("day")
    )


@query("cln09_abstract", "SELECT conv_id, turn, concat_ws(' ', role, 'said', role, (turn % 7)::VARCHAR) AS abstract FROM conversations")
def cln09(spark, sf):
    index = F.create_map(
        F.col("role"), F.array(F.lit(2), F.lit(0)), F.lit("lost"), F.array(F.lit(1)), F.lit("said"), F.array(F.lit(1)),
        (F.col("turn") % 7).cast("string"), F.array(F.lit(3)),
    )
    return V.table(spark, sf, "conversations").select("conv_id", "turn", C.abstract_text(index).alias("abstract"))


@query("cln14_hash_ids", """
  SELECT doc_id, left(sha256('{"lang": "' || lang || '", "n": ' || n_chars || ', "text": ' || to_json(text) || '}'), 14) AS stable_id,
         left(sha256(text), 32) AS content_id, sha1(text) AS sha1_id, left(md5(text), 16) AS md5_id,
         left(trim(regexp_replace(trim(text), '[^0-9A-Za-z_\\-一-鿿]+', '_', 'g'), '_'), 80) AS slug FROM documents""")
def cln14(spark, sf):
    text = F.col("text")
    key = X.stable_hash({"text": X.json_text(text), "lang": X.json_text(F.col("lang")), "n": F.col("n_chars").cast("string")}, 14)
    return V.table(spark, sf, "documents").select(
        "doc_id", key.alias("stable_id"), X.content_hash(text).alias("content_id"), F.sha1("text").alias("sha1_id"),
        F.substring(F.md5("text"), 1, 16).alias("md5_id"), C.slugify(text).alias("slug"),
    )


@query("cln16_index_values", """
  SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_text,
         round(value, 2)::DOUBLE AS amount, event_type AS raw FROM events""")
def cln16(spark, sf):
    e = V.table(spark, sf, "events").select(
        "event_id", "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
        F.col("value").cast("decimal(12,2)").alias("amount"), F.encode("event_type", "UTF-8").alias("raw"),
    )
    return C.normalise_for_index(e)


@query("cln17_flat_props", """
  SELECT c_custkey::VARCHAR AS c_custkey,
    '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"tags":["' || c_mktsegment || '"]}' AS props,
    '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"tags":["' || c_mktsegment || '"],"nested":{"seg":"' || c_mktsegment || '"}}' AS properties_json
  FROM customer""")
def cln17(spark, sf):
    rec = V.table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", F.array("c_mktsegment").alias("tags"),
        F.struct(F.col("c_mktsegment").alias("seg")).alias("nested"),
    )
    return C.flat_props(rec, ["c_custkey"])


TOKENS_SQL = "regexp_extract_all(lower({0}), '[A-Za-z0-9_]+|[一-鿿]')"
_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.QUESTION_STOP_WORDS) + "]"
_KEEP = f"list_filter({TOKENS_SQL}, lambda t: NOT list_contains({_STOP}, t) AND NOT regexp_full_match(t, '[一-鿿]') AND (length(t) > 1 OR regexp_full_match(t, '[0-9]')))"
_PHRASES = r"array_to_string(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\-]*(?:\s+[A-Za-z][A-Za-z0-9_\-]*){0,4}'), ' ')"

KEYWORDS_SQL = f"""
  SELECT item_id, text, list_slice(list_filter(allk, lambda k, i: list_position(allk, k) = i), 1, 12) AS kw FROM (
    SELECT item_id, text, list_concat({_KEEP.format(_PHRASES)}, {_KEEP.format("text")}) AS allk FROM benchmark)
"""


@query("cln20_keywords", f"""
  SELECT item_id, array_to_string(kw, ' ') AS keywords, left(array_to_string(list_slice(kw, 1, 6), ' '), 240) AS primary_query,
    array_to_string(list_filter([CASE WHEN len(kw) > 3 THEN left(array_to_string(list_slice(kw, 1, 3), ' '), 240) END,
      CASE WHEN len(kw) > 6 THEN left(array_to_string(list_slice(kw, 4, 9), ' '), 240) END], lambda x: x IS NOT NULL), ' | ') AS alternates
  FROM ({KEYWORDS_SQL})""")
def cln20(spark, sf):
    q = V.table(spark, sf, "benchmark").select("item_id", X.keywords(F.col("text")).alias("kw"))
    return q.select(
        "item_id", F.array_join("kw", " ").alias("keywords"), X.primary_query(F.col("kw")).alias("primary_query"),
        F.array_join(X.alternate_queries(F.col("kw")), " | ").alias("alternates"),
    )


@query("cln21_perspectives", f"""
  SELECT item_id, name, text || ' ' || name AS retrieval_question,
    array_to_string(list_append(list_slice(kw, 1, 6), name), ' ') AS words,
    CASE WHEN name = 'applications' THEN 0 ELSE 2 END AS n_exclude,
    CASE WHEN name = 'recent trends' THEN 'recent 5 years' ELSE 'all years' END AS time_range
  FROM ({KEYWORDS_SQL}), (SELECT unnest([{", ".join(f"'{p}'" for p in fixed.PERSPECTIVES)}]) AS name)""")
def cln21(spark, sf):
    q = V.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), X.keywords(F.col("text")).alias("keywords"))
    return C.perspectives(q).select(
        "item_id", "name", "retrieval_question", F.array_join("facet_keywords", " ").alias("words"),
        F.size("exclude_terms").alias("n_exclude"), "time_range",
    )


@query("flt02_plan_filter", V.with_flat("""
  SELECT count(*) AS n, sum(o) AS key_sum FROM (SELECT DISTINCT o FROM ft WHERE source = 'topics' AND concept_id IN ('T3', 'T8'))
  JOIN orders ON o_orderkey = o WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND o % 3 = 0""", "ft").replace("sum(o)", "sum(o)::BIGINT"))
def flt02(spark, sf):
    """FLT-02 and FLT-08: works by topic, years and type, counted."""
    w = V.raw_works(spark, sf)
    hit = C.matches_plan(
        F.transform("topics", lambda t: F.struct(C.entity_id(t["id"]).alias("id"))),
        F.col("publication_year"), F.col("type"), ["T3", "T8"], (1996, 1999), "article",
    )
    return w.filter(hit).agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("key_sum"))


@query("flt04_incremental", "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def flt04(spark, sf):
    return C.updated_since(V.table(spark, sf, "events"), "2024-01-20 00:00:00", "ts").select("event_id", "user_id")


@query("flt03_by_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def flt03(spark, sf):
    ids = V.table(spark, sf, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.by_ids(V.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ids, "o_orderkey")


@query("flt01_validity", """
  SELECT CASE WHEN doc_id % 3 = 0 THEN 'source' WHEN doc_id % 4 = 0 THEN 'lang' ELSE '' END AS reason, count(*) AS n
  FROM (SELECT doc_id FROM documents) GROUP BY 1""")
def flt01(spark, sf):
    d = V.table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"),
        F.when((F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 4 != 0), F.col("lang")).otherwise("").alias("lang"),
    )
    good, bad = C.split_valid(d, ["source", "lang"])
    both = good.select(F.lit("").alias("reason")).unionByName(bad.select(F.col("reject_reason").alias("reason")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("flt06_boolean_search", f"""
  SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND n_chars >= 1000 AND source = 'src3'""")
def flt06(spark, sf):
    d = V.table(spark, sf, "documents").withColumn("venues", F.array(F.struct(F.col("source").alias("name"))))
    return d.filter(C.search_filter(F.col("text"), ["the"], F.col("n_chars"), 1000, F.col("venues"), "src3")).select("doc_id")


@query("flt07_quality", r"""
  SELECT doc_id, round(length(regexp_replace(text, '[\p{C}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')
      || regexp_replace(text, '[^\n\r\t]', '', 'g')) / greatest(length(text), 1), 6) AS ratio FROM documents
  WHERE length(text) >= 50 AND length(regexp_replace(text, '[\p{C}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')
      || regexp_replace(text, '[^\n\r\t]', '', 'g')) / greatest(length(text), 1) >= 0.7""")
def flt07(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").filter(X.quality_ok(t)).select(
        "doc_id", F.round(X.printable_ratio(t), 6).alias("ratio")
    )
