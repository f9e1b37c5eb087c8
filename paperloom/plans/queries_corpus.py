"""Corpus and expansion queries (CRP-*, BFS-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import corpus as C
from paperloom.plans import views as V
from paperloom.plans.registry import query
from paperloom.session import cut, spread

REFS = f"refs AS MATERIALIZED ({V.REF_LINKS_SQL})"
QUESTION = "the question LE other"
TERMS = sorted(set(QUESTION.lower().split()))


def doc_works(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("work_id"), F.col("source").alias("title"), F.col("text").alias("abstract"), F.col("n_chars").alias("cited_by_count"))


def score_sql(terms, text):
    return " + ".join(f"contains(lower({text}), '{t}')::INTEGER" for t in terms)


SEARCH_SQL = f"SELECT doc_id AS work_id, ({score_sql(TERMS, chr(39) + chr(39) + ' || source || ' + chr(39) + ' ' + chr(39) + ' || text')})::INTEGER AS score, n_chars FROM documents ORDER BY score DESC, n_chars DESC, doc_id LIMIT 30"


@query("crp01_search", f"SELECT work_id, score FROM ({SEARCH_SQL})")
def crp01(spark, sf):
    return C.search_works(doc_works(spark, sf), QUESTION, 30).select("work_id", "score")


@query("crp02_field_corpus", f"""
  SELECT 'field_' || left(sha256('"{QUESTION}|30"'), 12) AS corpus_id, work_id, 'field_query' AS membership_source FROM ({SEARCH_SQL})""")
def crp02(spark, sf):
    return C.field_corpus(doc_works(spark, sf), QUESTION, ["question"], 30)[1]


def seeds(spark, sf):
    """Search hits start the walk: the 40 dearest orders."""
    o = V.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)
    return cut(o.select(F.col("o_orderkey").alias("work_id")), "seeds")


SEEDS = "seeds AS MATERIALIZED (SELECT o_orderkey AS work_id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)"


def works(spark, sf):
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_totalprice").alias("score"))


@query("crp03_references", f"""
  WITH {REFS}, {SEEDS} SELECT work_id, pos::INTEGER AS pos, ref_id FROM refs WHERE work_id IN (FROM seeds) AND pos < 2 AND ref_id IN (SELECT o_orderkey FROM orders)""")
def crp03(spark, sf):
    return C.expand_references(V.ref_links(spark, sf), works(spark, sf), seeds(spark, sf), 2)


@query("crp04_citing", f"""
  WITH {REFS}, {SEEDS} SELECT seed, citing_id, position::INTEGER AS position FROM (SELECT ref_id AS seed, work_id AS citing_id,
    row_number() OVER (PARTITION BY ref_id ORDER BY work_id) AS position FROM (SELECT DISTINCT ref_id, work_id FROM refs) WHERE ref_id IN (FROM seeds)) WHERE position <= 3""")
def crp04(spark, sf):
    return C.citing_works(V.ref_links(spark, sf), seeds(spark, sf), 3)


@query("crp05_get_work", "SELECT o_orderkey AS work_id, o_totalprice AS score FROM orders WHERE o_orderkey = 77")
def crp05(spark, sf):
    return C.get_work(works(spark, sf), 77)


LINEAGE_SQL = f"""
  WITH {REFS}, s AS (SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1),
  cit AS MATERIALIZED (SELECT ref_id, work_id, row_number() OVER (PARTITION BY ref_id ORDER BY work_id) AS p FROM (SELECT DISTINCT ref_id, work_id FROM refs)),
  e1 AS (SELECT ref_id AS id, [0, pos] AS path FROM refs JOIN s ON work_id = id UNION ALL SELECT work_id, [1, p] FROM cit JOIN s ON ref_id = id WHERE p <= 25),
  l1 AS MATERIALIZED (SELECT e1.id, min(path) AS path FROM e1 WHERE id NOT IN (FROM s) AND id IN (SELECT o_orderkey FROM orders) GROUP BY 1),
  e2 AS (SELECT ref_id AS id, list_concat(path, [0, pos]) AS path FROM refs JOIN l1 ON work_id = id UNION ALL SELECT work_id, list_concat(path, [1, p]) FROM cit JOIN l1 ON ref_id = id WHERE p <= 25),
  l2 AS (SELECT e2.id, min(path) AS path FROM e2 WHERE id NOT IN (FROM s) AND id NOT IN (SELECT id FROM l1) AND id IN (SELECT o_orderkey FROM orders) GROUP BY 1)
  SELECT id AS work_id, 0 AS depth, 'seed' AS source, '' AS place FROM s UNION ALL
  SELECT id, 1, CASE WHEN path[1] = 0 THEN 'reference_depth_1' ELSE 'citing_depth_1' END, array_to_string(path, '.') FROM l1 UNION ALL
  SELECT id, 2, CASE WHEN path[3] = 0 THEN 'reference_depth_2' ELSE 'citing_depth_2' END, array_to_string(path, '.') FROM l2
"""


@query("crp06_lineage", LINEAGE_SQL)
def crp06(spark, sf):
    seed = V.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").first()["o_orderkey"]
    out = C.seed_lineage(V.ref_links(spark, sf), works(spark, sf), seed, size=2000, max_references=50, max_citers=25)
    return out.select("work_id", "depth", "source", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("place"))


def bfs_sql(depth: int, ref_fan: int, cite_fan: int, target: int, batch: int, cap: int) -> str:
    parts = [
        REFS, SEEDS,
        "cit AS MATERIALIZED (SELECT ref_id, work_id, row_number() OVER (PARTITION BY ref_id ORDER BY work_id) AS p FROM (SELECT DISTINCT ref_id, work_id FROM refs))",
        "f0 AS MATERIALIZED (SELECT work_id, row_number() OVER (ORDER BY work_id) AS nth FROM seeds)",
        "k0 AS (SELECT work_id FROM f0)",
    ]
    done = "0"
    for d in range(depth + 1):
        parts.append(f"y{d} AS MATERIALIZED (SELECT work_id, nth FROM f{d} WHERE nth <= {target} - ({done}) AND work_id IN (SELECT o_orderkey FROM orders))")
        parts.append(f"m{d} AS MATERIALIZED (SELECT work_id FROM f{d} WHERE nth <= {target} - ({done}) AND work_id NOT IN (SELECT o_orderkey FROM orders))")
        done += f" + (SELECT count(*) FROM y{d})"
        if d == depth:
            break
        n = d + 1
        known = " UNION ALL ".join(f"SELECT work_id FROM k{i}" for i in range(n))
        parts += [
            f"e{d} AS MATERIALIZED (SELECT r.work_id AS src, ref_id AS dst, 'references' AS type, ref_id AS nx, [(nth - 1) // {batch}, 0, nth, pos] AS ord FROM refs r JOIN y{d} y ON y.work_id = r.work_id WHERE pos < {ref_fan}"
            f" UNION ALL SELECT c.work_id, c.ref_id, 'cites', c.work_id, [(nth - 1) // {batch}, 1, nth, p] FROM cit c JOIN y{d} y ON y.work_id = c.ref_id WHERE p <= {cite_fan})",
            f"a{n} AS (SELECT nx AS work_id, min(ord) AS ord FROM e{d} WHERE nx NOT IN ({known}) GROUP BY 1)",
            f"b{n} AS MATERIALIZED (SELECT work_id, nth FROM (SELECT work_id, row_number() OVER (ORDER BY ord) AS nth FROM a{n}) WHERE nth <= {target} - ({done}))",
            f"k{n} AS (SELECT work_id FROM b{n})",
            f"p{n} AS (SELECT b.work_id, b.nth, coalesce(o_totalprice, 0) AS sc FROM b{n} b LEFT JOIN orders ON o_orderkey = b.work_id)",
            f"f{n} AS MATERIALIZED (SELECT work_id, CASE WHEN (SELECT count(*) FROM b{n}) > {cap} THEN rk ELSE nth END AS nth FROM (SELECT *, row_number() OVER (ORDER BY sc DESC, nth) AS rk FROM p{n}) WHERE rk <= {cap})",
        ]
    return "WITH " + ", ".join(parts)


BFS = bfs_sql(3, 2, 1, 250, 10, 60)


def run_bfs(spark, sf):
    return C.layered_bfs(
        cut(V.ref_links(spark, sf), "refs"), cut(works(spark, sf), "works"), seeds(spark, sf),
        max_depth=3, reference_fanout=2, citing_fanout=1, target=250, batch=10, max_frontier=60,
    )


@query("bfs01_layers", BFS + " " + " UNION ALL ".join(f"SELECT work_id, {d} AS depth, nth FROM y{d}" for d in range(4)))
def bfs01(spark, sf):
    return run_bfs(spark, sf).all("layer").filter("held").select("work_id", "depth", "nth")


@query("bfs02_edges", BFS + " " + " UNION ALL ".join(f"SELECT src, dst, type, {d} AS depth FROM e{d}" for d in range(3)))
def bfs02(spark, sf):
    return run_bfs(spark, sf).all("edges").select("src", "dst", "type", "depth")


@query("bfs07_statistics", BFS + " SELECT depth, works, coalesce(missing, 0) AS missing, coalesce(r, 0) AS reference_edges, coalesce(c, 0) AS citing_edges FROM (" + " UNION ALL ".join(
    f"SELECT {d} AS depth, (SELECT count(*) FROM y{d}) AS works, (SELECT count(*) FROM m{d}) AS missing,"
    + (f" (SELECT count(*) FROM e{d} WHERE type = 'references') AS r, (SELECT count(*) FROM e{d} WHERE type = 'cites') AS c" if d < 3 else " 0 AS r, 0 AS c")
    for d in range(4)) + ")")
def bfs07(spark, sf):
    return C.crawl_statistics(run_bfs(spark, sf))


@query("bfs03_score", V.with_flat("""
  , m AS (SELECT o, sum(50 * CASE WHEN score = 0 THEN 1 ELSE score END) AS s FROM ft WHERE contains(lower(t_name), '7') AND NOT (source = 'concepts') GROUP BY 1)
  SELECT 'W' || o_orderkey AS work_id, round((o_orderkey % 100) + CASE WHEN o_orderkey % 20 <> 0 AND contains('order ' || o_orderkey, '7') THEN 100 ELSE 0 END + coalesce(s, 0), 6)::DOUBLE AS score
  FROM orders LEFT JOIN m ON m.o = o_orderkey""", "ft"))
def bfs03(spark, sf):
    w = V.raw_works(spark, sf)
    score = C.frontier_score(F.col("cited_by_count"), F.col("title"), F.col("topics"), "7")
    return w.select(F.substring_index("id", "/", -1).alias("work_id"), F.round(score, 6).alias("score"))


FILL = f"""
  WITH {REFS}, h0 AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'),
  h1 AS MATERIALIZED (SELECT DISTINCT ref_id AS id FROM refs WHERE work_id IN (FROM h0) AND ref_id NOT IN (FROM h0) AND ref_id IN (SELECT o_orderkey FROM orders)),
  h2 AS MATERIALIZED (SELECT DISTINCT ref_id AS id FROM refs WHERE work_id IN (FROM h0 UNION ALL FROM h1) AND ref_id NOT IN (FROM h0 UNION ALL FROM h1) AND ref_id IN (SELECT o_orderkey FROM orders)),
  f AS MATERIALIZED (SELECT id, 0 AS level FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)
"""


def fill(spark, sf):
    cites = cut(V.ref_links(spark, sf).select(F.col("work_id").alias("citing_work_id"), F.col("ref_id").alias("cited_work_id")), "cites")
    held = V.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("work_id"))
    return cites, C.citation_fill(cites, works(spark, sf), held, 2, 50)


@query("bfs06_fill", FILL + " SELECT id AS work_id, level FROM f")
def bfs06(spark, sf):
    return fill(spark, sf)[1]


@query("bfs06_fill_stats", FILL + """
  SELECT count(*) AS total_citations, count(*) FILTER (ref_id IN (SELECT id FROM f)) AS resolved_citations, (SELECT count(*) FROM f WHERE level > 0) AS works_from_citations
  FROM refs WHERE work_id IN (SELECT id FROM f)""")
def bfs06s(spark, sf):
    return C.fill_statistics(*fill(spark, sf))
