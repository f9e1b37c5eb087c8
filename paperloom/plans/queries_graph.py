"""Graph queries (GRA-*, DSN-04, DSN-05) on the order citation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import clean as C
from paperloom.operators import communities as M
from paperloom.operators import entities as E
from paperloom.operators import graph as G
from paperloom.plans import views as V
from paperloom.plans.registry import query
from paperloom.session import cut


def pagerank_sql(rounds: int = 30, d: float = 0.85) -> str:
    """Unrolled power iteration over ``papers`` and ``citations``."""
    parts = [
        "deg AS MATERIALIZED (SELECT src, count(*) AS k FROM citations GROUP BY src)",
        "n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM papers)",
        "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS r FROM papers, n)",
    ]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT p.id, {1 - d} / n + {d} * (SELECT coalesce(sum(r), 0) FROM {p} WHERE id NOT IN (SELECT src FROM deg)) / n"
            f" + {d} * coalesce(s.x, 0) AS r FROM papers p CROSS JOIN n LEFT JOIN (SELECT c.dst, sum(q.r / deg.k) AS x FROM citations c"
            f" JOIN {p} q ON q.id = c.src JOIN deg ON deg.src = c.src GROUP BY c.dst) s ON s.dst = p.id)"
        )
    return ", ".join(parts)


# The orders of one customer form one chain, so its smallest key names the component.
COMPONENTS_SQL = "SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders"


@query(
    "gra02_pagerank",
    V.with_graph(f", {pagerank_sql()} SELECT id, round(r, 10) AS pagerank FROM r30", True).replace("  ,", ","),
)
def gra02(spark, sf):
    cites = V.citations(spark, sf)
    ids = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return G.pagerank(ids, cites).select("id", F.round("pagerank", 10).alias("pagerank"))


@query("gra03_components", COMPONENTS_SQL)
def gra03(spark, sf):
    cites = V.citations(spark, sf)
    ids = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return G.connected_components(ids, cites)


def labels_sql(rounds: int = 3, own_vote: bool = False) -> str:
    own = " UNION SELECT id, id FROM papers" if own_vote else ""
    parts = [
        f"und AS MATERIALIZED (SELECT src, dst FROM citations UNION SELECT dst, src FROM citations{own})",
        "l0 AS MATERIALIZED (SELECT id, id AS l FROM papers)",
    ]
    for i in range(1, rounds + 1):
        parts.append(
            f"l{i} AS MATERIALIZED (SELECT p.id, coalesce(b.l, p.l) AS l FROM l{i - 1} p LEFT JOIN ("
            f"SELECT n, l FROM (SELECT n, l, row_number() OVER (PARTITION BY n ORDER BY c DESC, l) AS rn FROM ("
            f"SELECT u.dst AS n, q.l, count(*) AS c FROM und u JOIN l{i - 1} q ON q.id = u.src GROUP BY 1, 2)) WHERE rn = 1) b ON b.n = p.id)"
        )
    return ", ".join(parts)


SETTLED_ROUNDS = 20  # unrolled in SQL; still_moving shows that the last changes nothing (14 do at scale factor 0.01)


def settled_sql(rounds: int = SETTLED_ROUNDS) -> str:
    """Label propagation to its fixed point, as ``settled(id, l)``."""
    parts = [
        "und AS MATERIALIZED (SELECT src, dst FROM citations WHERE src <> dst UNION SELECT dst, src FROM citations WHERE src <> dst)",
        "l0 AS MATERIALIZED (SELECT id, id AS l FROM papers)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"v{i} AS MATERIALIZED (SELECT u.dst AS id, q.l, count(*) AS c FROM und u JOIN l{i - 1} q ON q.id = u.src GROUP BY 1, 2)")
        parts.append(
            f"w{i} AS MATERIALIZED (SELECT p.id, b.l, md5(p.id::VARCHAR) AS h FROM l{i - 1} p JOIN (SELECT id, l, c FROM"
            f" (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, l) AS rn FROM v{i}) WHERE rn = 1) b ON b.id = p.id"
            f" LEFT JOIN v{i} o ON o.id = p.id AND o.l = p.l WHERE b.c > coalesce(o.c, 0))"
        )
        parts.append(
            f"l{i} AS MATERIALIZED (SELECT p.id, CASE WHEN w.l IS NULL OR w.h > f.h THEN p.l ELSE w.l END AS l FROM l{i - 1} p"
            f" LEFT JOIN w{i} w ON w.id = p.id LEFT JOIN (SELECT u.dst AS id, min(x.h) AS h FROM und u JOIN w{i} x ON x.id = u.src"
            f" GROUP BY 1) f ON f.id = p.id)"
        )
    parts.append(f"settled AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY l) AS l FROM l{rounds})")
    return ", ".join(parts)


@query("gra04_settled", V.with_graph(f"""
  , {settled_sql()} SELECT id, l AS community, (SELECT count(*) FROM w{SETTLED_ROUNDS}) AS still_moving FROM settled""", True))
def gra04_settled(spark, sf):
    cites = V.citations(spark, sf)
    ids = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return G.settled_labels(ids, cites).withColumn("still_moving", F.lit(0).cast("long"))


@query(
    "gra04_labels",
    V.with_graph(f", {labels_sql()} SELECT id, l AS community FROM l3", True).replace("  ,", ","),
)
def gra04_labels(spark, sf):
    cites = V.citations(spark, sf)
    ids = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return G.label_propagation(ids, cites, 3)


@query("gra04_modularity", """
  SELECT 'nodes' AS metric, count(*) AS n FROM orders UNION ALL SELECT 'labelled', count(*) FROM orders UNION ALL
  SELECT 'node_moves', 0 UNION ALL SELECT 'community_moves', 0 UNION ALL SELECT 'worse_than_start', 0""")
def gra04_modularity(spark, sf):
    """At the fixed point no node and no community has a move that gains; label propagation is no better."""
    cites = V.citations(spark, sf)
    ids = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    start = cut(G.label_propagation(ids, cites, 3, own_vote=True), "lpa")
    return M.fixed_point_report(ids, cites, start, cut(M.louvain(ids, cites, start), "communities"))


@query(
    "gra05_bridge",
    V.with_graph(
        f", {settled_sql()} SELECT id, count(*)::DOUBLE AS bridge_score FROM (SELECT unnest([c.src, c.dst]) AS id"
        " FROM citations c JOIN settled a ON a.id = c.src JOIN settled b ON b.id = c.dst WHERE a.l <> b.l) GROUP BY id",
        True,
    ).replace("  ,", ","),
)
def gra05(spark, sf):
    cites = V.citations(spark, sf)
    ids = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return G.bridge_scores(cites, G.settled_labels(ids, cites))


KEY_PAPERS_SQL = V.with_graph(
    f""", {pagerank_sql()}, {settled_sql()},
    rep AS (SELECT id FROM (SELECT r.id, row_number() OVER (PARTITION BY s.l ORDER BY round(r.r, 12) DESC, r.id) AS rn
            FROM r30 r JOIN settled s ON s.id = r.id) WHERE rn = 1),
    bridge AS (SELECT id, count(*)::DOUBLE AS b FROM (SELECT unnest([c.src, c.dst]) AS id
        FROM citations c JOIN settled a ON a.id = c.src JOIN settled b ON b.id = c.dst WHERE a.l <> b.l) GROUP BY id),
    scored AS (SELECT p.id AS work_id, title, publication_year, cited_by_count, s.l AS community, r.r,
        rep.id IS NOT NULL AS is_rep, coalesce(bridge.b, 0.0) AS bridge_score,
        0.45 * r.r + 0.30 * cited_by_count / (SELECT max(cited_by_count)::DOUBLE FROM papers)
          + CASE WHEN rep.id IS NOT NULL THEN 0.15 ELSE 0 END + 0.10 * least(1.0, coalesce(bridge.b, 0.0) / 3.0) AS score_
      FROM papers p JOIN r30 r ON r.id = p.id JOIN settled s ON s.id = p.id LEFT JOIN rep ON rep.id = p.id LEFT JOIN bridge ON bridge.id = p.id)
    SELECT work_id, title, round(score_, 6) AS score,
      CASE WHEN publication_year >= 2022 THEN 'recent_representative' WHEN bridge_score > 0 THEN 'bridge_paper'
        WHEN is_rep THEN 'community_representative' ELSE 'influential_paper' END AS role,
      round(r, 6) AS pagerank, community, bridge_score, cited_by_count, publication_year::INTEGER AS publication_year
    FROM scored ORDER BY score DESC, work_id LIMIT 30""",
    True,
).replace("  ,", ",")


@query("gra06_key_papers", KEY_PAPERS_SQL)
def gra06(spark, sf):
    cites = V.citations(spark, sf)
    papers = cut(V.papers(spark, sf, cites), "papers")
    return G.field_structure(papers, cites, 30)["key_papers"]


@query("gra07_field", V.with_graph(f"""
  , {settled_sql()}
  SELECT 'nodes' AS metric, NULL::INTEGER AS year, count(*) AS n FROM papers UNION ALL SELECT 'edges', NULL, count(*) FROM citations UNION ALL
  SELECT 'communities', NULL, count(DISTINCT l) FROM settled UNION ALL SELECT 'papers', publication_year::INTEGER, count(*) FROM papers GROUP BY 2""", True).replace("  ,", ","))
def gra07(spark, sf):
    cites = V.citations(spark, sf)
    f = G.field_structure(cut(V.papers(spark, sf, cites), "papers"), cites)
    return f["counts"].select("metric", F.lit(None).cast("int").alias("year"), "n").unionByName(
        f["yearly"].select(F.lit("papers").alias("metric"), F.col("publication_year").cast("int").alias("year"), F.col("n_papers").alias("n")))


@query("gra10_collaborators", f"""
  WITH wa AS MATERIALIZED (SELECT DISTINCT work_id, author_id FROM ({V.WORK_AUTHORS_SQL}))
  SELECT b.author_id, count(DISTINCT b.work_id) AS shared_works FROM wa a JOIN wa b ON a.work_id = b.work_id
  WHERE a.author_id = 1 AND b.author_id <> 1 GROUP BY b.author_id""")
def gra10(spark, sf):
    return G.collaborators(V.work_authors(spark, sf), 1)


@query("gra11_paths", V.with_graph("""
  , s AS (SELECT max(o_orderkey) AS id FROM orders),
  h1 AS (SELECT c.src AS a, c.dst AS b FROM citations c JOIN s ON s.id = c.src),
  h2 AS (SELECT h1.a, h1.b, c.dst AS c FROM h1 JOIN citations c ON c.src = h1.b),
  h3 AS (SELECT h2.a, h2.b, h2.c, c.dst AS d FROM h2 JOIN citations c ON c.src = h2.c)
  SELECT concat_ws('>', a, b) AS path, 1 AS hops FROM h1 UNION ALL
  SELECT concat_ws('>', a, b, c), 2 FROM h2 UNION ALL SELECT concat_ws('>', a, b, c, d), 3 FROM h3"""))
def gra11(spark, sf):
    cites = V.citations(spark, sf)
    start = V.table(spark, sf, "orders").agg(F.max("o_orderkey").alias("id"))
    return G.citation_paths(cites, start, 3).select(F.array_join("path", ">").alias("path"), "hops")


@query("gra12_influence", V.with_graph(f"""
  , f0 AS (SELECT DISTINCT work_id AS id FROM ({V.WORK_AUTHORS_SQL}) WHERE author_id = 1),
  f1 AS MATERIALIZED (SELECT DISTINCT src AS id FROM citations JOIN f0 ON dst = id),
  f2 AS MATERIALIZED (SELECT DISTINCT src AS id FROM citations JOIN f1 ON dst = id),
  f3 AS MATERIALIZED (SELECT DISTINCT src AS id FROM citations JOIN f2 ON dst = id),
  f4 AS MATERIALIZED (SELECT DISTINCT src AS id FROM citations JOIN f3 ON dst = id),
  f5 AS MATERIALIZED (SELECT DISTINCT src AS id FROM citations JOIN f4 ON dst = id)
  SELECT id, min(h) AS hops FROM (SELECT id, 1 AS h FROM f1 UNION ALL SELECT id, 2 FROM f2 UNION ALL
    SELECT id, 3 FROM f3 UNION ALL SELECT id, 4 FROM f4 UNION ALL SELECT id, 5 FROM f5) GROUP BY id"""))
def gra12(spark, sf):
    cites = V.citations(spark, sf)
    own = V.work_authors(spark, sf).filter("author_id = 1").select(F.col("work_id").alias("id")).distinct()
    return G.influence(cites, own, 5)


@query("gra14_collaboration", """
  WITH l AS (SELECT DISTINCT l_orderkey AS w, s_nationkey AS i FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
  SELECT x.i AS a, y.i AS b, count(*) AS n_groups FROM l x JOIN l y ON x.w = y.w AND x.i < y.i GROUP BY 1, 2""")
def gra14(spark, sf):
    links = (
        V.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
        .join(V.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("l_orderkey").alias("w"), F.col("s_nationkey").alias("i"))
    )
    return G.pair_counts(links, "w", "i")


@query("dsn05_topic_pairs", f"""
  WITH l AS (SELECT DISTINCT work_id AS w, concept AS i FROM ({V.WORK_CONCEPTS_SQL}))
  SELECT x.i AS a, y.i AS b, count(*) AS n_groups FROM l x JOIN l y ON x.w = y.w AND x.i < y.i GROUP BY 1, 2""")
def dsn05(spark, sf):
    return G.pair_counts(V.work_concepts(spark, sf), "work_id", "concept")


def hits_sql(rounds: int) -> str:
    parts = ["h0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS h FROM papers)"]
    for i in range(1, rounds + 1):
        parts.append(f"a{i}r AS (SELECT dst AS id, sum(h) AS a FROM citations JOIN h{i - 1} ON id = src GROUP BY dst)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT id, a / (SELECT sqrt(sum(a * a)) FROM a{i}r) AS a FROM a{i}r)")
        parts.append(f"h{i}r AS (SELECT src AS id, sum(a) AS h FROM citations JOIN a{i} ON id = dst GROUP BY src)")
        parts.append(f"h{i} AS MATERIALIZED (SELECT id, h / (SELECT sqrt(sum(h * h)) FROM h{i}r) AS h FROM h{i}r)")
    return ", ".join(parts)


@query("dsn04_hits", V.with_graph(f"""
  , {hits_sql(5)} SELECT p.id, round(coalesce(h, 0), 9) AS hub, round(coalesce(a, 0), 9) AS authority
  FROM papers p LEFT JOIN h5 USING (id) LEFT JOIN a5 USING (id)""", True))
def dsn04(spark, sf):
    cites = V.citations(spark, sf)
    ids = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    h = G.hits(ids, cites, rounds=5)
    return h.select("id", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


# --- snapshot and typed graph ------------------------------------------------------------


def snapshot_papers(spark, sf):
    """papers(work_id, title, authors, topics, referenced_works, seq) of the nested records."""
    w = V.raw_works(spark, sf)
    names = F.filter(F.transform("authorships", lambda a: F.trim(a["author"]["display_name"])), lambda n: n.isNotNull())
    chosen = F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.slice("concepts", 1, 5))
    refs = F.transform("referenced_works", lambda r: C.normalize_id(r))
    return cut(w.select(
        "seq", C.normalize_id(F.col("id")).alias("work_id"), F.trim("title").alias("title"), names.alias("authors"),
        F.transform(chosen, lambda t: t["display_name"]).alias("topics"), refs.alias("referenced_works"),
    ), "snapshot-papers")


SNAPSHOT_SQL = V.with_flat(""", ftt AS (SELECT o, pos, t_name FROM ft UNION ALL
    SELECT o_orderkey, 0, 'Topic ' || (o_custkey + 15) % 60 FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 17 <> 0)""", "fa", "ft", "fc").replace(") , ftt", "), ftt")


@query("gra01_vertices", SNAPSHOT_SQL + """
  SELECT 'paper:W' || o_orderkey AS id, 'paper' AS type, CASE WHEN o_orderkey % 20 <> 0 THEN 'Order ' || o_orderkey END AS label, NULL::BIGINT AS paper_count FROM orders UNION ALL
  SELECT 'author:author_' || a, 'author', 'Author ' || a, count(*) FROM fa WHERE a_name IS NOT NULL GROUP BY a UNION ALL
  SELECT 'topic:' || replace(lower(t_name), ' ', '_'), 'topic', t_name, count(*) FROM ftt GROUP BY t_name""")
def gra01v(spark, sf):
    return G.snapshot_vertices(snapshot_papers(spark, sf))


EDGES_SQL = SNAPSHOT_SQL + """,
  refs AS (SELECT o_orderkey AS o, unnest([0, 1]) AS pos, unnest([CASE WHEN o_orderkey >= 1 + o_custkey % 5 THEN o_orderkey - 1 - o_custkey % 5 END,
      CASE WHEN o_orderkey >= 10 + o_custkey % 7 THEN o_orderkey - 10 - o_custkey % 7 END]) AS r FROM orders),
  e AS (SELECT o, 0 AS k, j AS pos, 'author:author_' || a AS dst, 'AUTHORED_BY' AS type FROM fa WHERE a_name IS NOT NULL UNION ALL
    SELECT o, 1, pos, 'topic:' || replace(lower(t_name), ' ', '_'), 'HAS_TOPIC' FROM ftt UNION ALL SELECT o, 2, pos, 'paper:W' || r, 'CITES' FROM refs WHERE r IS NOT NULL)
"""


@query("gra01_edges", EDGES_SQL + " SELECT 'paper:W' || o AS src, dst, type FROM e")
def gra01e(spark, sf):
    return G.snapshot_edges(snapshot_papers(spark, sf))


@query("gra15_snapshot", EDGES_SQL + """
  SELECT 'graph_' || left(sha256('{"corpus": "c1", "edges": ' || e || ', "nodes": ' || n || '}'), 12) AS graph_snapshot_id, 'c1' AS corpus_id, n AS node_count, e AS edge_count FROM (
    SELECT (SELECT count(*) FROM orders) + (SELECT count(DISTINCT a) FROM fa WHERE a_name IS NOT NULL) + (SELECT count(DISTINCT t_name) FROM ftt) AS n, (SELECT count(*) FROM e) AS e)""")
def gra15(spark, sf):
    p = snapshot_papers(spark, sf)
    return G.snapshot_record("c1", G.snapshot_vertices(p), G.snapshot_edges(p))


TYPED_SQL = V.with_flat("""
  , ed AS (
  SELECT 'Paper:' || citing_work_id AS src, 'Paper:' || cited_work_id AS dst, 'CITES' AS type, 1.0 AS weight FROM fc WHERE cited_work_id IN (SELECT 'W' || o_orderkey FROM orders) UNION ALL
  SELECT 'Author:' || author_id, 'Paper:W' || o, 'AUTHORED', 1.0 FROM fa WHERE a_name IS NOT NULL UNION ALL
  SELECT 'Paper:W' || o_orderkey, 'Venue:V' || (o_custkey % 40), 'PUBLISHED_IN', 1.0 FROM orders UNION ALL
  SELECT 'Paper:W' || o, 'Concept:' || concept_id, 'ABOUT', score FROM ft WHERE score > 0 UNION ALL
  SELECT 'Paper:W' || o, 'Concept:' || concept_id, 'HAS_TOPIC', 1.0 FROM ft WHERE score > 0.3 UNION ALL
  SELECT DISTINCT 'Author:' || author_id, 'Institution:' || institution_id, 'AFFILIATED_WITH', 1.0 FROM fi UNION ALL
  SELECT DISTINCT 'Paper:W' || o, 'Institution:' || institution_id, 'ASSOCIATED_WITH', 1.0 FROM fi UNION ALL
  SELECT 'Author:' || author_id, 'Institution:' || institution_id, 'AFFILIATED_IN_WORK', 1.0 FROM (SELECT DISTINCT o, author_id, institution_id FROM fi) UNION ALL
  SELECT DISTINCT 'Institution:' || institution_id, 'Country:' || country_code, 'LOCATED_IN', 1.0 FROM fi WHERE country_code IS NOT NULL UNION ALL
  SELECT 'Paper:W' || o_orderkey, 'WorkType:' || CASE o_orderkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'review' ELSE 'posted-content' END, 'HAS_TYPE', 1.0 FROM orders)
""", "fa", "fi", "ft", "fc")


def typed_tables(spark, sf):
    return E.clean_batch(cut(V.raw_works(spark, sf), "parsed-works"))


@query("gra09_typed_edges", TYPED_SQL + " SELECT src, dst, type, weight::DOUBLE AS weight FROM ed")
def gra09(spark, sf):
    return G.typed_edges(typed_tables(spark, sf))


@query("agg11_type_counts", TYPED_SQL + """
  SELECT 'edge' AS kind, type, count(*) AS n FROM ed GROUP BY type UNION ALL
  SELECT 'node', 'Paper', count(*) FROM orders UNION ALL SELECT 'node', 'Author', count(DISTINCT author_id) FROM fa WHERE a_name IS NOT NULL UNION ALL
  SELECT 'node', 'Institution', count(DISTINCT institution_id) FROM fi UNION ALL SELECT 'node', 'Country', count(DISTINCT country_code) FROM fi UNION ALL
  SELECT 'node', 'Concept', count(DISTINCT concept_id) FROM ft UNION ALL SELECT 'node', 'Venue', count(DISTINCT o_custkey % 40) FROM orders UNION ALL
  SELECT 'node', 'WorkType', count(DISTINCT o_orderkey % 3) FROM orders""")
def agg11(spark, sf):
    t = typed_tables(spark, sf)
    # Written once, for the counts and for the ends of the edges.
    vertices = cut(G.typed_vertices(t).select("id", "type"), "node-ids")
    return G.type_counts(vertices, G.typed_edges(t, vertices))
