"""Literature tables stood in for by the given tables, in Spark and in SQL.

Each Spark function has a SQL text of the same meaning beside it, for use in
the checks. Nothing here collects a group: nested records are projections of
one order row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.skew import lagged_pairs
from paperloom.session import cut, spread
from paperloom.sources.works import parse_works


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- citation graph on orders ---------------------------------------------------
# An order cites the previous one, two and three orders of its customer.

CITATIONS_SQL = """
  SELECT src, dst FROM (
    SELECT o_orderkey AS src, unnest([
      lag(o_orderkey, 1) OVER w, lag(o_orderkey, 2) OVER w, lag(o_orderkey, 3) OVER w]) AS dst
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
  WHERE dst IS NOT NULL
"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return cut(lagged_pairs(rows, ["o_custkey"], "o_orderkey", 3), "citations")


PAPERS_SQL = """
  SELECT o.o_orderkey AS id, 'Order ' || o.o_orderkey AS title, year(o.o_orderdate) AS publication_year,
         coalesce(c.n, 0) AS cited_by_count
  FROM orders o LEFT JOIN (SELECT dst, count(*) AS n FROM citations GROUP BY dst) c ON c.dst = o.o_orderkey
"""


def papers(spark: SparkSession, sf_dir: str, cites: DataFrame) -> DataFrame:
    """(id, title, publication_year, cited_by_count)"""
    counts = cites.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("Order "), "o_orderkey").alias("title"),
            F.year("o_orderdate").alias("publication_year"),
        )
        .join(counts, "id", "left")
        .select("id", "title", "publication_year", F.coalesce("n", F.lit(0)).alias("cited_by_count"))
    )


# --- link tables on lineitem -------------------------------------------------------

WORK_AUTHORS_SQL = "SELECT DISTINCT l_orderkey AS work_id, l_suppkey AS author_id, l_linenumber AS author_order FROM lineitem"
WORK_CONCEPTS_SQL = """
  SELECT l_orderkey AS work_id, p_brand AS concept, cast(round((1 - max(l_discount)) * 100) AS INTEGER) AS score
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, p_brand
"""


def work_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("author_id"),
        F.col("l_linenumber").alias("author_order"),
    ).distinct()


def work_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, concept, score): score is an integer percentage, so sums are exact."""
    return (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("work_id"), F.col("p_brand").alias("concept"))
        .agg(F.round((1 - F.max("l_discount")) * 100).cast("int").alias("score"))
    )


# --- nested work records on orders ----------------------------------------------------
# One JSON record per order, built by arithmetic on its two keys; read back through
# the declared schema. The SQL side works on the flat author and topic rows.

PREFIX = "https://works.example.org/"


def works_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")

    def institution(n):
        return F.struct(
            F.concat(F.lit(PREFIX + "I"), n).alias("id"),
            F.concat(F.lit("  Institution "), n).alias("display_name"),
            F.lit("education").alias("type"),
            F.when(n % 6 != 5, F.concat(F.lit("C"), n % 6)).alias("country_code"),
        )

    def authorship(j):
        a = c + j * (1 + o % 11)
        return F.struct(
            F.struct(
                F.concat(F.lit(PREFIX + "A"), a).alias("id"),
                F.when(a % 50 != 49, F.concat(F.lit("Author "), a, F.lit(" "))).alias("display_name"),
                F.when(
                    a % 4 == 0, F.concat(F.lit("orcid 0000-0001-"), F.lpad((a % 10000).cast("string"), 4, "0"), F.lit("-000X"))
                ).alias("orcid"),
            ).alias("author"),
            F.when(j == 0, "first").otherwise("middle").alias("author_position"),
            (j == 0).alias("is_corresponding"),
            F.when(a % 3 == 0, F.array(institution(a % 25), institution((a + 7) % 25)))
            .otherwise(F.array(institution(a % 25))).alias("institutions"),
            F.when(a % 5 != 0, F.array(F.concat(F.lit(" Dept "), a % 7))).alias("raw_affiliation_strings"),
            F.array(
                F.struct(F.when(a % 10 == 1, F.concat(F.lit("Dept "), a % 7)).otherwise(F.concat(F.lit("Lab "), a % 3)).alias("raw_affiliation_string"))
            ).alias("affiliations"),
        )

    def topic(k):
        t = (c + k * 5) % 60
        return F.struct(
            F.concat(F.lit(PREFIX + "T"), t).alias("id"), F.concat(F.lit("Topic "), t).alias("display_name"),
            ((o + k) % 10 / 10).alias("score"), (t % 4).cast("int").alias("level"),
        )

    topics = F.transform(F.sequence(F.lit(0), F.lit(1)), topic)
    record = F.struct(
        F.concat(F.lit(PREFIX + "W"), o).alias("id"),
        F.concat(F.lit("https://doi.org/10.5/"), o).alias("doi"),
        F.when(o % 20 != 0, F.concat(F.lit(" Order "), o, F.lit(" "))).alias("title"),
        F.create_map(F.lit("order"), F.array(F.lit(0), F.lit(2)), F.lit("of"), F.array(F.lit(1)),
                     F.col("o_orderpriority"), F.array(F.lit(3))).alias("abstract_inverted_index"),
        F.year("o_orderdate").alias("publication_year"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
        F.when(o % 3 == 0, F.lit("article")).when(o % 3 == 1, F.lit("review")).alias("type"),
        F.lit("posted-content").alias("type_crossref"),
        (o % 100).cast("int").alias("cited_by_count"),
        F.transform(F.sequence(F.lit(0), (o % 3).cast("int")), authorship).alias("authorships"),
        F.when(o % 17 == 0, F.lit(None)).when(o % 13 == 0, F.slice(topics, 1, 0)).otherwise(topics).alias("topics"),
        F.array(topic(F.lit(3))).alias("concepts"),
        F.struct(
            F.struct(
                F.concat(F.lit(PREFIX + "V"), c % 40).alias("id"),
                F.concat(F.lit("Venue "), c % 40).alias("display_name"),
                F.array(F.concat(F.lit("1234"), F.lpad((c % 40).cast("string"), 4, "0"))).alias("issn"),
                (c % 2 == 0).alias("is_oa"),
            ).alias("source")
        ).alias("primary_location"),
        F.struct((o % 9).cast("string").alias("volume"), F.when(o % 2 == 0, (o % 4).cast("string")).alias("issue"),
                 (o % 300).cast("string").alias("first_page"), (o % 300 + 8).cast("string").alias("last_page")).alias("biblio"),
        # Two orders of the recent past, possibly none, and one work nobody holds.
        F.filter(
            F.array(
                F.when(o >= 1 + c % 5, F.concat(F.lit(PREFIX + "W"), o - 1 - c % 5)),
                F.when(o >= 10 + c % 7, F.concat(F.lit(PREFIX + "W"), o - 10 - c % 7, F.lit("/"))),
                F.when(o % 6 == 0, F.concat(F.lit(PREFIX + "W"), F.lit(900000000) + o % 97)),
            ),
            lambda r: r.isNotNull(),
        ).alias("referenced_works"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return spread(orders).select(o.alias("seq"), F.to_json(record).alias("json"))


def raw_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_works(works_json(spark, sf_dir))


REF_LINKS_SQL = """
  SELECT o_orderkey AS work_id, pos, ref_id FROM (SELECT o_orderkey, unnest([
      CASE WHEN o_orderkey >= 1 + o_custkey % 5 THEN o_orderkey - 1 - o_custkey % 5 END,
      CASE WHEN o_orderkey >= 10 + o_custkey % 7 THEN o_orderkey - 10 - o_custkey % 7 END,
      CASE WHEN o_orderkey % 6 = 0 THEN 900000000 + o_orderkey % 97 END]) AS ref_id, unnest([0, 1, 2]) AS pos FROM orders) WHERE ref_id IS NOT NULL
"""


def ref_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference lists of the records as rows (work_id, pos, ref_id), numeric ids."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    refs = F.array(
        F.when(o >= 1 + c % 5, o - 1 - c % 5), F.when(o >= 10 + c % 7, o - 10 - c % 7),
        F.when(o % 6 == 0, F.lit(900000000) + o % 97),
    )
    return table(spark, sf_dir, "orders").select(
        o.alias("work_id"), F.posexplode(refs).alias("pos", "ref_id")
    ).filter("ref_id IS NOT NULL")


# Flat rows of the same records. a_name is NULL where the author has no name.
FLAT_SQL = {
    "fa": """
      SELECT o, seq, j, a, 'A' || a AS author_id, CASE WHEN a % 50 <> 49 THEN 'Author ' || a END AS a_name
      FROM (SELECT o_orderkey AS o, o_orderkey AS seq, j, o_custkey + j * (1 + o_orderkey % 11) AS a
            FROM orders, (SELECT unnest([0, 1, 2]) AS j) WHERE j <= o_orderkey % 3)
    """,
    "fi": """
      SELECT o, seq, j, a, author_id, p, i, 'I' || i AS institution_id, 'Institution ' || i AS i_name,
             CASE WHEN i % 6 <> 5 THEN 'C' || (i % 6) END AS country_code
      FROM (SELECT o, seq, j, a, author_id, 0 AS p, a % 25 AS i FROM fa WHERE a_name IS NOT NULL
            UNION ALL
            SELECT o, seq, j, a, author_id, 1, (a + 7) % 25 FROM fa WHERE a_name IS NOT NULL AND a % 3 = 0)
    """,
    "ft": """
      SELECT o, k AS pos, 'T' || t AS concept_id, 'Topic ' || t AS t_name, t % 4 AS level, ((o + k) % 10) / 10.0 AS score,
             CASE WHEN o % 17 = 0 THEN 'concepts' ELSE 'topics' END AS source
      FROM (SELECT o_orderkey AS o, k, (o_custkey + k * 5) % 60 AS t FROM orders, (SELECT unnest([0, 1, 3]) AS k)
            WHERE (o_orderkey % 17 = 0 AND k = 3) OR (o_orderkey % 17 <> 0 AND o_orderkey % 13 <> 0 AND k < 3))
    """,
    "fc": """
      SELECT DISTINCT 'W' || o_orderkey AS citing_work_id, 'W' || r AS cited_work_id
      FROM (SELECT o_orderkey, unnest([
              CASE WHEN o_orderkey >= 1 + o_custkey % 5 THEN o_orderkey - 1 - o_custkey % 5 END,
              CASE WHEN o_orderkey >= 10 + o_custkey % 7 THEN o_orderkey - 10 - o_custkey % 7 END,
              CASE WHEN o_orderkey % 6 = 0 THEN 900000000 + o_orderkey % 97 END]) AS r FROM orders)
      WHERE r IS NOT NULL
    """,
}


def with_flat(sql: str, *names: str) -> str:
    """SQL text with the flat views it names in front."""
    order = [n for n in FLAT_SQL if n in names or (n == "fa" and "fi" in names)]
    return "WITH " + ", ".join(f"{n} AS ({FLAT_SQL[n]})" for n in order) + " " + sql


def with_graph(sql: str, papers_too: bool = False) -> str:
    head = f"WITH citations AS MATERIALIZED ({CITATIONS_SQL})"
    if papers_too:
        head += f", papers AS MATERIALIZED ({PAPERS_SQL})"
    return head + " " + sql
