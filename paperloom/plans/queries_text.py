"""Chunking, retrieval and vector queries (TXT-*, VEC-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions import text as X
from paperloom.operators import chunks as K
from paperloom.operators import vectors as E
from paperloom.plans import views as V
from paperloom.plans.registry import query
from paperloom.session import cut, spread

TOK = "regexp_extract_all(lower({0}), '[A-Za-z0-9_]+|[一-鿿]')"
BL = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{BL}+|{BL}+$', '', 'g')"


# Documents with headings: every line that begins with an E becomes one.
DOCS_SQL = "SELECT doc_id, replace(text, chr(10) || 'E', chr(10) || '## E') AS text FROM documents"


def docs(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    return spread(d).select("doc_id", F.replace("text", F.lit("\nE"), F.lit("\n## E")).alias("text"))


SECTIONS_SQL = rf"""
  lines AS (SELECT doc_id, array_to_string(list_transform(string_split_regex(text, '\r\n|[\n\r\x0B\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: {trim_sql("l")}), chr(10)) AS t FROM d),
  pieces AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '(^|\n)(#{{1,3}}[ \t]+[^\s])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS p, generate_subscripts(string_split(regexp_replace(t, '(^|\n)(#{{1,3}}[ \t]+[^\s])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS i FROM lines),
  secs0 AS (SELECT doc_id, i, CASE WHEN regexp_matches(p, '\A#{{1,3}}[ \t]+[^\s]') THEN left({trim_sql("regexp_replace(regexp_extract(p, '^[^\\n]*'), '^#+', '')")}, 80) ELSE 'body' END AS name,
      regexp_replace(CASE WHEN regexp_matches(p, '\A#{{1,3}}[ \t]+[^\s]') THEN regexp_replace(p, '\A[^\n]*\n?', '') ELSE p END, '\n\z', '') AS body FROM pieces),
  secs AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sec, name, body FROM secs0 WHERE {trim_sql("body")} <> '')
"""


def sentences_sql(c: str) -> str:
    return (rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({c}, '([。！？.!?]){BL}+', '\1' || chr(1), 'g'), '[\n\r]+', chr(1), 'g'), chr(1)),"
            f" lambda s: {trim_sql('s')}), lambda s: length(s) >= 20)")


HEAD = f"WITH d AS ({DOCS_SQL}), {SECTIONS_SQL}"


def parents_sql() -> str:
    return HEAD + f""",
  ss AS MATERIALIZED (SELECT doc_id, sec, name, body, {sentences_sql("body")} AS s FROM secs),
  st AS (SELECT doc_id, sec, name, body, s, len(s) AS n, unnest(generate_series(0, len(s) - 1, 6)) AS start FROM ss WHERE len(s) > 0),
  par AS MATERIALIZED (SELECT *, start // 6 AS idx, least(8, n - start) AS k, array_to_string(s[start + 1:start + 8], ' ') AS ptext,
    'P_' || left(sha256('{{"idx": ' || (start // 6) || ', "section": ' || to_json(name) || ', "work": "' || doc_id || '"}}'), 14) AS parent_id,
    sum(least(8, n - start)) OVER (PARTITION BY doc_id ORDER BY sec, start) - least(8, n - start) AS first FROM st)
"""


CHILDREN_SQL = parents_sql() + f""",
  ch AS MATERIALIZED (SELECT doc_id, parent_id, name, body, s, first + l AS child_index, start + l AS j, l FROM (SELECT *, unnest(generate_series(0, k - 1)) AS l FROM par)),
  chd AS MATERIALIZED (SELECT doc_id, parent_id, name AS section, child_index, array_to_string(s[greatest(j, 1):j + 2], ' ') AS text,
    greatest(instr(body, s[j + 1]) - 1, 0) AS char_start, length(s[j + 1]) AS len, body FROM ch),
  chi AS MATERIALIZED (SELECT *, 'C_' || left(sha256('{{"idx": ' || child_index || ', "parent": "' || parent_id || '", "work": "' || doc_id || '"}}'), 14) AS child_id FROM chd)
"""


@query("txt01_tokens", f"""
  SELECT token, count(*) AS n FROM (SELECT unnest({TOK.format("text")}) AS token FROM documents) GROUP BY 1""")
def txt01(spark, sf):
    d = spread(V.table(spark, sf, "documents").select("text"))
    return d.select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("txt02_sections", HEAD + " SELECT doc_id, sec::INTEGER AS sec, name, md5(body) AS body_md5, length(body)::INTEGER AS n FROM secs")
def txt02(spark, sf):
    s = docs(spark, sf).select("doc_id", F.posexplode(X.sections(F.col("text"))).alias("sec", "s"))
    return s.select("doc_id", "sec", "s.name", F.md5("s.body").alias("body_md5"), F.length("s.body").alias("n"))


@query("txt03_sentences", f"""
  SELECT doc_id, (p - 1)::INTEGER AS pos, s AS sentence FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS p FROM (SELECT doc_id, {sentences_sql("text")} AS ss FROM documents))""")
def txt03(spark, sf):
    d = spread(V.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query("txt04_parents", parents_sql() + """
  SELECT parent_id, doc_id AS work_id, name AS section, idx::INTEGER AS parent_index, first::INTEGER AS start_child_index, (first + k - 1)::INTEGER AS end_child_index,
    left(sha256(ptext), 32) AS content_hash FROM par""")
def txt04p(spark, sf):
    return K.parent_chunks(docs(spark, sf), "doc_id").drop("text")


@query("txt04_children", CHILDREN_SQL + f"""
  SELECT child_id, doc_id AS work_id, parent_id, section, child_index::INTEGER AS child_index, char_start::INTEGER AS char_start, (char_start + len)::INTEGER AS char_end,
    len({TOK.format("left(body, char_start)")})::INTEGER AS token_start, (len({TOK.format("left(body, char_start)")}) + len({TOK.format("text")}))::INTEGER AS token_end,
    left(sha256(text), 32) AS content_hash FROM chi""")
def txt04c(spark, sf):
    return K.child_chunks(docs(spark, sf), "doc_id").drop("text")


def vector_sql(source: str, c: str) -> str:
    """``source`` plus its count vector v, for text column ``c``."""
    return (f"(SELECT * EXCLUDE (bk), list_transform(range(0, 64), lambda i: len(list_filter(bk, lambda b: b = i))::DOUBLE) AS v FROM ("
            f"SELECT *, list_transform({TOK.format(c)}, lambda t: ('0x' || left(sha256(t), 8))::BIGINT % 64) AS bk FROM {source}))")


@query("txt06_embedding", f"""
  SELECT item_id, array_to_string(list_transform(v, lambda x: CASE WHEN norm = 0 THEN 0 ELSE round(x / norm * 1000000)::BIGINT END), ',') AS vec FROM (
    SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM {vector_sql("benchmark", "text")})""")
def txt06(spark, sf):
    b = V.table(spark, sf, "benchmark").withColumn("v", X.unit(X.counts_vector(X.bucket_array(F.col("text")))))
    return b.select("item_id", F.array_join(F.transform("v", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("vec"))


@query("txt07_digest", """
  SELECT doc_id, array_to_string(list_transform(range(0, 40), lambda i: ('0x' || substr(sha256(text), (i % 32) * 2 + 1, 2))::BIGINT), ',') AS vec FROM documents""")
def txt07(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", X.digest_embedding(F.col("text"), 40).alias("v"))
    return d.select("doc_id", F.array_join(F.transform("v", lambda x: F.round(x * 255).cast("long").cast("string")), ",").alias("vec"))


QUESTION = "which question of the other this, que le la"
QUERIES = [f"{QUESTION} {p}" for p in fixed.PERSPECTIVES]

SEARCH_SQL = CHILDREN_SQL + f""",
  q AS MATERIALIZED (SELECT query_no, query, list_transform(v, lambda x: x / norm) AS qv FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (
    FROM {vector_sql("(SELECT unnest([" + ", ".join(f"'{x}'" for x in QUERIES) + f"]) AS query, unnest(range(0, {len(QUERIES)})) AS query_no)", "query")}))),
  cv AS MATERIALIZED (SELECT child_id, doc_id, parent_id, section, text, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM {vector_sql("chi", "text")}),
  sc AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, child_id) AS rank FROM (
    SELECT child_id, doc_id, parent_id, section, text, query_no, query, round(CASE WHEN norm = 0 THEN 0 ELSE list_dot_product(v, qv) / norm END, 9) AS score FROM cv, q)),
  ev AS MATERIALIZED (SELECT *, 'E_' || left(sha256('{{"child": "' || child_id || '", "query": ' || to_json(query) || '}}'), 14) AS evidence_id FROM sc WHERE rank <= 8)
"""


def evidence(spark, sf):
    return K.search_evidence(K.child_chunks(docs(spark, sf), "doc_id", buckets=64), QUERIES, 8)


@query("txt08_search", SEARCH_SQL + """
  SELECT evidence_id, query_no::INTEGER AS query_no, rank::INTEGER AS rank, doc_id AS work_id, child_id, parent_id, round(score, 6) AS retrieval_score FROM ev""")
def txt08(spark, sf):
    return evidence(spark, sf).select("evidence_id", "query_no", "rank", "work_id", "child_id", "parent_id", "retrieval_score")


@query("txt09_bundles", SEARCH_SQL + """
  SELECT 'EB_' || left(sha256('{"question": ' || to_json(query) || ', "records": [' || string_agg('"' || evidence_id || '"', ', ' ORDER BY rank) || ']}'), 14) AS evidence_bundle_id,
    query, count(DISTINCT doc_id)::INTEGER AS n_works FROM ev GROUP BY query""")
def txt09(spark, sf):
    return K.evidence_bundle(evidence(spark, sf)).select("evidence_bundle_id", "query", "n_works")


@query("txt09_empty", SEARCH_SQL + f""",
  b AS (SELECT query, count(*) AS n, string_agg('"' || evidence_id || '"', ', ' ORDER BY rank) AS ids FROM ev WHERE query_no <> 1 GROUP BY query UNION ALL
    SELECT query, 0, '' FROM q WHERE query_no = 1)
  SELECT 'EB_' || left(sha256('{{"question": ' || to_json(query) || ', "records": [' || ids || ']}}'), 14) AS evidence_bundle_id, query, n::INTEGER AS n_records,
    CASE WHEN n = 0 THEN '{K.NO_EVIDENCE}' ELSE '' END AS warning FROM b""")
def txt09_empty(spark, sf):
    """A query without matching chunks keeps its row, with the warning."""
    bundle = K.evidence_bundle(evidence(spark, sf).filter("query_no <> 1"), QUERIES)
    return bundle.select("evidence_bundle_id", "query", F.size("records").alias("n_records"), F.array_join("warnings", "").alias("warning"))


CLAIM = "the question of other is in this que main"


@query("txt10_claims", SEARCH_SQL + f""",
  o AS (SELECT evidence_id, score, round(len(list_intersect(list_distinct({TOK.format(f"'{CLAIM}'")}), {TOK.format("text")})) / len(list_distinct({TOK.format(f"'{CLAIM}'")})), 6) AS term_overlap FROM ev)
  SELECT evidence_id, term_overlap, CASE WHEN round(score, 6) >= 0.12 AND term_overlap > 0.05 THEN 'supports' ELSE 'uncertain' END AS support_status FROM o""")
def txt10(spark, sf):
    return K.verify_claim(evidence(spark, sf), CLAIM).select("evidence_id", "term_overlap", "support_status")


@query("txt11_status", CHILDREN_SQL + """
  SELECT d.doc_id AS work_id, count(child_id) > 0 AS materialized, count(child_id) AS children FROM d LEFT JOIN chi ON chi.doc_id = d.doc_id GROUP BY 1""")
def txt11(spark, sf):
    d = docs(spark, sf)
    return K.materialization_status(d.select(F.col("doc_id").alias("work_id")), K.child_chunks(d, "doc_id"))


@query("txt12_parent_context", SEARCH_SQL + """
  SELECT parent_id, md5(ptext) AS text_md5 FROM par WHERE parent_id IN (SELECT parent_id FROM ev)""")
def txt12(spark, sf):
    d = docs(spark, sf)
    found = K.parent_context(K.parent_chunks(d, "doc_id"), evidence(spark, sf))
    return found.select("parent_id", F.md5("text").alias("text_md5"))


@query("txt13_headings", rf"""
  SELECT doc_id, array_to_string(list_slice(list_transform(list_filter(list_transform(string_split_regex(t, '\r\n|[\n\r]'), lambda l: {trim_sql("l")}),
      lambda l: l <> '' AND ((regexp_matches(l, '^[0-9]') AND contains(left(l, 6), '.')) OR (upper(l) = l AND lower(l) <> l))), lambda l: left(l, 120)), 1, 20), ' | ') AS headings
  FROM (SELECT doc_id, replace(replace(text, chr(10) || 'E', chr(10) || '1.2 E'), chr(10) || 'A', chr(10) || 'ABSTRACT' || chr(10)) AS t FROM documents)""")
def txt13(spark, sf):
    t = F.replace(F.replace("text", F.lit("\nE"), F.lit("\n1.2 E")), F.lit("\nA"), F.lit("\nABSTRACT\n"))
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(X.headings(t), " | ").alias("headings"))


def key_docs(spark, sf):
    return V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("work_id"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("n_chars").cast("double").alias("score"),
        F.lit("influential_paper").alias("role"), F.lit(2020).alias("publication_year"))


PACK_SQL = SEARCH_SQL + """,
  kp AS (SELECT doc_id, n_chars, text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS nth FROM documents),
  be AS (SELECT * FROM (SELECT doc_id, text, score, child_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, child_id) AS rn FROM ev) WHERE rn = 1),
  pack AS (SELECT 'E' || nth AS citation_id, CASE WHEN child_id IS NOT NULL THEN 'evidence_bundle' WHEN kp.text <> '' THEN 'corpus_abstract' ELSE 'graph_key_paper' END AS source_type,
    kp.doc_id AS work_id, left(CASE WHEN child_id IS NOT NULL THEN be.text ELSE kp.text END, 500) AS snippet,
    CASE WHEN child_id IS NOT NULL THEN round(be.score, 6) ELSE n_chars::DOUBLE END AS score, nth FROM kp LEFT JOIN be ON be.doc_id = kp.doc_id WHERE nth <= 12)
"""


def pack(spark, sf):
    works = V.table(spark, sf, "documents").select(F.col("doc_id").alias("work_id"), F.col("text").alias("abstract"))
    return K.source_pack(key_docs(spark, sf), cut(evidence(spark, sf), "evidence"), works)


@query("txt14_sources", PACK_SQL + " SELECT citation_id, source_type, work_id, snippet, score FROM pack")
def txt14(spark, sf):
    return pack(spark, sf).select("citation_id", "source_type", "work_id", "snippet", "score")


@query("txt15_guide", PACK_SQL + """,
  tp AS (SELECT source AS topic, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
  SELECT '# Field Guide: q' || chr(10) || chr(10) || '## Main Topics' || chr(10) || (SELECT string_agg('- ' || topic || ': ' || n || ' papers', chr(10) ORDER BY n DESC, topic) FROM tp)
    || chr(10) || chr(10) || '## Key Papers' || chr(10) || (SELECT string_agg('- [' || citation_id || '] Document ' || work_id || ' (2020) - influential_paper', chr(10) ORDER BY nth) FROM pack WHERE nth <= 10)
    || chr(10) || chr(10) || '## Evidence' || chr(10) || (SELECT string_agg('- [' || citation_id || '] ' || left(replace(snippet, chr(10), ' '), 260), chr(10) ORDER BY nth) FROM pack WHERE nth <= 8) AS markdown""")
def txt15(spark, sf):
    topics = V.table(spark, sf, "documents").groupBy(F.col("source").alias("topic")).agg(F.count(F.lit(1)).alias("n_works"))
    guide = K.field_guide("q", cut(pack(spark, sf), "pack"), topics)
    # Engines print doubles differently, so the score text is left out of the check.
    return guide.select(F.regexp_replace("markdown", r" - score [0-9.E]+", "").alias("markdown"))


# --- vectors ---------------------------------------------------------------------------


def probe(spark, sf):
    """The query vector: the stored one with the smallest id."""
    return list(V.table(spark, sf, "embeddings").agg(F.min_by("embedding", "vec_id").alias("e")).first()["e"])


COSINE_SQL = """
  SELECT vec_id, label, round(list_sum(list_transform(range(1, 65), lambda i: e[i]::DOUBLE * q[i]::DOUBLE))
     / ((sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-8) * (sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))) + 1e-8)), 6) AS score
  FROM (SELECT vec_id, label, embedding AS e, (SELECT arg_min(embedding, vec_id) FROM embeddings) AS q FROM embeddings)
"""


@query("vec02_topk", f"SELECT vec_id, score FROM ({COSINE_SQL}) ORDER BY score DESC, vec_id LIMIT 25")
def vec02(spark, sf):
    return E.search(V.table(spark, sf, "embeddings"), probe(spark, sf), 25, key="vec_id").select("vec_id", "score")


def mixed_sql(times: int) -> str:
    """Vectors repeated ``times`` over, every seventh one element short; the query is that of vector 0."""
    long = "list_concat(" * (times - 1) + "embedding::DOUBLE[]" + ", embedding::DOUBLE[])" * (times - 1)
    return f"""
  SELECT {times * 64} AS dim, vec_id, score FROM (SELECT vec_id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) + 1e-8) / (sqrt(list_dot_product(q, q)) + 1e-8), 6) AS score
    FROM (SELECT vec_id, {long} AS v FROM embeddings WHERE vec_id % 7 <> 3), (SELECT {long} AS q FROM embeddings WHERE vec_id = 0)) ORDER BY score DESC, vec_id LIMIT 20"""


@query("vec02_mixed_sizes", f"SELECT * FROM ({mixed_sql(1)}) UNION ALL SELECT * FROM ({mixed_sql(3)})")
def vec02m(spark, sf):
    """Below and above the unrolled size, vectors of another size are left out alike."""
    out = None
    for times in (1, 3):
        long = F.flatten(F.array_repeat(F.col("embedding"), times))
        v = V.table(spark, sf, "embeddings").select("vec_id", long.alias("embedding"))
        q = list(v.filter("vec_id = 0").first()["embedding"])
        short = F.when(F.col("vec_id") % 7 == 3, F.slice("embedding", 1, len(q) - 1)).otherwise(F.col("embedding"))
        got = E.search(v.withColumn("embedding", short), q, 20, key="vec_id").select(F.lit(len(q)).alias("dim"), "vec_id", "score")
        out = got if out is None else out.unionByName(got)
    return out


@query("vec02_filtered", f"""
  SELECT 'first' AS mode, vec_id, score FROM (FROM ({COSINE_SQL}) WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 20) UNION ALL
  SELECT 'after', vec_id, score FROM (FROM ({COSINE_SQL}) ORDER BY score DESC, vec_id LIMIT 20) WHERE label = 3""")
def vec02f(spark, sf):
    v, q, cond = V.table(spark, sf, "embeddings"), probe(spark, sf), F.col("label") == 3
    first = E.search(v, q, 20, cond, True, "vec_id").select(F.lit("first").alias("mode"), "vec_id", "score")
    after = E.search(v, q, 20, cond, False, "vec_id").select(F.lit("after").alias("mode"), "vec_id", "score")
    return first.unionByName(after)


@query("vec01_append", """
  SELECT label AS collection, vec_id::VARCHAR AS id, CASE WHEN label < 4 THEN 1 ELSE 0 END AS version FROM embeddings""")
def vec01(spark, sf):
    v = V.table(spark, sf, "embeddings").select(F.col("label").alias("collection"), F.col("vec_id").cast("string").alias("id"), F.lit(0).alias("version"))
    return E.append(v, v.filter("collection < 4").withColumn("version", F.lit(1)), "overwrite")


@query("vec03_delete", "SELECT count(*) FILTER (label <> 4) AS kept, count(*) FILTER (label = 4) AS deleted FROM embeddings")
def vec03(spark, sf):
    kept, gone = E.delete(V.table(spark, sf, "embeddings"), F.col("label") == 4)
    return kept.agg(F.count(F.lit(1)).alias("kept")).select("kept", gone.scalar().alias("deleted"))


@query("vec04_sizes", "SELECT label AS collection, count(*) AS n_vectors FROM embeddings GROUP BY 1")
def vec04(spark, sf):
    return E.sizes(V.table(spark, sf, "embeddings").select(F.col("label").alias("collection")))


@query("vec05_profiles", """
  SELECT doc_id::VARCHAR AS id, left(sha256(t), 32) AS content_hash, list_sum(list_transform(range(0, 32), lambda i: ('0x' || substr(sha256(t), i * 2 + 1, 2))::BIGINT))::BIGINT * 2 AS vec_sum
  FROM (SELECT doc_id, source || '. ' || text AS t FROM documents) WHERE length(t) > 10""")
def vec05(spark, sf):
    w = V.table(spark, sf, "documents").select(F.col("doc_id").alias("work_id"), F.col("source").alias("title"), F.col("text").alias("abstract"))
    p = E.paper_profiles(w, "c1")
    total = F.aggregate("embedding", F.lit(0).cast("long"), lambda s, x: s + F.round(x * 255).cast("long"))
    return p.select("id", "content_hash", total.alias("vec_sum"))


@query("vec06_child_vectors", CHILDREN_SQL + " SELECT count(*) AS total_chunks, count(DISTINCT left(sha256(text), 32)) AS n_hashes FROM chi")
def vec06(spark, sf):
    v = E.child_vectors(K.child_chunks(docs(spark, sf), "doc_id"), "c1")
    return v.agg(F.count("embedding").alias("total_chunks"), F.countDistinct("content_hash").alias("n_hashes"))
