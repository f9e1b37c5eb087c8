"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import ann, archive, bpe, decontaminate, divergence, extract, language, payload, simhash, spelling, surrogates, toxicity, wordpiece
from paperloom.llm.batches import crc_bucket, prepare, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The demonstration key of the query; a user passes a secret of their own.
SURROGATE_KEY = b"paperloom-demonstration-key"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(prepare(spark), sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return wordpiece.token_counts(docs, tokenizer_path("byte_bpe_50k.json"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return surrogates.replaced(docs, SURROGATE_KEY)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    bucket = crc_bucket(F.col("doc_id"), 3)
    model = language.train(docs.filter(bucket != 1))
    out = docs.select("doc_id", "text", language.held_out(bucket, 1).alias("held_out"))
    return language.identified(out, model)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(prepare(spark), sf_dir, "pages")
    weights = extract.train(pages)
    out = extract.extracted(pages.select("page_id", "url", "html"), weights)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    bucket = crc_bucket(F.col("doc_id"), 4)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), bucket != 2)
    out = toxicity.scored(docs, model)
    flag = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return out.select("doc_id", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"), "score", flag)


def op9_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(table(prepare(spark), sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(prepare(spark), sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(prepare(spark), sf_dir, "documents"))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    out = payload.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("payload").alias("ids_crc32"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_multi_index": op2_multi_index,
    "op3_token_counts": op3_token_counts,
    "op4_surrogates": op4_surrogates,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_main_text": op7_main_text,
    "op8_toxicity": op8_toxicity,
    "op9_archive": op9_archive,
    "op10_bpe": op10_bpe,
    "op11_spelling": op11_spelling,
    "op12_divergence": op12_divergence,
    "op13_token_ids": op13_token_ids,
}
ORACLE_SQL: dict[str, str] = {
    "op9_archive": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f
    """,
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
            FROM documents
        ), t AS (
            SELECT r, lang, source, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM d
        ), kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
        ), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
        ), g AS (SELECT DISTINCT lang, source FROM d
        ), gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
        ), p AS (
            SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
                1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.total + v.v) AS p
            FROM gn JOIN v USING (lang) JOIN kept k USING (lang)
            LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term
        ), cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL
        ), ln AS (SELECT lang, sum(n) AS total FROM cl GROUP BY lang
        ), q AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (cl.n + 1)) // (ln.total + v.v) AS q FROM cl JOIN ln USING (lang) JOIN v USING (lang)
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pair AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), term AS (
            SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
            FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
            FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
