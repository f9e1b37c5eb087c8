"""Parent and child chunks, evidence retrieval, report tables (TXT-*).

Chunking runs inside the document row: sections, sentences and windows are
arrays, exploded at the end. No shuffle, whatever the number of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from paperloom.functions import text as X
from paperloom.operators.relate import papers_with_evidence
from paperloom.operators.sets import overlap
from paperloom.operators.skew import top_n
from paperloom.session import pin

# --- fixed values: windows and support thresholds ----------------------------------
PARENT_SIZE, PARENT_STEP = 8, 6
MIN_SCORE, MIN_OVERLAP = 0.12, 0.05


def section_rows(docs: DataFrame, work: str = "work_id", body: str = "text") -> DataFrame:
    """One row per section with its sentences and its first child number."""
    found = F.transform(
        X.sections(F.col(body)),
        lambda s: F.struct(s["name"].alias("name"), s["body"].alias("body"), X.sentences(s["body"]).alias("sents")),
    )
    parts = pin(
        docs.select(F.col(work).alias("work_id"), body), _secs=F.filter(found, lambda s: F.size(s["sents"]) > 0)
    ).drop(body)

    def children(n: Column) -> Column:
        starts = F.sequence(F.lit(0), n - 1, F.lit(PARENT_STEP))
        return F.aggregate(starts, F.lit(0), lambda a, at: a + F.least(F.lit(PARENT_SIZE), n - at))

    counted = pin(parts, _n=F.transform("_secs", lambda s: children(F.size(s["sents"]))))
    rows = counted.select("work_id", "_n", F.posexplode("_secs").alias("sec", "_s"))
    before = F.aggregate(F.slice("_n", 1, F.col("sec")), F.lit(0), lambda a, x: a + x)
    return rows.select(
        "work_id", "sec", F.col("_s.name").alias("section"), F.col("_s.body").alias("body"),
        F.col("_s.sents").alias("sents"), before.alias("first_child"),
    )


def parent_rows(sections: DataFrame) -> DataFrame:
    starts = F.sequence(F.lit(0), F.size("sents") - 1, F.lit(PARENT_STEP))
    rows = sections.select("*", F.posexplode(starts).alias("idx", "start"))
    earlier = F.aggregate(
        F.slice(starts, 1, F.col("idx")), F.lit(0),
        lambda a, at: a + F.least(F.lit(PARENT_SIZE), F.size("sents") - at),
    )
    key = X.stable_hash(
        {"work": X.json_text(F.col("work_id").cast("string")), "section": X.json_text(F.col("section")), "idx": F.col("idx").cast("string")}, 14
    )
    return (
        rows.withColumn("parent_id", F.concat(F.lit("P_"), key))
        .withColumn("n_sents", F.least(F.lit(PARENT_SIZE), F.size("sents") - F.col("start")))
        .withColumn("start_child_index", F.col("first_child") + earlier)
    )


def parent_chunks(docs: DataFrame, work: str = "work_id", body: str = "text") -> DataFrame:
    """TXT-04 parents: eight sentences every six."""
    rows = parent_rows(section_rows(docs, work, body)).withColumn(
        "text", F.array_join(F.slice("sents", F.col("start") + 1, F.lit(PARENT_SIZE)), " ")
    )
    return rows.select(
        "parent_id", "work_id", "section", F.col("idx").alias("parent_index"), "start_child_index",
        (F.col("start_child_index") + F.col("n_sents") - 1).alias("end_child_index"), "text",
        X.content_hash(F.col("text")).alias("content_hash"),
    )


def child_chunks(
    docs: DataFrame, work: str = "work_id", body: str = "text", max_per_work: int = 0, buckets: int = 0
) -> DataFrame:
    """TXT-04 children: each sentence of a parent with its neighbours.

    Offsets belong to the first occurrence of the sentence in its section.
    Offsets, token counts and, with ``buckets`` = dimension, hash buckets are
    computed once per sentence; a child adds up those of its three sentences. They are
    plain columns below the explode, so those that a reader does not ask for are not
    computed: the offsets of a long section cost the square of its length.
    """
    secs = section_rows(docs, work, body).withColumn("_at", F.transform("sents", lambda s: F.greatest(F.instr(F.col("body"), s) - 1, F.lit(0))))
    secs = secs.withColumns({
        "_cnt": F.transform("sents", X.token_count),
        "_tok": F.transform("_at", lambda at: X.token_count(F.substring(F.col("body"), F.lit(1), at))),
        "_bk": F.transform("sents", lambda s: X.bucket_array(s, buckets)) if buckets else F.array().cast("array<array<bigint>>"),
    })
    rows = parent_rows(secs.drop("body")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n_sents") - 1)).alias("_l")
    )
    j = F.col("start") + F.col("_l")

    def around(values: str) -> Column:
        return F.slice(values, F.greatest(j, F.lit(1)), F.when(j == 0, 2).otherwise(3))

    rows = rows.select(
        "work_id", "parent_id", "section",
        (F.col("start_child_index") + F.col("_l")).alias("child_index"),
        F.array_join(around("sents"), " ").alias("text"),
        F.get("_at", j).alias("char_start"),
        (F.get("_at", j) + F.length(F.get("sents", j))).alias("char_end"),
        F.get("_tok", j).alias("token_start"),
        (F.get("_tok", j) + F.aggregate(around("_cnt"), F.lit(0), lambda a, n: a + n)).alias("token_end"),
        *([F.flatten(around("_bk")).alias("buckets")] if buckets else []),
    )
    key = X.stable_hash(
        {"work": X.json_text(F.col("work_id").cast("string")), "parent": X.json_text(F.col("parent_id")), "idx": F.col("child_index").cast("string")}, 14
    )
    rows = rows.select(
        F.concat(F.lit("C_"), key).alias("child_id"), "*", X.content_hash(F.col("text")).alias("content_hash")
    )
    return rows.filter(F.col("child_index") < max_per_work) if max_per_work > 0 else rows


def materialization_status(works: DataFrame, children: DataFrame) -> DataFrame:
    """TXT-11"""
    n = children.groupBy("work_id").agg(F.count(F.lit(1)).alias("children"))
    return works.select("work_id").join(n, "work_id", "left").select(
        "work_id", F.col("children").isNotNull().alias("materialized"), F.coalesce("children", F.lit(0)).alias("children")
    )


def parent_context(parents: DataFrame, wanted: DataFrame) -> DataFrame:
    """TXT-12"""
    return parents.join(wanted.select("parent_id").distinct(), "parent_id", "left_semi")


def query_vectors(spark: SparkSession, queries: Sequence[str], dim: int = 64) -> list[list[float]]:
    """Unit hash vectors of a given list of query texts."""
    texts = F.array(*[F.lit(q) for q in queries])
    row = spark.range(1).select(
        F.transform(texts, lambda q: X.unit(X.counts_vector(X.bucket_array(q, dim), dim))).alias("v")
    ).first()
    return [list(v) for v in row["v"]]


def batch_best(children: DataFrame, vectors: list[list[float]], k: int) -> DataFrame:
    """Rows of children(child_id, ..., buckets) as (query_no, score, ...): of each Arrow batch the k best for each query vector."""
    weights = np.array(vectors).reshape(len(vectors), -1)
    kept = [c for c in children.columns if c != "buckets"]
    schema = StructType([*[children.schema[c] for c in kept], StructField("query_no", IntegerType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_dim = weights.shape[1]
        for b in batches:
            lists = b.column("buckets")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(b.num_rows), size) * n_dim + pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            counts = np.bincount(at, minlength=b.num_rows * n_dim).reshape(b.num_rows, n_dim).astype(float)
            norm = np.sqrt((counts * counts).sum(1))
            norm[norm == 0] = 1  # its counts are zero, too
            rest, names = b.select(kept), b.column("child_id")
            for q, w in enumerate(weights):
                score = np.round((counts * w).sum(1) / norm, 9)
                at = np.arange(b.num_rows)
                if b.num_rows > k:
                    at = np.flatnonzero(score >= np.partition(score, b.num_rows - k)[b.num_rows - k])
                # Code points sort as the UTF-8 bytes do.
                at = at[sorted(range(len(at)), key=lambda i, at=at, score=score: (-score[at[i]], names[int(at[i])].as_py()))[:k]]
                cols = [c.take(pa.array(at)) for c in rest.columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(at), q, np.int32)), pa.array(score[at])], names=schema.fieldNames())

    return children.mapInArrow(run, schema)


def search_evidence(
    children: DataFrame, queries: Sequence[str], k: int = 8, works: DataFrame | None = None, dim: int = 64
) -> DataFrame:
    """TXT-08: top k children per query by hash-embedding similarity.

    The query texts are arguments, so their vectors are constants of the plan: every
    child is read once and scored for all queries, and only the k best of an Arrow batch
    leave it, so neither a sort nor an exchange holds more. Scores equal to 9 decimals tie on child_id.
    """
    if works is not None:
        children = children.join(works.select("work_id").distinct(), "work_id", "left_semi")
    vectors = query_vectors(children.sparkSession, queries, dim)
    if "buckets" not in children.columns:
        children = children.withColumn("buckets", X.bucket_array(F.col("text"), dim))
    rows = children.select("child_id", "parent_id", "work_id", "section", F.col("text").alias("child_text"), "buckets")
    best = top_n(batch_best(rows, vectors, k), ["query_no"], [F.desc("score"), F.asc("child_id")], k, "rank")
    query = F.get(F.array(*[F.lit(q) for q in queries]), F.col("query_no"))
    best = best.withColumn("query", query)
    key = X.stable_hash({"query": X.json_text(F.col("query")), "child": X.json_text(F.col("child_id"))}, 14)
    return best.select(
        F.concat(F.lit("E_"), key).alias("evidence_id"), "query_no", "query", "rank", "work_id", "child_id", "parent_id",
        "section", "child_text", F.round("score", 6).alias("retrieval_score"), F.lit("uncertain").alias("support_status"),
    )


# --- fixed value: the warning of a bundle without records
NO_EVIDENCE = "No matching child chunks were available; summary should fall back to abstract-level evidence."


def evidence_bundle(evidence: DataFrame, queries: list[str] | None = None, works: DataFrame | None = None) -> DataFrame:
    """TXT-09: one row per query (at most k records each), with a warning if empty.

    ``queries``, numbered from 0 as in the search, also gives those without records
    a row. ``works(work_id, title, publication_year)`` adds the metadata of the
    works a bundle names.
    """
    record = F.struct("rank", "evidence_id", "work_id", "retrieval_score")
    bundle = evidence.groupBy("query_no", "query").agg(F.array_sort(F.collect_list(record)).alias("records"))
    kind = bundle.schema["records"].dataType
    if queries is not None:
        number = bundle.schema["query_no"].dataType
        asked = evidence.sparkSession.createDataFrame(list(enumerate(queries)), "query_no int, query string")
        asked = asked.withColumn("query_no", F.col("query_no").cast(number))
        bundle = asked.join(bundle, ["query_no", "query"], "left").withColumn("records", F.coalesce("records", F.array().cast(kind)))
    metadata = []
    if works is not None:
        meta = F.struct("work_id", "title", "publication_year")
        known = evidence.select("query_no", "work_id").distinct().join(works, "work_id")
        known = known.groupBy("query_no").agg(F.array_sort(F.collect_list(meta)).alias("works"))
        kind = known.schema["works"].dataType
        bundle = bundle.join(known, "query_no", "left").withColumn("works", F.coalesce("works", F.array().cast(kind)))
        metadata = ["works"]
    ids = F.concat(F.lit("["), F.array_join(F.transform("records", lambda r: F.concat(F.lit('"'), r["evidence_id"], F.lit('"'))), ", "), F.lit("]"))
    key = X.stable_hash({"question": X.json_text(F.col("query")), "records": ids}, 14)
    return bundle.select(
        F.concat(F.lit("EB_"), key).alias("evidence_bundle_id"), "query", "records",
        F.size(F.array_distinct("records.work_id")).alias("n_works"),
        F.when(F.size("records") == 0, F.array(F.lit(NO_EVIDENCE))).otherwise(F.array().cast("array<string>")).alias("warnings"), *metadata,
    )


def verify_claim(evidence: DataFrame, claim: str, min_score: float = MIN_SCORE) -> DataFrame:
    """TXT-10: supports, or uncertain."""
    shared = overlap(X.tokens(F.lit(claim)), X.tokens(F.col("child_text")))
    ok = (F.col("retrieval_score") >= min_score) & (shared > MIN_OVERLAP)
    return evidence.withColumn("term_overlap", F.round(shared, 6)).withColumn(
        "support_status", F.when(ok, "supports").otherwise("uncertain")
    )


def source_pack(key_papers: DataFrame, evidence: DataFrame, works: DataFrame, limit: int = 12) -> DataFrame:
    """TXT-14: citations E1.. of the top papers: best evidence, else abstract, else neither."""
    ranked = top_n(
        key_papers.withColumn("_all", F.lit(0)), ["_all"], [F.desc("score"), F.asc("work_id")], limit, "nth"
    ).drop("_all")
    rows = papers_with_evidence(ranked, evidence, works)
    found = F.col("child_id").isNotNull()
    abstract = F.coalesce("work_abstract", F.lit(""))
    return rows.select(
        F.concat(F.lit("E"), "nth").alias("citation_id"),
        F.when(found, "evidence_bundle").when(abstract != "", "corpus_abstract").otherwise("graph_key_paper").alias("source_type"),
        "work_id", "title",
        F.substring(F.when(found, F.col("child_text")).otherwise(abstract), 1, 500).alias("snippet"),
        F.when(found, F.col("retrieval_score")).otherwise(F.col("score")).alias("score"),
        "role", "publication_year", "nth",
    )


def field_guide(question: str, pack: DataFrame, topics: DataFrame) -> DataFrame:
    """TXT-15: the guide as one text row, from at most 12 citations and 20 topics."""
    paper = F.format_string(
        "- [%s] %s (%s) - %s - score %s", "citation_id", "title",
        F.coalesce(F.col("publication_year").cast("string"), F.lit("n.d.")), "role", F.col("score").cast("string"),
    )
    note = F.format_string("- [%s] %s", "citation_id", F.coalesce(F.nullif(F.substring(F.translate("snippet", "\n", " "), 1, 260), F.lit("")), F.lit("No snippet available.")))

    def block(df: DataFrame, order: Column, line: Column, n: int) -> Column:
        lines = df.orderBy(order).limit(n).select(F.struct(order.alias("o"), line.alias("t")).alias("x"))
        return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("b")).scalar()

    topic = F.format_string("- %s: %s papers", "topic", F.col("n_works").cast("string"))
    spark = pack.sparkSession
    return spark.range(1).select(
        F.concat_ws(
            "\n", F.lit(f"# Field Guide: {question}"), F.lit("\n## Main Topics"),
            block(topics.withColumn("_o", F.struct((-F.col("n_works")).alias("c"), "topic")), F.col("_o"), topic, 8),
            F.lit("\n## Key Papers"), block(pack, F.col("nth"), paper, 10),
            F.lit("\n## Evidence"), block(pack, F.col("nth"), note, 8),
        ).alias("markdown")
    )
