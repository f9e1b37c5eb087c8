"""Corpus pipeline: each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, decontaminate, minhash, surrogates, toxicity
from paperloom.llm.batches import crc_bucket, fresh, prepare, table
from paperloom.llm.queries import SURROGATE_KEY, tokenizer_path
from paperloom.session import cut


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go. It learns from the labels of the given documents."""
    prepare(spark)
    learn = crc_bucket(F.col("doc_id"), 4) != 2
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), learn))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8 or more) the smallest id stays.

    SimHash links and MinHash bands propose the pairs, the exact shingle sets decide.
    """
    prepare(spark)
    return minhash.keep_one(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    prepare(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates; ``n_chars`` follows the text."""
    prepare(spark)
    got = surrogates.replaced(docs, SURROGATE_KEY, out=fresh(docs, "_entities"))
    chars = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.withColumn("n_chars", chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text as these decode."""
    prepare(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path), path)
    return both.select(
        "doc_id", "lang", "source", F.col("decoded").alias("text"), F.size("ids").cast("long").alias("n_tokens"), "ids"
    )


STAGES = [
    ("toxicity", toxic_out),
    ("near-dedup", near_duplicates_out),
    ("benchmark decontamination", contaminated_out),
    ("surrogates", personal_data_replaced),
    ("bpe", encoded),
]
ORACLE_SQL = None  # trained scores, shingle similarities and merges are beyond SQL; tests hold brute force against it


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
