"""Vector collections (VEC-*): rows (collection, id, embedding, ...)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text as X
from paperloom.operators.skew import first_per_key
from paperloom.operators.upsert import changed_content

NORM_EPSILON = 1e-8  # fixed value


def append(old: DataFrame, new: DataFrame, on_conflict: str = "keep_all") -> DataFrame:
    """VEC-01: plain append, or keyed overwrite by (collection, id)."""
    if on_conflict == "keep_all":
        return old.unionByName(new)
    rows = old.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    rest = [c for c in old.columns if c not in ("collection", "id")]
    return first_per_key(rows, ["collection", "id"], ["_old"], rest).select(*old.columns)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity with the small constant on both norms; null for a vector of another size."""
    q = [float(x) for x in query]
    length = sum(x * x for x in q) ** 0.5 + NORM_EPSILON
    scaled = [x / length for x in q]
    value = X.fixed_dot(vector, scaled) / (X.fixed_norm(vector, len(q)) + NORM_EPSILON)
    return F.when(F.size(vector) == len(q), value)


def search(
    vectors: DataFrame, query: Sequence[float], k: int = 10, where: Column | None = None, filter_first: bool = True, key: str = "id"
) -> DataFrame:
    """VEC-02: k nearest rows by cosine, among the vectors of the query's size.

    Vectors of another size have no cosine with the query and are left out.
    ``filter_first=False`` filters the k nearest, and may return fewer. The take
    is a partial sort per task, so k rows per task reach the driver.
    """
    rows = vectors.filter(where) if where is not None and filter_first else vectors
    rows = rows.filter(F.size("embedding") == len(query))
    top = rows.withColumn("score", F.round(cosine(F.col("embedding"), query), 6)).orderBy(F.desc("score"), F.asc(key)).limit(k)
    return top.filter(where) if where is not None and not filter_first else top


def delete(vectors: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """VEC-03: (rows that stay, one-row count of the deleted)."""
    hit = F.coalesce(where, F.lit(False))
    return vectors.filter(~hit), vectors.agg(F.count_if(hit).alias("deleted"))


def sizes(vectors: DataFrame) -> DataFrame:
    """VEC-04"""
    return vectors.groupBy("collection").agg(F.count(F.lit(1)).alias("n_vectors"))


def paper_profiles(works: DataFrame, corpus: str, stored: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """VEC-05: embed "title. abstract"; short texts and unchanged hashes are skipped."""
    rows = works.select(
        F.lit("paper_emb").alias("collection"), F.col("work_id").cast("string").alias("id"), "title",
        F.concat_ws(". ", "title", "abstract").alias("text"), F.lit(corpus).alias("corpus_id"),
    ).filter(F.length("text") > 10)
    return _embedded(rows, stored, dim)


def child_vectors(children: DataFrame, corpus: str, stored: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """VEC-06: the same for child chunks, on their real text."""
    rows = children.select(
        F.lit("chunk_emb").alias("collection"), F.col("child_id").alias("id"), "work_id", "text", F.lit(corpus).alias("corpus_id")
    )
    return _embedded(rows, stored, dim)


def _embedded(rows: DataFrame, stored: DataFrame | None, dim: int) -> DataFrame:
    rows = rows.withColumn("content_hash", X.content_hash(F.col("text")))
    if stored is not None:
        rows = changed_content(rows, stored, ["id"])
    return rows.withColumn("embedding", X.digest_embedding(F.col("text"), dim)).drop("text")


def embedding_run(vectors: DataFrame, corpus: str, backend: str, dim: int) -> DataFrame:
    """VEC-05: the run record, one row."""
    return vectors.agg(F.count(F.lit(1)).alias("total_chunks")).select(
        F.lit(corpus).alias("corpus_id"), F.lit(backend).alias("embedder_backend"), "total_chunks", F.lit(dim).alias("vector_dim")
    )


def embed(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]) -> DataFrame:
    """Hook for a model embedder: ``load`` runs once per task and returns a batch function."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in model(batch.fillna("").tolist())])

    return df.withColumn("embedding", run(F.col(text)))
