"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k0 string, score string, _row string, ids string, `a.b` long"


def awkward(spark: SparkSession, texts: list[str | None], ids: list[int | None] | None = None) -> DataFrame:
    """Documents with columns whose names clash with inner ones."""
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, None, None, None if t is None else len(t), "x", "s", "r", "i", 1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


LONG = "word sequence that goes on and on with numbers 12345 and signs ;:! " * 3000
TEXTS = [None, "", " \t\n", "one", "A b C", LONG, "same text here twice over", "same text here twice over", "ünïcode ß 漢字   end"]
