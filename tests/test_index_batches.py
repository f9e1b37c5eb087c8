"""The order of an index's batches."""

from paperloom.operators import documents
from paperloom.session import new_table_path


def synced(spark, names):
    path = new_table_path(spark, "index")
    for name in names:
        docs = spark.createDataFrame([(1, f"of {name}")], "work_id long, title string")
        documents.sync_documents(docs, path, "work_id", batch=name)
    return documents.synced_documents(spark, path, docs.schema, "work_id").first()["title"]


def test_the_last_batch_counts(spark):
    assert synced(spark, ["9", "10"]) == "of 10"
    assert synced(spark, ["2", "100", "99"]) == "of 100"
    assert synced(spark, ["2024-09-30", "2024-10-01"]) == "of 2024-10-01"
