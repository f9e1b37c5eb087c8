"""The data dictionary of stored tables, from parquet footers."""

from paperloom.session import new_table_path
from paperloom.sources import tables as T


def test_counts_and_ranges_of_many_files(spark):
    path = new_table_path(spark, "many-files")
    df = spark.range(1000).selectExpr(
        "id", "if(id % 10 = 0, null, id * 0.5D) AS half", "cast(id AS string) AS name", "array(id, null) AS list", "struct(id AS x) AS inner", "cast(null AS int) AS nothing"
    )
    df.repartition(7).write.parquet(path)
    d = T.stored_dictionary(spark, {"t": path, "u": f"{path}-gone"}, {"t": "about t"}, {"half": "a half"})
    got = {(r["table_name"], r["column_name"]): r for r in d.collect()}
    assert [got["t", c]["position"] for c in df.columns] == [0, 1, 2, 3, 4, 5]
    assert all(got["t", c]["row_count"] == 1000 and got["t", c]["table_description"] == "about t" for c in df.columns)
    seen = {c: (got["t", c]["null_count"], got["t", c]["low"], got["t", c]["high"]) for c in df.columns}
    assert seen == {
        "id": (0, 0, 999), "half": (100, 0.5, 499.5), "name": (0, None, None), "list": (None, None, None),
        "inner": (None, None, None), "nothing": (1000, None, None),
    }
    assert got["t", "half"]["column_description"] == "a half"
    assert got["u", None]["skipped"] == "not found" and len(got) == 7


def test_an_empty_table(spark):
    path = new_table_path(spark, "no-rows")
    spark.createDataFrame([], "a int").write.parquet(path)
    r = T.stored_dictionary(spark, {"t": path}).first()
    assert (r["column_name"], r["row_count"], r["low"]) == ("a", 0, None)
