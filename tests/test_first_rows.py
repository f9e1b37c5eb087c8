"""First rows per key: an aggregation, without a sort where only the keys are read."""

from pyspark.sql import functions as F

from tests.conftest import rows
from paperloom.operators.graph import typed_edges
from paperloom.operators.skew import first_per_key


def links(spark):
    data = [("a", 2, "x"), ("a", 1, "y"), ("a", None, "z"), ("b", 5, None), ("b", 7, "w"), (None, 3, "n"), (None, 4, "m")]
    return spark.createDataFrame(data, "k string, seq int, v string").repartition(4)


def test_first_rows_with_null_keys_and_orders(spark):
    want = [("a", "z"), ("b", None), (None, "n")]
    assert rows(first_per_key(links(spark), ["k"], ["seq"], ["v"])) == sorted(want, key=repr)
    last = [("a", "x"), ("b", "w"), (None, "m")]
    assert rows(first_per_key(links(spark), ["k"], [F.desc("seq")], ["v"])) == sorted(last, key=repr)


def test_keys_alone_are_not_sorted(spark):
    keys = first_per_key(links(spark), ["k"], ["seq"], ["v"]).select("k")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "HashAggregate" in plan
    assert rows(keys) == sorted([("a",), ("b",), (None,)], key=repr)


def test_subject_edges_by_score(spark):
    def one(schema, *data):
        return spark.createDataFrame(list(data), schema)

    scores = [("W1", "T0", 0.0), ("W1", "T1", 0.2), ("W1", "T2", 0.3), ("W1", "T3", 0.4), ("W1", "T4", None), ("W2", "T3", 0.9)]
    tables = {
        "works": one("work_id string, title string, type_name string", ("W1", "t", None)),
        "concepts": one("concept_id string, display_name string", *[(f"T{n}", "t") for n in range(5)]),
        "work_concepts": one("work_id string, concept_id string, score double", *scores),
        "citations": one("citing_work_id string, cited_work_id string"),
        "work_authors": one("work_id string, author_id string"),
        "work_venues": one("work_id string, venue_id string"),
        "author_institutions": one("author_id string, institution_id string"),
        "work_institutions": one("work_id string, institution_id string"),
        "work_author_affiliations": one("work_id string, author_id string, institution_id string"),
        "institutions": one("institution_id string, display_name string, country_code string"),
    }
    want = [("ABOUT", "T1", 0.2), ("ABOUT", "T2", 0.3), ("ABOUT", "T3", 0.4), ("HAS_TOPIC", "T3", 1.0)]
    got = rows(typed_edges(tables), "src", "dst", "type", "weight")
    assert got == sorted((("Paper:W1", f"Concept:{c}", kind, w) for kind, c, w in want), key=repr)
