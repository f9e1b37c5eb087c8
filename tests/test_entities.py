"""One full work record, and the relational split of it."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import entities as E
from paperloom.operators import relate as J
from paperloom.sources import works as W
from tests.conftest import rows

WORK = {
    "id": "https://works.example.org/W1", "title": " A work ", "publication_year": 2024, "type": "article", "cited_by_count": 5,
    "authorships": [
        {"author": {"id": "https://works.example.org/A1", "display_name": "Ann"}, "author_position": "first", "is_corresponding": True,
         "institutions": [{"id": "https://works.example.org/I1", "display_name": "One", "country_code": "US"},
                          {"id": "https://works.example.org/I2", "display_name": "Two", "country_code": "GB"}],
         "raw_affiliation_strings": ["Dept, One"]},
        {"author": {"id": "https://works.example.org/A2", "display_name": "Bob"}, "institutions": [{"id": "https://works.example.org/I1", "display_name": "One", "country_code": "US"}]},
        {"author": {"id": "https://works.example.org/A3"}},
    ],
    "topics": [{"id": "https://works.example.org/C1", "display_name": "Topic", "score": 0.9}],
    "primary_location": {"source": {"id": "https://works.example.org/V1", "display_name": "Venue", "issn": ["12345678"], "is_oa": True}},
    "referenced_works": ["https://works.example.org/W2", "https://works.example.org/W2/"],
}


@pytest.fixture(scope="module")
def raw(spark):
    second = {"id": "W3", "title": None, "raw": 1, "topics": [], "concepts": [{"id": "C9", "display_name": "Old"}], "authorships": [
        {"author": {"id": "A1", "display_name": "Ann Later"}, "institutions": [], "raw_affiliation_strings": "plain text"}]}
    bad = {"title": "no id"}
    return W.parse_works(spark.createDataFrame([(0, json.dumps(WORK)), (1, json.dumps(second)), (2, json.dumps(bad))], "seq long, json string"))


def test_split_counts(raw):
    b = E.clean_batch(raw)
    assert rows(b["works"], "work_id", "title") == [("W1", "A work"), ("W3", "(untitled)")]
    assert rows(b["work_authors"], "work_id", "author_id", "author_order") == [("W1", "A1", 0), ("W1", "A2", 1), ("W3", "A1", 0)]
    assert rows(b["author_institutions"]) == [("A1", "I1"), ("A1", "I2"), ("A2", "I1")]
    assert rows(b["work_institutions"]) == [("W1", "I1"), ("W1", "I2")]
    assert rows(b["work_author_affiliations"], "author_id", "institution_id", "raw_affiliation_string") == [
        ("A1", "I1", "Dept, One"), ("A1", "I2", "Dept, One"), ("A2", "I1", None)]
    assert rows(b["countries"]) == [("GB",), ("US",)]
    assert rows(b["work_types"]) == [("article",)]
    assert rows(b["citations"]) == [("W1", "W2")]
    assert rows(b["authors"], "author_id", "display_name") == [("A1", "Ann"), ("A2", "Bob")]
    assert rows(b["work_concepts"], "work_id", "concept_id", "score", "source") == [("W1", "C1", 0.9, "topics")]
    assert rows(b["work_venues"], "work_id", "venue_id", "is_primary") == [("W1", "V1", True)]
    assert rows(b["venues"], "venue_id", "issn_print", "is_open_access") == [("V1", "1234-5678", True)]
    assert dict(rows(E.batch_counts(b)))["works"] == 2


def test_external_refs(raw):
    ext = J.external_refs(E.citations(raw), E.works(raw))
    assert rows(ext, "external_work_id", "first_seen_from") == [("W2", "W1")]


def test_three_way_link_needs_an_institution(raw):
    assert rows(E.work_author_institutions(raw), "author_id", "institution_id", "author_order") == [
        ("A1", "I1", 1), ("A1", "I2", 1), ("A2", "I1", 2)]


def test_affiliation_text_may_be_a_plain_string(raw):
    s = raw.select("seq", F.explode("authorships").alias("a")).select("seq", E.affiliation_strings(F.col("a")).alias("s"))
    assert (1, ["plain text"]) in rows(s)


def test_json_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"id": "W1", "title": "x"}))
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"results": [{"id": "W2"}, {"title": "none"}]}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text(json.dumps([{"id": "W4"}]))
    got = W.read_works_tree(spark, str(tmp_path))
    assert rows(got, "id") == [("W1",), ("W2",), ("W4",)]
    assert rows(W.read_works_tree(spark, str(tmp_path), limit=1), "id") == [("W1",)]


def test_jsonl_fails_on_a_broken_line(spark, tmp_path):
    good = tmp_path / "g.jsonl"
    good.write_text('{"id": "W1"}\n\n{"id": "W2"}\n')
    assert rows(W.read_works_jsonl(spark, str(good)), "id") == [("W1",), ("W2",)]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"id": "W1"}\n{"id": \n')
    with pytest.raises(Exception):
        W.read_works_jsonl(spark, str(bad)).collect()


def test_resumable_ingest(spark, tmp_path):
    drop, table, check = (str(tmp_path / n) for n in ("drop", "table", "check"))
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "1.jsonl").write_text('{"id": "W1"}\n{"id": "W2"}\n')
    assert W.ingest_new_works(spark, drop, table, check) == 2
    (tmp_path / "drop" / "2.jsonl").write_text('{"id": "W3"}\n')
    assert W.ingest_new_works(spark, drop, table, check) == 1
    assert spark.read.parquet(table).count() == 3
