"""Column rules on hand-written values."""

import datetime as dt
import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.functions import clean as C
from paperloom.functions import text as X


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [
    ("https://works.example.org/W123", "W123"), ("https://works.example.org/W123/", "W123"), (" W9 ", "W9"), ("", ""), (None, ""),
])
def test_normalize_id(spark, value, want):
    assert one(spark, C.normalize_id(F.lit(value).cast("string"))) == want


def test_entity_id(spark):
    assert one(spark, C.entity_id(F.lit("https://x/A1/"))) == "A1"
    assert one(spark, C.entity_id(F.lit("https://x/A1/"), strip_slash=False)) is None
    assert one(spark, C.entity_id(F.lit(None).cast("string"))) is None


def test_strings_and_identifiers(spark):
    assert one(spark, C.clean_string(F.lit("  a　 "), 10)) == "a"
    assert one(spark, C.clean_string(F.lit(" \t "), 10)) is None
    assert one(spark, C.clean_string(F.lit("abcdef"), 3)) == "abc"
    assert one(spark, C.clean_orcid(F.lit("orcid.org/0000-0001-2345-678X"))) == "https://orcid.org/0000-0001-2345-678X"
    assert one(spark, C.clean_orcid(F.lit("none"))) is None
    assert one(spark, C.clean_doi(F.lit("HTTPS://doi.org/10.1/x"))) == "10.1/x"
    assert one(spark, C.clean_doi(F.lit("doi:10.1/x"))) == "10.1/x"
    assert one(spark, C.clean_issn(F.lit("1234567x"))) == "1234-567X"
    assert one(spark, C.clean_issn(F.lit("abc-1"))) == "ABC-1"
    assert one(spark, C.country2(F.lit("usa"))) == "US"
    assert one(spark, C.slugify(F.lit(" a b/ç中文 "))) == "a_b_中文"
    assert one(spark, C.venue_biblio(F.lit("1"), F.lit("2"))) == "Vol.1, No.2"
    assert one(spark, C.page_range(F.lit("3"), F.lit("9"))) == "3-9"
    assert one(spark, C.page_range(F.lit("3"), F.lit(None).cast("string"))) == "3"
    assert one(spark, C.page_range(F.lit(None).cast("string"), F.lit("9"))) is None


@pytest.mark.parametrize("value, want", [
    ("2024-02-29", dt.date(2024, 2, 29)), ("2024-2", dt.date(2024, 2, 1)), ("2024", dt.date(2024, 1, 1)), ("soon", None), ("2023-02-31", None),
])
def test_partial_dates(spark, value, want):
    assert one(spark, C.parse_partial_date(F.lit(value))) == want


def test_abstract(spark):
    index = F.create_map(F.lit("hello"), F.array(F.lit(0)), F.lit("world"), F.array(F.lit(1)))
    assert one(spark, C.abstract_text(index)) == "hello world"
    clash = F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(2)), F.lit("b"), F.array(F.lit(0)))
    assert one(spark, C.abstract_text(clash)) == "b a"
    assert one(spark, C.abstract_text(clash, keep_repeats=True)) == "a b a"
    assert one(spark, C.abstract_text(F.lit(None).cast("map<string,array<int>>"))) == ""


def test_stable_hash_matches_json_text(spark):
    value = {"work": 'W"1\n', "idx": 3, "section": "中"}
    want = hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:14]
    key = X.stable_hash({"work": X.json_text(F.lit(value["work"])), "idx": "3", "section": X.json_text(F.lit("中"))}, 14)
    assert one(spark, key) == want


def test_keywords(spark):
    words = one(spark, X.keywords(F.lit("帮我写一篇 Transformer 综述")))
    assert words == ["transformer"]
    long = " ".join(f"word{i}" for i in range(14))
    ks = F.lit(long)
    assert one(spark, X.keywords(ks)) == [f"word{i}" for i in range(12)]
    assert one(spark, X.alternate_queries(X.keywords(ks))) == ["word0 word1 word2", "word3 word4 word5 word6 word7 word8"]
    assert one(spark, X.keywords(F.lit(" 的 "))) == ["的"]


def test_sections_and_sentences(spark):
    text = "intro line\n## Methods\nfirst\r\n  second  \n#\n\n# Empty\n### Last one\nend"
    got = [(s["name"], s["body"]) for s in one(spark, X.sections(F.lit(text)))]
    assert got == [("body", "intro line"), ("Methods", "first\nsecond\n#\n"), ("Last one", "end")]
    s = one(spark, X.sentences(F.lit("A sentence of some length. Short.  Another sentence that is long!\nA third long enough line")))
    assert s == ["A sentence of some length.", "Another sentence that is long!", "A third long enough line"]


def test_headings_and_quality(spark):
    text = "1. Intro\nplain\nABSTRACT\n12.3 Data\n12345678. no"
    assert one(spark, X.headings(F.lit(text))) == ["1. Intro", "ABSTRACT", "12.3 Data"]
    assert one(spark, X.quality_ok(F.lit("x" * 60))) is True
    assert one(spark, X.quality_ok(F.lit("x" * 30 + "\x00" * 30))) is False
    assert one(spark, X.quality_ok(F.lit("short"))) is False


def test_hash_embedding(spark):
    text = "alpha beta alpha 中"
    vec = [0.0] * 64
    for t in ["alpha", "beta", "alpha", "中"]:
        vec[int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % 64] += 1
    norm = sum(x * x for x in vec) ** 0.5
    got = one(spark, X.unit(X.counts_vector(X.bucket_array(F.lit(text)))))
    assert got == pytest.approx([x / norm for x in vec])
    assert one(spark, X.bucket_norm(X.bucket_array(F.lit(text)))) == pytest.approx(norm)
    assert one(spark, X.unit(X.counts_vector(X.bucket_array(F.lit("..."))))) == [0.0] * 64
    digest = hashlib.sha256(text.encode()).digest()
    assert one(spark, X.digest_embedding(F.lit(text), 40)) == pytest.approx([digest[i % 32] / 255 for i in range(40)], abs=1e-6)


def test_token_counts_agree(spark):
    text = "The a_b 12 中文 x-y"
    toks = one(spark, X.tokens(F.lit(text)))
    assert toks == ["the", "a_b", "12", "中", "文", "x", "y"]
    assert one(spark, X.token_count(F.lit(text))) == len(toks)
    assert Counter(toks)["x"] == 1


def test_flat_props(spark):
    df = spark.sql("SELECT 'n1' AS id, 3 AS k, named_struct('a', 1) AS nested, array(1, 2) AS xs, cast(null AS string) AS gone")
    r = C.flat_props(df, ["id"]).first()
    assert json.loads(r["props"]) == {"id": "n1", "k": 3, "xs": [1, 2]}
    assert json.loads(r["properties_json"]) == {"id": "n1", "k": 3, "nested": {"a": 1}, "xs": [1, 2], "gone": None}


def test_index_values(spark):
    df = spark.sql("SELECT timestamp'2025-12-11 16:28:11' AS t, '2025-12-11 16:28:11' AS s, cast(1.5 AS decimal(5,2)) AS d, cast('x' AS binary) AS b")
    assert tuple(C.normalise_for_index(df).first()) == ("2025-12-11T16:28:11", "2025-12-11T16:28:11", 1.5, "x")
