"""The pipeline's stages and the registered queries on the smallest tables."""

import importlib.util
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import bpe, queries, surrogates, toxicity
from paperloom.llm.batches import crc_bucket, prepare, utf8
from paperloom.session import cut
from tests.llm.test_near_copies import plain_kept

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs, out = prepare(spark).read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        got = cut(stage(spark, docs, SF))
        out.append((docs, got))
        docs = got
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_are_kept(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.schema.simpleString() == before.schema.simpleString()


def test_toxicity_stage(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(before, labels, crc_bucket(F.col("doc_id"), 4) != 2)
    given = rows(before)
    one_by_one = {i: toxicity.scores(*utf8(pa.array([r["text"]])), model)[0] for i, r in given.items()}
    assert set(rows(after)) == {i for i, s in one_by_one.items() if s < toxicity.THRESHOLD}
    assert all(given[i] == r for i, r in rows(after).items())


def test_near_duplicate_stage(stages):
    given, kept = rows(stages[1][0]), rows(stages[1][1])
    ids = sorted(given)
    names = {ids[k] for k in plain_kept([given[i]["text"] for i in ids])}
    assert set(kept) == names and all(given[i] == r for i, r in kept.items())


def test_decontamination_stage(spark, stages):
    given, kept = rows(stages[2][0]), rows(stages[2][1])
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, r in given.items() if any(t in r["text"] for t in items)}
    assert not held & set(kept)
    folded = lambda t: "".join(c.lower() for c in t if c.isalnum())
    parts = {folded(t)[k : k + 12] for t in items for k in range(0, len(folded(t)) - 12)}
    for i in set(given) - set(kept) - held:  # what else went shares long passages with an item
        text = folded(given[i]["text"])
        assert sum(text[k : k + 12] in parts for k in range(len(text) - 12)) >= 12


def test_surrogate_stage(stages):
    given, kept = rows(stages[3][0]), rows(stages[3][1])
    assert set(given) == set(kept)
    for i, r in given.items():
        found = surrogates.entities(r["text"])
        if not found:
            assert kept[i] == r
        else:
            assert kept[i]["text"] != r["text"] and kept[i]["n_chars"] == len(kept[i]["text"])
            assert not {r["text"][a:b] for a, b, *_ in found} & {kept[i]["text"][a:b] for a, b, *_ in surrogates.entities(kept[i]["text"])}


def test_bpe_stage(stages):
    given, kept = rows(stages[4][0]), rows(stages[4][1])
    tok = bpe.tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    assert set(given) == set(kept)
    for i, r in given.items():
        assert kept[i]["text"] == r["text"] and list(kept[i]["ids"]) == tok.encode(r["text"], add_special_tokens=False).ids


def test_archive_query_against_sql(spark):
    spec = importlib.util.spec_from_file_location("parity", ROOT / "tools" / "parity.py")
    parity = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(parity)
    got = queries.QUERIES["op9_archive"](spark, SF)
    assert parity.compare(got, parity.duck(SF), queries.ORACLE_SQL["op9_archive"])[0] == "ok"


def test_query_columns(spark):
    want = {
        "op2_multi_index": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
        "op5_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op6_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op7_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op9_archive": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
        "op10_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    }
    for name, columns in want.items():
        kinds = dict(queries.QUERIES[name](spark, SF).dtypes)
        assert {c: kinds[c] for c in columns} == columns, name


def test_language_query(spark):
    got = queries.QUERIES["op5_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert held and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
