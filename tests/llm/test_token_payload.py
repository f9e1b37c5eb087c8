"""Token ids in raw files, read back by key through the perfect hash index."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paperloom.llm import payload, perfect
from paperloom.llm.batches import gathered, prepare, utf8
from paperloom.llm.queries import op13_token_ids, tokenizer_path
from paperloom.session import new_table_path
from tests.llm.helpers import TEXTS, awkward, empty

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def plain(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def ids_of(blob):
    return np.frombuffer(blob, "<u4").tolist()


def test_perfect_hashes_give_each_key_its_own_slot():
    rng = np.random.default_rng(1)
    shards = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 2, 1000, 5000)]
    table = perfect.joined([perfect.build(h) for h in shards])
    assert np.diff(table.first).tolist() == [len(h) for h in shards]
    for i, h in enumerate(shards):
        got = table.slots(h, np.full(len(h), i))
        assert sorted(got.tolist()) == list(range(table.first[i], table.first[i + 1]))
    with pytest.raises(ValueError):
        perfect.build(np.array([7, 7], np.uint64))


def test_round_trip_equals_the_library(session):
    texts = [*TEXTS, "a<|endoftext|>b", "!!! ! 0", "don't we'll   x\n\n\ty"]
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    want, start = {}, 0
    for i, tokens in sorted(zip(ids, plain(texts), strict=True)):
        want[i] = (start, tokens)
        start += len(tokens)
    got = payload.round_trip(awkward(session, texts, ids), PATH).collect()
    assert {r["doc_id"]: (r["start"], ids_of(r["payload"])) for r in got} == want and len(got) == len(texts)


def test_small_files_and_index_buckets_repeated_and_null_ids(session):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["word", "Wort", "mot", "42", "é"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts[7] = "long " * 5000  # beyond a file's size
    ids = [None if i % 50 == 0 else 5 if i % 3 == 0 else i for i in range(300)]  # one id holds a third of the rows
    folder = new_table_path(session, "small-files")
    docs = awkward(session, texts, ids).repartition(5)
    payload.write_ids(docs, PATH, folder, file_bytes=1000, bucket_keys=16)
    assert session.read.parquet(f"{folder}/files").count() > 12
    assert session.read.parquet(f"{folder}/buckets").count() > 5
    got = payload.read_ids(session, folder, docs, PATH).collect()
    want = plain(texts)
    found = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, ids_of(r["payload"])) for r in got))
    assert found == sorted((i is not None, i or 0, t) for i, t in zip(ids, want, strict=True))
    # In order of the ids, without gaps.
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(ids_of(r["payload"]))
        at += r["n_tokens"]
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert in_order == sorted(ids, key=lambda i: (i is not None, i or 0))
    # Keyed access: some ids, one of them unknown.
    some = session.createDataFrame([(5,), (8,), (99999,), (8,)], "doc_id long")
    part = payload.read_ids(session, folder, some, PATH).collect()
    assert sorted(r["doc_id"] for r in part) == sorted([8, *(i for i in ids if i == 5)])


def test_lost_files_are_not_read(session):
    docs = awkward(session, ["one", "two"], [1, 2])
    folder = payload.write_ids(docs, PATH, new_table_path(session, "lost"))
    payload.put(folder, "ids-000000-000000-of-a-lost-task.bin", b"\x01\x00")
    assert payload.read_ids(session, folder, docs, PATH).count() == 2


def test_empty_table(session):
    assert payload.round_trip(empty(session), PATH).count() == 0


def test_query(session):
    rows = session.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r) for r in op13_token_ids(session, "/root/testdata/sf0.001").collect()}
    start = 0
    for r, tokens in zip(rows, plain([r["text"] for r in rows]), strict=True):
        assert got[r["doc_id"]] == (r["doc_id"], start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        start += len(tokens)
    assert len(got) == len(rows)


def test_words_are_encoded_once_over_short_batches(monkeypatch):
    """Short batches are encoded together, and a full table of words forgets no word in use."""
    texts = [f"common words w{i} again" if i % 7 else "" for i in range(200)]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 5])}) for i in range(0, 200, 5)]
    assert [b.num_rows for b in gathered(iter(batches), "text", 1 << 20)] == [200]
    assert pa.Table.from_batches(gathered(iter(batches), "text", 300)).column("text").to_pylist() == texts
    asked, real = [], payload.tokenizer(PATH)

    class Counted:
        def encode_batch_fast(self, words, **options):
            asked.extend(words)
            return real.encode_batch_fast(words, **options)

    monkeypatch.setattr(payload, "tokenizer", lambda path: Counted())
    encoder, got = payload.WordIds(PATH, most=20), []
    for b in gathered(iter(batches), "text", 300):
        ids, ends = encoder.of_texts(*utf8(b.column("text")))
        got += [ids[a:z].tolist() for a, z in zip(ends, ends[1:])]
    assert got == plain(texts)
    assert asked.count("common") == asked.count(" again") == 1 and len(encoder.older) > 0
    ids, ends = encoder.of_texts(*utf8(pa.array([], pa.string())))
    assert len(ids) == 0 and ends.tolist() == [0]
