"""BPE, token counts and language codes against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import bpe, language, queries, wordpiece
from paperloom.llm.batches import prepare, slices, utf8
from tests.llm.helpers import LONG, TEXTS, awkward, empty

PATH = queries.tokenizer_path("byte_bpe_50k.json")
SIGNS = ["'", "s", "t", "re", "ve", " ", "  ", "\n", "a", "é", "1", "²", "-", "'s", "I'm", "<|endoftext|>", "漢", " ", "　", "😀", "\r\n", "<|", "|>", "\x85"]


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def test_split_equals_the_tokenizer():
    rng = random.Random(1)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    raw, off = utf8(pa.array(texts))
    words, first = bpe.split_chunk(raw, off, bpe.added_tokens(PATH))
    blob, tok = raw.tobytes(), bpe.tokenizer(PATH)
    for i, t in enumerate(texts):
        own = [blob[words[k] : words[k + 1]].decode() for k in range(first[i], first[i + 1])]
        assert "".join(own) == t
        ids = [x for w in own for x in tok.encode(w, add_special_tokens=False).ids]
        assert ids == tok.encode(t, add_special_tokens=False).ids


def test_bpe_round_trip(session):
    texts = [*TEXTS, "a <|endoftext|> b", "it's  ok\n\n\nx "]
    docs = awkward(session, texts, [None, 1, 1, *range(3, len(texts))])
    for chunk in (40, bpe.CHUNK_BYTES):  # many chunks and one
        got = bpe.decode(bpe.encode(docs, PATH, chunk_bytes=chunk), PATH)
        assert set(got.columns) == {*docs.columns, "decoded"}
        rows = got.collect()
        tok = bpe.tokenizer(PATH)
        want = sorted((t or "", tok.encode(t or "", add_special_tokens=False).ids) for t in texts)
        assert sorted((r["text"] or "", list(r["ids"])) for r in rows) == want
        assert all(r["decoded"] == (r["text"] or "") and r["k0"] == "x" and r["a.b"] == 1 for r in rows)
        assert sum(r["text"] is None for r in rows) == 1
    assert bpe.decode(bpe.encode(empty(session), PATH), PATH).count() == 0


def test_words_forgotten_by_a_task_are_encoded_again(session, monkeypatch):
    docs = awkward(session, [LONG, LONG + " more"])
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 1)
    rows = bpe.encode(docs, PATH).collect()
    tok = bpe.tokenizer(PATH)
    assert {len(r["ids"]) for r in rows} == {len(tok.encode(t, add_special_tokens=False).ids) for t in (LONG, LONG + " more")}


def test_decode_odd_ids(session):
    df = session.createDataFrame([([50256, -1, 60000, None],), ([],), (None,), ([222],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df, PATH).collect()] == ["<|endoftext|>", "", "", "�"]


def greedy(word: bytes, first: set, inner: set) -> int:
    n = at = 0
    while at < len(word):
        for k in range(len(word), at, -1):
            if word[at:k] in (first if at == 0 else inner):
                break
        else:
            return -1
        at, n = k, n + 1
    return n


def test_longest_match_equals_brute_force():
    rng = random.Random(2)
    make = lambda top: "".join(rng.choice("abc") for _ in range(rng.randint(1, top))).encode()
    for _ in range(150):
        first, inner = [make(4) for _ in range(6)], [make(4) for _ in range(6)]
        words = [b"", *(make(9) for _ in range(60))]
        off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        got = wordpiece.lengths(wordpiece.build(first, inner), np.frombuffer(b"".join(words), np.uint8), off[:-1], off[1:])
        assert got.tolist() == [greedy(w, set(first), set(inner)) for w in words]


def test_token_counts(session):
    first, inner = wordpiece.byte_vocabulary(PATH)
    first, inner = set(first), set(inner)
    docs = awkward(session, TEXTS)
    got = {r["doc_id"]: r for r in wordpiece.token_counts(docs, PATH).collect()}
    for i, t in enumerate(TEXTS):
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if w]
        known = {w: greedy(b" " + w, first, inner) for w in set(words)}
        assert (got[i]["n_words"], got[i]["n_tokens"], got[i]["n_unknown"]) == (len(words), sum(known[w] for w in words), 0)
        assert got[i]["k0"] == "x"
    assert wordpiece.token_counts(empty(session), PATH).count() == 0


def test_language_codes(session):
    rng = random.Random(3)
    words = {"xx": "gro bla tok mun del".split(), "yy": "shi nai kor emi usa".split(), "zz": "ploč žena čaj šum ždral".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i, k in enumerate(list(words) * 30)]
    docs = session.createDataFrame([*rows, (90, None, "xx"), (91, "123 !", "yy"), (92, "gro bla tok", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identified(docs, model).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 and not got[i]["ambiguous"] for i, _, k in rows)
    assert [(got[i]["lang_pred"], got[i]["score"], got[i]["ambiguous"]) for i in (90, 91)] == [("und", 0.0, True)] * 2
    assert got[92]["lang_pred"] == "xx"
    mixed = session.createDataFrame([(1, "gro shi bla nai tok kor mun emi del usa gro shi bla nai")], "doc_id long, text string")
    assert language.identified(mixed, model).first()["score"] < 0.99
    none = language.train(docs.filter("doc_id < 0"))
    assert {r["lang_pred"] for r in language.identified(docs, none).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 30])
def test_codewords_are_far_apart(n):
    code = language.codewords(n)
    assert code.shape[0] == n
    for i in range(n):
        for j in range(i):
            assert (code[i] != code[j]).sum() >= min(2 ** (n - 2), 5)


def test_slices_keep_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * k if k % 5 else None for k in range(40)])], names=["text"])
    for limit in (1, 7, 100, 10_000):
        parts = list(slices(b, "text", limit))
        assert pa.Table.from_batches(parts).to_pylist() == b.to_pylist()
