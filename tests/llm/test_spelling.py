"""Spelling variants against an edit distance of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import spelling
from paperloom.llm.batches import prepare
from paperloom.llm.queries import op11_spelling
from tests.llm.helpers import TEXTS, awkward, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def neighbours(words):
    """Near words by the words without one of their characters: at most one edit apart, two share such a rest."""
    rests = {}
    for w in words:
        for r in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            rests.setdefault(r, set()).add(w)
    out = {w: set() for w in words}
    for group in rests.values():
        for a in group:
            out[a] |= {b for b in group if abs(len(a) - len(b)) <= 1 and edits(a, b) == 1}
    return out


def plain(rows, near=None):
    n = plain_words(rows)
    near = near(n) if near else {a: {b for b in n if abs(len(a) - len(b)) <= 1 and edits(a, b) == 1} for a in n}
    form = {w: min(near[w], key=lambda b: (-n[b], b)) if near[w] else None for w in n}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    words = list(stems)
    for w in stems:
        for _ in range(3):
            at = rng.randrange(len(w))
            words.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "x" + w[at + 1 :]]))
    weights = [rng.random() ** 4 for _ in words]
    return [" ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=40)) for _ in range(120)]


def test_variants_equal_all_pairs(session):
    texts = [*TEXTS, *made(1), "Straße straße STRASSE", "a×b÷c a×b÷c a×b÷c"]
    ids = [None if i % 40 == 0 else i for i in range(len(texts))]
    got = spelling.variants(awkward(session, texts, ids).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(list(zip(ids, texts, strict=True)))


@pytest.mark.parametrize("group", [2, 7])
def test_overfull_groups_lose_no_pair(session, group):
    words = ["prefix" + "".join(x) for x in {tuple(random.Random(i).choices("abc", k=4)) for i in range(120)}]
    words += [w[::-1] for w in words] + ["y" * 150 + "a" + "z" * 150, "y" * 150 + "z" * 150, "y" * 150 + "b" + "z" * 150]
    texts = [" ".join(words)] * 4 + made(2)
    ids = list(range(len(texts)))
    got = spelling.variants(awkward(session, texts, ids), group=group).collect()
    assert sorted(map(tuple, got), key=repr) == plain(list(zip(ids, texts, strict=True)), neighbours)


def test_walk_of_sorted_lists():
    rng = random.Random(7)
    for _ in range(60):
        keys, words, shared = [], [], []
        for k in range(rng.randrange(1, 5)):
            prefix = "".join(rng.choice("ab") for _ in range(rng.randrange(4)))
            own = sorted({prefix + "".join(rng.choice("abc") for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 15))})
            keys, words, shared = keys + [str(k)] * len(own), words + own, shared + [len(prefix)] * len(own)
        a, b = spelling.near_pairs(keys, words, np.array(shared), rng.choice([3, 1000]))
        want = {(i, j) for i in range(len(words)) for j in range(len(words)) if keys[i] == keys[j] and edits(words[i], words[j]) == 1}
        assert len(a) == len(want) and set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_roots_follow_long_chains(session):
    forms = session.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(f"w{i}", "w37") for i in range(37)}


def test_empty_table(session):
    assert spelling.variants(empty(session)).count() == 0


def test_query(session):
    rows = session.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = op11_spelling(session, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == plain([(r["doc_id"], r["text"]) for r in rows], neighbours)
