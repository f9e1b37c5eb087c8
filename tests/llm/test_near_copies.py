"""The pipeline's near-copies: exact Jaccard similarity of 5-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import minhash
from paperloom.llm.batches import prepare
from tests.llm.helpers import TEXTS, awkward, empty


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_kept(texts):
    """The least number of each component of the links at similarity 0.8, by all pairs."""
    sets, label = [plain_set(t) for t in texts], list(range(len(texts)))
    links = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
        if a == b or 5 * len(a & b) >= 4 * len(a | b)
    ]
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return set(label)


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_at_similarity_four_fifths(session):
    rng = random.Random(3)
    texts = list(TEXTS)
    for size in (30, 60, 120, 300):
        for _ in range(12):
            words = [f"w{rng.randrange(10**5)}" for _ in range(size)]
            texts += [" ".join(words), *(changed(rng, words, n) for n in {1, size // 60, size // 45, size // 30})]
    want = plain_kept(texts)
    stage = corpus_pipeline.STAGES[1][1]
    got = {r["doc_id"] for r in stage(session, awkward(session, texts), "").collect()}
    assert got == want
    assert minhash.keep_one(empty(session)).count() == 0


def test_a_large_group_of_near_copies(session):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = [changed(rng, words, 2) for _ in range(300)] + [changed(rng, words, 60) for _ in range(20)]
    got = {r["doc_id"] for r in minhash.keep_one(awkward(session, texts)).collect()}
    assert got == plain_kept(texts)


def test_a_forest_joins_what_all_pairs_join():
    rng = random.Random(6)
    for _ in range(40):
        pool = [rng.randrange(2**62) for _ in range(14)]
        sets = [np.array(sorted(rng.sample(pool, rng.randrange(5, 14)))) for _ in range(rng.randrange(2, 30))]
        given = np.array([rng.randrange(12) for _ in sets])

        def joined(links, given=given):
            label = given.tolist()
            for _ in label:
                for i, j in links:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
            return label

        full = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))]
        found = minhash.forest(sets, given)
        assert joined(found) == joined(full) and len(found) < len(set(given.tolist()))


@pytest.mark.parametrize("held", [minhash.HELD, 4000])
def test_crowded_buckets_lose_no_link(session, held):
    """Texts of several components, most pairs below the similarity, in the same few buckets; small ``held``: in blocks."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):  # about 0.6 to each other
        own = changed(rng, base, 6).split()
        texts += [" ".join(own), changed(rng, own, 2)] if rng.random() < 0.5 else [" ".join(own)]
    texts += [" ".join(base[:n]) for n in range(90, 120, 3)]
    want = plain_kept(texts)
    got = {r["doc_id"] for r in minhash.keep_one(awkward(session, texts), held=held).collect()}
    assert got == want and 30 < len(want) < len(texts)


def test_equality_counts(session):
    a, b = " ".join(f"w{i}" for i in range(12)), " ".join(f"w{i}" for i in range(14))  # 8 of 10 shingles
    assert len(plain_set(a) & plain_set(b)) * 5 == len(plain_set(a) | plain_set(b)) * 4
    assert [r["doc_id"] for r in minhash.keep_one(awkward(session, [a, b])).collect()] == [0]
