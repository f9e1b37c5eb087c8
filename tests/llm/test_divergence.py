"""The source divergence audit against a count in dictionaries."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import divergence
from paperloom.llm.batches import arrays, prepare, utf8
from paperloom.llm.perfect import build, joined
from paperloom.llm.queries import ORACLE_SQL, op12_divergence
from tests.llm.helpers import TEXTS, empty

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def plain(rows, min_docs=3, top=200):
    """(lang, source, part, item, value, rank) of (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, Counter(WORD.findall(text.translate(LOWER)))) for lang, source, text in rows]
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, n in found:
        docs[lang].update(n.keys())
        groups[lang, source].update(n)
        groups[lang, None].update(n)
    out = []
    for lang, source in [g for g in groups if g[1] is not None]:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def share(s, lang=lang, kept=kept):
            n = sum(groups[lang, s][t] for t in kept)
            return {t: 1 + 10**9 * (groups[lang, s][t] + 1) // (n + len(kept)) for t in kept}

        p = share(source)
        pair = []
        for other in [s for g, s in groups if g == lang and s not in (None, source)]:
            q = share(other)
            pair.append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
        q = share(None)
        term = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if groups[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            items = sorted(items, key=lambda x: (-x[1], x[0]))[:most]
            out += [(lang, source, part, i, v, k + 1) for k, (i, v) in enumerate(items)]
    return sorted(out)


def frame(session, rows):
    full = [(i, t, lang, source, "x", 1) for i, (lang, source, t) in enumerate(rows)]
    return session.createDataFrame(full, "doc_id long, text string, lang string, source string, term string, n long")


def made(n):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé漢Z") for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    rows = [
        (rng.choice(["en", "de", None]), f"s{min(rng.randrange(12), rng.randrange(12))}", " ".join(rng.choices(words, k=rng.randrange(60))))
        for _ in range(n)
    ]
    rows += [("en", None, t) for t in TEXTS] + [("xx", f"s{i}", f"only once {i}") for i in range(3)]  # no kept term
    long = "unbroken" * 200
    rows += [("en", "s1", f"{long} {long}x-{long}"), ("en", "s2", long), ("en", "s2", long), ("en", "s3", "A" + long[1:])]
    return [*rows, *[("en", "hot", "the same words the")] * (n // 2)]


def test_terms_equal_the_pattern():
    texts = ["", "Añb_c 1x[Y]é", "AB", "CD", None, "  ", "漢字 \U0001f600x\x7fz", "a"]
    words, doc = divergence.terms(*utf8(pa.array(texts)))
    want = [(w, i) for i, t in enumerate(texts) for w in WORD.findall((t or "").translate(LOWER))]
    assert list(zip([w.decode() for w in words.to_pylist()], doc.tolist(), strict=True)) == want


def test_audit_equals_dictionaries(session):
    rows = made(300)
    got = sorted(map(tuple, divergence.audit(frame(session, rows)).collect()))
    assert got == plain(rows)


def test_small_shards_blocks_and_counters(session):
    rows = made(120)
    small = {"shard_terms": 16, "block_bytes": 6000, "dense_bytes": 500, "sources_block": 3, "top": 4}
    got = sorted(map(tuple, divergence.audit(frame(session, rows).repartition(4), **small).collect()))
    assert got == plain(rows, top=4)


def test_a_shard_with_another_seed():
    slots = divergence.Slots([(0, 1, _blob(["aa", "bb", "cc"], 45))])
    assert sorted(slots.of(pa.array([b"bb", b"cc", b"aa", b"zz"], pa.large_binary())).tolist()) == [-1, 0, 1, 2]


def _blob(terms, seed):
    keys = [t.encode() for t in terms]
    h = divergence.hashes(keys, seed)
    sizes, words = build(h)
    order = np.argsort(joined([(sizes, words)]).slots(h, np.zeros(len(h), np.int64)))
    keys = [keys[i] for i in order]
    ends = np.cumsum([0, *map(len, keys)])
    return arrays(sizes=sizes, words=words, ends=ends, keys=np.frombuffer(b"".join(keys), np.uint8), seed=np.array([seed]))


def test_large_counts_are_exact():
    counts = np.array([0, 5, 10**13, 3 * 10**17], np.int64)
    total = int(counts.sum()) + 4
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]
    p, q = np.array([10**9, 1, 7]), np.array([1, 10**9, 7])
    assert divergence.distance(p, q).tolist() == [(a - b) ** 2 // b for a, b in zip(p.tolist(), q.tolist(), strict=True)]


def test_empty_table(session):
    assert divergence.audit(empty(session)).count() == 0


def test_query_equals_sql(session):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rel = con.execute(ORACLE_SQL["op12_divergence"])
    names = [d[0] for d in rel.description]
    got = op12_divergence(session, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(rel.fetchall())
