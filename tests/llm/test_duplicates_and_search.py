"""SimHash links, decontamination and nearest neighbours against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from paperloom.llm import ann, decontaminate, simhash
from paperloom.llm.batches import prepare, utf8
from tests.llm.helpers import TEXTS, awkward, empty


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def plain_simhash(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for sign in "\t\n\x0b\x0c\r":
        words = words.replace(sign, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, most=4):
    parent = list(range(len(prints)))

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                parent[root(i)] = root(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return [best.get(root(i)) for i in range(len(ids))]


def test_fingerprint_is_the_contract():
    for t in [*TEXTS, "a b c d e", "x\x1cy z Q R s", "One two  three\tfour FIVE"]:
        assert simhash.simhash(t) == plain_simhash(t)


@pytest.mark.parametrize("bucket", [20, 2048])  # overfull buckets take the narrowed keys
def test_links_lose_nothing(session, bucket):
    rng = random.Random(bucket)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:12]:  # chains and balls of near fingerprints
        for _ in range(12):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            prints.append(p)
    prints += [(prints[0] & 0x3FFFFF) | rng.getrandbits(42) << 22 for _ in range(120)]  # one value of a whole segment
    prints = sorted(set(prints))
    frame = session.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    pairs = [(r["src"] % 2**64, r["dst"] % 2**64) for r in simhash.links(frame, bucket=bucket).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
    at = {p: i for i, p in enumerate(prints)}
    label = list(range(len(prints)))
    for _ in range(len(prints)):
        for a, b in pairs:
            label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
    assert label == components(prints, list(range(len(prints))))


def test_near_duplicates(session):
    base = " ".join(f"w{i}" for i in range(80))
    texts = [*TEXTS, base, base + " end", base.replace("w40", "v40"), base.upper(), "quite another text of some words"]
    ids = [None, 1, 1, *range(3, len(texts))]
    got = simhash.near_duplicates(awkward(session, texts, ids)).collect()
    prints = [plain_simhash(t) for t in texts]
    want = sorted(zip(map(repr, ids), (format(p, "016x") for p in prints), map(repr, components(prints, ids)), strict=True))
    assert sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(empty(session)).count() == 0


def test_keep_one(session):
    texts = [None, "", "one two three four five", "ONE two three four five", "one two three four five", "other words are here now"]
    docs = awkward(session, texts, [None, 7, 5, 3, 3, 9])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # ids 5, 3 and 3 are one group, of which two rows have the least id: one of them stays.
    assert sorted(r["doc_id"] for r in rows) == [3, 7, 9] and all(r["_row"] == "r" for r in rows)
    twice = docs.filter("doc_id = 9").unionByName(docs.filter("doc_id = 9"))
    assert simhash.keep_one(twice).count() == 1
    assert simhash.keep_one(empty(session)).count() == 0


ITEM = "The quick brown fox jumps over the lazy dog while seventeen purple elephants recite poetry to a bewildered audience of penguins."


def test_leaks_and_clean_documents(session):
    rng = random.Random(5)
    filler = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    typo = ITEM.replace("fox", "fux").replace("purple", "purpel")
    texts = [
        filler(50) + " " + ITEM + " " + filler(50), filler(20) + "\n" + ITEM.upper().replace(" ", "  ") + "!", typo, ITEM[:110],
        ITEM[:40], filler(400), None, "", ITEM, ITEM + filler(3000) + ITEM,
    ]
    docs = awkward(session, texts)
    bench = session.createDataFrame([(1, ITEM), (2, None), (3, "short"), (4, ""), (5, filler(30))], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2, 3, 8, 9} and {r["item_id"] for r in got} == {1}
    assert sum(r["doc_id"] == 9 for r in got) == 2  # both occurrences
    for r in got:
        span = texts[r["doc_id"]][r["start"] : r["end"]]
        assert span.lower().split()[0] in ("the", "he") and r["edits"] <= decontaminate.EDITS
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7]
    none = bench.filter("item_id < 0")
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.decontaminated(docs, none).count() == len(texts)
    assert decontaminate.leaks(empty(session), bench).count() == 0


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


def test_every_window_within_the_budget_is_found(monkeypatch):
    rng = random.Random(8)
    ix = decontaminate.build_index([(1, ITEM)])
    plain = "".join(c.lower() if c.isalnum() else " " for c in ITEM)
    for hits in (decontaminate.HITS, 1):  # also with the search cut into halves
        monkeypatch.setattr(decontaminate, "HITS", hits)
        for _ in range(40):
            chars = list(plain)
            for _ in range(rng.randint(0, 12)):
                k = rng.randrange(len(chars))
                chars[k : k + 1] = rng.choice([[], ["q"], [chars[k], "z"]])
            text = "xy " * rng.randint(0, 400) + "".join(chars) + " yx" * rng.randint(0, 400)
            hit = decontaminate.find(*utf8(pa.array([text])), ix)
            for w in range(len(ix.item)):
                pattern = "".join(map(chr, ix.codes[w][: ix.size[w]]))
                inside = edit_distance_inside(pattern, " ".join(text.split())) <= ix.edits[w]
                assert inside == (w in hit["window"].tolist())


def test_benchmark_in_blocks(session, monkeypatch):
    docs = awkward(session, [ITEM, "nothing to see here"])
    bench = session.createDataFrame([(i, ITEM if i == 3 else f"{i} filler item {i} " * 12) for i in range(8)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()] == [(0, 3)]


def exact(vectors, k=20):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % 20 == 0:
            out[q] = sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q))[:k]
    return out


def test_a_walk_over_all_cells_is_exact(session):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.standard_normal((300, 9)))]
    rows += [(1000 + i, rows[5][1]) for i in range(50)] + [(2000, None), (2020, [0.0] * 9), (2040, [None] * 9), (2060, [float("nan")] * 9), (2080, [float("inf")] * 9)]
    df = session.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, cell long")
    got = {}
    for r in ann.nearest(df, query_block=7, share=1.0).collect():  # several blocks of queries
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(rows)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[1] for f in found] == [i for _, i in want[q]]
        assert np.allclose([f[2] for f in found], [-s for s, _ in want[q]], rtol=0, atol=1e-12)


def test_search_edges(session):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(session.createDataFrame([], schema)).count() == 0
    assert ann.nearest(session.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    few = session.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0]), (20, None)], schema)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(few).collect()] == [(0, 1, 2), (0, 2, 3)]


def test_recall(session):
    df = session.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    want = exact(rows)
    hit = sum((r["vec_id"] in {i for _, i in want[r["query_id"]]}) for r in ann.nearest(df).collect())
    assert hit / sum(map(len, want.values())) >= 0.9
    assert hit < sum(map(len, want.values()))  # the default goes through the index on this table, too
