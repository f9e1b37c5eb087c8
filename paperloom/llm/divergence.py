"""How far the words of each source are from the other sources of its language (operator 12).

The first pass counts in how many documents of a language each term occurs; an exact
threshold leaves the kept terms. They are dealt into shards, each shard gets a
minimal perfect hash that stores its terms by slot, and the hashes are broadcast.
The second pass looks every term up, compares it with the stored one and adds to
a dense row of slots for its (lang, source) and for its lang. From there on
numbers travel, no words.

All arithmetic is exact: shares are billionths in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.batches import arrays, arrays_of, slices, utf8
from paperloom.llm.perfect import Perfect, build, joined
from paperloom.operators.skew import top_n
from paperloom.session import cut

MIN_DOCS = 3
UNIT = 1_000_000_000
TOP_TERMS = 200
SHARD_TERMS = 1 << 13  # of a perfect hash
KEY_BYTES = 64  # a longer term is stored as its 64-byte BLAKE2b digest
BLOCK_BYTES = 64 << 20  # of hashes broadcast at once; beyond, the documents are read once for each block
SLICE_BYTES = 4 << 20  # text whose terms are found at once
DENSE_BYTES = 96 << 20  # of counters that a task holds; then it hands them on and starts anew
SOURCES_BLOCK = 64  # sources of a language that meet in one task, about; more are compared block by block
SEED = 42  # that of Spark's xxhash64


# --- terms ---------------------------------------------------------------------


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms, text of each) of back-to-back UTF-8 texts: runs of ASCII letters and code points from 0x80, A-Z lower-cased."""
    upper = (raw >= 0x41) & (raw <= 0x5A)
    ok = upper | ((raw >= 0x61) & (raw <= 0x7A)) | (raw >= 0x80)
    begins = ok.copy()
    begins[1:] &= ~ok[:-1]
    edge = off[:-1][np.diff(off) > 0]
    begins[edge] = ok[edge]
    at = np.flatnonzero(begins)
    kept = np.where(upper, raw | 0x20, raw)[ok]
    place = np.cumsum(ok)  # letters up to here
    offsets = np.append(place[at] - 1, len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    return words, np.searchsorted(off, at, "right") - 1


@dataclass
class Spoken:
    """The terms of one language in some texts, grouped by source."""

    lang: str
    distinct: pa.Array
    term: np.ndarray  # index into ``distinct``
    doc: np.ndarray
    sources: list[tuple[str, int, int]]  # with the range of terms


def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[Spoken]:
    """From (lang, source, text) without nulls."""
    for whole in batches:
        for b in slices(whole, "text", SLICE_BYTES):
            b = b.sort_by([("lang", "ascending"), ("source", "ascending")])
            words, doc = terms(*utf8(b.column("text")))
            names = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True))
            first = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            at = np.searchsorted(doc, [*first, len(names)])
            by_lang: dict[str, list[tuple[str, int, int]]] = {}
            for i, a, z in zip(first, at[:-1].tolist(), at[1:].tolist(), strict=True):
                by_lang.setdefault(names[i][0], []).append((names[i][1], a, z))
            for lang, sources in by_lang.items():
                a, z = sources[0][1], sources[-1][2]
                coded = words.slice(a, z - a).dictionary_encode()
                yield Spoken(lang, coded.dictionary, coded.indices.to_numpy(), doc[a:z], [(s, x - a, y - a) for s, x, y in sources])


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term): terms in at least ``min_docs`` documents of their language; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in spoken(batches):
            if len(s.distinct):
                in_docs = np.unique(s.doc * len(s.distinct) + s.term) % len(s.distinct)
                n = np.bincount(in_docs, minlength=len(s.distinct))
                term = s.distinct.cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([s.lang] * len(n)), term, pa.array(n.astype(np.int64))], names=["lang", "term", "n"])

    counts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


# --- perfect hashes ------------------------------------------------------------


def stored(key: bytes) -> bytes:
    """What a slot stores of a term, of bounded size: shorter than a digest, it is the term."""
    return key if len(key) < KEY_BYTES else hashlib.blake2b(key, digest_size=KEY_BYTES).digest()


def hashes(keys: list[bytes], seed: int = SEED) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys), np.uint64, len(keys))


def pages(kept: DataFrame, shard_terms: int) -> DataFrame:
    """(lang, shard, shards, n, hash, terms): a perfect hash for each shard, its terms in the order of its slots."""
    sized = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_terms)).cast("int").alias("shards"))
    dealt = kept.join(sized, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys = [k.encode() for k in t.column("term").to_pylist()]
        seed = SEED
        while True:
            try:
                h = hashes(keys, seed)
                sizes, words = build(h)
                break
            except ValueError:  # two terms with one hash: take the next seed
                seed += 1
        order = np.argsort(joined([(sizes, words)]).slots(h, np.zeros(len(h), np.int64)))
        keys = [keys[i] for i in order.tolist()]
        own = [stored(k) for k in keys]
        ends = np.cumsum([0, *map(len, own)])
        blob = arrays(sizes=sizes, words=words, ends=ends, keys=np.frombuffer(b"".join(own), np.uint8), seed=np.array([seed]))
        return pa.table({
            "lang": [key[0].as_py()], "shard": pa.array([key[1].as_py()], pa.int32()), "shards": pa.array([t.column("shards")[0].as_py()], pa.int32()),
            "n": pa.array([len(keys)], pa.int32()), "hash": pa.array([blob], pa.binary()), "terms": pa.array([[k.decode() for k in keys]], pa.list_(pa.string())),
        })

    return dealt.groupBy("lang", "shard").applyInArrow(run, "lang string, shard int, shards int, n int, hash binary, terms array<string>")


class Slots:
    """The broadcast shards of one language."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        rows = sorted(rows)
        self.shards, self.numbers = rows[0][1], [r[0] for r in rows]
        parts = [arrays_of(r[2]) for r in rows]
        self.perfect: Perfect = joined([(p["sizes"], p["words"]) for p in parts])
        self.here = np.full(self.shards, -1, np.int64)  # a shard's place in this block
        self.here[self.numbers] = np.arange(len(rows))
        self.seeds = {i: int(p["seed"][0]) for i, p in enumerate(parts) if p["seed"][0] != SEED}
        ends = np.concatenate([[0], *(np.diff(p["ends"]) for p in parts)]).cumsum()
        data = np.concatenate([p["keys"] for p in parts])
        self.keys = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])

    def of(self, distinct: pa.Array) -> np.ndarray:
        """The slot of each term in this block; -1 for terms that are not kept or lie in other blocks."""
        keys = distinct.to_pylist()
        h = hashes(keys)
        shard = self.here[h.view(np.int64) % self.shards]
        for i, seed in self.seeds.items():
            own = np.flatnonzero(shard == i)
            h[own] = hashes([keys[j] for j in own.tolist()], seed)
        out = np.full(len(keys), -1, np.int64)
        inside = np.flatnonzero(shard >= 0)
        slot = self.perfect.slots(h[inside], shard[inside])
        inside, slot = inside[slot >= 0], slot[slot >= 0]
        asked = pa.array([stored(keys[j]) for j in inside.tolist()], pa.large_binary())
        same = pc.equal(self.keys.take(pa.array(slot)), asked).to_numpy(zero_copy_only=False)
        out[inside[same]] = slot[same]
        return out


def blocks_of(table: DataFrame, block_bytes: int) -> list[list]:
    """Rows (lang, shard, shards, hash) to broadcast, in blocks of at most ``block_bytes`` or one shard; one block at a time is collected."""
    size = F.length("hash")
    total = table.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    while n > 1 or total > block_bytes:
        block = F.pmod(F.xxhash64("lang", "shard"), F.lit(n))
        worst = table.groupBy(block.alias("b")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("k"))
        if worst.filter((F.col("bytes") > block_bytes) & (F.col("k") > 1)).isEmpty():
            break
        n *= 2
    rows = table.select("lang", "shard", "shards", "hash")
    for i in range(n):
        yield rows.filter(F.pmod(F.xxhash64("lang", "shard"), F.lit(n)) == i).collect()


# --- second pass ---------------------------------------------------------------

COUNTED = "lang string, source string, shard int, slots array<int>, counts array<long>"


def list_rows(lang: str, source: str | None, shard: list[int], ends: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    off = pa.array(ends.astype(np.int32))
    cols = [
        pa.array([lang] * len(shard), pa.string()), pa.array([source] * len(shard), pa.string()), pa.array(shard, pa.int32()),
        pa.ListArray.from_arrays(off, pa.array(slots.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(counts.astype(np.int64))),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "shard", "slots", "counts"])


def recount(docs: DataFrame, block: list, dense_bytes: int) -> DataFrame:
    """COUNTED rows of each task: the counts that are not zero, by group and shard. A null source is the whole language."""
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in block])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list] = {}
        for lang, shard, shards, blob in sent.value:
            by_lang.setdefault(lang, []).append((shard, shards, bytes(blob)))
        tables: dict[str, Slots] = {}
        dense: dict[tuple[str, str | None], np.ndarray] = {}
        held = seen = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), row in dense.items():
                full = np.flatnonzero(row)
                first = tables[lang].perfect.first
                ends = np.searchsorted(full, first)
                some = np.flatnonzero(np.diff(ends))
                if len(some):
                    base = np.repeat(first[some], np.diff(ends)[some])
                    numbers = [tables[lang].numbers[i] for i in some.tolist()]
                    yield list_rows(lang, source, numbers, np.append(ends[some], len(full)), full - base, row[full])

        for s in spoken(batches):
            if s.lang not in by_lang or not len(s.distinct):
                continue
            if s.lang not in tables:
                tables[s.lang] = Slots(by_lang[s.lang])
            slot = tables[s.lang].of(s.distinct)[s.term]
            n = int(tables[s.lang].perfect.first[-1])
            for source, a, z in [*s.sources, (None, 0, len(slot))]:
                if (s.lang, source) not in dense:
                    dense[s.lang, source] = np.zeros(n, np.uint32)
                    held += 4 * n
                own = slot[a:z]
                np.add.at(dense[s.lang, source], own[own >= 0], 1)
            seen += len(slot)
            if held > dense_bytes or seen > 1 << 31:
                yield from handed_on()
                dense, held, seen = {}, 0, 0
        yield from handed_on()

    return docs.select("lang", "source", "text").mapInArrow(run, COUNTED)


def summed(rows: DataFrame) -> DataFrame:
    """COUNTED rows, one for each (lang, shard, source), and their ``total``. A key's rows are read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, row = None, np.zeros(0, np.int64)

        def close() -> pa.RecordBatch:
            full = np.flatnonzero(row)
            out = list_rows(open_key[0], open_key[2], [open_key[1]], np.array([0, len(full)]), full, row[full])
            return out.append_column("total", pa.array([int(row.sum())]))

        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in ("lang", "shard", "source")), strict=True)
            slots, counts = b.column("slots"), b.column("counts")
            ends, slots, counts = slots.offsets.to_numpy(), slots.values.to_numpy(), counts.values.to_numpy()
            for i, key in enumerate(keys):
                if key != open_key:
                    if open_key is not None:
                        yield close()
                    open_key, row = key, np.zeros(0, np.int64)
                at = slots[ends[i] : ends[i + 1]]
                if at[-1] >= len(row):
                    row = np.append(row, np.zeros(at[-1] + 1 - len(row), np.int64))
                row[at] += counts[ends[i] : ends[i + 1]]
        if open_key is not None:
            yield close()

    dealt = rows.repartition("lang", "shard", "source").sortWithinPartitions("lang", "shard", "source")
    return dealt.mapInArrow(run, f"{COUNTED}, total long")


# --- results -------------------------------------------------------------------


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exactly."""
    most = int(counts.max(initial=0)) + 1
    if most < (1 << 63) // UNIT:
        return 1 + UNIT * (counts + 1) // total
    return np.array([1 + UNIT * (int(c) + 1) // total for c in counts], np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of positive shares; unsigned, below 2^61."""
    d = (p - q).astype(np.uint64)  # wraps like its square
    return (d * d) // q.astype(np.uint64)


def all_shares(n: int, total: int, slots: list | None, counts: list | None) -> np.ndarray:
    out = np.full(n, shares(np.zeros(1, np.int64), total)[0])
    if slots:
        out[slots] = shares(np.array(counts, np.int64), total)
    return out


def pair_sums(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): distances from source to item, summed over a shard.

    ``rows`` has every source of a language for each of its shards. Blocks of
    sources meet pair by pair.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = rows.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        rows = t.select(["source", "block", "n", "size", "slots", "counts"]).to_pylist()
        share = np.stack([all_shares(r["n"], r["size"], r["slots"], r["counts"]) for r in rows])
        at = {b: [k for k, r in enumerate(rows) if r["block"] == b] for b in {i, j}}
        out: list[tuple[str, str, int]] = []
        for a, b in {(i, j), (j, i)}:
            q = share[at[b]]
            for k in at[a]:
                value = distance(share[k], q).sum(axis=1, dtype=np.uint64).tolist()
                out += [(rows[k]["source"], rows[o]["source"], v) for o, v in zip(at[b], value, strict=True) if o != k]
        cols = [[key[0].as_py()] * len(out), [o[0] for o in out], [o[1] for o in out]]
        return pa.table([*(pa.array(c, pa.string()) for c in cols), pa.array([o[2] for o in out], pa.int64())], names=["lang", "source", "item", "value"])

    return met.groupBy("lang", "shard", "i", "j").applyInArrow(run, "lang string, source string, item string, value long")


def term_heads(rows: DataFrame, whole: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): of each source and shard the ``top`` terms that are commoner there than in the language."""
    facts = whole.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    facts = facts.select(*[F.col(c).alias(c) for c in facts.columns])  # both sides come from one table

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_source, out_item, out_value = [], [], []
        if left.num_rows and right.num_rows:
            r = right.to_pylist()[0]
            q = all_shares(len(r["terms"]), r["size"], r["slots"], r["counts"])
            raw = [t.encode() for t in r["terms"]]
            rank = np.empty(len(raw), np.int64)
            rank[sorted(range(len(raw)), key=raw.__getitem__)] = np.arange(len(raw))
            for s in left.select(["source", "size", "slots", "counts"]).to_pylist():
                at = np.array(s["slots"] or [], np.int64)
                p = shares(np.array(s["counts"] or [], np.int64), s["size"])
                at, p = at[p > q[at]], p[p > q[at]]
                value = distance(p, q[at]).astype(np.int64)
                best = np.lexsort((rank[at], -value))[:top]
                out_source += [s["source"]] * len(best)
                out_item += [r["terms"][i] for i in at[best].tolist()]
                out_value.append(value[best])
        lang = left.column("lang")[0].as_py() if left.num_rows else None
        value = np.concatenate([np.zeros(0, np.int64), *out_value])
        cols = [pa.array([lang] * len(value), pa.string()), pa.array(out_source, pa.string()), pa.array(out_item, pa.string()), pa.array(value)]
        return pa.table(cols, names=["lang", "source", "item", "value"])

    both = rows.groupBy("lang", "shard", "block").cogroup(facts.groupBy("lang", "shard", "block"))
    return both.applyInArrow(run, "lang string, source string, item string, value long")


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    shard_terms: int = SHARD_TERMS,
    block_bytes: int = BLOCK_BYTES,
    dense_bytes: int = DENSE_BYTES,
    sources_block: int = SOURCES_BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    Part ``pair``: the sum of the distances of all kept terms to each other source of
    the language. Part ``term``: the ``top`` terms that are commoner than in the
    language. Ranks go by descending value, then by item in UTF-8. Null texts, langs and
    sources read as empty; each row is a document, also a repeated one. A group
    without terms has pairs; a language without kept terms has pairs of value 0. Other columns
    are ignored. An empty table gives no rows. Sums fit a long for fewer than two
    thousand million kept terms.
    """
    read = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    given = docs.select(read(lang, "lang"), read(source, "source"), read(text, "text"))
    table = cut(pages(kept_terms(given, min_docs), shard_terms), "term-hashes")
    parts = [recount(given, block, dense_bytes) for block in blocks_of(table, block_bytes)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    counted = cut(summed(rows), "term-counts")

    group = given.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).drop("docs")
    group = cut(group, "sources")
    kept = table.groupBy("lang").agg(F.sum("n").alias("kept"))
    n = counted.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    blocks = group.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(sources_block)).cast("int").alias("blocks"))
    named = group.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    named = named.unionByName(blocks.withColumns({"source": F.lit(None).cast("string"), "block": F.lit(None).cast("int")}))
    same = lambda a, b: (a["lang"] == b["lang"]) & a["source"].eqNullSafe(b["source"])
    facts = named.join(n, same(named, n), "left").select(named["*"], F.coalesce("total", F.lit(0)).alias("total")).join(kept, "lang")
    facts = cut(facts.withColumn("size", F.col("total") + F.col("kept")), "source-sizes")

    # Every group has a row for every shard of its language, also without a count there.
    full = facts.join(table.select("lang", "shard", "n"), "lang")
    on = (full["lang"] == counted["lang"]) & (full["shard"] == counted["shard"]) & full["source"].eqNullSafe(counted["source"])
    full = cut(full.join(counted, on, "left").select(full["*"], "slots", "counts"), "source-shards")
    own, whole = full.filter("source is not null"), full.filter("source is null")

    sums = pair_sums(own).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = group.join(group.withColumnRenamed("source", "item"), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    order = [F.col("value").desc(), F.col("item").asc()]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    head = term_heads(own, whole.drop("block").join(table.select("lang", "shard", "terms"), ["lang", "shard"]), top)
    ranked = top_n(head, ["lang", "source"], order, top, "rank")
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(ranked.withColumn("part", F.lit("term")).select(*columns))
