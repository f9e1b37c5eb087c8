"""SimHash near-duplicates by deletion-variant signatures (operator 6).

A fingerprint is cut into fewer segments than two bits each would need: with at
most four differing bits and three segments, one segment differs by at most one
bit. Each segment is indexed once per bit with that bit wiped out, so an equality
on (segment, wiped bit, remaining value) finds every such pair; the whole
fingerprint then verifies it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import fresh, mix64
from paperloom.operators.graph import connected_components
from paperloom.session import cut

SEED = 42
SHINGLE = 4
MAX_BITS = 4
PARTS = 3  # 4 differing bits in 3 segments: one segment holds at most one
BUCKET = 1 << 15  # members one bucket may have before it is split by further segments
COUNT_BLOCK = 1 << 18  # shingles whose bits are counted at once


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint of a text; 0 without words, one shingle below ``shingle`` words."""
    # bytes.lower and bytes.split touch A-Z and the ASCII white space only.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    last = end[min(shingle, len(words)) - 1 :]
    first = (end - size)[: len(last)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), COUNT_BLOCK):
        spans = zip(first[at : at + COUNT_BLOCK].tolist(), last[at : at + COUNT_BLOCK].tolist(), strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(last)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """All columns but the text, and the fingerprint as a signed long (same bits).

    Null and empty texts, and texts of white space only, have fingerprint 0.
    """
    keep = [c for c in docs.columns if c != text]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"))
    schema = ", ".join([*(f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "_fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t) for t in b.column("_text").to_pylist()], np.uint64)
            cols = [b.column(f"_k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(fp.view(np.int64))], names=[*(f"_k{i}" for i in range(len(keep))), "_fp"]
            )

    out = renamed.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_fp").alias(name))


def segments(rest: int, parts: int = PARTS) -> list[list[int]]:
    """The set bits of ``rest``, cut into at most ``parts`` runs of like length."""
    bits = [i for i in range(64) if rest >> i & 1]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def mask(bits: list[int]) -> int:
    return sum(1 << i for i in bits)


def variants(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Deletion variants of rows (key, fp, rest): the key narrowed by one segment less one bit.

    ``rest`` holds the bits that the key does not cover yet. Keys are 64-bit
    hashes; a chance collision only adds pairs that fail the verification.
    """
    key, fp, rest = (rows.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fp", "rest"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for left in np.unique(rest).tolist():
        at = rest == np.uint64(left)
        k, f = key[at], fp[at]
        for segment in segments(left):
            whole = mask(segment)
            for bit in segment:
                value = f & np.uint64(whole & ~(1 << bit))
                new = mix64(mix64(k + np.uint64(bit + 1)) ^ value)
                out.append((new, f, np.full(len(f), left & ~whole, np.uint64)))
    cols = [np.concatenate([o[i] for o in out]).view(np.int64) if out else np.zeros(0, np.int64) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "fp", "rest"])


def narrowed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield variants(b)

    return rows.mapInArrow(run, "key long, fp long, rest long")


def tree(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one bucket: as connected as all its pairs."""
    left, queue, a, b = fp, [], [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= max_bits
        if near.any():
            found = left[near]
            a.append(np.full(len(found), at, np.uint64))
            b.append(found)
            queue.extend(found)
            left = left[~near]
        if not len(left):
            break
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def bucket_links(rows: DataFrame, max_bits: int, bucket: int) -> DataFrame:
    """(a, b, key, rest, link) from rows sorted by key: links, or the members of overfull buckets.

    The rows of a key are read as a stream: at most ``bucket`` members are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(a, b, key, rest, link):
            cols = [np.asarray(c, np.uint64).view(np.int64) for c in (a, b, key, rest)]
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, cols), pa.array(np.full(len(a), link))], names=["a", "b", "key", "rest", "link"]
            )

        zero = lambda n: np.zeros(n, np.uint64)
        held = [zero(0)] * 3
        open_key = None  # a bucket that is already known to be overfull
        for batch in _with_end(batches):
            if batch is not None:
                new = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fp", "rest")]
                held = [np.concatenate([h, n]) for h, n in zip(held, new, strict=True)]
            key, fp, rest = held
            if not len(key):
                continue
            change = np.flatnonzero(key[1:] != key[:-1]) + 1
            start = np.concatenate([[0], change])
            end = np.concatenate([change, [len(key)]])
            if batch is not None:  # the last key may go on, unless it is overfull already
                if end[-1] - start[-1] <= bucket and key[-1] != open_key:
                    held = [h[start[-1] :] for h in held]
                    start, end = start[:-1], end[:-1]
                else:
                    held = [zero(0)] * 3
            else:
                held = [zero(0)] * 3
            size = end - start
            over = size > bucket
            if len(start) and open_key is not None:
                over |= key[start] == open_key
            if over.any():
                open_key = key[start[over][-1]]
                at = np.flatnonzero(np.repeat(over, size))
                yield emit(fp[at], fp[at], key[at], rest[at], False)
            a, b = [], []
            for n in np.unique(size[~over]):
                first = start[~over & (size == n)]
                if n < 2:
                    continue
                if n <= 8:
                    for i in range(n):
                        for j in range(i + 1, n):
                            x, y = fp[first + i], fp[first + j]
                            near = np.bitwise_count(x ^ y) <= max_bits
                            a.append(x[near])
                            b.append(y[near])
                else:
                    for s in first:
                        x, y = tree(fp[s : s + n], max_bits)
                        a.append(x)
                        b.append(y)
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                if len(a):
                    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                    yield emit(pairs[:, 0], pairs[:, 1], zero(len(pairs)), zero(len(pairs)), True)

    return rows.mapInArrow(run, "a long, b long, key long, rest long, link boolean")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(src, dst): links whose components equal those of all pairs within ``max_bits`` bits.

    ``distinct(fp long)`` holds each fingerprint once. A bucket with more than
    ``bucket`` members is not compared as a whole: its members get keys narrowed
    by a further segment of the bits left, by the same rule, until the buckets
    are small or no bits are left. No pair is lost on the way.
    """
    if max_bits >= 2 * PARTS:
        raise ValueError(f"{PARTS} segments find at most {2 * PARTS - 1} differing bits")
    rows = distinct.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(-1).cast("long").alias("rest"))
    found = None
    while True:
        # Out of bits, a bucket's size is bounded by the bits wiped on the way.
        keyed = narrowed(rows).repartition("key").sortWithinPartitions("key")
        out = cut(bucket_links(keyed, max_bits, bucket), "simhash-links")
        some = out.filter("link").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        found = some if found is None else found.unionByName(some)
        rows = out.filter("not link").select("key", F.col("a").alias("fp"), "rest").distinct()
        if rows.isEmpty():
            return found.distinct()
        last = rows.filter("rest = 0")
        if not last.isEmpty():  # the whole rest is wiped: compare what is left as it is
            ends = last.repartition("key").sortWithinPartitions("key")
            some = cut(bucket_links(ends, max_bits, 1 << 30), "simhash-ends").filter("link")
            found = found.unionByName(some.select(F.col("a").alias("src"), F.col("b").alias("dst")))
            rows = rows.filter("rest <> 0")


def named(prints: DataFrame, least: Column, max_bits: int, bucket: int) -> DataFrame:
    """(fp, name): for each fingerprint the least value of ``least`` over its component."""
    nodes = cut(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(least).alias("least")), "simhash-nodes")
    pairs = cut(links(nodes.select("fp"), max_bits, bucket), "simhash-pairs")
    return named_by(nodes, pairs)


def named_by(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, name): the least ``least`` of ``nodes(fp, least)`` over each component of ``pairs(src, dst)``."""
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    roots = connected_components(ends, pairs)
    joined = nodes.join(roots, nodes["fp"] == roots["id"], "left").withColumn("root", F.coalesce("component", "fp"))
    names = joined.groupBy("root").agg(F.min("least").alias("name"))
    return cut(joined.select("fp", "root").join(names, "root").select("fp", "name"), "simhash-names")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, bucket: int = BUCKET
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits; ``component_id`` is
    the smallest id reachable. Equal fingerprints are one node, so copies are never
    expanded into pairs. A null id never names a component while another member
    has an id; a component of null ids only has a null name. Null and empty texts
    share fingerprint 0 and link like any other. Repeated rows stay repeated.
    """
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))), "simhash")
    names = named(prints, F.col("doc_id"), max_bits, bucket)
    return prints.join(names, prints["fingerprint"] == names["fp"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("name").alias("component_id")
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, bucket: int = BUCKET
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the smallest id stays.

    A row with a null id stays only if its component has no id. Of rows that agree
    in id and text one stays. Texts without words are near-duplicates of each other.
    """
    row = fresh(docs, "_row")
    keyed = docs.withColumn(row, row_key(id_col, text))
    prints = fingerprints(keyed.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    prints = cut(prints, "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    return kept_rows(docs, keyed, row, prints, named(prints, first, max_bits, bucket))


def row_key(id_col: str, text: str) -> Column:
    """The same for rows that agree in id and text."""
    has_id = F.col(id_col).isNull().cast("string")
    return F.md5(F.concat_ws("\u0000", F.coalesce(F.col(id_col).cast("string"), F.lit("")), has_id, F.coalesce(text, F.lit(""))))


def kept_rows(docs: DataFrame, keyed: DataFrame, row: str, prints: DataFrame, names: DataFrame) -> DataFrame:
    """The rows that name their component; of equal rows one."""
    joined = prints.join(names, prints["fingerprint"] == names["fp"])
    # Rows that go are fewer than rows that stay: the texts meet the smaller table.
    gone = cut(joined.filter(F.col("row") != F.col("name.row")).select(F.col("row").alias(row)).distinct(), "simhash-gone")
    left = keyed.join(gone, row, "left_anti")
    again = prints.groupBy(F.col("row").alias(row)).count().filter("count > 1").select(row)
    again = cut(again.join(gone, row, "left_anti"), "simhash-again")
    own = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return left.select(*own)
    one = left.join(again, row, "left_semi").dropDuplicates([row])
    return left.join(again, row, "left_anti").unionByName(one).select(*own)
