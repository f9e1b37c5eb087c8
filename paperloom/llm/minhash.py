"""Near-copies by exact Jaccard similarity of word shingles (the pipeline's second stage).

SimHash fingerprints propose pairs, as in operator 6: segments, keys with one bit wiped
out, equality by key, at most four differing bits. At the threshold most pairs differ
by more (about ten bits), so MinHash bands propose the others. The shingle sets decide
on all. Texts with the same set are one node. A pair at the threshold meets in a band with
probability 1 - (1 - 0.8 ** ROWS) ** BANDS, which is 0.9999; above it with more. Of the
pairs that meet, no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import simhash
from paperloom.llm.batches import fresh, mix64, slices
from paperloom.llm.simhash import kept_rows, named_by, row_key
from paperloom.operators.graph import connected_components
from paperloom.session import cut

SEED = 42
SHINGLE = 5
FOUR_OF_FIVE = (4, 5)  # similarity 0.8, as a fraction, so that equality counts
BANDS = 32
ROWS = 6
HELD = 1 << 20  # shingles of a bucket whose members are compared in one piece
SLICE = 1 << 20  # text bytes whose shingles are hashed at once
FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; below ``shingle`` words one for the whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    last = end[min(shingle, len(words)) - 1 :]
    spans = zip((end - size)[: len(last)].tolist(), last.tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(last)))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of non-empty sets, one row of BANDS keys each."""
    start = np.cumsum([0, *map(len, sets)])[:-1]
    values = np.concatenate(sets)
    out = np.zeros((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for factor in FACTORS[band * ROWS : (band + 1) * ROWS]:
            key = mix64(key ^ np.minimum.reduceat(values * factor, start))
        out[:, band] = key
    return out


def hashed(rows: DataFrame) -> DataFrame:
    """(row, doc_id, fingerprint, size, bands, simhash) of (row, doc_id, text); the fingerprint names the shingle set."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                sets = [shingles(t) for t in b.column("text").to_pylist()]
                full = [s for s in sets if len(s)]
                keys = iter(bands(full).view(np.int64).tolist() if full else [])
                near = np.array([simhash.simhash(t, SHINGLE) for t in b.column("text").to_pylist()], np.uint64)
                name = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64)
                cols = [
                    b.column("row"), b.column("doc_id"), pa.array(name.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())), pa.array(near.view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "fingerprint", "size", "bands", "simhash"])

    return rows.mapInArrow(run, f"row string, doc_id {kind}, fingerprint long, size long, bands array<long>, simhash long")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(fp, items) of (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [shingles(t).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(items, pa.list_(pa.int64()))], names=["fp", "items"])

    return rows.mapInArrow(run, "fp long, items array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (src, dst) whose shingle sets reach the similarity."""
    a = sets.select(F.col("fp").alias("src"), F.col("items").alias("a"))
    b = sets.select(F.col("fp").alias("dst"), F.col("items").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    up, down = FOUR_OF_FIVE
    reach = both * down >= (F.size("a") + F.size("b") - both) * up
    return pairs.join(a, "src").join(b, "dst").filter(reach).select("src", "dst")


def forest(items: list[np.ndarray], component: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) between members of different components that join all components with a link at the similarity.

    A pair is compared unless its components are joined by then, so what the links
    connect is what all pairs would connect.
    """
    up, down = FOUR_OF_FIVE
    size = np.fromiter(map(len, items), np.int64, len(items))
    order = np.argsort(size, kind="stable")
    size = size[order]
    label = np.unique(component, return_inverse=True)[1][order]
    start = np.concatenate([[0], np.cumsum(size)])
    number = np.unique(np.concatenate([items[i] for i in order.tolist()]), return_inverse=True)[1]
    present = np.zeros(int(number.max(initial=0)) + 1, np.int8)
    # A partner has at most down / up times as many shingles.
    until = np.searchsorted(size * up, size * down, "right")
    links = []
    for i in range(len(order) - 1):
        z = int(until[i])
        others = np.flatnonzero(label[i + 1 : z] != label[i]) + i + 1
        if not len(others):
            continue
        own = number[start[i] : start[i + 1]]
        present[own] = 1
        a, z = int(others[0]), int(others[-1]) + 1
        common = np.add.reduceat(present[number[start[a] : start[z]]], start[a:z] - start[a], dtype=np.int64)[others - a]
        present[own] = 0
        reach = others[common * down >= (size[i] + size[others] - common) * up]
        for other in np.unique(label[reach], return_index=True)[1].tolist():
            j = int(reach[other])
            links.append((int(order[i]), int(order[j])))
        if len(reach):
            label[np.isin(label, label[reach])] = label[i]
    return links


def bucket_forests(rows: DataFrame) -> DataFrame:
    """(src, dst): ``forest`` of each (key, i, j) of rows (key, i, j, fp, component, items), read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, fps, components, sets = None, [], [], []

        def close() -> pa.RecordBatch:
            found = forest(sets, np.array(components, np.int64))
            cols = [pa.array([min(fps[a], fps[b]) for a, b in found], pa.int64()), pa.array([max(fps[a], fps[b]) for a, b in found], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["src", "dst"])

        for b in batches:
            lists = b.column("items")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            names = zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "fp", "component")), strict=True)
            for at, (key, i, j, fp, component) in enumerate(names):
                if (key, i, j) != open_key:
                    if len(fps) > 1:
                        yield close()
                    open_key, fps, components, sets = (key, i, j), [], [], []
                fps.append(fp)
                components.append(component)
                sets.append(values[ends[at] : ends[at + 1]])
        if len(fps) > 1:
            yield close()

    return rows.mapInArrow(run, "src long, dst long")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(src, dst) proposed by operator 6: sets of one SimHash with the least of them, and the least ones of linked SimHashes."""
    nodes = nodes.select("fp", "simhash")
    least = cut(nodes.groupBy("simhash").agg(F.min("fp").alias("least")), "near-simhash")
    pairs = simhash.links(least.select(F.col("simhash").alias("fp")))
    a = least.select(F.col("simhash").alias("src"), F.col("least").alias("a"))
    b = least.select(F.col("simhash").alias("dst"), F.col("least").alias("b"))
    linked = pairs.join(a, "src").join(b, "dst").select("a", "b")
    alike = nodes.join(least, "simhash").select(F.col("fp").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return linked.unionByName(alike).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def links(nodes: DataFrame, texts: DataFrame, held: int = HELD) -> DataFrame:
    """(src, dst): verified links between the shingle sets of ``nodes(fp, size, bands, simhash, row)``, as connected as all pairs that share a band.

    The first round compares the pairs that SimHash proposes, and each member of a bucket with
    the bucket's least and greatest fingerprint. What that joins needs no further comparison, so the second
    round reads only buckets with members of several components: all their pairs
    of different components are compared inside a task, and only links that join
    components leave it. A bucket of more than ``held`` shingles is cut into blocks,
    and each pair of blocks is compared.
    """
    rows = nodes.select("fp", "size", F.explode("bands").alias("key"))
    end = F.struct("fp", "size")
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(end).alias("low"), F.max(end).alias("high"))
    shared = cut(rows.join(stats.filter("n > 1").drop("n"), "key"), "minhash-buckets")
    near = cut(simhash_pairs(nodes), "near-pairs")
    named = shared.select("fp").unionByName(near.select(F.explode(F.array("src", "dst")).alias("fp"))).distinct()
    members = nodes.select("fp", "row").join(named, "fp")
    chosen = texts.join(members, "row").select("fp", "text").dropDuplicates(["fp"])
    sets = cut(shingle_sets(chosen), "minhash-sets")

    up, down = FOUR_OF_FIVE
    ends = shared.select("fp", "size", F.explode(F.array("low", "high")).alias("end")).filter("fp <> end.fp")
    ends = ends.filter(F.least("size", "end.size") * down >= F.greatest("size", "end.size") * up)
    stars = ends.select(F.least("fp", "end.fp").alias("src"), F.greatest("fp", "end.fp").alias("dst")).unionByName(near).distinct()
    first = cut(similar(stars, sets), "minhash-first")
    nodes_met = first.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    roots = cut(connected_components(nodes_met, first).withColumnRenamed("id", "fp"), "minhash-roots")
    joined = shared.select("key", "fp", "size").join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = cut(joined, "minhash-joined")
    sides = joined.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.sum("size").alias("shingles"))
    sides = sides.filter("a <> b").select("key", F.ceil(2 * F.col("shingles") / held).cast("int").alias("blocks"))
    sides = sides.withColumn("blocks", F.when(F.col("blocks") > 2, F.col("blocks")).otherwise(F.lit(1)))
    apart = joined.join(sides, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    apart = apart.select("key", "fp", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    apart = apart.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "component")
    dealt = apart.join(sets, "fp").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    second = cut(bucket_forests(dealt), "minhash-second")
    return first.unionByName(second).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component the smallest id stays.

    Two texts link if their sets of lower-cased 5-word shingles have a Jaccard
    similarity of 0.8 or more. Ids, nulls, repeated rows and texts without words
    are treated as in ``simhash.keep_one``.
    """
    row = fresh(docs, "_row")
    keyed = docs.withColumn(row, row_key(id_col, text))
    texts = keyed.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    prints = cut(hashed(texts), "minhash")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    nodes = prints.groupBy(F.col("fingerprint").alias("fp")).agg(
        F.min(first).alias("least"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands"),
        F.min("simhash").alias("simhash"),
    )
    nodes = cut(nodes, "minhash-nodes")
    pairs = cut(links(nodes, texts.select("row", "text"), held), "minhash-pairs")
    return kept_rows(docs, keyed, row, prints, named_by(nodes.select("fp", "least"), pairs))
