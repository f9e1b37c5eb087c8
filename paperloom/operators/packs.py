"""Whole connected components, packed into rows on which one task works (GRA-02, GRA-04).

A job that goes round by round over a graph exchanges its node values in every round.
What happens in one component does not depend on the links of another, so the small
components are dealt into packs once, and a task takes a pack through all rounds in
numpy. A component of more than ``most`` rows is not packed: it is left to the
distributed rounds, so no task ever holds more than a few times that many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import cut

MOST = 1 << 15  # nodes and edges of a packed component, and of a pack, about
OVERFULL = 4  # times the mean: such a pack is looked at for components that are too large

KINDS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)  # of ids, whose text and order are those of Spark


@dataclass
class Packed:
    """``packs(ids, times, label, src, dst, links)``; ``rest`` and ``rest_edges`` are what is not packed, None without any.

    ``ids`` are sorted, and src, dst count in them; dst -1 is a null. ``times`` is how often an id is
    a vertex, ``links`` the ends of the links between different ids, each link once.
    ``rest(id, label)`` has a row for each time.
    """

    packs: DataFrame
    rest: DataFrame | None
    rest_edges: DataFrame | None


def packed(nodes: DataFrame, edges: DataFrame, roots: DataFrame, most: int = MOST) -> Packed:
    """The packs of ``nodes(id, times, label)``, one row per id, and ``edges(src, dst)``; ``roots(u, v)`` has the component of each node that does not name its own."""
    kind = nodes.schema["id"].dataType
    id_of = roots.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    e = edges.select("src", "dst").filter("src is not null")
    none = F.lit(None)
    rows = e.join(id_of, e["src"] == id_of["_u"], "left").select(
        F.coalesce("_v", "src").alias("c"), F.col("src").alias("a"), F.col("dst").alias("b"),
        none.cast("int").alias("times"), none.cast(kind).alias("label"),
    )
    n = nodes.join(id_of, nodes["id"] == id_of["_u"], "left").select(
        F.coalesce("_v", "id").alias("c"), F.col("id").alias("a"), none.cast(kind).alias("b"),
        F.col("times").cast("int").alias("times"), F.col("label").cast(kind).alias("label"),
    )
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("c").isNull()).alias("unnamed")]
    rows = cut(rows.unionByName(n).observe(seen, *counts), "component-rows")
    total, unnamed = seen.get["n"], seen.get["unnamed"]
    n_packs = max(1, -(-total // max(1, most)))
    place = F.pmod(F.xxhash64("c"), F.lit(n_packs)).cast("int")
    large = rows.select("c").filter(F.lit(not isinstance(kind, KINDS)))
    if total > most:
        by_pack = rows.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n"))
        full = cut(by_pack.filter(F.col("n") > OVERFULL * most).select("p"), "overfull-packs")
        if not full.isEmpty():
            some = rows.select("c", place.alias("p")).join(full, "p", "left_semi")
            large = some.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("c")
    large = cut(large.distinct(), "large-components")
    small, left, left_edges = rows.filter("c is not null"), None, None
    if not large.isEmpty():
        out = rows.join(large, "c", "left_semi")
        small = small.join(large, "c", "left_anti")
        left_edges = cut(out.filter("times is null").select(F.col("a").alias("src"), F.col("b").alias("dst")), "large-edges")
        left = out.filter("times is not null")
    if unnamed:  # vertices without an id
        lost = rows.filter("c is null")
        left = lost if left is None else left.unionByName(lost)
    if left is not None:
        left = cut(left.select(F.col("a").alias("id"), "label", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("id", "label"), "large-nodes")
    held = T.StructType([
        T.StructField("ids", T.ArrayType(kind)),
        *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("times", "label", "src", "dst")], T.StructField("links", T.LongType()),
    ])
    packs = small.withColumn("p", place).groupBy("p").applyInArrow(_pack, held)
    return Packed(cut(packs, "packs"), left, left_edges)


def _pack(rows: pa.Table) -> pa.Table:
    """One row for the rows of a pack."""
    a, b, c = (rows[x].combine_chunks() for x in "abc")
    node = rows["times"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    ids = pc.unique(pa.chunked_array([a, b])).drop_null()
    ids = ids.take(pc.array_sort_indices(ids))
    at = pc.index_in(a, ids).to_numpy(zero_copy_only=False)
    to = pc.fill_null(pc.index_in(b, ids), -1).to_numpy(zero_copy_only=False)
    m = len(ids)
    times, label = np.zeros(m, np.int32), np.arange(m, dtype=np.int32)
    times[at[node]] = rows["times"].combine_chunks().filter(pa.array(node)).to_numpy(zero_copy_only=False)
    # Labels of two components are two labels, whatever they are called.
    called = rows["label"].combine_chunks()
    mark = node & called.is_valid().to_numpy(zero_copy_only=False)
    if mark.any():
        _, first = np.unique(_codes(called.filter(pa.array(mark))) * m + _codes(c.filter(pa.array(mark))), return_inverse=True)
        own = np.full(first.max() + 1, m, np.int64)
        np.minimum.at(own, first, at[mark])
        label[at[mark]] = own[first]
    src, dst = at[~node].astype(np.int64), to[~node].astype(np.int64)
    order = np.argsort(src * (m + 1) + dst)
    src, dst = src[order], dst[order]
    low, high = _simple(m, src, dst)
    out = [ids, pa.array(times), pa.array(label), pa.array(src.astype(np.int32)), pa.array(dst.astype(np.int32))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in out]
    return pa.Table.from_arrays([*lists, pa.array([2 * len(low)], pa.int64())], names=["ids", "times", "label", "src", "dst", "links"])


def _codes(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _simple(m: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different links between two different nodes, in one direction."""
    use = (src != dst) & (dst >= 0)
    low, high = np.minimum(src[use], dst[use]), np.maximum(src[use], dst[use])
    both = np.unique(low * m + high)
    return both // max(m, 1), both % max(m, 1)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, times, label, src, dst) of each pack."""
    for b in batches:
        for i in range(b.num_rows):
            ids, *rest = (b.column(n)[i].values for n in ("ids", "times", "label", "src", "dst"))
            yield ids, *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in rest)


def _both(m: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = _simple(m, src, dst)
    return np.concatenate([low, high]), np.concatenate([high, low])


# --- PageRank -------------------------------------------------------------------


def _terms(times: np.ndarray, src: np.ndarray, dst: np.ndarray, start: float, damping: float, rounds: int) -> Iterator[np.ndarray]:
    """v_1, v_2, ... of a pack; the last entry takes what goes to null."""
    m = len(times)
    share = damping / np.bincount(src, minlength=m)[src] if len(src) else np.zeros(0)
    to = np.where(dst < 0, m, dst)
    v = np.append(np.where(times > 0, start, 0.0), 0.0)
    for _ in range(rounds):
        v = np.bincount(to, weights=v[src] * share, minlength=m + 1)
        yield v


def rank_masses(p: Packed, start: float, damping: float, rounds: int) -> list[float]:
    """The masses of the terms of all packs, round by round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(rounds)
        for _, times, _, src, dst in _each(batches):
            mass += [v.sum() for v in _terms(times, src, dst, start, damping, rounds)]
        yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), pa.array(mass)], names=["step", "mass"])

    found = p.packs.mapInArrow(run, "step int, mass double").groupBy("step").agg(F.sum("mass").alias("mass")).collect()
    by_step = {r["step"]: r["mass"] for r in found}
    return [by_step.get(i, 0.0) for i in range(rounds)]


def ranks(p: Packed, start: float, damping: float, coefficients: list[float]) -> DataFrame:
    """(id, pagerank) of the vertices in packs: the start and the terms, each times its coefficient."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, times, _, src, dst in _each(batches):
            total = np.zeros(len(ids) + 1)
            for c, v in zip(coefficients[1:], _terms(times, src, dst, start, damping, len(coefficients) - 1)):
                total += c * v
            is_vertex = pa.array(times > 0)
            yield pa.RecordBatch.from_arrays([ids.filter(is_vertex), pa.array(coefficients[0] * start + total[:-1]).filter(is_vertex)], names=["id", "pagerank"])

    return p.packs.mapInArrow(run, _schema(p, "pagerank", T.DoubleType()))


def _schema(p: Packed, name: str, kind: T.DataType | None = None) -> T.StructType:
    ids = p.packs.schema["ids"].dataType.elementType
    return T.StructType([T.StructField("id", ids), T.StructField(name, kind or ids)])


# --- communities ------------------------------------------------------------------


def _named(ids: pa.Array, times: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """(id, community), a row for each time an id is a vertex; a community is named by its smallest member."""
    m, at = len(ids), np.flatnonzero(times)
    name = np.full(m, m, np.int64)
    np.minimum.at(name, label[at], at)
    rows = np.repeat(at, times[at])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), ids.take(pa.array(name[label[rows]]))], names=["id", "community"])


def _summed(keys: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, with the sums of their weights."""
    if not len(keys):
        return keys, w
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(w[order], first)


def _best(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of each group the place of its first largest value; ``group`` is sorted."""
    if not len(group):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    most = np.repeat(np.maximum.reduceat(value, first), np.diff(np.append(first, len(group))))
    at = np.flatnonzero(value == most)
    return at[np.append(True, group[at][1:] != group[at][:-1])]


def _settled(ids: pa.Array, times: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The rounds of ``graph.settled_labels`` on one pack."""
    m = len(ids)
    src, dst = _both(m, src, dst)
    use = (times[src] > 0) & (times[dst] > 0)  # an end that is no vertex has no vote and does not move
    src, dst = src[use], dst[use]
    digest = np.array([md5(str(i).encode()).digest() for i in ids.to_pylist()], dtype="S16")
    place = np.empty(m, np.int64)
    place[np.argsort(digest, kind="stable")] = np.arange(m)
    before = place[src] < place[dst]
    label, want = np.arange(m), np.full(m, -1)
    touched = np.ones(m, bool)
    while True:
        ask = touched[dst]
        key, votes = _summed(dst[ask] * m + label[src[ask]], times[src[ask]])
        node, to = key // m, key % m
        stay = np.zeros(m, np.int64)
        own = to == label[node]
        stay[node[own]] = votes[own]
        best = _best(node, votes)
        gains = votes[best] > stay[node[best]]
        want[touched] = -1
        want[node[best][gains]] = to[best][gains]
        wants = want >= 0
        if not wants.any():
            return label
        blocked = np.zeros(m, bool)
        blocked[dst[wants[src] & before]] = True
        moves = wants & ~blocked
        label = np.where(moves, want, label)
        touched = moves.copy()
        touched[dst[moves[src]]] = True


def settled(p: Packed) -> DataFrame:
    """(id, community) of the vertices in packs, by label propagation to its fixed point."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, times, _, src, dst in _each(batches):
            yield _named(ids, times, _settled(ids, times, src, dst))

    return p.packs.mapInArrow(run, _schema(p, "community"))


def _local_moves(src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: np.ndarray, label: np.ndarray, two_m: int) -> tuple[np.ndarray, bool]:
    """``communities.local_moves`` on arrays: in each round the moves that do not touch each other, so the score only grows."""
    m, label = len(k), label.copy()
    tie = np.random.default_rng(0).permutation(m)
    tot = np.zeros(m, np.int64)
    np.add.at(tot, label, k)
    want, gain = np.full(m, -1), np.zeros(m, np.int64)
    asked, moved = np.ones(m, bool), False
    while True:
        ask = asked[dst]
        key, links = _summed(dst[ask] * m + label[src[ask]], w[ask])
        node, to = key // m, key % m
        here = to == label[node]
        value = two_m * links - k[node] * (tot[to] - np.where(here, k[node], 0))
        stay = -k * (tot[label] - k)
        stay[node[here]] = value[here]
        node, to, value = node[~here], to[~here], value[~here]
        best = _best(node, value)
        more = value[best] - stay[node[best]]
        best, more = best[more > 0], more[more > 0]
        want[asked], gain[asked] = -1, 0
        want[node[best]], gain[node[best]] = to[best], more
        movers = np.flatnonzero(want >= 0)
        if not len(movers):
            return label, moved
        # The best of both of its communities moves.
        ranked = movers[np.lexsort((tie[movers], -gain[movers]))]
        order = np.arange(len(ranked))
        first = np.full(m, len(ranked))
        np.minimum.at(first, label[ranked], order)
        np.minimum.at(first, want[ranked], order)
        chosen = ranked[(first[label[ranked]] == order) & (first[want[ranked]] == order)]
        changed = np.zeros(m, bool)
        changed[label[chosen]] = changed[want[chosen]] = True
        np.subtract.at(tot, label[chosen], k[chosen])
        np.add.at(tot, want[chosen], k[chosen])
        label[chosen] = want[chosen]
        moved = True
        asked = changed[label]
        asked[dst[asked[src]]] = True


def _modular(times: np.ndarray, label: np.ndarray, src: np.ndarray, dst: np.ndarray, two_m: int) -> np.ndarray:
    """``communities.louvain`` on one pack of a graph with ``two_m`` link ends."""
    m = len(times)
    src, dst = _both(m, src, dst)
    k = np.bincount(src, minlength=m).astype(np.int64)
    use = (times[src] > 0) & (times[dst] > 0)
    src, dst = src[use], dst[use]
    k = np.where(times > 0, k, 0)
    w = np.ones(len(src), np.int64)
    while True:
        label, changed = _local_moves(src, dst, w, k, label, two_m)
        a, b, weight, degree, step = src, dst, w, k, label
        while True:
            names, of = np.unique(step, return_inverse=True)
            label, n = np.searchsorted(names, label), len(names)
            a, b = of[a], of[b]
            between = a != b
            key, weight = _summed(a[between] * n + b[between], weight[between])
            a, b = key // max(n, 1), key % max(n, 1)
            sums = np.zeros(n, np.int64)
            np.add.at(sums, of, degree)
            degree = sums
            step, merged = _local_moves(a, b, weight, degree, np.arange(n), two_m)
            if not merged:
                break
            label, changed = step[label], True
        if not changed:
            return label


def modular(p: Packed, two_m: int) -> DataFrame:
    """(id, community) of the vertices in packs: neither a move of a node nor of a community raises modularity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, times, label, src, dst in _each(batches):
            yield _named(ids, times, _modular(times, label, src, dst, two_m))

    return p.packs.mapInArrow(run, _schema(p, "community"))
