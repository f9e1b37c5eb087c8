"""Benchmark decontamination by the q-gram lemma (operator 1).

Benchmark items are cut into overlapping windows. A window that occurs in a text
with at most ``e`` edits shares at least ``w + 1 - q (e + 1)`` character q-grams with
it, all of them on ``e + 1`` neighbouring diagonals. So hits are counted in
overlapping diagonal bands; regions that reach the bound are kept and verified by
a banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.batches import normalised, slices, utf8

Q = 10
WINDOW = 66  # normalised characters; every passage of WINDOW + STRIDE holds a whole window
STRIDE = 33
EDITS = 5  # of a whole window; shorter items get a share of it
MIN_CHARS = 24  # shorter items are too common to be evidence
BLOCK_CHARS = 2_000_000  # benchmark characters that one pass over the documents looks for
STEP = 1 << 18  # text positions searched at once
HITS = 1_000_000  # hits held at once
SLICE = 1 << 20  # text bytes that are folded at once
GAP = 0x110001
FAR = 1 << 40  # the cost of a place outside the text
PRIME = np.uint64(0x9E3779B97F4A7C15)


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    n = len(codes) - q + 1
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h *= PRIME
        h += codes[k : k + n]
    return h


@dataclass
class Index:
    """Windows of one benchmark block and where each q-gram occurs in them."""

    item: np.ndarray
    start: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    codes: np.ndarray  # windows x WINDOW, padded with GAP
    keys: np.ndarray
    first: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    seen: np.ndarray  # filter on a hash of the key


SEEN_BITS = np.uint64(42)  # a table of 2^22 flags


def slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * PRIME) >> SEEN_BITS).astype(np.int64)


def build_index(items: list[tuple[int, str]]) -> Index:
    rows, parts = [], []
    for item, text in items:
        raw, off = utf8(pa.array([text], pa.string()))
        codes = normalised(raw, off)[0][:-1]
        while len(codes) and codes[-1] == 32:
            codes = codes[:-1]
        if len(codes) < MIN_CHARS:
            continue
        starts = [*range(0, max(len(codes) - WINDOW, 0), STRIDE), max(len(codes) - WINDOW, 0)]
        for s in dict.fromkeys(starts):
            part = codes[s : s + WINDOW]
            edits = len(part) * EDITS // WINDOW
            while edits and len(part) + 1 - Q * (edits + 1) < 1:
                edits -= 1
            rows.append((item, s, len(part), edits, len(part) + 1 - Q * (edits + 1)))
            parts.append(part)
    padded = np.full((len(parts), WINDOW), GAP, np.uint32)
    keys, window, offset = [], [], []
    for i, p in enumerate(parts):
        padded[i, : len(p)] = p
        g = qgrams(p)
        keys.append(g)
        window.append(np.full(len(g), i, np.int32))
        offset.append(np.arange(len(g), dtype=np.int32))
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    key, win, offs = cat(keys, np.uint64), cat(window, np.int32), cat(offset, np.int32)
    order = np.argsort(key, kind="stable")
    unique, first = np.unique(key[order], return_index=True)
    seen = np.zeros(1 << 22, bool)
    seen[slot(unique)] = True
    cols = [np.array([r[i] for r in rows], np.int64) for i in range(5)]
    return Index(*cols, padded, unique, np.append(first, len(key)), win[order], offs[order], seen)


def aligned(
    codes: np.ndarray, ix: Index, window: np.ndarray, diagonal: np.ndarray, first: np.ndarray, stop: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Banded alignment of windows against one text each, from their band on.

    The text, codes ``first`` to ``stop``, may go on at both ends, but no alignment
    leaves it. Returns (edits, start, end) in ``codes``; a cell holds edits * 1024 +
    the diagonal where the alignment began.
    """
    width = 4 * EDITS + 2
    lane = np.arange(width)
    begin = diagonal - EDITS
    out = [np.zeros(len(window), np.int64) for _ in range(3)]
    for size in np.unique(ix.size[window]).tolist():
        at = np.flatnonzero(ix.size[window] == size)
        pattern, base = ix.codes[window[at]], begin[at]
        lo, hi = first[at][:, None], stop[at][:, None]
        text = base[:, None] + lane
        cost = np.where((text >= lo) & (text <= hi), lane, FAR)
        for r in range(size):
            new = cost + 1024 * (codes[np.clip(text, 0, len(codes) - 1)] != pattern[:, r : r + 1])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1024)
            cost = np.minimum.accumulate(new - 1024 * lane, axis=1) + 1024 * lane
            text = text + 1
            cost[(text < lo) | (text > hi)] = FAR
        best = cost.argmin(axis=1)
        value = cost[np.arange(len(at)), best]
        out[0][at], out[1][at], out[2][at] = value >> 10, base + (value & 1023), base + best + size
    return tuple(out)


def find(raw: np.ndarray, off: np.ndarray, ix: Index) -> dict[str, np.ndarray]:
    """Verified windows in back-to-back texts: row, window, edits, start, end (code points)."""
    codes, place, row, begin = normalised(raw, off)
    stop = np.append(begin[1:], len(codes)) - 1  # the END of each text
    found: list[tuple[np.ndarray, ...]] = []
    reach = WINDOW + EDITS - Q

    def search(lo: int, hi: int) -> None:
        keys = qgrams(codes[lo:hi])
        maybe = ix.seen[slot(keys)]
        # Cheap necessary condition first: enough hits of any window within reach.
        total = np.concatenate([[0], np.cumsum(maybe)])
        here = np.flatnonzero(maybe)
        if not len(here) or not len(ix.need):
            return
        rank = total[here]
        least = int(ix.need.min())
        after = np.minimum(rank + least - 1, len(here) - 1)
        dense = (rank + least - 1 < len(here)) & (here[after] - here <= reach)
        mark = np.zeros(len(keys) + reach + 2, np.int32)
        mark[here[dense]] += 1
        np.subtract.at(mark, here[dense] + reach + 1, 1)
        here = here[np.cumsum(mark)[here] > 0]
        slot_of = np.searchsorted(ix.keys, keys[here])
        slot_of[slot_of == len(ix.keys)] = 0
        true = ix.keys[slot_of] == keys[here]
        here, slot_of = here[true], slot_of[true]
        count = ix.first[slot_of + 1] - ix.first[slot_of]
        if count.sum() > HITS and hi - lo > 8 * WINDOW:
            middle = (lo + hi) // 2
            search(lo, middle + 2 * WINDOW)
            search(middle - 2 * WINDOW, hi)
            return
        if not len(here):
            return
        pos = np.repeat(here + lo, count)
        entry = np.arange(len(pos)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ix.first[slot_of], count)
        window, diagonal = ix.window[entry].astype(np.int64), pos - ix.offset[entry]
        # Bands of 2 (e + 1) diagonals every e + 1: each run of e + 1 diagonals lies in one.
        step = EDITS + 1
        band = (diagonal + step) // step
        window, pos, band = np.tile(window, 2), np.tile(pos, 2), np.concatenate([band, band - 1])
        order = np.lexsort((pos, band, window))
        window, pos, band = window[order], pos[order], band[order]
        last = np.arange(len(pos)) + ix.need[window] - 1
        ok = last < len(pos)
        last[~ok] = 0
        ok &= (window[last] == window) & (band[last] == band) & (row[pos[last]] == row[pos]) & (pos[last] - pos <= reach)
        if not ok.any():
            return
        pairs = np.unique(np.stack([window[ok], band[ok], row[pos[ok]]], 1), axis=0)
        of = pairs[:, 2]
        edits, start, end = aligned(codes, ix, pairs[:, 0], (pairs[:, 1] - 1) * step, begin[of], stop[of])
        good = edits <= ix.edits[pairs[:, 0]]
        found.append((pairs[good, 0], edits[good], start[good], end[good], of[good]))

    for lo in range(0, max(len(codes) - Q + 1, 0), STEP):
        search(lo, min(lo + STEP + 2 * WINDOW, len(codes)))
    if not found:
        return {k: np.zeros(0, np.int64) for k in ("row", "window", "edits", "start", "end")}
    window, edits, start, end, of = (np.concatenate([f[i] for f in found]) for i in range(5))
    order = np.lexsort((end, start, edits, window))
    window, edits, start, end, of = window[order], edits[order], start[order], end[order], of[order]
    return {"row": of, "window": window, "edits": edits, "start": place[start], "end": place[end - 1] + 1}


def blocks(spark: SparkSession, benchmark: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    """Indexes of benchmark blocks of about BLOCK_CHARS characters, one at a time."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield build_index([(r["item"], r["text"]) for r in part.collect()])  # bounded by the block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, windows, edits, start, end): benchmark items found in documents.

    One row per occurrence of an item in a row of ``docs``: how many of its
    windows were found, the fewest edits of a window, and the code points of the text from
    the first found window to the last. Null and empty texts hold nothing; null
    and short items (under MIN_CHARS) are never found; repeated rows and items
    repeat their results; a null id is reported as null.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, windows long, edits long, start long, end long"
    out = None
    for ix in blocks(spark, benchmark, item_id, text):
        shared = spark.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for whole in batches:
                for b in slices(whole, "text", SLICE):
                    hit = find(*utf8(b.column("text")), index)
                    if len(hit["row"]):
                        yield merged(b.column("doc_id"), hit, index)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def merged(ids: pa.Array, hit: dict[str, np.ndarray], ix: Index) -> pa.RecordBatch:
    """Windows of one item that lie close together in one text, as one row."""
    item = ix.item[hit["window"]]
    order = np.lexsort((hit["start"], item, hit["row"]))
    row, item, start, end, edits = hit["row"][order], item[order], hit["start"][order], hit["end"][order], hit["edits"][order]
    window = hit["window"][order]
    far = np.ones(len(row), bool)
    far[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] > end[:-1] + 2 * WINDOW)
    first = np.flatnonzero(far)
    group = np.cumsum(far) - 1
    distinct = np.unique(np.stack([group, window], 1), axis=0)[:, 0]
    cols = {
        "doc_id": ids.take(pa.array(row[first])), "item_id": pa.array(item[first]),
        "windows": pa.array(np.bincount(distinct, minlength=len(first))), "edits": pa.array(np.minimum.reduceat(edits, first)),
        "start": pa.array(start[first]), "end": pa.array(np.maximum.reduceat(end, first)),
    }
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window is found, unchanged. Null texts stay."""
    keep = docs.columns
    at = keep.index(text)
    left = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    for ix in blocks(docs.sparkSession, benchmark, item_id, text):
        shared = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, f"k{at}", SLICE):
                    clean = np.ones(b.num_rows, bool)
                    clean[find(*utf8(b.column(f"k{at}")), shared.value)["row"]] = False
                    yield b.filter(pa.array(clean))

        left = left.mapInArrow(run, left.schema)
    return left.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
