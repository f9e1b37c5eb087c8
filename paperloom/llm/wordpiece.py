"""Token counts by a linear longest-match automaton (operator 3).

The vocabulary is a trie with failure links. A link jumps to where the next piece
goes on, and carries how many pieces the match so far is worth. So greedy
word-piece lengths take one step per byte, without building a piece. All distinct
words of a batch walk the automaton at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import slices, utf8

SPLIT_BYTES = 8 << 20  # text of one step
MARK = "Ġ"  # fixed value: in byte-level vocabularies it stands for the space before a word
NONE = -1


@dataclass
class Automaton:
    """Nodes 0 (before a word) and 1 (inside a word, between pieces), then the trie."""

    keys: np.ndarray  # node * 256 + byte, sorted
    to: np.ndarray
    link: np.ndarray  # node to go on from, NONE where no segmentation is left
    popped: np.ndarray  # pieces that the link closes

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) * 256 + byte
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.to[at], NONE)


def build(first: list[bytes], inner: list[bytes]) -> Automaton:
    """Automaton for pieces that may begin a word and pieces that may go on inside one."""
    children: list[dict[int, int]] = [{}, {}]
    final = [False, False]
    for root, words in ((0, first), (1, inner)):
        for w in words:
            node = root
            for byte in w:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][byte]
            if w:
                final[node] = True
    link, popped = [NONE] * len(children), [0] * len(children)
    queue = [0, 1]
    while queue:
        later = []
        for u in queue:
            for byte, v in children[u].items():
                if final[v]:
                    link[v], popped[v] = 1, 1
                elif u > 1:
                    # Close pieces of the parent's match until the byte can be taken.
                    z, n = link[u], popped[u]
                    while z != NONE and byte not in children[z]:
                        n, z = n + popped[z], link[z]
                    if z != NONE:
                        link[v], popped[v] = children[z][byte], n
                later.append(v)
        queue = later
    edges = sorted((u * 256 + b, v) for u, c in enumerate(children) for b, v in c.items())
    return Automaton(
        np.array([k for k, _ in edges], np.int64), np.array([v for _, v in edges], np.int32),
        np.array(link, np.int32), np.array(popped, np.int32),
    )


def lengths(a: Automaton, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Pieces of each word raw[start:end] by greedy longest match; NONE where none fits."""
    order = np.argsort(start - end, kind="stable")  # longest first: the active words are a prefix
    start, size = start[order], (end - start)[order]
    node, count = np.zeros(len(size), np.int32), np.zeros(len(size), np.int64)
    dead = np.zeros(len(size), bool)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # words with size > t
    for t in range(longest + 1):
        if t < longest:
            n = int(active[t])
            byte = raw[start[:n] + t]
            todo = np.flatnonzero(~dead[:n])
        else:
            todo = np.flatnonzero(~dead & (size > 0))
        while len(todo):
            if t < longest:
                new = a.step(node[todo], byte[todo])
                ok = new != NONE
                node[todo[ok]] = new[ok]
                todo = todo[~ok]
            else:
                todo = todo[node[todo] != 1]
            left = a.link[node[todo]]
            count[todo] += a.popped[node[todo]]
            lost = left == NONE
            dead[todo[lost]] = True
            node[todo] = left
            todo = todo[~lost]
    out = np.empty(len(size), np.int64)
    out[order] = np.where(dead, NONE, count)
    return out


def byte_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(first, inner) pieces of a byte-level vocabulary file.

    A piece with the space mark begins a word. The mark alone may begin any word,
    so every word has a segmentation; special tokens take no part.
    """
    from paperloom.llm.bpe import pieces

    with open(path, encoding="utf-8") as f:
        special = {t["id"] for t in json.load(f)["added_tokens"]}
    all_pieces = [p for i, p in enumerate(pieces(path).to_pylist()) if i not in special]
    return [p for p in all_pieces if p[:1] == b" "], all_pieces


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs without ASCII white space, never over a text's end."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw) + 1, bool)
    if len(raw):
        edge[1:-1] = space[1:] != space[:-1]
        edge[off] = True
        edge[[0, -1]] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    word = ~space[start]
    return start[word], end[word], np.searchsorted(off, start[word], "right") - 1


def counted(raw: np.ndarray, off: np.ndarray, a: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, tokens, unknown) of back-to-back texts; a word without segmentation is one unknown token."""
    n = len(off) - 1
    start, end, row = words_of(raw, off)
    zero = np.zeros(n, np.int64)
    if not len(start):
        return zero, zero, zero
    # Words and gaps alternate in one array, so that Arrow finds the distinct words.
    bounds = np.unique(np.concatenate([start, end]))
    column = pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]
    )
    words = column.take(pa.array(np.searchsorted(bounds, start))).dictionary_encode()
    which = words.indices.to_numpy()
    # The space before the word is part of the match.
    text, place = utf8(words.dictionary)
    size = np.diff(place)
    spaced = np.full(len(text) + len(size), 32, np.uint8)
    at = place[:-1] + np.arange(len(size))
    inside = np.ones(len(spaced), bool)
    inside[at] = False
    spaced[inside] = text
    pieces = lengths(a, spaced, at, at + size + 1)[which]
    lost = pieces == NONE
    total = lambda x: np.bincount(row, weights=x, minlength=n).astype(np.int64)
    return np.bincount(row, minlength=n), total(np.where(lost, 1, pieces)), total(lost)


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns but the text, and n_words, n_tokens, n_unknown (long) of the whole text.

    Words are runs without ASCII white space, each matched greedily with the
    space before it. Null and empty texts count 0; repeated rows stay repeated.
    """
    keep = [c for c in docs.columns if c != text]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(build(*byte_vocabulary(path)))
    names = [*(f"k{i}" for i in range(len(keep))), "n_words", "n_tokens", "n_unknown"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SPLIT_BYTES):
                counts = counted(*utf8(b.column("text")), shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, counts)], names=names)

    fields = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = inner.mapInArrow(run, ", ".join([*fields, "n_words long", "n_tokens long", "n_unknown long"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_tokens", "n_unknown")
