"""Byte-level BPE by a table of distinct words (operator 10).

Texts are packed into chunks. Each chunk sends each of its distinct words once to
the task that owns the word; there each distinct word is encoded once and its ids
go back to the chunks, where they are set in by position. A word as frequent as
"the" travels once per chunk, not once per position. Decoding joins ids to the
pieces of the vocabulary.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import BATCH_ROWS, utf8
from paperloom.session import spread

CHUNK_BYTES = 8 << 20  # text of one chunk; a longer single text is a chunk of its own
SPLIT_BYTES = 1 << 18  # text split at once
KNOWN_WORDS = 1 << 17  # encoded words that a task keeps; beyond, it starts anew
ENCODE_WORDS = 1 << 13  # words given to the tokenizer at once
BUCKETS_PER_PARTITION = 2  # of words, for each shuffle partition of the session
PRESS_LEVEL = 3
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# The endings that the public split pattern takes as words of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    # White_Space of the Unicode character database.
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                 (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = SPACE
    return out


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[bytes, ...]:
    """Contents of the tokens that are matched before the split, longest first."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return tuple(sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True))


@lru_cache(maxsize=4)
def pieces(path: str) -> pa.LargeBinaryArray:
    """The vocabulary as bytes, by id: the right side of the id-to-piece join."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # Printable bytes stand for themselves, the others for code points from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(b): b for b in shown}
    of_char |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    by_id = {i: bytes(of_char[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if i not in added}
    by_id |= added
    return pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.large_binary())


def special_spans(raw: bytes, off: np.ndarray, specials: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """Left-most matches of added tokens that lie inside one text."""
    spans: list[tuple[int, int]] = []
    at = 0
    while hits := [(i, -len(s), s) for s in specials if (i := raw.find(s, at)) >= 0]:
        i, _, s = min(hits)
        end = i + len(s)
        inside = np.searchsorted(off, i, "right") == np.searchsorted(off, end - 1, "right")
        if inside:
            spans.append((i, end))
        at = end if inside else i + 1
    return spans


def split_words(raw: np.ndarray, off: np.ndarray, specials: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words of back-to-back UTF-8 texts, and each text's first word.

    The words cover the texts. The rule is the public split pattern of byte-level
    BPE: an ending with an apostrophe, or a run of letters, numbers or other signs
    with at most one space before it, or a run of white space without the space
    that the next run takes. It runs on whole batches: runs of one class first,
    then spaces, then endings.
    """
    if not len(raw):
        return np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    blob = raw.tobytes()
    spans = special_spans(blob, off, specials) if specials else []
    edges = np.unique(np.concatenate([off, np.array(spans, np.int64).reshape(-1)]))
    code = np.frombuffer(blob.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    width = (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(width)])  # byte offset of each code point
    n = len(code)
    cut = np.searchsorted(place, edges)  # code point of each forced boundary
    kind = classes()[code]
    first = np.zeros(n + 1, bool)
    first[1:n] = kind[1:] != kind[:-1]
    first[cut] = True
    forced = np.zeros(n + 1, bool)
    forced[cut] = True
    space = kind == SPACE
    # The last white space before a run: a plain space joins the run, another sign stands alone.
    before = np.flatnonzero(first[1:n] & ~forced[1:n] & space[:-1] & ~space[1:])  # index of that white space
    plain = before[code[before] == 32]
    first[before] = True
    first[plain + 1] = False
    joined = np.zeros(n + 1, bool)
    joined[plain] = True
    # Apostrophe alone, no space taken in, and an ending after it.
    quote = np.flatnonzero((code[:-1] == 39) & first[:n][:-1] & (kind[1:] == LETTER) & ~forced[1:n])
    for q in quote.tolist():
        tail = "".join(map(chr, code[q : q + 3].tolist()))
        for ending in CONTRACTIONS:
            stop = q + len(ending)
            if tail.startswith(ending) and not forced[q + 1 : stop].any():
                first[q + 1] = False
                first[stop] = True
                break
    first[n] = True
    for a, b in spans:
        i, j = np.searchsorted(place, (a, b))
        first[i + 1 : j] = False
    start = np.flatnonzero(first)
    words = place[start]
    return words, np.searchsorted(words, off)


def split_chunk(raw: np.ndarray, off: np.ndarray, specials: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """``split_words`` of a whole chunk, a few texts at a time."""
    words, first, at, n = [np.zeros(1, np.int32)], [np.zeros(1, np.int64)], 0, 0
    while at < len(off) - 1:
        end = max(at + 1, int(np.searchsorted(off, off[at] + SPLIT_BYTES, "right")) - 1)
        w, f = split_words(raw[off[at] : off[end]], off[at : end + 1] - off[at], specials)
        words.append((w[1:] + off[at]).astype(np.int32 if off[-1] < 2**31 else np.int64))
        first.append(f[1:] + n)
        at, n = end, n + len(w) - 1
    return np.concatenate(words), np.concatenate(first)


def word_list(raw: np.ndarray, words: np.ndarray) -> pa.DictionaryArray:
    """The words with their distinct list, in order of first occurrence."""
    if words[-1] < 2**31:
        offsets, kind = words.astype(np.int32), pa.binary()
    else:
        offsets, kind = words.astype(np.int64), pa.large_binary()
    column = pa.Array.from_buffers(kind, len(words) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return column.dictionary_encode()


def press(*parts: bytes) -> bytes:
    """Byte strings with their lengths, compressed."""
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=PRESS_LEVEL).compress(b"".join([head, *parts]))


def unpress(blob: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    size = np.frombuffer(raw[8 : 8 * (n + 1)], np.int64)
    ends = 8 * (n + 1) + np.concatenate([[0], np.cumsum(size)])
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def planes(x: np.ndarray) -> bytes:
    """Integers with their high bytes apart from the low ones, which compresses better."""
    return np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(raw: memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)


def rows_blob(t: pa.Table) -> bytes:
    """Whole rows; the texts lie together, apart from the other columns."""
    raw, off = utf8(t.column("text").combine_chunks())
    sink = pa.BufferOutputStream()
    rest = t.drop_columns(["text"]).append_column("size", pa.array(np.diff(off)))
    rest = rest.append_column("null", pa.array(t.column("text").is_null()))
    with pa.ipc.new_stream(sink, rest.schema) as w:
        w.write_table(rest)
    return press(sink.getvalue().to_pybytes(), raw.tobytes())


def rows_of(blob: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(other columns with ``null``, text bytes, offsets)"""
    head, text = unpress(blob)
    rest = pa.ipc.open_stream(pa.py_buffer(head)).read_all().combine_chunks()
    off = np.concatenate([[0], np.cumsum(rest.column("size").to_numpy())]).astype(np.int64)
    return rest.drop_columns(["size"]), np.frombuffer(text, np.uint8), off


def dealt(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(order, ends, words) of a word list: words by the bucket of a fixed hash, then by place."""
    texts = words.to_pylist()
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in texts), np.int64, len(texts))
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1)), texts


def packed(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, blob): whole rows in compressed chunks; the number is the same on a retry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0

        def close(held):
            t = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | number], pa.int64()), pa.array([rows_blob(t)], pa.binary())], names=["chunk", "blob"]
            )

        held, size = [], 0
        for b in batches:
            _, off = utf8(b.column("text"))
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(off, off[at] + chunk_bytes - size, "right")) - 1)
                end = min(end, b.num_rows)
                if held and size + off[end] - off[at] > chunk_bytes:
                    yield close(held)
                    held, size, number = [], 0, number + 1
                    continue
                held.append(b.slice(at, end - at))
                size += int(off[end] - off[at])
                at = end
        if held:
            yield close(held)

    return docs.mapInArrow(run, "chunk long, blob binary")


def chunk_words(chunks: DataFrame, path: str, buckets: int) -> DataFrame:
    """(bucket, chunk, words): the distinct words of a chunk, one row per bucket of words."""
    specials = added_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob").to_pylist(), strict=True):
                _, raw, off = rows_of(blob)
                words, _ = split_chunk(raw, off, specials)
                order, ends, texts = dealt(word_list(raw, words).dictionary, buckets)
                out = []
                for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = [texts[i] for i in order[a:z].tolist()]
                    out.append(press(planes(np.fromiter(map(len, own), np.int32, len(own))), b"".join(own)) if own else None)
                del raw, words, order, texts
                pa.default_memory_pool().release_unused()
                full = [i for i, w in enumerate(out) if w is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array([out[i] for i in full], pa.binary())],
                    names=["bucket", "chunk", "words"],
                )

    return chunks.mapInArrow(run, "bucket int, chunk long, words binary")


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(chunk, bucket, answer): the ids of the words, in the words' order.

    All rows of a bucket meet in one task, which encodes each distinct word once and
    keeps it (a task with more than KNOWN_WORDS forgets, and encodes again).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for b in batches:
            out = []
            for blob in b.column("words").to_pylist():
                size, text = unpress(blob)
                ends = np.cumsum(unplanes(size)).tolist()
                text = text.tobytes()
                own = [text[a:z] for a, z in zip([0, *ends], ends, strict=False)]
                if len(known) > KNOWN_WORDS:
                    known = {}
                new = [w for w in dict.fromkeys(own) if w not in known]
                for at in range(0, len(new), ENCODE_WORDS):
                    part = new[at : at + ENCODE_WORDS]
                    found = tokenizer(path).encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)
                    known.update((w, np.array(e.ids, np.int32).tobytes()) for w, e in zip(part, found, strict=True))
                ids = [known[w] for w in own]
                out.append(press(planes(np.fromiter((len(i) // 4 for i in ids), np.int32, len(ids))), planes(np.frombuffer(b"".join(ids), np.int32))))
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("bucket"), pa.array(out, pa.binary())], names=["chunk", "bucket", "answer"])

    return words.repartition("bucket").mapInArrow(run, "chunk long, bucket int, answer binary")


def set_in(chunks: DataFrame, answers: DataFrame, fields: str, path: str, buckets: int) -> DataFrame:
    """Whole rows again, each with the ids of its words in order."""
    specials = added_tokens(path)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rest, raw, off = rows_of(left.column("blob")[0].as_py())
        pa.default_memory_pool().release_unused()
        words, first = split_chunk(raw, off, specials)
        values, ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        if len(words) > 1:
            coded = word_list(raw, words)
            order = dealt(coded.dictionary, buckets)[0]
            size, ids = [], []
            for i in np.argsort(right.column("bucket").to_numpy(), kind="stable").tolist():
                a, z = unpress(right.column("answer")[i].as_py())
                size.append(unplanes(a))
                ids.append(unplanes(z))
            size, ids = np.concatenate(size), np.concatenate(ids)
            start = np.empty(len(order), np.int64)
            count = np.empty(len(order), np.int64)
            start[order], count[order] = np.cumsum(size) - size, size
            # A list view per distinct word, set in by the words of the text.
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(ids[_spans(start, count)]))
            per_word = lists.take(coded.indices)
            values = per_word.values.to_numpy()
            ends = per_word.offsets.to_numpy()
        column = pa.ListArray.from_arrays(pa.array(ends[first].astype(np.int32)), pa.array(values, pa.int32()))
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(raw)])
        text = pc.if_else(rest.column("null").combine_chunks(), None, text.cast(pa.large_string()).cast(pa.string()))
        out = rest.drop_columns(["null"]).append_column("text", text).append_column("ids", column)
        # In short batches: the JVM reads them one at a time.
        return pa.Table.from_batches(out.combine_chunks().to_batches(int(BATCH_ROWS)))

    pairs = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return pairs.applyInArrow(run, fields)


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns of ``docs`` and ``ids array<int>``, as the tokenizer of ``path`` encodes whole texts.

    No special tokens are added; those that a text holds become their ids. Null
    and empty texts have no ids. Repeated rows stay repeated. An existing column
    named ``ids`` is replaced. ``path`` must be readable on every executor.
    """
    keep = [c for c in docs.columns if c not in (text, ids)]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    # A chunk is one blob row: what the words and the answers read is the same exchange.
    chunks = packed(spread(inner), chunk_bytes).repartition("chunk")
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = encoded_words(chunk_words(chunks, path, buckets), path)
    fields = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = set_in(chunks, answers, ", ".join([*fields, "text string", "ids array<int>"]), path, buckets)
    named = {c: F.col(f"k{i}") for i, c in enumerate(keep)} | {text: F.col("text")}
    return out.select(*[named[c].alias(c) for c in docs.columns if c != ids], F.col("ids").alias(ids))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and the text of ``ids``: pieces joined by id, bytes set in a row.

    Special tokens are kept. Null and empty id lists give an empty text; ids
    outside the vocabulary and null ids give nothing; bytes that are no UTF-8
    become replacement characters. The vocabulary is a constant of the plan, of the
    fixed size of its file; no Python runs. Pieces travel as one character per byte.
    """
    mark = "\u0100"  # no byte
    table = F.split(F.lit(mark.join(p.decode("latin-1") for p in pieces(path).to_pylist())), mark)
    parts = F.transform(F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")), lambda i: F.coalesce(F.get(table, i), F.lit("")))
    raw = F.encode(F.array_join(parts, ""), "ISO-8859-1")
    return docs.withColumn(out, F.make_valid_utf8(raw.cast("string")))
