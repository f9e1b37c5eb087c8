"""Token ids as raw binary files with a minimal perfect hash index (operator 13).

A folder holds, for documents in ascending order of their ids:

* ``ids-<file>-<attempt>.bin``: the ids of the documents back to back, nothing else,
  little-endian, unsigned, 2 bytes wide where the vocabulary fits and else 4;
* ``ids-<file>-<attempt>.npz``: ``offsets``, the first id of each document in the file
  and the number of all;
* ``index-<bucket>-<attempt>.npz``: for the document keys of a hash bucket a minimal perfect
  hash, by slot a 64-bit fingerprint and a span of ``place`` (the file), ``row`` and ``rows``:
  where the key's documents are;
* the tables ``files`` and ``buckets``, which name the files of whole tasks only.

A key is found in constant time: bucket, slot, fingerprint, place. Files of a task
that was lost are not named and never read.
"""

from __future__ import annotations

import json
import os
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.batches import arrays, arrays_of, gathered, parts_by_bytes, slices, utf8
from paperloom.llm.bpe import ENCODE_WORDS, added_tokens, split_chunk, tokenizer, word_list
from paperloom.llm.perfect import build, joined
from paperloom.session import new_table_path

END_ID = 0
FILE_BYTES = 64 << 20  # of a payload file; a longer single document is a file of its own
PART_BYTES = 64 << 20  # of text a task encodes, by the table's size on disk
SLICE_BYTES = 8 << 20  # text encoded at once
KNOWN_WORDS = 3 << 17  # encoded words that a worker keeps, also for its next task; beyond, it keeps as many older ones at most
BUCKET_KEYS = 1 << 16  # document keys of an index file
READ_BYTES = 8 << 20  # payload read at once; a longer document is read alone
FILE_BITS = 24  # files of one task
KEY_SEED, PRINT_SEED = 42, 43


# --- encoding ------------------------------------------------------------------


class WordIds:
    """Ids of texts; each distinct word is given to the tokenizer once while it is kept."""

    def __init__(self, path: str, most: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would start a thread for each of the machine
        self.path, self.most, self.specials = path, most, added_tokens(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # what was known before; a word of it that comes again is known again

    def of_words(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        out = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        if missing and self.older:
            for i in missing:
                if (ids := self.older.get(words[i])) is not None:
                    out[i] = self.known[words[i]] = ids
            missing = [i for i in missing if out[i] is None]
        for at in range(0, len(missing), ENCODE_WORDS):
            part = missing[at : at + ENCODE_WORDS]
            found = tokenizer(self.path).encode_batch_fast([words[i].decode("utf-8") for i in part], add_special_tokens=False)
            for i, e in zip(part, found, strict=True):
                out[i] = self.known[words[i]] = array("I", e.ids).tobytes()
        return out

    def of_texts(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of back-to-back UTF-8 texts: each text's ids and END_ID."""
        n = len(off) - 1
        words, first = split_chunk(raw, off, self.specials)
        lists, per_word = [], np.zeros(0, np.int32)
        if len(words) > 1:
            coded = word_list(raw, words)
            lists = self.of_words(coded.dictionary.to_pylist())
            per_word = coded.indices.to_numpy()
        end = len(lists)  # a further word, which ends each text
        entries = pa.array([*lists, END_ID.to_bytes(4, "little")], pa.large_binary())
        _, offsets, data = entries.take(pa.array(np.insert(per_word, first[1:], end))).buffers()
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        text_ends = np.frombuffer(offsets, np.int64)[first[1:] + np.arange(1, n + 1)] // 4
        return np.frombuffer(data, "<u4")[: text_ends[-1]], np.concatenate([[0], text_ends])


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(maxsize=4)
def id_type(path: str) -> str:
    """Width of an id in the files: 2 bytes if the vocabulary of ``path`` fits, else 4."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


# --- files ---------------------------------------------------------------------


def put(folder: str, name: str, data: bytes | memoryview) -> None:
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{base}/{name}") as out:
        out.write(data)


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{name}") as f:
        return arrays_of(f.read())


def doc_key(id_col: Column) -> Column:
    """The key of a document id as a text; a null id has a key of its own."""
    return F.coalesce(F.concat(F.lit("k"), id_col.cast("string")), F.lit("n"))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def written(docs: DataFrame, path: str, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write payload files; (file, row, key): one row per document, its place.

    ``docs`` has key, doc_id and text. Documents go to files in ascending order of
    doc_id; null ids come first, equal ids are ordered by their texts' hashes.
    """
    kind = id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        encoder, task = encoder_of(path), TaskContext.get().partitionId()
        state = {"number": 0, "size": 0, "held": [], "sizes": [], "keys": []}

        def close() -> pa.RecordBatch:
            name = f"ids-{task:06d}-{state['number']:06d}-{uuid.uuid4().hex}"
            size = np.concatenate(state["sizes"])
            offsets = np.concatenate([[0], np.cumsum(size)])
            with fs.open_output_stream(f"{base}/{name}.bin") as out:
                for part in state["held"]:
                    out.write(part.tobytes())
            put(folder, f"{name}.npz", arrays(offsets=offsets))
            keys = pa.chunked_array(state["keys"]).combine_chunks()
            n, file = len(keys), task << FILE_BITS | state["number"]
            state.update(number=state["number"] + 1, size=0, held=[], sizes=[], keys=[])
            named = pa.array([name] + [None] * (n - 1), pa.string())  # the file's facts stand in its first row
            facts = pa.array([int(offsets[-1])] + [None] * (n - 1), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, file)), pa.array(np.arange(n)), keys, named, facts], names=["file", "row", "key", "name", "ids"]
            )

        for whole in gathered(batches, "text", SLICE_BYTES):
            for b in slices(whole, "text", SLICE_BYTES):
                ids, ends = encoder.of_texts(*utf8(b.column("text")))
                ids = ids.astype(kind)
                room = file_bytes // ids.itemsize
                at = 0
                while at < b.num_rows:
                    stop = int(np.searchsorted(ends, ends[at] + room - state["size"], "right")) - 1
                    if stop <= at:
                        if state["size"]:
                            yield close()
                            continue
                        stop = at + 1
                    stop = min(stop, b.num_rows)
                    state["held"].append(ids[ends[at] : ends[stop]])
                    state["sizes"].append(np.diff(ends[at : stop + 1]))
                    state["keys"].append(b.column("key").slice(at, stop - at))
                    state["size"] += int(ends[stop] - ends[at])
                    at = stop
        if state["size"]:
            yield close()

    salted = docs.select("key", "doc_id", "text", F.monotonically_increasing_id().alias("salt"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("salt")]
    parts = parts_by_bytes(docs, PART_BYTES)
    dealt = salted.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select("key", "text").mapInArrow(run, "file long, row long, key string, name string, ids long")


def indexed(places: DataFrame, folder: str, buckets: int) -> DataFrame:
    """(bucket, name): write one index file for each bucket of document keys.

    ``places`` has key, file, row. A key's rows in a file follow each other, so a key
    has one entry in each file that holds it, however often it is repeated.
    """
    runs = places.groupBy("key", "file").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"))
    keyed = runs.withColumn("bucket", bucket_of(F.col("key"), buckets))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("file", "ascending")])
        coded = t.column("key").combine_chunks().dictionary_encode()
        names = [k.encode() for k in coded.dictionary.to_pylist()]
        h, prints = (np.fromiter((xxhash.xxh64_intdigest(k, s) for k in names), np.uint64, len(names)) for s in (KEY_SEED, PRINT_SEED))
        sizes, words = build(h)
        slot = joined([(sizes, words)]).slots(h, np.zeros(len(h), np.int64))
        of_entry = slot[coded.indices.to_numpy()]
        order = np.argsort(of_entry, kind="stable")
        first = np.searchsorted(of_entry[order], np.arange(len(names) + 1))
        by_slot = np.empty(len(names), np.uint64)
        by_slot[slot] = prints
        entries = {c: t.column("file" if c == "place" else c).to_numpy()[order] for c in ("place", "row", "rows")}
        bucket = key[0].as_py()
        name = f"index-{bucket:06d}-{uuid.uuid4().hex}.npz"
        put(folder, name, arrays(sizes=sizes, words=words, prints=by_slot, first=first, **entries))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "name": [name]})

    return keyed.groupBy("bucket").applyInArrow(run, "bucket int, name string")


def write_ids(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES, bucket_keys: int = BUCKET_KEYS) -> str:
    """Write the ids of whole texts to ``folder`` and return it.

    ``path`` is a byte-level tokenizer file readable on every executor. No special
    tokens are added; END_ID ends each document, also null and empty texts, which
    have no other id. Repeated rows and repeated or null ids are documents of their
    own. Other columns are ignored. An empty table writes empty tables.
    """
    spark = docs.sparkSession
    rows = docs.select(doc_key(F.col(f"`{id_col}`")).alias("key"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    written(rows, path, folder, file_bytes).write.parquet(f"{folder}/places")
    places = spark.read.parquet(f"{folder}/places")
    files = places.filter("name is not null")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per payload file
    start = F.coalesce(F.sum("ids").over(earlier), F.lit(0)).cast("long")
    files.select("file", "name", "ids", start.alias("start")).write.parquet(f"{folder}/files")
    buckets = max(1, -(-places.count() // bucket_keys))
    index = indexed(places.select("key", "file", "row"), folder, buckets)
    index.withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/buckets")
    return folder


def found(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(key columns, file, row, rows): where the index of ``folder`` has the distinct ``keys(key, doc_id)``."""
    buckets = spark.read.parquet(f"{folder}/buckets")
    one = buckets.select("buckets").first()
    if one is None:  # nothing was written
        return keys.select("doc_id", F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("rows")).limit(0)
    dealt = keys.withColumn("bucket", bucket_of(F.col("key"), one[0])).join(buckets.select("bucket", "name"), "bucket")
    kind = keys.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, table, hashes = None, {}, None
        for b in batches:
            names = b.column("name").to_pylist()
            cut = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, z in zip(cut, cut[1:], strict=False):
                if a == z:
                    continue
                if names[a] != opened:
                    opened, table = names[a], load(folder, names[a])
                    hashes = joined([(table["sizes"], table["words"])])
                raw = [k.encode() for k in b.column("key").slice(a, z - a).to_pylist()]
                h, prints = (np.fromiter((xxhash.xxh64_intdigest(k, s) for k in raw), np.uint64, len(raw)) for s in (KEY_SEED, PRINT_SEED))
                slot = hashes.slots(h, np.zeros(len(h), np.int64))
                hit = np.flatnonzero(slot >= 0)
                hit = hit[table["prints"][slot[hit]] == prints[hit]]
                begin, end = table["first"][slot[hit]], table["first"][slot[hit] + 1]
                n = end - begin
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
                ids = b.column("doc_id").take(pa.array(np.repeat(hit + a, n)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(table[c][at]) for c in ("place", "row", "rows"))], names=["doc_id", "file", "row", "rows"])

    sorted_keys = dealt.select("bucket", "name", "key", "doc_id").repartition("bucket").sortWithinPartitions("bucket")
    return sorted_keys.mapInArrow(run, f"doc_id {kind}, file long, row long, rows long")


def read_ids(spark: SparkSession, folder: str, ids: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, payload) of the documents of ``folder`` with the ids of ``ids``.

    ``payload`` holds the document's ids with END_ID as little-endian unsigned 32-bit
    integers; ``start`` counts the ids of all documents before it. Ids that the folder
    does not have give no row, a repeated one gives a row for each of its documents.
    Each wanted payload range is read once.
    """
    kind, wide = id_type(path), ids.schema[id_col].dataType.simpleString()
    keys = ids.select(F.col(f"`{id_col}`").alias("doc_id")).distinct().withColumn("key", doc_key(F.col("doc_id")))
    files = spark.read.parquet(f"{folder}/files").select("file", "name", "start")
    spans = found(spark, folder, keys).join(files, "file")
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        opened, offsets, f = None, np.zeros(1, np.int64), None

        def ranges(name: str, doc: pa.Array, row: np.ndarray, rows: np.ndarray, start: int) -> Iterator[pa.RecordBatch]:
            nonlocal opened, offsets, f
            if name != opened:
                if f is not None:
                    f.close()
                opened, offsets, f = name, load(folder, f"{name}.npz")["offsets"], fs.open_input_file(f"{base}/{name}.bin")
            of = np.repeat(np.arange(len(row)), rows)
            each = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows) + np.repeat(row, rows)
            begin, end = offsets[each], offsets[each + 1]
            at = 0
            while at < len(each):
                stop = at + 1  # neighbours in the file are read together
                while stop < len(each) and begin[stop] == end[stop - 1] and (end[stop] - begin[at]) * width <= READ_BYTES:
                    stop += 1
                f.seek(int(begin[at]) * width)
                raw = f.read(int(end[stop - 1] - begin[at]) * width)
                got = np.frombuffer(raw, kind).astype("<u4").tobytes()
                cuts = ((np.append(begin[at:stop], end[stop - 1]) - begin[at]) * 4).astype(np.int64)
                payload = pa.Array.from_buffers(pa.large_binary(), stop - at, [None, pa.py_buffer(cuts), pa.py_buffer(got)])
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(of[at:stop])), pa.array(begin[at:stop] + start), pa.array(end[at:stop] - begin[at:stop]), payload.cast(pa.binary())],
                    names=["doc_id", "start", "n_tokens", "payload"],
                )
                at = stop

        for b in batches:
            names = b.column("name").to_pylist()
            cut = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, z in zip(cut, cut[1:], strict=False):
                if a < z:
                    part = b.slice(a, z - a)
                    yield from ranges(names[a], part.column("doc_id"), part.column("row").to_numpy(), part.column("rows").to_numpy(), part.column("start")[0].as_py())
        if f is not None:
            f.close()

    # A span is a few bytes and stands for a whole range, so small partitions are not merged.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count())
    sorted_spans = spans.repartition(parts, "file").sortWithinPartitions("file", "row")
    return sorted_spans.mapInArrow(run, f"doc_id {wide}, start long, n_tokens long, payload binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``write_ids`` of ``docs`` to a new folder, and ``read_ids`` of every document through its index."""
    spark = docs.sparkSession
    folder = write_ids(docs, path, new_table_path(spark, "token-ids"), id_col, text)
    return read_ids(spark, folder, docs, path, id_col)
