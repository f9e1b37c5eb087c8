"""Helpers for Arrow batches of texts, shared by the operators of this package."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import tune

# Rows of one Arrow batch. Texts are sent whole, so the batch is kept short.
BATCH_ROWS = "512"

# Allocator of the Python workers. Workers outlive their stage and lie idle beside those of the next, so blocks of
# 1 MB and more are mapped on their own and go back to the system when freed, Arrow's as well.
WORKER_MEMORY = {
    "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this package's queries; they stay set on the session.

    The runtime settings of the library, and short Arrow batches, so that a batch
    of very long texts fits a Python worker, which gives freed memory back.
    """
    tune(spark)
    # Workers import this package from where the driver has it; on a cluster, from its install.
    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.update(WORKER_MEMORY)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(id_col.cast("string")) % n


def parts_by_bytes(df: DataFrame, part_bytes: int) -> int:
    """Partitions of about ``part_bytes`` for a table, by its size on disk; at least the session's shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // part_bytes)) if size < 1 << 60 else least  # beyond: a size that Spark does not know


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text.

    The bytes hold exactly the texts of the column, back to back.
    """
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (fixed multipliers of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``limit`` text bytes or one row."""
    _, off = utf8(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Short batches put together up to ``limit`` text bytes; a longer one stays as it is."""
    held, size = [], 0
    for b in batches:
        own = len(utf8(b.column(text))[0])
        if held and size + own > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += own
    if held:
        yield pa.concat_batches(held)


def arrays(**named: np.ndarray) -> bytes:
    """Numpy arrays as the bytes of an uncompressed npz file."""
    buffer = io.BytesIO()
    np.savez(buffer, **named)
    return buffer.getvalue()


def arrays_of(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


END = 0x110000  # the sign that ends each text of a batch


@lru_cache(maxsize=2)
def folding(letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point (where it is one code point), and whether it counts."""
    fold, counts = np.arange(END + 2, dtype=np.uint32), np.zeros(END + 2, bool)
    for c in range(END):
        ch = chr(c)
        if ch.isalpha() if letters_only else ch.isalnum():
            counts[c] = True
            low = ch.lower()
            if len(low) == 1:
                fold[c] = ord(low)
    counts[END] = True
    return fold, counts


def normalised(
    raw: np.ndarray, off: np.ndarray, letters_only: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, place, row, first): folded letters (and digits), any other run as one space.

    ``place`` is the code point's index in its text, ``row`` the text's number. Each
    text ends with END. ``first`` holds where each text begins.
    """
    fold, counts = folding(letters_only)
    code = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(begins)])[off]  # code point where each text begins
    size = np.diff(at)
    n = len(size)
    row = np.repeat(np.arange(n), size + 1)
    ends = at[1:] + np.arange(n)
    full = np.full(len(code) + n, END, np.uint32)
    inside = np.ones(len(full), bool)
    inside[ends] = False
    full[inside] = code
    place = np.arange(len(full)) - (at[:-1] + np.arange(n))[row]
    ok = counts[full]
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # the first sign after a letter stands for its whole run
    codes = np.where(ok, fold[full], 32).astype(np.uint32)[keep]
    row, place = row[keep], place[keep]
    return codes, place, row, np.searchsorted(row, np.arange(n))
