"""Web archives packed in ZIP files: writing, listing and range reads (operator 9).

An archive is a ZIP file whose members are stored, not compressed: WARC files of
one gzip member per record, and an index with the place of each record. A reader
takes the end of the file, the central directory (ZIP or ZIP64) and the index, and
then only the byte ranges of the records it wants; nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut, new_table_path

WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
ARCHIVE_BYTES = 32 << 20  # compressed records of one archive
READ_GAP = 1 << 16  # bytes between two records that are read over rather than skipped
READ_MOST = 8 << 20  # bytes of one range read
SHORT = 100  # payloads below this many bytes are always written whole
DATE = "2020-01-01T00:00:00Z"  # pages carry no time; one date makes archives repeatable
# Fixed values of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL name space of UUIDs


# --- ZIP directories ----------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int  # 0: stored
    size: int
    packed: int
    header: int  # offset of the local header


def directory(f, size: int) -> list[Member]:
    """The central directory of a ZIP or ZIP64 file, from a seekable file of ``size`` bytes."""
    tail = min(size, 22 + 65535)
    f.seek(size - tail)
    raw = f.read(tail)
    at = raw.rfind(END)
    if at < 0:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack("<HII", raw[at + 10 : at + 20])
    place = size - tail + at
    if place >= 20:
        f.seek(place - 20)
        locator = f.read(20)
        if locator[:4] == LOCATOR64:
            f.seek(struct.unpack("<Q", locator[8:16])[0])
            end = f.read(56)
            if end[:4] != END64:
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack("<QQQ", end[32:56])
    f.seek(start)
    raw, at, out = f.read(length), 0, []
    for _ in range(count):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
        packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
        (header,) = struct.unpack("<I", raw[at + 42 : at + 46])
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # 8-byte values for the fields that are full, in this order
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        out.append(Member(name, method, full, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(f, m: Member) -> int:
    """Where the bytes of a stored member begin."""
    if m.method != 0:
        raise ValueError(f"{m.name} is compressed; only stored members can be read in ranges")
    f.seek(m.header)
    head = f.read(30)
    if head[:4] != LOCAL:
        raise ValueError("broken local header")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return m.header + 30 + n_name + n_extra


# --- WARC records -------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    """The same page with the same payload has the same record id, wherever it is written."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has the HTTP head only and names its response."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if page_id is not None:
        fields.append(("WARC-Page-ID", str(page_id)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", record_id(refers_to, digest)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 5, mtime=0)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, payload) of a decompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# --- jobs ---------------------------------------------------------------------


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to: null for responses, else the response's page_id.

    Only (digest, page_id) is exchanged; a payload that occurs once is not joined.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("_n"))
    equal = rows.filter(F.col("_n") >= SHORT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    equal = cut(equal.filter("n > 1 and first is not null").select(F.col("digest").alias("_digest"), "first"), "equal-payloads")
    joined = rows.join(equal, (rows["digest"] == equal["_digest"]) & (F.col("_n") >= SHORT), "left")
    # A page without an id can refer, but cannot be referred to.
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, records, bytes): one row per archive written below ``folder``.

    Each task writes archives of its own names and reports them when they are
    whole, so files of a task that was lost are never read. ``pages`` has page_id,
    url and html; a null html is an empty payload, null urls and ids are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        records, lines, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal records, lines, size
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
                z.writestr(zipfile.ZipInfo(WARC_MEMBER), b"".join(records))
                z.writestr(zipfile.ZipInfo(INDEX_MEMBER), "".join(lines))
            name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(buffer.getbuffer())
            n, total = len(records), buffer.tell()
            records, lines, size = [], [], 0
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": total}])

        for b in batches:
            for r in b.to_pylist():
                raw = warc_record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"])
                entry = {"url": r["url"], "page_id": r["page_id"], "offset": size, "length": len(raw), "digest": f"sha256:{r['digest']}"}
                lines.append(json.dumps(entry, ensure_ascii=False) + "\n")
                records.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield close()
        if records:
            yield close()

    return cut(planned(pages).mapInArrow(run, "path string, records long, bytes long"), "archives")


def record_index(archives: DataFrame) -> DataFrame:
    """(path, offset, length, page_id, url, digest): places of all records, from the archives' indexes.

    ``archives`` has a column ``path``. Offsets count from the start of the file. A
    stored member without lines in the index is not listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                size = fs.get_file_info(name).size
                with fs.open_input_file(name) as f:
                    members = {m.name: m for m in directory(f, size)}
                    warc = data_start(f, members[WARC_MEMBER])
                    f.seek(data_start(f, members[INDEX_MEMBER]))
                    lines = f.read(members[INDEX_MEMBER].size).decode("utf-8").splitlines()
                rows = [json.loads(x) for x in lines]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(rows), pa.string()), pa.array([warc + r["offset"] for r in rows], pa.int64()),
                        pa.array([r["length"] for r in rows], pa.int64()), pa.array([r["page_id"] for r in rows], pa.int64()),
                        pa.array([r["url"] for r in rows], pa.string()), pa.array([r["digest"] for r in rows], pa.string()),
                    ],
                    names=["path", "offset", "length", "page_id", "url", "digest"],
                )

    return archives.select("path").mapInArrow(run, "path string, offset long, length long, page_id long, url string, digest string")


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, url, type, record_id, refers_to_id, digest, payload binary) of the indexed records.

    Only the ranges of ``index`` (path, offset, length) are read; ranges that lie
    close together are read at once. A revisit's payload is null.
    """
    schema = "page_id long, url string, type string, record_id string, refers_to_id string, digest string, payload binary"
    names = ["page_id", "url", "type", "record_id", "refers_to_id", "digest", "payload"]

    def ranges(rows: list[tuple[str, int, int]]) -> Iterator[bytes]:
        fs = f = None
        opened, block, start = None, b"", 0
        for i, (path, offset, length) in enumerate(rows):
            if path != opened:
                if f is not None:
                    f.close()
                fs, name = pafs.FileSystem.from_uri(path)
                f, opened, block = fs.open_input_file(name), path, b""
            if not start <= offset or offset + length > start + len(block):
                end = offset + length
                for p, o, n in rows[i + 1 :]:
                    if p != path or o > end + READ_GAP or o < offset or o + n - offset > READ_MOST:
                        break
                    end = max(end, o + n)
                f.seek(offset)
                block, start = f.read(end - offset), offset
            yield zlib.decompress(block[offset - start : offset - start + length], 31)
        if f is not None:
            f.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = sorted(zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))
            out = []
            for raw in ranges(rows):
                h, payload = parsed(raw)
                page = h.get("warc-page-id")
                revisit = h["warc-type"] == "revisit"
                out.append((
                    int(page) if page is not None else None, h.get("warc-target-uri"), h["warc-type"], h["warc-record-id"],
                    h.get("warc-refers-to"), h["warc-payload-digest"].partition(":")[2], None if revisit else payload,
                ))
            kinds = (pa.int64(), *[pa.string()] * 5, pa.binary())
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return index.select("path", "offset", "length").mapInArrow(run, schema)


def payload_digest(records: DataFrame) -> DataFrame:
    """Records with ``n`` and ``sha`` of their payload instead of the payload (null for revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = b.column("payload").to_pylist()
            n = pa.array([None if p is None else len(p) for p in payloads], pa.int64())
            sha = pa.array([None if p is None else hashlib.sha256(p).hexdigest() for p in payloads], pa.string())
            keep = [b.column(c) for c in ("page_id", "type", "record_id", "refers_to_id")]
            yield pa.RecordBatch.from_arrays([*keep, n, sha], names=["page_id", "type", "record_id", "refers_to_id", "n", "sha"])

    return records.mapInArrow(run, "page_id long, type string, record_id string, refers_to_id string, n long, sha string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, read these back, and say what each record holds.

    (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per row
    of ``pages``. Of equal payloads of SHORT bytes or more the smallest page_id is
    the response, also where that id is repeated; revisits get size and digest
    from the response they name. Payloads of which no row has an id are responses.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))
    archives = write_archives(pages, new_table_path(pages.sparkSession, "wacz"))
    read = cut(payload_digest(read_records(record_index(archives))), "archive-records")
    own = read.filter("type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    named = read.filter("type = 'response'").groupBy(F.col("record_id").alias("named")).agg(
        F.min("page_id").alias("refers_to"), F.min("n").alias("payload_bytes"), F.min("sha").alias("payload_digest")
    )
    again = read.filter("type = 'revisit'")
    again = again.join(named, again["refers_to_id"] == named["named"]).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
    return own.unionByName(again)
