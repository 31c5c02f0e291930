"""WARC archives: write them, normalise whole-file gzip streams to one member per record, read them by their index.

Archives are files in the shared folder, written and read through Arrow's file systems, so the folder may be local or
in a store.  Each file is the work of one task; a task that runs again writes files under new names, and only files
that the stored manifest names are used, so what a lost task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import all_slices, as_bytes, stored
from shelfmark.session import shared_dir, task_count

_LEVEL = 3
_CHUNK = 1 << 20
_FILE_BYTES = 64 << 20  # payload bytes of one archive
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"

_MANIFEST_DDL = "file string, ord bigint, page_id bigint, digest string, payload_bytes bigint"
_MANIFEST = pa.schema(
    [("file", pa.string()), ("ord", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64())]
)
_PAGES_DDL = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_PAGES = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64())]
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_uri(page_id: int | None) -> str:
    return "page:" if page_id is None else f"page:{page_id}"


def _page_of(uri: str) -> int | None:
    number = uri.removeprefix("page:")
    return int(number) if number else None


def make_record(kind: str, headers: dict[str, str], payload: bytes) -> bytes:
    """One WARC/1.1 record with its closing blank lines; line ends in values become spaces."""
    fields = {"WARC-Type": kind, "WARC-Date": _DATE, **headers, "Content-Length": str(len(payload))}
    clean = (f"{name}: {' '.join(value.splitlines())}\r\n" for name, value in fields.items())
    return ("WARC/1.1\r\n" + "".join(clean) + "\r\n").encode() + payload + b"\r\n\r\n"


def split_record(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, payload, end) of the record at ``start``; None where the data stops before its end."""
    head = data.find(b"\r\n\r\n", start)
    if head < 0:
        return None
    lines = data[start:head].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    begin, size = head + 4, int(headers["Content-Length"])
    end = begin + size + 4
    return None if end > len(data) else (headers, data[begin : begin + size], end)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URI or a plain path."""
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _inflated(source) -> Iterator[bytes]:
    """The plain bytes of a gzip file of any number of members, in pieces of bounded size; a cut-off member is an error."""
    engine, ended = zlib.decompressobj(31), True
    while chunk := source.read(_CHUNK):
        while chunk:
            if ended:
                engine, ended = zlib.decompressobj(31), False
            yield engine.decompress(chunk, _CHUNK)
            ended = engine.eof
            chunk = engine.unused_data if ended else engine.unconsumed_tail
        while not ended and (rest := engine.decompress(b"", _CHUNK)):
            yield rest
            ended = engine.eof
    if not ended:
        raise ValueError("the archive ends inside a gzip member")


def _size_at(data: bytearray, start: int) -> int:
    """Bytes of the record at ``start``, or one more than there are while its headers are not complete."""
    head = data.find(b"\r\n\r\n", start)
    if head < 0:
        return len(data) - start + 1
    length = re.search(rb"^Content-Length: *(\d+)\r?$", data[start : head + 2], re.MULTILINE)
    return head + 4 - start + int(length.group(1)) + 4


def records_of(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a gzip stream, inflated once from front to back; one record at a time is held."""
    kept, need = bytearray(), 1
    for piece in _inflated(source):
        kept += piece
        start = 0
        while len(kept) - start >= need:
            need = _size_at(kept, start)
            if len(kept) - start >= need:
                headers, payload, _ = split_record(bytes(kept[start : start + need]))
                yield headers, payload
                start, need = start + need, 1
        del kept[:start]
    if kept:
        raise ValueError("the archive ends inside a record")


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write each page as a response record; a file is one gzip stream.  Returns (file, ord, page_id, digest, payload_bytes)."""

    def write(batches):
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        out = engine = name = None
        ord_ = size = 0
        for part in all_slices(batches, 1, _CHUNK):
            rows = []
            for page_id, url, payload in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), as_bytes(part.column(1))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, engine, ord_, size = store.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(_LEVEL, wbits=31), 0, 0
                digest = payload_digest(payload)
                headers = {
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{ord_}')}>",
                    "WARC-Target-URI": url or "", "WARC-Payload-Digest": f"sha1:{digest}", "X-Page": _page_uri(page_id),
                }
                record = make_record("response", headers, payload)
                out.write(engine.compress(record))
                rows.append((name, ord_, page_id, digest, len(payload)))
                ord_, size = ord_ + 1, size + len(record)  # headers too, so empty payloads fill an archive as well
                if size >= _FILE_BYTES:
                    out.write(engine.flush())
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MANIFEST)], schema=_MANIFEST)
        if out is not None:
            out.write(engine.flush())
            out.close()

    return stored(pages.select("page_id", F.col("html").cast("string"), "url").mapInArrow(write, _MANIFEST_DDL), "manifest")


def revisits(manifest: DataFrame, least_bytes: int) -> DataFrame:
    """(file, ord, refers_to) of records whose payload an earlier page has: the smallest page id keeps the payload.

    All rows with that id stay responses, as do payloads below ``least_bytes``.  A page without an id refers to the
    smallest id there is; where none is, its record stays a response.
    """
    large = manifest.filter(F.col("payload_bytes") >= least_bytes)
    firsts = large.groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
    shared = firsts.filter((F.col("_n") > 1) & F.col("refers_to").isNotNull()).drop("_n")
    later = ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return large.join(shared, ["digest", "payload_bytes"]).filter(later).select("file", "ord", "refers_to")


def normalise(spark: SparkSession, manifest: DataFrame, later: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite every record as a gzip member of its own and write an offset index beside each archive.

    Each whole-file stream is inflated once.  Records that ``later`` names become revisits without their payload.  The
    index has one JSON line per record: page, offset, length, digest, record type.  Returns (file, records).
    """
    jobs = (
        manifest.select("file").distinct()
        .join(later.groupBy("file").agg(F.collect_list(F.struct("ord", "refers_to")).alias("later")), "file", "left")
        # By an expression of the name: a repartition by the join key itself would be merged into few tasks again.
        .repartition(task_count(spark), F.xxhash64("file"))
    )

    def rewrite(batches):
        store, _ = _open(source)
        source_path, target_path = _open(source)[1], _open(target)[1]
        store.create_dir(target_path, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                refers = {j["ord"]: j["refers_to"] for j in row["later"] or ()}
                new, offset, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with (
                    store.open_input_stream(f"{source_path}/{row['file']}", compression=None) as old,
                    store.open_output_stream(f"{target_path}/{new}", compression=None) as out,
                    store.open_output_stream(f"{target_path}/{new}.idx", compression=None) as index,
                ):
                    for headers, payload in records_of(old):
                        kind = "response"
                        headers = {k: v for k, v in headers.items() if k not in ("WARC-Type", "WARC-Date", "Content-Length")}
                        if count in refers:
                            kind = "revisit"
                            headers |= {"WARC-Profile": _PROFILE, "X-Refers-To": _page_uri(refers[count]), "X-Payload-Length": str(len(payload))}
                            payload = b""
                        engine = zlib.compressobj(_LEVEL, wbits=31)
                        member = engine.compress(make_record(kind, headers, payload)) + engine.flush()
                        out.write(member)
                        line = {
                            "page": headers["X-Page"], "offset": offset, "length": len(member),
                            "digest": headers["WARC-Payload-Digest"], "type": kind,
                        }
                        index.write(json.dumps(line).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                names, counts = pa.array([new]), pa.array([count], pa.int64())
                yield pa.RecordBatch.from_arrays([names, counts], names=["file", "records"])

    return stored(jobs.mapInArrow(rewrite, "file string, records bigint"), "normalised")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Read records at the offsets of the index: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Payloads of responses are hashed again; one that differs from its header's digest raises an error.
    """
    parts = task_count(files.sparkSession)

    def read(batches):
        store, path = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{path}/{row['file']}.idx", compression=None) as index:
                    lines = [json.loads(line) for line in index.read().splitlines()]
                if len(lines) != row["records"]:
                    raise ValueError(f"{row['file']}: {len(lines)} index lines for {row['records']} records")
                rows = []
                with store.open_input_file(f"{path}/{row['file']}") as archive:
                    for line in lines:
                        data = zlib.decompress(archive.read_at(line["length"], line["offset"]), 31)
                        headers, payload, _ = split_record(data)
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        if kind == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"{row['file']}: digest of {line['page']} differs")
                        size = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                        refers = _page_of(headers["X-Refers-To"]) if kind == "revisit" else None
                        rows.append((_page_of(headers["X-Page"]), size, digest, kind, refers))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PAGES)], schema=_PAGES)

    return files.select("file", "records").repartition(parts, F.xxhash64("file")).mapInArrow(read, _PAGES_DDL)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages (page_id, html, url) as archives, normalise them, and read them back, one row per page row.

    A null html is an empty payload, a null url an empty target.  The archives stay in the shared folder.
    """
    spark = pages.sparkSession
    raw, final = shared_dir(spark, "warc-streams"), shared_dir(spark, "warc")
    manifest = write_monolithic(pages, raw)
    files = normalise(spark, manifest, revisits(manifest, least_bytes), raw, final)
    return read_archives(files, final)
