"""WARC archives: a writer, a normaliser for whole-file gzip streams, and a reader over the normaliser's index.

``write_archives`` makes one response or revisit record per page and compresses each archive as a single gzip stream, the
way careless tools do. ``normalise`` inflates such a stream once, in pieces, rewrites every record as a gzip member of its
own and writes a sidecar index (JSON lines: offset, length, id, type, digest), so that ``read_records`` can fetch any
record by itself.

All files lie in the folder that ``spark.checkpoint.dir`` names. A task writes under a name of its own and reports it in
its row of the manifest table; what a lost or repeated task wrote is in no manifest and is never read.

Revisits: of rows with equal payloads of at least ``min_bytes`` bytes, the one with the smallest id (and, of rows that
repeat that id, one) is the response, the others are revisits without payload. Equality is that of length, SHA-256 and
SHA-1, so that payloads made to collide in SHA-1 are kept apart. Hot payloads: the smallest id is a ``min`` combined before
the shuffle and written, and goes back to the rows by a join whose hot keys Spark can split. Rows are told apart by a
number that is written with them once, while the archives are made.

Defined cases: a null payload counts as empty; a null id sorts last and is read back as null; a null URL is left out;
control characters and blanks in URLs are percent-encoded; an empty table gives no archives and an empty result; other
columns are not archived, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, discard, drop_folder, durable, fresh_path, lean

#: An archive is closed once it holds so many bytes before compression.
ARCHIVE_BYTES = 256 << 20
_CHUNK = 1 << 20
_LAST_ID = (1 << 63) - 1
_DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def same_payload(payload: Column) -> Column:
    """What equal payloads, and no others, have in common: length, SHA-256 and SHA-1."""
    return F.concat_ws(":", F.octet_length(payload).cast("string"), F.sha2(payload, 256), F.sha1(payload))


def _safe_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(record_id: str, kind: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """The bytes of one record, uncompressed. A revisit keeps the HTTP header, which tells the payload's size."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe_url(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflate(source: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of one member or many, in pieces of ``_CHUNK`` bytes at most, however well it is packed."""
    z, begun = zlib.decompressobj(31), False
    while data := source.read(_CHUNK):
        while data:
            begun = True
            yield z.decompress(data, _CHUNK)
            data = z.unconsumed_tail
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
    while begun:  # what was held back for its size
        piece = z.decompress(z.unconsumed_tail, _CHUNK)
        begun = not z.eof
        if piece:
            yield piece
        elif begun:
            raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """``(header fields in lower case, block, whole record)`` of each record of an inflated stream."""
    held = bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's header")
                return
        head = held[:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size = int(fields["content-length"])
        total = end + 4 + size + 4
        while len(held) < total:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(held[end + 4 : end + 4 + size]), bytes(held[:total])
        del held[:total]


def _open(path: str, write: bool = False):
    store, inner = fs.FileSystem.from_uri(path)
    if not write:
        return store.open_input_file(inner)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner, compression=None)


def _id(page: int | None, row: int) -> str:
    return f"urn:page:{'' if page is None else page}:{row}"


def _page(record_id: str) -> int | None:
    page = record_id.strip("<>").split(":")[2]
    return int(page) if page else None


MANIFEST = "path string, index string, n long, bytes long"
_MANIFEST_PA = pa.schema([("path", pa.string()), ("index", pa.string()), ("n", pa.int64()), ("bytes", pa.int64())])


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MANIFEST_PA, strict=True)], schema=_MANIFEST_PA)


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write the archives; returns their manifest (``path, index`` null``, n, bytes``), a written table."""
    spark = df.sparkSession
    bound_batches(spark)
    folder = fresh_path(spark, "warc-whole")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = durable(rows.select("*", F.monotonically_increasing_id().alias("row"), same_payload(F.col("payload")).alias("same")), "warc-rows")
    order = F.struct(F.coalesce("page", F.lit(_LAST_ID)).alias("at"), "row")
    groups = durable(rows.where(F.octet_length("payload") >= min_bytes).groupBy("same").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", F.col("first.at").alias("first_at"), F.col("first.row").alias("first_row")), "copies")
    known = rows.join(groups, "same", "left").select("page", "url", "payload", "row", "first_at", "first_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        done, out, path, z, n, size = [], None, "", None, 0, 0
        for b in batches:
            for page, url, body, row, first_at, first_row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, z = _open(path, write=True), zlib.compressobj(level, zlib.DEFLATED, 31)
                again = first_row is not None and first_row != row and len(body) >= min_bytes
                refers = _id(None if first_at == _LAST_ID else first_at, first_row) if again else None
                raw = record(_id(page, row), "revisit" if again else "response", url, body, payload_digest(body), refers)
                out.write(z.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    out.write(z.flush())
                    out.close()
                    done.append((path, None, n, size))
                    out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            done.append((path, None, n, size))
        if done:
            yield _listed(done)

    manifest = durable(known.mapInArrow(run, MANIFEST), "warc-manifest")
    discard(spark, rows, groups)
    return manifest


def _one_each(manifest: DataFrame) -> DataFrame:
    """Deals the files out, each task a few; a file's name says nothing about its place."""
    return manifest.repartition(max(1, manifest.count()))


def normalise(manifest: DataFrame, level: int = 6) -> DataFrame:
    """Rewrite the archives of a manifest record by record; returns the manifest of the new files and their indexes."""
    spark = manifest.sparkSession
    folder = fresh_path(spark, "warc-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for path in b.column(0).to_pylist():
                name, offset, n, lines = f"{folder}/{uuid.uuid4().hex}", 0, 0, []
                with _open(path) as source, _open(f"{name}.warc.gz", write=True) as out, _open(f"{name}.idx", write=True) as index:
                    for fields, _, whole in records(inflate(source)):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        entry = {"offset": offset, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"], "digest": fields.get("warc-payload-digest", "")}
                        lines.append(json.dumps(entry))
                        offset, n = offset + len(member), n + 1
                        if len(lines) == 1000:
                            index.write(("\n".join(lines) + "\n").encode())
                            lines = []
                    if lines:
                        index.write(("\n".join(lines) + "\n").encode())
                yield _listed([(f"{name}.warc.gz", f"{name}.idx", n, offset)])

    return durable(_one_each(manifest).mapInArrow(run, MANIFEST), "warc-members-manifest")


RECORDS = "page_id long, record_id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_RECORDS_PA = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_member(member: bytes) -> tuple:
    """A row of ``RECORDS`` from one gzip member; the payload of a response is held against its digest."""
    ((fields, block, _),) = records(iter([zlib.decompress(member, 31)]))
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    refers = fields.get("warc-refers-to")
    return _page(fields["warc-record-id"]), fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), payload if kind == "response" else None, size, digest, None if refers is None else _page(refers)


def read_records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of normalised archives, each fetched by its place in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS_PA, strict=True)], schema=_RECORDS_PA)

        for b in batches:
            for path, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                with _open(path) as source, _open(index) as entries:
                    for line in _lines(entries):
                        at = json.loads(line)
                        source.seek(at["offset"])
                        row = read_member(source.read(at["length"]))
                        if not with_payload:
                            row = (*row[:4], None, *row[5:])
                        rows.append(row)
                        held += len(row[4] or b"")
                        if len(rows) == 500 or held > 2 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return _one_each(manifest).mapInArrow(run, RECORDS)


def _lines(source: BinaryIO) -> Iterator[bytes]:
    rest = b""
    while data := source.read(_CHUNK):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, with_payload: bool = True) -> DataFrame:
    """Archive the rows, normalise the archives and read the records back. The archives as first written are deleted once they
    are normalised."""
    whole = write_archives(df, id_col, url_col, payload_col, min_bytes)
    members = normalise(whole)
    for r in whole.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().collect():
        drop_folder(df.sparkSession, r["folder"])
    discard(df.sparkSession, whole)
    return read_records(members, with_payload)
