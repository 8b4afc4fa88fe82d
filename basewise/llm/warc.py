"""WARC archives: writing captures, reading records, and assembling transactions.

``write_archives`` turns each page into three records, a request, a response (or a revisit of an
earlier response with the same payload) and a metadata record; request and metadata name the
response in WARC-Concurrent-To. Records are gzip members of their own in files of bounded size.
``read_records`` parses archives record by record; ``assemble`` joins records through their
concurrent-to identifiers and emits one nested row per capture.

Files are written by tasks under names of their own attempt and count only if the committed manifest
names them, so a lost executor or a second attempt does no harm.

Defined cases: a null html is an empty payload. A null url is written as ``urn:page:<page_id>``. Rows
that repeat a page_id are captures of their own; a null page_id is written as an absent header and
read back as null. Of equal payloads the one with the largest page_id is the response (of rows that
repeat it, the one with the largest url; of wholly equal rows the first is the response). An empty table
gives no files and no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, staged

#: Payload bytes below which a payload is never written as a revisit.
MIN_REVISIT_BYTES = 0
DATE = "2026-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to array<string>, target_uri string, page_id long, "
    "payload_bytes long, payload_digest string, refers_to string, content_type string, payload binary"
)

_ARROW = pa.schema(
    [(n, pa.list_(pa.string()) if t == "array<string>" else {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))]
)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def choose_responses(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Each page's page_id, url, html, ``key`` (a digest of the three) and ``first``, the page that it revisits or null.

    Winners are found by a map-side combined aggregate over digests. They are joined back to slim
    rows (a hot digest is a skewed key that adaptive execution splits), and only those go to the html.
    Rows with equal keys are left to the writer, which finds them side by side.
    """
    sha = F.sha1(F.coalesce("html", F.lit("")))
    keyed = pages.select("page_id", "url", "html", F.sha1(F.to_json(F.struct("page_id", "url", sha.alias("sha")))).alias("key"))
    slim = keyed.select("key", "page_id", "url", F.unhex(sha).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= min_bytes)
    rank = F.struct(F.col("page_id").isNotNull().alias("given"), "page_id", F.coalesce("url", F.lit("")).alias("url"), "key")
    best = slim.groupBy("sha", "n").agg(F.max(rank).alias("first"), F.min("key").alias("least"), F.max("key").alias("most")).where("least != most")
    # written, so that the join below shuffles both sides for itself: only then can a hot digest be split
    best = staged(best.select(F.col("sha").alias("_sha"), F.col("n").alias("_n"), "first"), "first-copies")
    revisits = slim.join(best, (F.col("sha") == F.col("_sha")) & (F.col("n") == F.col("_n"))).where(F.col("key") != F.col("first.key"))
    decided = revisits.groupBy(F.col("key").alias("_key")).agg(F.first("first").alias("first"))
    # the html is shuffled once, by the key that the writer needs side by side and the join uses
    return keyed.repartition("key").join(decided, F.col("key") == F.col("_key"), "left").drop("_key").sortWithinPartitions("key")


def _record(kind: str, record: str, headers: dict[str, object], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers.items() if v is not None]
    head = "WARC/1.1\r\n" + "".join(f"{x}\r\n" for x in lines) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _record_uuid(key: str, copy: int, part: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{part}:{key}:{copy}"))


def _header_safe(uri: str) -> str:
    return "".join(c if c > " " else "%{:02X}".format(ord(c)) for c in uri)


def write_archives(pages: DataFrame, folder: str, file_bytes: int = 64 << 20, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the archives; returns their manifest (path, records), one row per file.

    A task starts a new file once the current one has ``file_bytes``.
    """

    def capture(page_id: int | None, url: str | None, html: str | None, key: str, first: dict | None, copy: int) -> bytes:
        """The three records of a page; copy: how many rows with this key came before."""
        if first is None and copy and len((html or "").encode()) >= min_bytes:
            first = {"page_id": page_id, "url": url, "key": key}
        payload = (html or "").encode()
        uri = _header_safe(url if url else f"urn:page:{page_id}")
        response, digest = _record_uuid(key, copy, "response"), _digest(payload)
        to = f"<urn:uuid:{response}>"
        about = {"WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}"}
        http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n"
        if first is None:
            main = _record("response", response, about | {"Content-Type": "application/http; msgtype=response"}, http.encode() + payload)
        else:
            about |= {
                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                "WARC-Refers-To": f"<urn:uuid:{_record_uuid(first['key'], 0, 'response')}>",
                "WARC-Refers-To-Target-URI": _header_safe(first["url"] or f"urn:page:{first['page_id']}"),
                "Content-Type": "application/http; msgtype=response",
            }
            main = _record("revisit", response, about, http.encode())
        ask = f"GET {uri} HTTP/1.1\r\nUser-Agent: basewise\r\n\r\n".encode()
        request = _record("request", _record_uuid(key, copy, "request"), {"WARC-Target-URI": uri, "WARC-Concurrent-To": to, "Content-Type": "application/http; msgtype=request"}, ask)
        fields = [("page-id", page_id), ("payload-length", len(payload)), ("refers-to-page-id", first["page_id"] if first else None)]
        text = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()
        meta = _record("metadata", _record_uuid(key, copy, "metadata"), {"WARC-Target-URI": uri, "WARC-Concurrent-To": to, "Content-Type": "application/warc-fields"}, text)
        return request + main + meta

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        sink, name, size, records, last, copy = None, "", 0, 0, None, 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "key", "first")), strict=True):
                copy, last = (copy + 1 if r[3] == last else 0), r[3]
                if sink is None:
                    name, size, records = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = files.open_output_stream(f"{path}/{name}", compression=None)
                data = capture(*r, copy)
                sink.write(data)
                size, records = size + len(data), records + 3
                if size >= file_bytes:
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": records}])
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": records}])

    return staged(choose_responses(pages, min_bytes).mapInArrow(write, "path string, records long"), "archives")


def parse_records(stream, buffer: int = 1 << 20) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case name to values) and block of each record of a plain or gzip-by-member archive."""
    data, raw, unzip = bytearray(), b"", None
    zipped: bool | None = None

    def more() -> bool:
        nonlocal raw, unzip, zipped
        raw = raw or stream.read(buffer)
        if zipped is None:
            zipped = raw[:2] == b"\x1f\x8b"
        if not raw:
            return False
        if not zipped:
            data.extend(raw)
            raw = b""
            return True
        unzip = unzip or zlib.decompressobj(31)
        data.extend(unzip.decompress(raw))
        raw, unzip = unzip.unused_data if unzip.eof else b"", None if unzip.eof else unzip
        return True

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                if data.strip():
                    raise ValueError("archive ends inside a record's header")
                return
        lines = data[:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers: dict[str, list[str]] = {}
        for line in lines[1:]:
            k, _, v = line.partition(":")
            headers.setdefault(k.strip().lower(), []).append(v.strip())
        length = int(headers["content-length"][0])
        del data[: end + 4]
        while len(data) < length + 4:
            if not more():
                raise ValueError("archive ends inside a record's block")
        yield headers, bytes(data[:length])
        del data[: length + 4]


def read_records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives at ``path``. Payloads are read in full; with_payload=False leaves them out of the rows.

    Of response records length and digest are those of the payload as read, and must agree with the header.
    """

    def row(headers: dict[str, list[str]], block: bytes) -> dict:
        one = lambda k: headers.get(k, [None])[0]
        kind = one("warc-type")
        out = {
            "record_id": one("warc-record-id"), "record_type": kind, "concurrent_to": headers.get("warc-concurrent-to", []), "target_uri": one("warc-target-uri"),
            "page_id": None, "payload_bytes": None, "payload_digest": (one("warc-payload-digest") or "").removeprefix("sha1:") or None,
            "refers_to": one("warc-refers-to"), "content_type": one("content-type"), "payload": None,
        }
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            digest = _digest(payload)
            if out["payload_digest"] not in (None, digest):
                raise ValueError(f"{out['record_id']}: payload and digest differ")
            out |= {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload if with_payload else None}
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
            out |= {"page_id": _number(fields.get("page-id")), "payload_bytes": _number(fields.get("payload-length")), "refers_to": fields.get("refers-to-page-id")}
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for uri in b.column("path").to_pylist():
                files, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for headers, block in parse_records(stream):
                        rows.append(row(headers, block))
                        held += len(block) if with_payload else 0
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, RECORD_SCHEMA)


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id and structs request, response, metadata, with counts of the first and last.

    A response or revisit is a capture. Others belong to the capture that they name in concurrent-to
    or that names them; a record that names only another such record follows that one. Of several
    requests (or metadata records) the row has the one with the smallest id; ``unassembled`` gives the rest.
    """
    body = F.struct(*(c for c in records.columns if c != "concurrent_to"))
    main = F.col("record_type").isin("response", "revisit", "resource")
    captures = records.where(main).groupBy("record_id").agg(F.min(body).alias("response"))
    owned = _owners(records)
    pick = lambda kind: F.min(F.when(F.col("record_type") == kind, F.col("body")))
    sides = (
        records.where(~main).select("record_id", "record_type", body.alias("body")).join(owned, "record_id")
        .groupBy("capture_id")
        .agg(
            pick("request").alias("request"), pick("metadata").alias("metadata"),
            F.count(F.when(F.col("record_type") == "request", 1)).alias("n_requests"), F.count(F.when(F.col("record_type") == "metadata", 1)).alias("n_metadata"),
        )
    )
    none = F.lit(0).cast("long")
    return captures.join(sides, captures.record_id == sides.capture_id, "left").select(
        captures.record_id.alias("capture_id"), "request", "response", "metadata", F.coalesce("n_requests", none).alias("n_requests"), F.coalesce("n_metadata", none).alias("n_metadata")
    )


def _owners(records: DataFrame) -> DataFrame:
    """(record_id, capture_id) of requests and metadata records, through one concurrent-to link or two."""
    main = F.col("record_type").isin("response", "revisit", "resource")
    links = records.select("record_id", main.alias("is_main"), F.explode("concurrent_to").alias("to"))
    # both directions: the link's owner is the side, or the capture itself names its sides
    named = links.select(F.when(F.col("is_main"), F.col("to")).otherwise(F.col("record_id")).alias("record_id"), F.when(F.col("is_main"), F.col("record_id")).otherwise(F.col("to")).alias("near")).distinct()
    mains = records.where(main).select(F.col("record_id").alias("near"), F.lit(True).alias("hit")).distinct()
    known = named.join(mains, "near", "left")
    direct = known.where("hit").groupBy("record_id").agg(F.min("near").alias("capture_id"))
    through = known.where("hit is null").select("record_id", F.col("near").alias("_near")).join(direct.select(F.col("record_id").alias("_near"), "capture_id"), "_near").select("record_id", "capture_id")
    return direct.unionByName(through.join(direct.select("record_id"), "record_id", "left_anti").groupBy("record_id").agg(F.min("capture_id").alias("capture_id")))


def unassembled(records: DataFrame, captures: DataFrame) -> DataFrame:
    """Records that are in no nested row of ``captures``: without a capture, or beside another of their kind."""
    used = captures.select(F.explode(F.array("request.record_id", "response.record_id", "metadata.record_id")).alias("record_id")).where("record_id is not null")
    return records.join(used, "record_id", "left_anti")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back and assemble the captures."""
    records = read_records(write_archives(pages, scratch(pages.sparkSession, "warc")), with_payload=False)
    return assemble(staged(records, "records"))
