"""Large files by byte range: FASTA records in pieces that know their place, and the cuts of FASTQ files.

A range of a FASTA file may begin anywhere: inside a header, inside a line of bases, at a line's start. What a range holds is therefore read
twice. The first pass gives one row per range: how many bases it has before its first header and behind its last, and what kind of line it ends in. Windows over these
few rows tell each range which record it continues and how many bases of that stand before. The second pass emits pieces of ``piece`` bases, each
with ``overlap`` bases more of the record, read on beyond the range where they are; no record is ever held whole, also not one on a single line.

Compressed files cannot be entered in the middle: each is one range, and gives the same pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range, of one read, and bases of a piece.
RANGE, READ, PIECE = 64 << 20, 1 << 20, 1 << 20
#: White space is no base.
BLANK = b" \t\r\n\x0b\x0c"
BODY, HEADER, NAME, END = range(4)


def open_file(uri: str):
    """A file for random access, and its size in bytes."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return files.open_input_file(path), files.get_file_info(path).size


def files_below(path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of a file, or of all files in a folder but hidden ones."""
    from pyarrow import fs

    files, own = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = files.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(own)] if path.endswith(own) else path.split("://")[0] + "://" if "://" in path else ""
    found = [x for x in files.get_file_info(fs.FileSelector(own, recursive=True)) if x.type == fs.FileType.File and not re.search(r"/[._][^/]*$", x.path)]
    return sorted((prefix + x.path, x.size) for x in found)


def is_zipped(head: bytes) -> bool:
    """Whether a file begins as gzip or zlib data do."""
    return head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0)


def unzipped(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of gzip members or zlib streams, one after another."""
    unzip = None
    for raw in chunks:
        while raw:
            unzip = unzip or zlib.decompressobj(47)  # gzip or zlib
            yield unzip.decompress(raw)
            raw, unzip = (unzip.unused_data, None) if unzip.eof else (b"", unzip)


def chunks_of(source, at: int, to: int | None = None) -> Iterator[bytes]:
    """Bytes from ``at`` to ``to`` (None: the end), some at a time."""
    source.seek(at)
    while to is None or at < to:
        chunk = source.read(READ if to is None else min(READ, to - at))
        if not chunk:
            return
        at += len(chunk)
        yield chunk


class Scanner:
    """Cuts FASTA bytes into events: (BODY, bases), (HEADER, its offset), (NAME, part of a comment), (END, None)."""

    def __init__(self, at: int, line_start: bool, in_header: bool) -> None:
        self.at, self.line_start, self.in_header = at, line_start, in_header

    def feed(self, data: bytes) -> Iterator[tuple[int, object]]:
        p, n = 0, len(data)
        while p < n:
            if self.in_header:
                stop = data.find(b"\n", p)
                yield NAME, data[p:] if stop < 0 else data[p:stop]
                if stop < 0:
                    self.line_start, p = False, n
                else:
                    self.line_start, self.in_header, p = True, False, stop + 1
                    yield END, None
            elif self.line_start and data[p : p + 1] == b">":
                yield HEADER, self.at + p
                self.in_header, self.line_start, p = True, False, p + 1
            else:
                stop = data.find(b"\n>", p)
                body = data[p:] if stop < 0 else data[p : stop + 1]
                yield BODY, body.translate(None, BLANK)
                self.line_start, p = body.endswith(b"\n"), p + len(body)
        self.at += n


def _survey(uri: str, start: int, end: int) -> dict:
    """What the first pass says of a range; see ``read_pieces``."""
    source, size = open_file(uri)
    with source:
        whole = start == 0 and is_zipped(source.read(2))
        chunks = unzipped(chunks_of(source, 0)) if whole else chunks_of(source, max(0, start - 1), min(end, size))
        row = {"file": uri, "start": start, "end": end, "line_start": start == 0, "zipped": whole, "fragment": 0, "before": 0, "headers": 0, "record": None, "comment": None, "behind": 0, "ends_in": None}
        scanner, name = Scanner(0, True, False) if start == 0 else None, bytearray()

        def take(event: int, value) -> None:
            if event == BODY:
                row["behind" if row["headers"] else "before"] += len(value)
            elif event == HEADER:
                row.update(headers=row["headers"] + 1, record=value, behind=0)
                name.clear()
            elif event == NAME:
                name.extend(value)

        at = max(0, start - 1)
        for k, chunk in enumerate(chunks):
            if k == 0 and start:
                row["line_start"], chunk, at = chunk[:1] == b"\n", chunk[1:], at + 1
                scanner = Scanner(at, True, False) if row["line_start"] else None
            if scanner is None:  # still in the line that the range began in
                stop = chunk.find(b"\n")
                row["fragment"] += len((chunk if stop < 0 else chunk[:stop]).translate(None, BLANK))
                if stop >= 0:
                    scanner = Scanner(at + stop + 1, True, False)
                    for e in scanner.feed(chunk[stop + 1 :]):
                        take(*e)
            else:
                for e in scanner.feed(chunk):
                    take(*e)
            at += len(chunk)
        if scanner is not None:
            row["ends_in"] = "header" if scanner.in_header else "bases"
            if scanner.in_header and not whole:  # a comment is read to its end
                for chunk in chunks_of(source, at):
                    stop = chunk.find(b"\n")
                    name.extend(chunk if stop < 0 else chunk[:stop])
                    if stop >= 0:
                        break
        if row["headers"]:
            row["comment"] = name.rstrip(b"\r").decode("utf-8", "replace")
        return row


def _pieces(uri: str, start: int, end: int, zipped: bool, line_start: bool, in_header: bool, record: int | None, comment: str | None, at: int, piece: int, overlap: int) -> Iterator[tuple]:
    """(record, comment, at, own, seq) of a range."""
    source, size = open_file(uri)
    with source:
        scanner, name, held = Scanner(0 if zipped else start, line_start, in_header), bytearray(), bytearray()

        def full(least: int) -> Iterator[tuple]:
            nonlocal at
            while record is not None and len(held) >= least:
                own = min(piece, len(held))
                yield record, comment, at, own, held[: own + overlap].decode("ascii", "replace")
                del held[:own]
                at += own

        own_chunks = unzipped(chunks_of(source, 0)) if zipped else chunks_of(source, start, min(end, size))
        for chunk in own_chunks:
            for event, value in scanner.feed(chunk):
                if event == BODY:
                    if record is not None:  # what stands before the first header is no record
                        held += value
                        yield from full(piece + overlap)
                elif event == HEADER:
                    yield from full(1)
                    record, comment, at = value, None, 0
                    name.clear()
                elif event == NAME:
                    name += value
                elif comment is None:
                    comment = name.rstrip(b"\r").decode("utf-8", "replace")
        # the range's own bases are complete; what follows is only overlap
        own, done = len(held), zipped or record is None or not len(held)
        if not done:
            for chunk in chunks_of(source, scanner.at):
                for event, value in scanner.feed(chunk):
                    if event == HEADER:
                        done = True
                        break
                    if event == BODY:
                        held += value
                if done or len(held) >= own + overlap:
                    break
        while own > 0:
            size = min(piece, own)
            yield record, comment, at, size, held[: size + overlap].decode("ascii", "replace")
            del held[:size]
            at, own = at + size, own - size


def read_pieces(spark: SparkSession, path: str, overlap: int = 0, range_bytes: int = RANGE, piece: int = PIECE) -> DataFrame:
    """file, record (the byte at which its header begins, in the unzipped file), comment, at (its first base's place in the record), own and seq of FASTA pieces.

    A piece's first ``own`` bases are its own, up to ``overlap`` more are the next piece's, so with an overlap of k - 1 each k-mer of a record lies in exactly one piece. An empty record has no piece.
    Bases before a file's first header are left out. path: a file, a folder, or several with commas between.
    """
    if overlap < 0 or piece < 1 or range_bytes < 2:
        raise ValueError("overlap must be 0 at least, piece 1, and range_bytes 2")
    found = [x for p in path.split(",") for x in files_below(p)]
    files = spark.createDataFrame(found, "file string, size long")
    ranges = files.where("size > 0").select("file", "size", F.explode(F.expr(f"sequence(0L, size - 1, {int(range_bytes)}L)")).alias("start")).withColumn("end", F.least(F.col("start") + int(range_bytes), "size"))
    tasks = max(1, min(sum(-(-n // int(range_bytes)) for _, n in found), 4 * spark.sparkContext.defaultParallelism, 100_000))
    dealt = lambda df: df.repartition(tasks, F.xxhash64("file", "start"))
    fields = "file string, start long, end long, line_start boolean, zipped boolean, fragment long, before long, headers long, record long, comment string, behind long, ends_in string"

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zipped: dict[str, bool] = {}
            for uri, start, end in zip(*(b.column(c).to_pylist() for c in ("file", "start", "end")), strict=True):
                if start and uri not in zipped:
                    with open_file(uri)[0] as source:
                        zipped[uri] = is_zipped(source.read(2))
                if not zipped.get(uri):  # a compressed file is one range, its first
                    yield pa.RecordBatch.from_pylist([_survey(uri, start, end)], schema=known)

    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    known = pa.schema([(f.split()[0], types[f.split()[1]]) for f in fields.split(", ")])
    # one row per range from here on, a few dozen bytes each
    order = Window.partitionBy("file").orderBy("start")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt(ranges).mapInArrow(survey, fields)
    rows = rows.withColumn("in_header", ~F.col("line_start") & (F.coalesce(F.last("ends_in", True).over(past), F.lit("bases")) == "header"))
    rows = rows.withColumn("leading", F.col("before") + F.when(F.col("in_header"), 0).otherwise(F.col("fragment")))
    rows = rows.withColumn("part", F.coalesce(F.sum("headers").over(past), F.lit(0)))
    # a range adds all its leading bases to the record that goes on, or what stands behind its last header to a new one
    last = lambda c: F.last(F.when(F.col("headers") > 0, F.col(c)), True).over(past)
    rows = rows.withColumn("from_record", last("record")).withColumn("from_comment", last("comment")).withColumn("from_behind", F.coalesce(last("behind"), F.lit(0)))
    since = Window.partitionBy("file", "part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # in a group of ranges that continue one record all but the first have only leading bases, and so has the first
    rows = rows.withColumn("from_at", F.col("from_behind") + F.coalesce(F.sum("leading").over(since), F.lit(0)))
    plan = rows.select("file", "start", "end", "zipped", "line_start", "in_header", "from_record", "from_comment", "from_at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                some, size = [], 0
                for p in _pieces(r["file"], r["start"], r["end"], r["zipped"], r["line_start"], r["in_header"], r["from_record"], r["from_comment"], r["from_at"], piece, overlap):
                    some.append((r["file"], *p))
                    size += len(p[-1])
                    if size > 8 << 20 or len(some) > 10_000:
                        yield _batch(some)
                        some, size = [], 0
                if some:
                    yield _batch(some)

    return dealt(plan).mapInArrow(cut, "file string, record long, comment string, at long, own long, seq string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "record", "comment", "at", "own", "seq"])


def lines_from(source, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of all lines from one that begins at ``at``."""
    rest = []
    for chunk in chunks_of(source, at):
        parts = chunk.split(b"\n")
        for part in parts[:-1]:
            line = b"".join([*rest, part])
            yield at, line.rstrip(b"\r")
            at, rest = at + len(line) + 1, []
        if parts[-1]:
            rest.append(parts[-1])
    if rest:
        yield at, b"".join(rest).rstrip(b"\r")


def next_line(source, start: int) -> int | None:
    """Where the first line at or behind ``start`` begins; None if there is none."""
    if start == 0:
        return 0
    at = start - 1
    for chunk in chunks_of(source, at):
        stop = chunk.find(b"\n")
        if stop >= 0:
            return at + stop + 1
        at += len(chunk)
    return None


def fastq_records(source, start: int, end: int) -> Iterator[tuple[int, str, str, str]]:
    """(offset, comment, sequence, quality) of the records of four lines whose header begins in start..end.

    A line that begins with @ is a header if the line after the next begins with +. Were it a line of qualities, the next one would be a header and the one
    after that a sequence, which never begins so.
    """
    at = next_line(source, start)
    if at is None or at >= end:
        return
    lines, ahead = lines_from(source, at), []

    def peek(i: int) -> bytes | None:
        while len(ahead) <= i:
            line = next(lines, None)
            if line is None:
                return None
            ahead.append(line)
        return ahead[i][1]

    if start:
        while (line := peek(0)) is not None and not (line[:1] == b"@" and (peek(2) or b"")[:1] == b"+"):
            del ahead[0]
            if len(ahead) and ahead[0][0] >= end:
                return
    while peek(0) is not None:
        if not ahead[0][1].strip():
            del ahead[0]
            continue
        offset = ahead[0][0]
        if offset >= end:
            return
        header, seq, plus, quality = (peek(i) for i in range(4))
        # the quality of an empty sequence may be missing at a file's end
        quality = b"" if quality is None and seq == b"" else quality
        if header[:1] != b"@" or (plus or b"")[:1] != b"+" or quality is None or len(quality) != len(seq):
            raise ValueError(f"at byte {offset}: not a record of four lines, with a quality for each base; read with multiline")
        yield offset, header[1:].decode("utf-8", "replace"), seq.decode("ascii", "replace"), quality.decode("latin-1")
        del ahead[:4]
