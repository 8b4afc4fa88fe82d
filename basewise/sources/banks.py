"""Banks: FASTA, FASTQ, packed Parquet, albums, and generated ones.

A bank is a DataFrame (seq_id, comment, seq, and quality where there is one). Plain and .gz FASTA are read by
Spark's own text source, split by record; ``ranges.read_pieces`` reads records too long for one row in pieces. FASTQ, files without a telling name, and zlib streams go
through the ``fastx`` data source, which tells gzip and zlib by their first bytes and reads such files, and FASTA, as a stream in one task; plain FASTQ files
of four lines a record are read by byte range, by several tasks each.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import bits, blocks, ranges

FASTX_SCHEMA = "seq_id long, comment string, seq string, quality string"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, comment and seq of FASTA files; lines are joined, carriage returns dropped, empty records left out.

    seq_id is unique and rises within a file, but is not a row number.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.col("value"), "\r", "")
    # the first record of a file keeps its leading sign
    record = F.regexp_replace(body, "^\\s*>", "")
    head = F.split_part(record, F.lit("\n"), F.lit(1))
    seq = F.regexp_replace(F.when(F.instr(record, F.lit("\n")) > 0, F.substr(record, F.length(head) + 2)).otherwise(F.lit("")), "\\s", "")
    return records.select(F.monotonically_increasing_id().alias("seq_id"), head.alias("comment"), seq.alias("seq")).where("comment != '' or seq != ''")


def _lines(uri: str) -> Iterator[str]:
    """Lines of a plain, gzip or zlib file, told apart by its first bytes."""
    source, _ = ranges.open_file(uri)
    rest = b""
    with source:
        chunks = ranges.chunks_of(source, 0)
        if ranges.is_zipped(source.read(2)):
            chunks = ranges.unzipped(chunks)
        for chunk in chunks:
            parts = (rest + chunk).split(b"\n")
            rest = parts.pop()
            yield from (p.rstrip(b"\r").decode("utf-8", "replace") for p in parts)
    if rest:
        yield rest.rstrip(b"\r").decode("utf-8", "replace")


def parse_fastx(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None]]:
    """(comment, sequence, quality) of FASTA and FASTQ records; quality is read to the sequence's length."""
    line = next(lines, None)
    while line is not None:
        if not line.strip():
            line = next(lines, None)
        elif line[0] == ">":
            comment, parts = line[1:], []
            while (line := next(lines, None)) is not None and line[:1] not in (">", "@"):
                parts.append(line.strip())
            yield comment, "".join(parts), None
        elif line[0] == "@":
            comment, parts = line[1:], []
            while (line := next(lines, None)) is not None and line[:1] != "+":
                parts.append(line.strip())
            seq, quality = "".join(parts), ""
            while len(quality) < len(seq):
                if (line := next(lines, None)) is None:
                    raise ValueError(f"the quality of {comment!r} ends early")
                quality += line.strip()
            yield comment, seq, quality
            line = next(lines, None)
        else:
            raise ValueError(f"a record must begin with > or @, not {line[:20]!r}")


def looks_like_fastx(uri: str) -> bool:
    """Whether a file begins, white space aside, with > or @ and a printable name."""
    text = next((x.lstrip() for x in _lines(uri) if x.strip()), "")[:256]
    return text[:1] in (">", "@") and len(text) > 1 and text[1].isprintable()


class _Range(InputPartition):
    """A file (end None), or the records of four lines that begin in a range of it."""

    def __init__(self, number: int, uri: str, start: int = 0, end: int | None = None) -> None:
        self.number, self.uri, self.start, self.end = number, uri, start, end


class _FastxReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split(",") if p]
        self.size = int(options.get("rangebytes") or options.get("rangeBytes") or ranges.RANGE)
        self.multiline = str(options.get("multiline", "false")).lower() == "true"
        if not self.paths:
            raise ValueError("fastx needs a path")

    def partitions(self):
        found = []
        for i, (uri, size) in enumerate(x for p in self.paths for x in ranges.files_below(p)):
            # only a file of several ranges is looked into
            cuts = range(0, size, self.size) if size > self.size and not self.multiline and _plain_fastq(uri) else ()
            found += [_Range(i, uri, at, min(at + self.size, size)) for at in cuts] or [_Range(i, uri)]
        return found

    def read(self, partition):
        if partition.end is None:
            for i, (comment, seq, quality) in enumerate(parse_fastx(_lines(partition.uri))):
                yield (partition.number << 42) + i, comment, seq, quality
            return
        with ranges.open_file(partition.uri)[0] as source:
            for at, comment, seq, quality in ranges.fastq_records(source, partition.start, partition.end):
                yield (partition.number << 42) + at, comment, seq, quality


def _plain_fastq(uri: str) -> bool:
    """Whether a file is not compressed and begins with a record of four lines."""
    with ranges.open_file(uri)[0] as source:
        if ranges.is_zipped(source.read(2)):
            return False
        lines = (x for _, x in ranges.lines_from(source, 0))
        first = next((x for x in lines if x.strip()), b"")
        return first[:1] == b"@" and next(lines, None) is not None and (next(lines, None) or b"")[:1] == b"+"


class FastxDataSource(DataSource):
    """``spark.read.format("fastx")``: FASTA and FASTQ files, plain or compressed.

    Options: paths, files or folders with commas between; rangeBytes, of which larger plain FASTQ files are read in several tasks; multiline, for
    FASTQ files whose records have more than four lines, each then read by one task. seq_id rises within a file, but is not a row number.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return FASTX_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FastxReader(self.options)


def read_fastx(spark: SparkSession, *paths: str, range_bytes: int = ranges.RANGE, multiline: bool = False) -> DataFrame:
    spark.dataSource.register(FastxDataSource)
    return spark.read.format("fastx").option("paths", ",".join(paths)).option("rangeBytes", range_bytes).option("multiline", multiline).load()


def from_strings(spark: SparkSession, seqs: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")


def to_packed(seqs: DataFrame, min_length: int = 1) -> DataFrame:
    """A bank in two bits per base: pieces between other letters, those shorter than min_length dropped."""
    others = [c for c in seqs.columns if c != "seq"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, number, size, data in bits.pieces(b.column("seq"), min_length):
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in others), pa.array(number.astype(np.int32)), pa.array(size.astype(np.int32)), data], [*others, "piece", "n_bases", "packed"])

    kinds = [f"`{c}` {seqs.schema[c].dataType.simpleString()}" for c in others]
    return seqs.select(*others, "seq").mapInArrow(cut, ", ".join([*kinds, "piece int, n_bases int, packed binary"]))


def from_packed(packed: DataFrame) -> DataFrame:
    others = [c for c in packed.columns if c not in ("n_bases", "packed")]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = bits.binaries(b.column("packed"))
            n = np.minimum(pc.fill_null(b.column("n_bases"), 0).to_numpy(zero_copy_only=False).astype(np.int64), 4 * np.diff(at))
            for i, j in bits.slices(n):
                here = b.slice(i, j - i)
                seqs = pc.if_else(pc.is_valid(here.column("packed")), bits.unpacked(data, at[i:j], n[i:j]), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*(here.column(c) for c in others), seqs], [*others, "seq"])

    kinds = [f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in others]
    return packed.select(*others, "n_bases", "packed").mapInArrow(spell, ", ".join([*kinds, "seq string"]))


def combine(banks: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """Several banks in one table, in order, each row with its bank_id."""
    names = names or [str(i) for i in range(len(banks))]
    every = [b.withColumn("bank_id", F.lit(n)) for b, n in zip(banks, names, strict=True)]
    out = every[0]
    for b in every[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def _members(lines: Iterator[str], path: str) -> list[str]:
    named = (x.strip() for x in lines)
    return [x if x.startswith("/") or "://" in x else posixpath.join(posixpath.dirname(path), x) for x in named if x and not x.startswith("#")]


def album_members(spark: SparkSession, path: str) -> list[str]:
    """The files that an album lists, one a line; relative names are beside the album."""
    return _members((r.value for r in spark.read.text(path).collect()), path)


#: Bytes within which a file must tell that it is an album: a list of files that exist.
ALBUM_BYTES = 1 << 20


def sniff(uri: str) -> str:
    """What a file is by its contents: album, fasta, fastx (FASTQ, or FASTA that only ``fastx`` can open), packed or parquet, tried in this order. A folder is what its first file is."""
    files = ranges.files_below(uri)
    if not files:
        raise ValueError(f"{uri} is empty")
    first, size = files[0]
    with ranges.open_file(first)[0] as source:
        head = source.read(min(size, ALBUM_BYTES))
    zipped = ranges.is_zipped(head)
    if not zipped and size <= ALBUM_BYTES and b"\0" not in head and head.strip():
        members = _members(iter(head.decode("utf-8", "replace").splitlines()), first)
        if members and all(_exists(m) for m in members):
            return "album"
    if looks_like_fastx(first):
        letter = next(x.lstrip() for x in _lines(first) if x.strip())[:1]
        return "fasta" if letter == ">" and (not zipped or first.endswith(".gz")) else "fastx"
    if head.startswith(blocks.MAGIC):
        return "packed"
    if head.startswith(b"PAR1"):
        return "parquet"
    raise ValueError(f"{uri} is no bank")


def _exists(uri: str) -> bool:
    try:
        return bool(ranges.files_below(uri))
    except (FileNotFoundError, ValueError, OSError):
        return False


def read_bank(spark: SparkSession, uri: str, kind: str | None = None) -> DataFrame:
    """A bank: comma-separated members, or what ``sniff`` tells from the contents; ``kind`` says it beforehand."""
    kind = kind or ("list" if "," in uri else sniff(uri))
    if kind in ("list", "album"):
        members = uri.split(",") if kind == "list" else album_members(spark, uri)
        return combine([read_bank(spark, m) for m in members], members)
    if kind == "parquet":
        table = spark.read.parquet(uri)
        return from_packed(table) if "packed" in table.columns else table
    if kind == "packed":
        return blocks.read_blocks(spark, uri)
    return read_fasta(spark, uri) if kind == "fasta" else read_fastx(spark, uri)


#: Bytes of each file that an estimate reads.
HEAD = 1 << 20


def estimate_files(spark: SparkSession, path: str, head: int = HEAD) -> DataFrame:
    """n_seqs, bases, longest (of those read) and bytes_read of the FASTA and FASTQ files at ``path``, from the first ``head`` bytes of each.

    What a head holds in whole records is carried on by the bytes that they take to the file's size, compressed or not. A file that is no longer than ``head`` is exact;
    otherwise the error is that of taking a file's first records for all of them.
    """
    files = spark.createDataFrame([x for p in path.split(",") for x in ranges.files_below(p)], "file string, size long")
    tasks = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for uri, size in zip(f["file"], f["size"].tolist(), strict=True):
                yield pd.DataFrame([_estimate(uri, size, head)], columns=["n_seqs", "bases", "longest", "bytes_read"])

    each = files.repartition(tasks).mapInPandas(look, "n_seqs double, bases double, longest long, bytes_read long")
    return each.agg(F.round(F.sum("n_seqs")).cast("long").alias("n_seqs"), F.round(F.sum("bases")).cast("long").alias("bases"), F.max("longest").alias("longest"), F.sum("bytes_read").alias("bytes_read"))


def _estimate(uri: str, size: int, head: int) -> tuple[float, float, int, int]:
    with ranges.open_file(uri)[0] as source:
        raw = source.read(min(size, head))
    whole, data = len(raw) == size, raw
    if ranges.is_zipped(raw):
        data = b"".join(ranges.unzipped(iter([raw])))
    lines = data.split(b"\n")
    if not whole and (lines[0][:1] != b">" or lines[-1][:1] in (b"", b">")):
        lines.pop()  # it may be cut; bases count as far as they go
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
    seen, lengths, ends = 0, [], []

    def counted() -> Iterator[str]:
        nonlocal seen
        for x in lines:
            seen += 1
            yield x.rstrip(b"\r").decode("utf-8", "replace")

    try:
        for _, seq, quality in parse_fastx(counted()):
            lengths.append(len(seq))
            ends.append(seen if quality is not None else seen - 1)  # a FASTA record ends where the next header is seen
    except ValueError:  # a record whose qualities go on behind the head
        if whole:
            raise
    scale = 1.0 if whole else size / len(raw)
    if not whole and ends and seen < len(lines):
        scale *= len(data) / starts[ends[-1]]
    elif not whole and len(lengths) > 1:
        lengths.pop()  # it may go on behind the head
        ends.pop()
        scale *= len(data) / starts[ends[-1]]
    return len(lengths) * scale, sum(lengths) * scale, max(lengths, default=0), len(raw)


def filter_bank(bank: DataFrame, condition) -> DataFrame:
    return bank.where(condition)
