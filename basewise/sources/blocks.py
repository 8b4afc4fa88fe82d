"""Packed bank files: blocks of sequences in two bits per base.

A file is a magic number and blocks; a block is its size in bytes and its sequences; a sequence is its length in bases and, four to a byte and the first one
highest, its bases. Sizes and lengths have four bytes, little-endian.

Each task writes one file, block by block, and only files of tasks that succeeded get their final names. A block is found through the sizes of those before it, so one task lists
the blocks of a file, by their sizes alone, and the blocks are then dealt to tasks.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bits
from .ranges import files_below, open_file

# Fixed value: the number that a file begins with, in eight bytes, little-endian.
MAGIC = struct.pack("<Q", 0x12345678)
#: Bytes from which on a block is written out.
BLOCK = 4 << 20


def is_packed(uri: str) -> bool:
    source, _ = open_file(uri)
    with source:
        return source.read(len(MAGIC)) == MAGIC


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_blocks(seqs: DataFrame, folder: str, min_length: int = 1, block: int = BLOCK) -> DataFrame:
    """Write a bank as packed files, and return a row for each: path, n_seqs and bases. Sequences are cut at other letters than bases, and pieces shorter than ``min_length`` left out.

    The folder must not exist yet.
    """
    from .banks import to_packed
    from ..plans.scratch import scratch

    spark = seqs.sparkSession
    files, at = _filesystem(folder)
    if files.get_file_info(at).type.name != "NotFound":
        raise FileExistsError(folder)
    files.create_dir(at, recursive=True)
    unfinished = f"{folder.rstrip('/')}/_unfinished"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, bases, held, size = None, 0, 0, [], 0  # held: parts of the block at hand
        fs_, base = _filesystem(unfinished)
        path = f"{base}/{uuid.uuid4().hex}"

        def emit() -> None:
            data = b"".join(held)
            out.write(struct.pack("<I", len(data)) + data)

        for b in batches:
            data, at = bits.binaries(b.column("packed"))
            lengths = b.column("n_bases").to_numpy()
            if out is None and len(lengths):
                fs_.create_dir(base, recursive=True)
                out = fs_.open_output_stream(path)
                out.write(MAGIC)
            n, bases = n + len(lengths), bases + int(lengths.sum(dtype=np.int64))
            for i, j in bits.slices(lengths):
                run, ends = _laid_out(data, at[i : j + 1], lengths[i:j])
                done = 0
                while len(run) > done:  # a block ends with the sequence that brings its bytes to ``block``
                    last = int(np.searchsorted(ends, done + max(1, block - size)))
                    to = int(ends[min(last, len(ends) - 1)])
                    held.append(run[done:to])
                    size += to - done
                    if size >= block:
                        emit()
                        held, size = [], 0
                    done = to
        if out is not None:
            if held:
                emit()
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": path, "n_seqs": n, "bases": bases}])

    manifest = scratch(spark, "packed-files")
    to_packed(seqs.select("seq"), min_length).select("n_bases", "packed").mapInArrow(write, "name string, n_seqs long, bases long").write.parquet(manifest)
    rows = []
    for i, r in enumerate(spark.read.parquet(manifest).collect()):  # one row per task
        files.move(r["name"], f"{at}/part-{i:05}.bin")
        rows.append((f"{folder.rstrip('/')}/part-{i:05}.bin", r["n_seqs"], r["bases"]))
    if files.get_file_info(f"{at}/_unfinished").type.name != "NotFound":
        files.delete_dir(f"{at}/_unfinished")
    return spark.createDataFrame(rows, "path string, n_seqs long, bases long")


def block_places(uri: str) -> Iterator[tuple[int, int]]:
    """Where each block's sequences begin, and their bytes."""
    source, size = open_file(uri)
    with source:
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no packed bank")
        at = len(MAGIC)
        while at < size:
            source.seek(at)
            (n,) = struct.unpack("<I", source.read(4))
            if at + 4 + n > size:
                raise ValueError(f"{uri} ends inside a block")
            yield at + 4, n
            at += 4 + n


def _laid_out(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Sequences as they stand in a block, and where each ends there."""
    wide = np.diff(at)
    ends = np.cumsum(wide + 4)
    out = np.empty(ends[-1], np.uint8)
    first = ends - wide
    out[first[:, None] + np.arange(-4, 0)] = lengths.astype("<i4").view(np.uint8).reshape(-1, 4)
    out[bits.places(first, wide)] = data[at[0] : at[-1]]
    return out.tobytes(), ends


def sequences_of(data: bytes) -> Iterator[pa.Array]:
    """The sequences of a block, some at a time."""
    at, found, lengths = 0, [], []
    while at < len(data):
        (n,) = struct.unpack_from("<i", data, at)
        found.append(at + 4)
        lengths.append(n)
        at += 4 - (-n // 4)
    start, n, codes = np.array(found, np.int64), np.array(lengths, np.int64), np.frombuffer(data, np.uint8)
    for i, j in bits.slices(n):
        yield bits.unpacked(codes, start[i:j], n[i:j])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, seq_id (its block's place and its number there, unique and rising in a file, as a sequence has more bytes than one) and seq of packed files."""
    found = [uri for p in path.split(",") for uri, _ in files_below(p)]
    wide = max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism))
    files = spark.createDataFrame([(u,) for u in found], "file string").repartition(wide)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("file").to_pylist():
                some = list(block_places(uri))  # two numbers a block
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(some), pa.string()), pa.array([x for x, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())], ["file", "at", "size"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, source = None, None
        try:
            for b in batches:
                for uri, at, size in zip(*(b.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
                    if uri != last:  # blocks come file by file
                        if source is not None:
                            source.close()
                        last, source = uri, open_file(uri)[0]
                    source.seek(at)
                    number = at
                    for seqs in sequences_of(source.read(size)):
                        yield pa.RecordBatch.from_arrays([pa.array([uri] * len(seqs), pa.string()), pa.array(range(number, number + len(seqs)), pa.int64()), seqs], ["file", "seq_id", "seq"])
                        number += len(seqs)
        finally:
            if source is not None:
                source.close()

    listed = files.mapInArrow(places, "file string, at long, size long")
    return listed.repartition(4 * spark.sparkContext.defaultParallelism, F.xxhash64("file", "at")).sortWithinPartitions("file", "at").mapInArrow(decode, "file string, seq_id long, seq string")
