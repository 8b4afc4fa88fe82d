"""Token ids as Arrow files of equal-length sequences.

Documents are encoded in ascending doc_id order, an end id after each, and the stream of ids is cut
into rows of ``length`` ids. A file is an Arrow IPC file of record batches with three fixed-size-list
columns: ``ids`` (uint16 where the vocabulary allows, else uint32), ``mask`` (bool: a token, not
padding) and ``ends`` (bool: the last id of a document). Nothing is compressed, so a memory map gives
any row without a copy, by (row div rows per batch, row mod rows per batch). Only a file's last row is padded.
Beside each file stands an index file with doc_id and n_tokens of its documents. A task rolls its files by their number of ids and of documents.

Files are written by tasks under names of their own attempt; a file counts only if the manifest,
committed by Spark's writer, names it. A retried or speculative task so leaves unnamed files at worst.

Defined cases: a null text is empty and yields its end id alone. Rows that repeat a doc_id follow
one another in the order of their texts; a null doc_id comes first. An empty table gives no rows.
Only doc_id and text are read; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, staged
from .encoding import encoded, vocabulary_path

LENGTH = 2048
#: Rows of a record batch.
ROWS = 128
#: Ids, and documents, after which a file ends, at the end of a document.
FILE_TOKENS, FILE_DOCS = 1 << 27, 1 << 20


def _schema(length: int, wide: bool) -> pa.Schema:
    kinds = {"ids": pa.uint32() if wide else pa.uint16(), "mask": pa.bool_(), "ends": pa.bool_()}
    return pa.schema([pa.field(k, pa.list_(pa.field("item", v, nullable=False), length), nullable=False) for k, v in kinds.items()])


def _file(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Rows of one file, batch by batch."""

    def __init__(self, sink: pa.NativeFile, length: int, wide: bool) -> None:
        self.length, self.dtype, self.schema = length, np.uint32 if wide else np.uint16, _schema(length, wide)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.rows = 0

    def add(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= self.length * ROWS:
            self.flush(self.length * ROWS)

    def flush(self, step: int) -> None:
        """Write what is held in batches of ``step`` ids, keeping the rest; the top bit marks a document's end."""
        held = np.concatenate(self.ids) if self.ids else np.empty(0, np.uint32)
        whole = len(held) // step * step
        for at in range(0, whole, step):
            self.batch(held[at : at + step], step)
        self.ids, self.held = [held[whole:]], len(held) - whole

    def batch(self, held: np.ndarray, padded: int) -> None:
        ids = np.zeros(padded, np.uint32)
        ids[: len(held)] = held
        ends = ids >> 31 == 1
        columns = [pa.array((ids & 0x7FFFFFFF).astype(self.dtype)), pa.array(np.arange(padded) < len(held)), pa.array(ends)]
        lists = [pa.FixedSizeListArray.from_arrays(c, type=f.type) for c, f in zip(columns, self.schema, strict=True)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.rows += padded // self.length

    def close(self) -> None:
        self.flush(self.length * ROWS)
        if self.held:
            self.batch(self.ids[0], -(-self.held // self.length) * self.length)
        self.out.close()


def write_sequences(docs: DataFrame, folder: str, length: int = LENGTH, vocabulary: str | None = None, file_tokens: int = FILE_TOKENS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write the files and return their manifest: path, part, number, n_rows, n_docs, n_tokens (one row per file).

    A task begins another file once one has ``file_tokens`` ids or ``file_docs`` documents; the order of the files is that of (part, number).
    """
    vocabulary = vocabulary or vocabulary_path()
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, current, held = TaskContext.get().partitionId(), 0, None, 0  # held: ids of the file at hand
        wide = _vocabulary_size(vocabulary) > 1 << 16
        for b in batches:
            counts = []  # of the rows from `first` on, which are not yet in an index
            first = 0
            for k, raw in enumerate(encoded(vocabulary, b.column("text").to_pylist())):
                current = current or _File(folder, length, wide)
                ids = np.frombuffer(raw, "<u4").copy()
                counts.append(len(ids))
                held += len(ids)
                ids[-1] |= 1 << 31
                current.out.add(ids)
                if held >= file_tokens or current.n_docs + len(counts) >= file_docs:
                    current.index(b.column("doc_id").slice(first, len(counts)), counts)
                    yield current.close(part, number)
                    current, number, first, counts, held = None, number + 1, k + 1, [], 0
            if counts:
                current.index(b.column("doc_id").slice(first, len(counts)), counts)
        if current:
            yield current.close(part, number)

    return staged(ordered.mapInArrow(write, "path string, part long, number long, n_rows long, n_docs long, n_tokens long"), "manifest")


class _File:
    """A file of sequences and its index, under a name of their own."""

    def __init__(self, folder: str, length: int, wide: bool) -> None:
        self.path, self.n_docs, self.n_tokens, self.rows = f"{folder}/part-{uuid.uuid4().hex}", 0, 0, None
        files, at = _file(self.path)
        files.create_dir(at.rpartition("/")[0], recursive=True)
        self.sink, self.side = files.open_output_stream(f"{at}.arrow"), files.open_output_stream(f"{at}.index.arrow")
        self.out = _Writer(self.sink, length, wide)

    def index(self, ids: pa.Array, counts: list[int]) -> None:
        rows = pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])
        self.rows = self.rows or pa.ipc.new_file(self.side, rows.schema)
        self.rows.write_batch(rows)
        self.n_docs, self.n_tokens = self.n_docs + len(counts), self.n_tokens + sum(counts)

    def close(self, part: int, number: int) -> pa.RecordBatch:
        self.out.close()
        self.rows.close()
        self.sink.close()
        self.side.close()
        return pa.RecordBatch.from_pylist([{"path": self.path, "part": part, "number": number, "n_rows": self.out.rows, "n_docs": self.n_docs, "n_tokens": self.n_tokens}])


def _vocabulary_size(vocabulary: str) -> int:
    from .encoding import encoder

    return encoder(vocabulary).tokenizer.get_vocab_size()


def _chunks(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and end marks of a file without padding, batch by batch."""
    files, at = _file(f"{path}.arrow")
    with files.open_input_file(at) as source:
        reader = pa.ipc.open_file(source)
        for k in range(reader.num_record_batches):
            b = reader.get_batch(k)
            mask = b.column("mask").flatten().to_numpy(zero_copy_only=False)
            n = int(mask.sum())  # padding stands at the end only
            yield b.column("ids").flatten().to_numpy()[:n], np.flatnonzero(b.column("ends").flatten().to_numpy(zero_copy_only=False)[:n])


def read_documents(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id (of type ``kind``), start, n_tokens and ids_crc32 of every document, from the files that the manifest names."""
    before = F.sum("n_tokens").over(Window.orderBy("part", "number")) - F.col("n_tokens")  # one row per file
    # one file to a task, as far as hashing deals them evenly
    todo = manifest.select("path", before.alias("before")).repartition(max(1, manifest.count()), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                files, at = _file(f"{path}.index.arrow")
                with files.open_input_file(at) as source:
                    index = pa.ipc.open_file(source).read_all()
                sizes, crcs = _document_sums(path)
                if sizes != index.column("n_tokens").to_pylist():
                    raise ValueError(f"{path}: end marks and index disagree")
                starts = start + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                for k in range(0, len(sizes), 10_000):
                    s = slice(k, k + 10_000)
                    ids = index.column("doc_id").slice(k, 10_000).combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts[s]), pa.array(sizes[s], pa.int64()), pa.array(crcs[s], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _document_sums(path: str) -> tuple[list[int], list[int]]:
    """Token count and CRC of each document; one that crosses batches is summed piece by piece."""
    sizes, crcs, crc, size = [], [], 0, 0
    for ids, ends in _chunks(path):
        raw, at = ids.astype("<u4").tobytes(), 0
        for end in (ends + 1).tolist():
            sizes.append(size + end - at)
            crcs.append(zlib.crc32(raw[4 * at : 4 * end], crc))
            crc, size, at = 0, 0, end
        crc, size = zlib.crc32(raw[4 * at :], crc), size + len(ids) - at
    return sizes, crcs


class SequenceFile:
    """Random access to one file: row ``i`` as views of the memory map, without copies."""

    def __init__(self, path: str) -> None:
        self.source = pa.memory_map(path.removeprefix("file://"))
        self.reader = pa.ipc.open_file(self.source)
        self.per_batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.per_batch + self.reader.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
        b = self.reader.get_batch(i // self.per_batch)
        ids, mask, ends = (b.column(k)[i % self.per_batch].values for k in range(3))
        return ids.to_numpy(zero_copy_only=True), mask, ends


def arrow_sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """Write all documents to new files in the shared folder and read them back."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read_documents(write_sequences(docs, scratch(docs.sparkSession, "sequences"), length, vocabulary), kind)
