"""Count processors: user code that sees every k-mer's counts once, partition by partition.

A processor is a prototype. Each task works on a copy of it: ``begin_part``, then ``process`` for some thousand k-mers at a time, then ``end_part``, whose rows are
the copy's result. ``finish`` merges the rows of all copies, as a DataFrame. Processors stand in a chain: each sees the k-mers that the ones
before it let pass. The counts are read once for the whole chain, and the copies' rows are written once.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .scratch import scratch


class CountProcessor:
    """The base: lets all pass and returns nothing. ``schema`` describes the rows of ``process_rows`` and ``end_part``."""

    schema = "n long"

    def begin_part(self, part: int) -> None:
        """Called on a copy before its first k-mers."""

    def process(self, rows: pd.DataFrame) -> np.ndarray | None:
        """Which rows (kmer, counts, total) pass, as booleans; None: all."""

    def rows(self) -> pd.DataFrame | None:
        """What the copy has to hand on by now; called after each ``process``."""

    def end_part(self, part: int) -> pd.DataFrame | None:
        """Called on a copy after its last k-mers: what it has left to hand on."""

    def finish(self, parts: DataFrame) -> DataFrame:
        """The result, from the rows of all copies."""
        return parts


class HistogramProcessor(CountProcessor):
    """count and n_kmers, the last bin for all larger counts."""

    schema = "count long, n_kmers long"

    def __init__(self, length: int = 10_000) -> None:
        self.length = length

    def begin_part(self, part: int) -> None:
        self.bins = np.zeros(self.length + 1, np.int64)

    def process(self, rows: pd.DataFrame) -> None:
        self.bins += np.bincount(np.minimum(rows["total"].to_numpy(), self.length), minlength=self.length + 1)

    def end_part(self, part: int) -> pd.DataFrame:
        used = np.flatnonzero(self.bins)
        return pd.DataFrame({"count": used, "n_kmers": self.bins[used]})

    def finish(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("count").agg(F.sum("n_kmers").alias("n_kmers"))


class RangeProcessor(CountProcessor):
    """Lets k-mers pass whose total is in a range, and counts the others: n_left_out."""

    schema = "n long"

    def __init__(self, low: int, high: int | None = None) -> None:
        self.low, self.high = low, high

    def begin_part(self, part: int) -> None:
        self.out = 0

    def process(self, rows: pd.DataFrame) -> np.ndarray:
        n = rows["total"].to_numpy()
        good = (n >= self.low) & (True if self.high is None else n <= self.high)
        self.out += int((~good).sum())
        return good

    def end_part(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"n": [self.out]})

    def finish(self, parts: DataFrame) -> DataFrame:
        return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_left_out"))


class DumpProcessor(CountProcessor):
    """kmer and n of all that reach it."""

    schema = "kmer string, n long"

    def begin_part(self, part: int) -> None:
        self.seen = None

    def process(self, rows: pd.DataFrame) -> None:
        self.seen = pd.DataFrame({"kmer": rows["kmer"], "n": rows["total"]})

    def rows(self) -> pd.DataFrame | None:
        seen, self.seen = self.seen, None
        return seen


def _as_bytes(kind: pa.Schema, rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows[kind.names], kind, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def process_counts(vectors: DataFrame, processors: list[CountProcessor]) -> list[DataFrame]:
    """What each processor of the chain makes of ``vectors`` (kmer, counts, total)."""
    kinds = [to_arrow_schema(StructType.fromDDL(p.schema)) for p in processors]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own = [copy.deepcopy(p) for p in processors]

        def packed(i: int, rows: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
            if rows is not None and len(rows):
                yield pd.DataFrame({"processor": [i], "rows": [_as_bytes(kinds[i], rows)]})

        for p in own:
            p.begin_part(part)
        for f in frames:
            for i, p in enumerate(own):
                good = p.process(f)
                yield from packed(i, p.rows())
                if good is not None:
                    f = f[np.asarray(good, bool)].reset_index(drop=True)
                if not len(f):
                    break
        for i, p in enumerate(own):
            yield from packed(i, p.end_part(part))

    path = scratch(vectors.sparkSession, "processed")
    vectors.select("kmer", "counts", "total").mapInPandas(work, "processor int, rows binary").write.partitionBy("processor").parquet(path)
    written = vectors.sparkSession.read.schema("rows binary, processor int").parquet(path)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("rows"):
                yield from pa.ipc.open_stream(raw.as_buffer()).read_all().to_batches()

    return [p.finish(written.where(F.col("processor") == i).select("rows").mapInArrow(unpacked, p.schema)) for i, p in enumerate(processors)]
