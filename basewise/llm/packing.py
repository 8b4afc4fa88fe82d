"""Best-fit packing by hierarchical residuals.

Documents become token pieces of at most ``capacity`` ids; a longer document is cut into full pieces
behind a first, shorter one. Full pieces are sequences of their own. All others are packed best-fit
decreasing inside hash partitions; nearly full bins are final, underfull bins go on as items of the
next round, in an eighth of the partitions, or as many as ``TASK_ITEMS`` items a task ask for, until one partition has packed what is left or a round joins nothing. Only sizes are packed, never token ids.

Each round is written to the shared folder, so bins keep their numbers whatever executors are lost.

Defined cases: a null text is empty and gives one piece, its end id. Rows that repeat a doc_id are
packed each for itself. A null doc_id is kept. An empty table gives no rows. Only doc_id and text
are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, staged
from .encoding import encoded, vocabulary_path

CAPACITY = 1024
#: Items that one task packs at most, about.
TASK_ITEMS = 200_000
FAN_IN = 8
#: A bin with no more room than this is final, as is one that not even the smallest item at hand fits into.
SLACK = 0


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """item (a number), doc_id, piece, start, length and ids_crc32 of each piece; with_ids adds the ids as binary."""
    vocabulary = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        item = TaskContext.get().partitionId() << 40
        for b in batches:
            rows, where = [], []
            for k, raw in enumerate(encoded(vocabulary, b.column("text").to_pylist())):
                n = len(raw) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for piece, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    part = raw[4 * x : 4 * y]
                    rows.append((item, piece, x, y - x, zlib.crc32(part), part if with_ids else None))
                    where.append(k)
                    item += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            arrays.insert(1, b.column("doc_id").take(pa.array(where, pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, ["item", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(released(cut), f"item long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit for lengths in descending order: bin and offset of each item, and the fill of each bin.

    Bins are kept in stacks by their room; a bit set over rooms finds the tightest that fits.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, fills = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fitting = open_rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = stacks[room].pop()
            if not stacks[room]:
                open_rooms ^= 1 << room
        else:
            k, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = k, fills[k]
        fills[k] += n
        if room > n:
            stacks[room - n].append(k)
            open_rooms |= 1 << (room - n)
    return bins, offsets, np.array(fills, np.int64)


def _round(items: DataFrame, number: int, partitions: int, capacity: int) -> DataFrame:
    """item, bin, offset and fill of the bin, each partition packed for itself."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts = list(frames)
        if not parts:
            return
        # sorted, so that a second attempt packs alike in whatever order the rows arrive
        own = pd.concat(parts).sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        bins, offsets, fills = best_fit(own["length"].to_numpy(), capacity)
        base = (number << 56) | (TaskContext.get().partitionId() << 32)
        yield pd.DataFrame({"item": own["item"], "bin": base + bins, "offset": offsets, "fill": fills[bins]})

    dealt = items.select("item", "length")
    dealt = dealt.coalesce(1) if partitions == 1 else dealt.repartition(partitions, F.xxhash64("item"))
    return staged(dealt.mapInPandas(pack, "item long, bin long, offset long, fill long"), f"bins-{number}")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """``pieces`` (item, length and more) with sequence_id and offset."""
    spare = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    partial = pieces.where(F.col("length") < capacity)
    waiting, n, rounds = partial.select("item", "length"), partial.count(), []
    partitions = max(1, -(-n // TASK_ITEMS))
    while n:
        bins = _round(waiting, len(rounds) + 1, partitions, capacity)
        rounds.append(bins)
        under = bins.where(F.col("fill") < capacity - slack).select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
        left, least = under.agg(F.count("*"), F.min("length")).first()
        if partitions == 1 or not left:
            break
        # a bin that not even the smallest one fits into is final
        waiting = under.where(F.col("length") + least <= capacity)
        before, n, last = n, waiting.count(), partitions
        partitions = max(-(-partitions // FAN_IN), -(-n // TASK_ITEMS))
        if left == before and partitions == last:  # nothing could be joined, and no other deal is at hand
            break
    placed = pieces.select(*spare).join(rounds[0].select("item", "bin", "offset"), "item", "left") if rounds else pieces.select(*spare, F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    for bins in rounds[1:]:
        moved = bins.select(F.col("item").alias("_from"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
        placed = placed.join(moved, F.col("bin") == F.col("_from"), "left").select(
            *spare, F.coalesce("_to", "bin").alias("bin"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset")
        )
    # a full piece is a sequence of its own; bins begin at 1 << 56, items do not reach that
    return placed.select(*spare, F.coalesce("bin", "item").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    pieces = staged(token_pieces(docs, capacity, vocabulary), "pieces")
    return pack(pieces, capacity).drop("item")
