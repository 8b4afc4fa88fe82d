"""Running counts and admission of k-mers over a stream of sequences.

Two ways to keep counts. The engine's state store holds one count per distinct k-mer (``running_counts``, ``admitted``, ``admitted_once``). ``merge_to_table`` keeps them as a
table of runs: each batch adds a run with its own counts, and runs are merged as they pile up, so that a batch's work follows the batch.
Sequences have no event time, so there is no watermark and no state expires.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed
from ..operators.counting import count_kmers


def running_counts(stream: DataFrame, k: int, policy: str = "skip", order: str = "ACGT") -> DataFrame:
    """kmer and n over all that has arrived: a streaming aggregate for output mode update or complete."""
    return count_kmers(stream, k, policy, order)


def admitted(stream: DataFrame, k: int, at_least: int = 4, policy: str = "skip") -> DataFrame:
    """K-mers once their count has reached ``at_least``; in output mode update again whenever they are seen."""
    return running_counts(stream, k, policy).where(F.col("n") >= at_least)


def admitted_once(stream: DataFrame, k: int, at_least: int = 4, policy: str = "skip") -> DataFrame:
    """Each k-mer once, in the batch that brings its ``at_least``-th occurrence: a stream for output mode append.

    Tasks count their part of a batch first, so a k-mer's state is touched once per task and batch, not once per occurrence. Its count stops
    at ``at_least``; from there on its state is only read.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        if before >= at_least:
            return
        n = min(at_least, before + sum(int(f["n"].sum()) for f in frames))
        state.update((n,))
        if n == at_least:
            yield pd.DataFrame({"code": [key[0]]})

    counts = packed.code_counts(stream, packed.check_k(k), policy)
    found = counts.groupBy("code").applyInPandasWithState(step, "code long", "seen long", "append", "NoTimeout")
    return found.select(packed.spelled("code", k, "ACGT").alias("kmer"))


def run_to_table(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what has arrived, leave the full result at ``path``, and read it. Each batch writes all of it anew; ``merge_to_table`` does not."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.read.schema(counts.schema).parquet(path)


def append_to_table(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what has arrived, append what it gives to ``path``, batch by batch, and read all of it."""
    query = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Runs:
    """Counts as runs, one folder each, named by the first and the last batch in it.

    Of folders that Spark has marked complete those count that no larger one contains. So a merged run takes over from its parts
    the moment it is complete, and a batch that is written again replaces its run, or is left out if a merged run has it already.
    """

    #: Runs of one size that are merged into one.
    FAN_IN = 4

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run-{run[0]}-{run[1]}"

    def _complete(self) -> list[tuple[int, int]]:
        if not self._files.exists(self._at(self.path)):
            return []
        named = (re.fullmatch(r"run-(\d+)-(\d+)", x.getPath().getName()) for x in self._files.listStatus(self._at(self.path)))
        found = [(int(m[1]), int(m[2])) for m in named if m]
        return sorted(r for r in found if self._files.exists(self._at(f"{self._folder(r)}/_SUCCESS")))

    def live(self) -> list[tuple[int, int]]:
        every = self._complete()
        return [r for r in every if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in every)]

    def add(self, counts: DataFrame, batch: int) -> None:
        """One batch's counts (kmer, n), then the merges that are due."""
        if any(first <= batch <= last and first < last for first, last in self.live()):
            return
        counts.select("kmer", "n").write.mode("overwrite").parquet(self._folder((batch, batch)))
        self._merge()

    def _merge(self) -> None:
        """Merge the last FAN_IN runs as long as they have the same number of batches: a count is written again once for each FAN_IN-fold of the batches."""
        while True:
            live = self.live()
            last = live[-self.FAN_IN :]
            if len(last) < self.FAN_IN or len({b - a for a, b in last}) > 1 or any(x[1] + 1 != y[0] for x, y in zip(last, last[1:])):
                break
            self._sum(last).write.mode("overwrite").parquet(self._folder((last[0][0], last[-1][1])))
        live = set(self.live())
        for r in set(self._complete()) - live:
            self._files.delete(self._at(self._folder(r)), True)

    def _sum(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.schema("kmer string, n long").parquet(*map(self._folder, runs)).groupBy("kmer").agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        """kmer and n over all runs."""
        live = self.live()
        return self._sum(live) if live else self.spark.createDataFrame([], "kmer string, n long")


def merge_to_table(stream: DataFrame, path: str, checkpoint: str, k: int, policy: str = "skip", order: str = "ACGT") -> DataFrame:
    """Count what has arrived batch by batch into runs at ``path``, and read the sums. The stream itself keeps no state."""
    runs = Runs(stream.sparkSession, path)

    def add(batch: DataFrame, number: int) -> None:
        runs.add(count_kmers(batch, k, policy, order), number)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return runs.counts()
