"""Streams over several batches, batches that are played again, and merged runs."""

import collections
import os
import random

from basewise.operators.counting import count_kmers
from basewise.streaming import counts as streaming

rnd = random.Random(6)


def brute(seqs, k):
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return collections.Counter(min(s[i : i + k], rc(s[i : i + k])) for s in seqs for i in range(len(s) - k + 1))


def arriving(spark, folder, files):
    for seqs in files:
        spark.createDataFrame([(s,) for s in seqs], "seq string").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(folder))


FILES = [["".join(rnd.choice("ACGT") for _ in range(40)) for _ in range(4)] for _ in range(7)]


def test_each_kmer_is_admitted_once(spark, tmp_path):
    stream = arriving(spark, tmp_path / "in", FILES)
    for _ in range(2):  # the second run finds nothing new
        rows = streaming.append_to_table(streaming.admitted_once(stream, 4), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    want = {x for x, n in brute(sum(FILES, []), 4).items() if n >= 4}
    assert sorted(r.kmer for r in rows) == sorted(want) and want
    arriving(spark, tmp_path / "in", [["AAAAAAAA"], ["ACGT" * 9]])
    rows = streaming.append_to_table(streaming.admitted_once(stream, 4), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    want = {x for x, n in brute(sum(FILES, ["AAAAAAAA", "ACGT" * 9]), 4).items() if n >= 4}
    assert sorted(r.kmer for r in rows) == sorted(want)


def test_batches_are_merged_once(spark, tmp_path):
    stream = arriving(spark, tmp_path / "in", FILES)
    got = streaming.merge_to_table(stream, str(tmp_path / "runs"), str(tmp_path / "state"), 4)
    assert {r.kmer: r.n for r in got.collect()} == brute(sum(FILES, []), 4)
    runs = streaming.Runs(spark, str(tmp_path / "runs"))
    assert runs.live() == [(0, 3), (4, 4), (5, 5), (6, 6)] == runs._complete()
    # batches that are played again: one that is merged already, and the last one
    for batch in (2, 6):
        runs.add(count_kmers(spark.createDataFrame([(s,) for s in FILES[batch]], "seq string"), 4), batch)
        assert {r.kmer: r.n for r in runs.counts().collect()} == brute(sum(FILES, []), 4)


def test_an_unfinished_merge_does_not_count(spark, tmp_path):
    runs = streaming.Runs(spark, str(tmp_path / "runs"))
    assert runs.counts().count() == 0 and runs.live() == []
    one = count_kmers(spark.createDataFrame([("ACGTA",)], "seq string"), 4)
    for batch in range(3):
        runs.add(one, batch)
    one.write.parquet(f"{runs.path}/run-0-2")
    os.remove(f"{runs.path}/run-0-2/_SUCCESS")
    assert len(runs.live()) == 3 and {r.n for r in runs.counts().collect()} == {3}
    runs.add(one, 3)
    assert runs.live() == [(0, 3)] and {r.n for r in runs.counts().collect()} == {4}
