"""Packed files, contents told from bytes, estimates, ranks, processors and the command."""

import gzip
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basewise.__main__ import main
from basewise.functions import hashing as H
from basewise.operators import counting, histogram, ranks, stats
from basewise.plans import processors
from basewise.sources import banks, blocks, counts

rnd = random.Random(5)


def bases(n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def test_packed_files(spark, tmp_path):
    seqs = [bases(rnd.randint(1, 90)) for _ in range(300)] + ["ACGTNNacg", "", "NN", None, "A"]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3)
    manifest = blocks.write_blocks(df, str(tmp_path / "p"), 2, block=500)
    want = sorted(p.upper() for s in seqs for p in (s or "").replace("N", " ").split() if len(p) >= 2)
    rows = blocks.read_blocks(spark, str(tmp_path / "p")).collect()
    assert sorted(r.seq for r in rows) == want and len({(r.file, r.seq_id) for r in rows}) == len(want)
    assert manifest.agg(F.sum("n_seqs")).first()[0] == len(want) and manifest.count() == 3
    assert all(len(list(blocks.block_places(r.path))) > 1 for r in manifest.collect())
    assert banks.sniff(str(tmp_path / "p")) == "packed" and banks.read_bank(spark, str(tmp_path / "p")).count() == len(want)
    with pytest.raises(FileExistsError):
        blocks.write_blocks(df, str(tmp_path / "p"))


def test_packed_bytes_by_hand(spark, tmp_path):
    # magic, one block of 11 bytes: 5 bases ACTGA, then 1 base T
    data = struct.pack("<Q", 0x12345678) + struct.pack("<I", 11) + struct.pack("<i", 5) + bytes([0b00011011, 0b00000000]) + struct.pack("<i", 1) + bytes([0b10000000])
    (tmp_path / "a.bin").write_bytes(data)
    assert [r.seq for r in blocks.read_blocks(spark, str(tmp_path / "a.bin")).orderBy("seq_id").collect()] == ["ACTGA", "T"]
    blocks.write_blocks(spark.createDataFrame([("ACTGA",), ("T",)], "seq string").coalesce(1), str(tmp_path / "w"))
    assert (tmp_path / "w" / "part-00000.bin").read_bytes() == data
    (tmp_path / "cut.bin").write_bytes(data[:-1])
    with pytest.raises(ValueError):
        list(blocks.block_places(str(tmp_path / "cut.bin")))


def test_contents_tell_what_a_file_is(spark, tmp_path):
    (tmp_path / "x1").write_text("\n>a\nACGT\n>b\nAC\n")
    (tmp_path / "x2").write_bytes(gzip.compress(b">a\nACGT\n"))
    (tmp_path / "x3.gz").write_bytes(gzip.compress(b">a\nACGT\n"))
    (tmp_path / "x4").write_text("@a\nACGT\n+\nIIII\n")
    (tmp_path / "album").write_text("x1\n\n# a note\nx4\n" + str(tmp_path / "x2") + "\n")
    (tmp_path / "no album").write_text("x1\nmissing\n")
    spark.createDataFrame([("ACG",)], "seq string").write.parquet(str(tmp_path / "t"))
    kinds = {n: banks.sniff(str(tmp_path / n)) for n in ("x1", "x2", "x3.gz", "x4", "album", "t")}
    assert kinds == {"x1": "fasta", "x2": "fastx", "x3.gz": "fasta", "x4": "fastx", "album": "album", "t": "parquet"}
    for n, rows in (("x1", 2), ("x2", 1), ("x3.gz", 1), ("x4", 1), ("album", 4), ("t", 1)):
        assert banks.read_bank(spark, str(tmp_path / n)).count() == rows
    with pytest.raises(ValueError):
        banks.sniff(str(tmp_path / "no album"))


@pytest.mark.parametrize("kind", ["fasta", "fastq", "gzip"])
def test_estimates_from_heads(spark, tmp_path, kind):
    seqs = [bases(rnd.randint(50, 150)) for _ in range(3000)]
    text = "".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" if kind == "fastq" else f">r{i}\n{s[:60]}\n{s[60:]}\n" for i, s in enumerate(seqs)).encode()
    (tmp_path / "f").write_bytes(gzip.compress(text) if kind == "gzip" else text)
    size = (tmp_path / "f").stat().st_size
    for head in (20_000, size, 10**7):
        e = banks.estimate_files(spark, str(tmp_path / "f"), head).first()
        assert e.bytes_read == min(head, size)
        exact = head >= size
        assert abs(e.n_seqs - 3000) <= (0 if exact else 150) and abs(e.bases - sum(map(len, seqs))) <= (0 if exact else 15_000)
        assert e.longest <= 150 and (not exact or e.longest == max(map(len, seqs)))
    (tmp_path / "one").write_text(">a\n" + bases(5000))
    e = banks.estimate_files(spark, str(tmp_path / "one"), 1000).first()
    assert 4000 < e.bases < 6000 and e.n_seqs in (4, 5, 6)


def test_numbered_rows(spark):
    rows = [(rnd.randint(0, 20), i) for i in range(200)]
    got = ranks.numbered(spark.createDataFrame(rows, "x int, y int").repartition(5), "x", F.desc("y"), name="r").collect()
    assert [(r.x, r.y) for r in sorted(got, key=lambda r: r.r)] == sorted(rows, key=lambda r: (r[0], -r[1])) and sorted(r.r for r in got) == list(range(200))
    assert ranks.numbered(spark.createDataFrame([], "x int"), "x").count() == 0


def test_processors_equal_the_built_in_steps(spark):
    seqs = spark.createDataFrame([(bases(60), b) for b in "abab" for _ in range(20)], "seq string, bank string")
    vectors = counting.count_vectors(counting.count_banks(seqs, 4, "bank"), ["a", "b"]).repartition(5)
    out, bins, dump = processors.process_counts(vectors, [processors.RangeProcessor(5, 30), processors.HistogramProcessor(20), processors.DumpProcessor()])
    kept = vectors.where("total between 5 and 30").select("kmer", F.col("total").alias("n"))
    assert sorted(map(tuple, dump.collect())) == sorted(map(tuple, kept.collect()))
    assert sorted(map(tuple, bins.collect())) == sorted(map(tuple, histogram.histogram(kept, 20).collect()))
    assert out.first()[0] == vectors.count() - kept.count() > 0
    none = processors.process_counts(vectors.limit(0), [processors.RangeProcessor(1), processors.DumpProcessor()])
    assert none[0].first()[0] == 0 and none[1].count() == 0


def test_distinct_from_share(spark):
    seqs = spark.createDataFrame([(i, bases(200)) for i in range(400)], "id long, seq string")
    exact = counting.count_kmers(seqs, 6).count()
    whole = stats.distinct_from_share(seqs, 6, "id", 1.0, 1 << 16).first()
    assert abs(whole.n_distinct - exact) < 0.05 * exact and whole.seen_kmers == 400 * 195 and whole.accurate
    part = stats.distinct_from_share(seqs, 6, "id", 0.25, 1 << 16).first()
    assert exact * 0.9 <= part.n_distinct <= exact * 4.4 and part.seen_kmers < 0.4 * 400 * 195
    assert not stats.distinct_from_share(seqs, 6, "id", 1.0, 64).first().accurate


def test_seeded_hashes():
    mask = (1 << 64) - 1

    def slow(key, seed):
        h = seed ^ ((seed << 7) & mask) ^ (key * (seed >> 3) & mask) ^ (~((seed << 11) + (key ^ (seed >> 5))) & mask)
        h = ((~h & mask) + (h << 21)) & mask
        h ^= h >> 24
        h = (h * 265) & mask
        h ^= h >> 14
        h = (h * 21) & mask
        h ^= h >> 28
        return (h + (h << 31)) & mask

    keys = [0, 1, 77, 1 << 40, mask]
    for seed in (0, 5, 0xAAAAAAAA55555555):
        assert H.seeded64(np.array(keys, np.uint64), seed).tolist() == [slow(k, seed) for k in keys]
    table = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert H.bytes16(np.array([0x123456], np.uint64), 8, table).tolist() == [int(table[0x34] ^ table[0x12] ^ table[0x56])]


def test_command(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text("".join(f">r{i}\n{s}\n" for i, s in enumerate([bases(80) for _ in range(20)] * 3)))
    (tmp_path / "b.fa").write_text(">x\nACGTACGTACGTNACG\n")
    a, b, out = str(tmp_path / "a.fa"), str(tmp_path / "b.fa"), str(tmp_path / "out")
    said = main(["count", a, "-k", "7", "--low", "3", "--out", out, "--sorted"], spark)
    want = counting.count_kmers(banks.read_fasta(spark, a), 7).where("n >= 3")
    assert said["n_solid"] == want.count() and counts.read_properties(spark, f"{out}/properties")["k"] == 7
    assert sorted(map(tuple, counts.read_counts(spark, f"{out}/counts").collect())) == sorted(map(tuple, want.collect()))
    assert main(["count", a, b, "-k", "5", "--solidity", "all", "--low", "1"], spark)["banks"] == [a, b]
    assert main(["heavy", a, "-k", "7", "--low", "3"], spark)["n_kmers"] == want.count() == main(["heavy", a, "-k", "7", "--low", "3", "--pieces", "--out", f"{out}2"], spark)["n_kmers"]
    assert main(["check", a, "-k", "9", "-m", "4"], spark) == {"disagreements": 0}
    assert main(["stats", b, "-k", "4"], spark)[b]["valid_kmers"] == 9
    assert main(["estimate", a, b], spark)["n_seqs"] == 61
    assert '"n_seqs": 61' in capsys.readouterr().out


def test_packed_pieces_many_at_a_time(spark, tmp_path, monkeypatch):
    """No Python call for each piece: short, long and odd sequences through both packed forms equal plain splitting."""
    from basewise.sources import bits

    seqs = [bases(rnd.randint(1, 40)) for _ in range(200)] + ["ACGTNNacg", "", "NN", None, "A", "é" + "ACG" + "\0" + "TTé", bases(700), "NAN" * 90]
    want = [[p.upper() for p in re.findall("[ACGTacgt]+", s or "")] for s in seqs]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string").coalesce(1)
    for chunk in (16, 1 << 18):
        monkeypatch.setattr(bits, "CHUNK", chunk)
        found = {(int(r), int(i)): (int(z), x) for row, number, size, data in bits.pieces(pa.array(seqs), 2) for r, i, z, x in zip(row, number, size, data.to_pylist())}
        assert {k: z for k, (z, _) in found.items()} == {(r, i): len(p) for r, own in enumerate(want) for i, p in enumerate(own) if len(p) >= 2}
        packed = pa.array([x for _, x in found.values()])
        data, at = bits.binaries(packed)
        n = np.array([z for z, _ in found.values()])
        spelt = [s for i, j in bits.slices(n) for s in bits.unpacked(data, at[i:j], n[i:j]).to_pylist()]
        assert spelt == [want[r][i] for r, i in found]
        assert data[: at[1]].tobytes() == packed[0].as_py() and (len(list(bits.slices(n))) == 1) == (chunk > 16)
    back = banks.from_packed(banks.to_packed(df, 2)).collect()
    assert {(r.id, r.piece): r.seq for r in back} == {(r, i): p for r, own in enumerate(want) for i, p in enumerate(own) if len(p) >= 2}
    blanks = spark.createDataFrame([(1, 5, bytearray(b"\x1b\x00")), (2, 0, None)], "id int, n_bases int, packed binary")
    assert {r.id: r.seq for r in banks.from_packed(blanks).collect()} == {1: "ACTGA", 2: None}
    blocks.write_blocks(df, str(tmp_path / "p"), 2, block=100)
    places = list(blocks.block_places(str(tmp_path / "p" / "part-00000.bin")))
    sizes = [4 + -(-len(p) // 4) for own in want for p in own if len(p) >= 2]
    cut, held = [], 0
    for z in sizes:
        held += z
        if held >= 100:
            cut.append(held)
            held = 0
    assert [n for _, n in places] == cut + [held] * (held > 0)
    rows = blocks.read_blocks(spark, str(tmp_path / "p")).orderBy("seq_id").collect()
    assert [r.seq for r in rows] == [p for own in want for p in own if len(p) >= 2] and len({r.seq_id for r in rows}) == len(rows)
