"""Byte ranges of FASTA and FASTQ files against whole reading."""

import collections
import gzip
import random

import pytest

from basewise.sources import banks, ranges

rnd = random.Random(8)


def bases(n):
    return "".join(rnd.choice("ACGTNacgt") for _ in range(n))


def fasta(records, width, end="\n"):
    return "".join(f">{c}{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for c, s in records)


RECORDS = [("one record", bases(997)), ("", bases(3)), ("empty", ""), ("x" * 90 + " > not a record", bases(250)), ("last", bases(40))]


def joined(rows, overlap):
    """Records put together from their pieces, each of which must begin where the one before ended and overlap the next."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.record].append(r)
    out = []
    for _, own in sorted(by.items()):
        own.sort(key=lambda r: r.at)
        text = "".join(r.seq[: r.own] for r in own)
        at = 0
        for r in own:
            assert r.at == at and r.seq == text[at : at + r.own + overlap]
            at += r.own
        out.append((own[0].comment, text))
    return out


@pytest.mark.parametrize("width, end", [(10**6, "\n"), (60, "\n"), (7, "\r\n"), (1, "\n")])
def test_pieces_of_all_ranges(tmp_path, width, end):
    text = "\n\nACGT before\n" + fasta(RECORDS, width, end)
    path = tmp_path / "a.fa"
    path.write_text(text)
    for size in (2, 3, 5, 17, 100, 1000, 10**6):
        for piece, overlap in ((1, 0), (10, 4), (400, 30), (10**6, 4)):
            if size < 17 and piece != 10:
                continue
            rows, record, comment, at, ends_in = [], None, None, 0, "bases"
            for start in range(0, len(text), size):
                s = ranges._survey(str(path), start, min(len(text), start + size))
                inside = not s["line_start"] and ends_in == "header"
                rows += [collections.namedtuple("R", "record comment at own seq")(*p) for p in ranges._pieces(str(path), start, s["end"], s["zipped"], s["line_start"], inside, record, comment, at, piece, overlap)]
                leading = s["before"] + (0 if inside else s["fragment"])
                record, comment, at = (s["record"], s["comment"], s["behind"]) if s["headers"] else (record, comment, at + leading)
                ends_in = s["ends_in"] or ends_in
            assert joined(rows, overlap) == [r for r in RECORDS if r[1]]


def test_read_pieces(spark, tmp_path):
    folder = tmp_path / "bank"
    folder.mkdir()
    (folder / "a.fa").write_text(fasta(RECORDS, 60))
    (folder / "b.fa").write_text(fasta(RECORDS[:1], 10**6).rstrip("\n"))
    (folder / "c.fa.gz").write_bytes(gzip.compress(fasta(RECORDS, 50).encode()[:700]) + gzip.compress(fasta(RECORDS, 50).encode()[700:]))
    (folder / "d.fa").write_text("")
    (folder / "_SUCCESS").write_text(">no\nACGT\n")
    want = [r for r in RECORDS if r[1]]
    for size, piece in ((37, 20), (256, 100), (1 << 20, 1 << 20)):
        rows = ranges.read_pieces(spark, str(folder), 6, size, piece).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.file[-4:]].append(r)
        assert joined(by["a.fa"], 6) == want and joined(by["b.fa"], 6) == want[:1] and joined(by["a.gz"], 6) == want and len(by) == 3
        assert all(r.own <= piece for r in rows)
    both = ranges.read_pieces(spark, f"{folder}/a.fa,file://{folder}/b.fa", 0, 100)
    assert both.rdd.getNumPartitions() > 1 and both.groupBy("file", "record").count().count() == 5
    with pytest.raises(FileNotFoundError):
        ranges.read_pieces(spark, str(folder / "none.fa"))


def test_fastq_cut_anywhere(tmp_path):
    records = []
    for i in range(60):
        n = rnd.choice([0, 1, 2, 30])
        records.append((f"@+r{i}", bases(n), rnd.choice(["@", "+", "I", "@+"]) * n))
    records = [(c, s, q[: len(s)]) for c, s, q in records]
    for end in ("\n", "\r\n"):
        text = "".join(f"@{c}{end}{s}{end}+{rnd.choice(['', c])}{end}{q}{end}" + rnd.choice(["", "", end]) for c, s, q in records)
        path = tmp_path / "r.fq"
        path.write_bytes(text.encode())
        for size in (1, 2, 7, 50, 333, 10**6):
            with ranges.open_file(str(path))[0] as source:
                got = [r for at in range(0, len(text), size) for r in ranges.fastq_records(source, at, at + size)]
            assert [r[1:] for r in got] == records and [r[0] for r in got] == sorted({r[0] for r in got})


def test_fastq_by_several_tasks(spark, tmp_path):
    records = [(f"read {i}", bases(40 + i % 7), ("@" if i % 2 else "+") * (40 + i % 7)) for i in range(400)]
    text = "".join(f"@{c}\n{s}\n+\n{q}\n" for c, s, q in records)
    (tmp_path / "p.fq").write_text(text)
    (tmp_path / "z.fq.gz").write_bytes(gzip.compress(text.encode()))
    plain = banks.read_fastx(spark, str(tmp_path / "p.fq"), range_bytes=1000)
    assert plain.rdd.getNumPartitions() == -(-len(text) // 1000)
    for read in (plain, banks.read_fastx(spark, str(tmp_path / "p.fq")), banks.read_fastx(spark, str(tmp_path / "z.fq.gz"), range_bytes=1000)):
        assert [tuple(r)[1:] for r in read.orderBy("seq_id").collect()] == records
    (tmp_path / "m.fq").write_text("@a\nACGT\nAC\n+\nIIII\nI@\n" * 50)
    assert banks.read_fastx(spark, str(tmp_path / "m.fq"), range_bytes=100).count() == 50
    (tmp_path / "half.fq").write_text("@a\nACGT\n+\nIIII\n" * 50 + "@a\nACGT\nAC\n+\nIIII\nI@\n")
    with pytest.raises(Exception, match="multiline"):
        banks.read_fastx(spark, str(tmp_path / "half.fq"), range_bytes=100).count()
    assert banks.read_fastx(spark, str(tmp_path / "half.fq"), range_bytes=100, multiline=True).count() == 51
