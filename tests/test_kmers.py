"""Hand-checked rows and brute force for k-mers, counts and minimizers."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basewise.functions import alphabet as A
from basewise.functions import hashing as H
from basewise.operators import compare, counting, histogram, kmers, minimizers, sketches, solidity, stats
from basewise.sources import banks, counts

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMPLEMENT)[::-1]


def brute(seqs, k, order="ACGT"):
    c = Counter()
    for s in seqs:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                c[min(w, rc(w), key=lambda x: [order.index(b) for b in x]) if order else w] += 1
    return dict(c)


@pytest.fixture(scope="module")
def reads():
    rnd = random.Random(3)
    some = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 80))) for _ in range(40)]
    return [*some, "", "A" * 40, "T" * 40, "ACGNACG", "NNNN", "ACG", "ACGTACGT", "acgtn" * 6]


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 3, 4, 7, 31])
@pytest.mark.parametrize("order", ["ACGT", "ACTG", None])
def test_counts_match_brute_force(spark, reads, k, order):
    got = {r.kmer: r.n for r in counting.count_kmers(banks.from_strings(spark, reads), k, order=order).collect()}
    assert got == brute([r.upper() for r in reads], k, order)


def test_hand_checked(spark):
    def count(seqs, k, **kw):
        return {r.kmer: r.n for r in counting.count_kmers(banks.from_strings(spark, seqs), k, **kw).collect()}

    assert count(["ACGTAC"], 3) == {"ACG": 2, "GTA": 2}
    assert count(["ACGTAC"], 3, order="ACTG") == {"ACG": 2, "TAC": 2}
    assert count(["AC"], 3) == {}
    assert count(["ACGNACG"], 3, order=None) == {"ACG": 2}
    assert count(["ACGNACG"], 3, order=None, policy="replace_a") == {"ACG": 2, "CGA": 1, "GAA": 1, "AAC": 1}
    assert count(["AAAA", "TTTT"], 4) == {"AAAA": 2}


def test_invariants(spark, reads):
    bank = banks.from_strings(spark, reads)
    flipped = bank.withColumn("seq", A.revcomp(F.translate("seq", "acgt", "ACGT")))
    plain = rows(counting.count_kmers(bank, 5))
    assert rows(counting.count_kmers(flipped, 5)) == plain
    assert rows(counting.merge_counts(counting.count_kmers(bank.where("seq_id < 20"), 5), counting.count_kmers(bank.where("seq_id >= 20"), 5))) == plain
    assert rows(counting.count_through_super_kmers(bank, 9, 4)) == rows(counting.count_kmers(bank, 9))
    assert compare.disagreements(counting.count_kmers(bank, 9), counting.count_kmers(bank, 9)).count() == 0


def mini(seq, k, m, i):
    """Place and text of the smallest canonical m-mer of k-mer i, the rightmost of equals."""
    best = None
    for j in range(i, i + k - m + 1):
        w = seq[j : j + m]
        key = min(*(["ACTG".index(c) for c in x] for x in (w, rc(w))))
        if best is None or key <= best[0]:
            best = (key, j)
    return "".join("ACTG"[x] for x in best[0]), best[1]


def test_minimizers_and_super_kmers(spark, reads):
    seqs = [r for r in reads if set(r) <= set("ACGT")]
    bank = banks.from_strings(spark, seqs)
    want = {(n, i, *mini(s, 9, 4, i)) for n, s in enumerate(seqs) for i in range(len(s) - 8)}
    got = minimizers.minimizers(bank, 9, 4).select("seq_id", "pos", "minimizer", "minimizer_at")
    assert rows(got) == want
    runs = minimizers.super_kmers(bank, 9, 4)
    assert rows(kmers.kmers(runs.select("seq_id", "start", "seq"), 9).select("seq_id", F.col("start") + F.col("pos"), "kmer")) == rows(kmers.kmers(bank, 9).select("seq_id", "pos", "kmer"))
    capped = minimizers.super_kmers(bank, 9, 4, max_kmers=3)
    assert capped.agg(F.max("n_kmers")).first()[0] == 3
    assert capped.agg(F.sum("n_kmers")).first()[0] == len(want)


def test_minimizers_by_rank_take_the_rarest(spark, reads):
    seqs = [r for r in reads if set(r) <= set("ACGT")]
    bank = banks.from_strings(spark, seqs)
    ranks = {r["mmer"]: r["rank"] for r in minimizers.mmer_ranks(bank, 3).collect()}

    def best(s, i):
        options = []
        for j in range(i, i + 5):
            w = min(s[j : j + 3], rc(s[j : j + 3]), key=lambda x: ["ACTG".index(c) for c in x])
            options.append((ranks[w], w))
        return min(options)[1]

    got = minimizers.minimizers(bank, 7, 3, ranks=minimizers.mmer_ranks(bank, 3)).select("seq_id", "pos", "minimizer")
    assert rows(got) == {(n, i, best(s, i)) for n, s in enumerate(seqs) for i in range(len(s) - 6)}


def test_banned_mmers_lose(spark):
    seq = "CAACCGTCAAAG"

    def best(i, m):
        options = []
        for j in range(i, i + 7 - m + 1):
            w = min(seq[j : j + m], rc(seq[j : j + m]), key=lambda x: ["ACTG".index(c) for c in x])
            key = [3] * m if "AA" in w[1:] else ["ACTG".index(c) for c in w]
            options.append((key, -j))
        return "".join("ACTG"[c] for c in min(options)[0])

    got = minimizers.minimizers(banks.from_strings(spark, [seq]), 7, 3, ban_aa=True).select("pos", "minimizer")
    assert rows(got) == {(i, best(i, 3)) for i in range(len(seq) - 6)}


def test_minimizers_by_hash(spark, reads):
    import numpy as np

    seqs = [r for r in reads if set(r) <= set("ACGT")]

    def best(s, i):
        options = []
        for j in range(i, i + 6):
            w = min([["ACTG".index(c) for c in x] for x in (s[j : j + 4], rc(s[j : j + 4]))])
            code = sum(d * 4 ** (3 - p) for p, d in enumerate(w))
            options.append((int(H.mix64(np.array([code], np.uint64))[0]), -j, "".join("ACTG"[d] for d in w)))
        return min(options)[2]

    got = minimizers.minimizers(banks.from_strings(spark, seqs), 9, 4, hashed=True).select("seq_id", "pos", "minimizer")
    assert rows(got) == {(n, i, best(s, i)) for n, s in enumerate(seqs) for i in range(len(s) - 8)}


def test_long_sequences_are_cut_without_seams(spark, reads, monkeypatch):
    from basewise.operators import packed

    bank = banks.from_strings(spark, ["".join(reads[:30]) + "N" + "ACGT" * 30, *reads])
    plain = [rows(counting.count_kmers(bank, 9)), rows(minimizers.minimizers(bank, 9, 4)), rows(minimizers.super_kmers(bank, 9, 4)), rows(kmers.kmers(bank, 9)), rows(kmers.valid_kmers(bank, 33)), rows(minimizers.strand_runs(bank, 9))]
    assert plain[0] == set(brute([r.upper() for r in ["".join(reads[:30]) + "N" + "ACGT" * 30, *reads]], 9).items())
    for module in (packed, minimizers):
        monkeypatch.setattr(module, "CHUNK", 16)
    monkeypatch.setattr(kmers, "PIECE", 64)
    # functions are shipped with the values that their modules have in the worker, so pieces are cut in this process
    made = packed.Minimizing(9, 4, "ACTG", "skip", False, None, False)
    for text in reads:
        codes = made.codes(text)
        small = [np_.tolist() for np_ in map(lambda x: __import__("numpy").concatenate(x), zip(*[p[1:] for p in made.pieces(codes)]))] if len(codes) >= 9 else []
        monkeypatch.setattr(packed, "CHUNK", 1 << 20)
        whole = [x.tolist() for p in made.pieces(codes) for x in p[1:]]
        monkeypatch.setattr(packed, "CHUNK", 16)
        assert small == whole
    assert rows(kmers.kmers(bank, 9)) == plain[3] and rows(kmers.valid_kmers(bank, 33)) == plain[4]


def test_repartition(spark):
    bins = spark.createDataFrame([("a", 9), ("b", 5), ("c", 4), ("d", 3)], "bin string, size long")
    load = Counter()
    for r in minimizers.greedy_partitions(bins, 2).collect():
        load[r.part] += r["size"]
    assert sorted(load.values()) == [9, 12] or sorted(load.values()) == [10, 11]
    assert minimizers.grouped_partitions(bins, 2, ["bin"]).agg(F.max("part")).first()[0] <= 1


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ACGTN",)], "s string")
    got = df.select(A.revcomp_lenient("s"), A.revcomp_cased(F.lit("acGTn")), A.encode(F.lit("GTCA")), A.decode(F.lit(228), 4), A.reverse_byte(F.lit(3)), A.grouped_number(F.lit(1234567)), A.short_comment(F.lit("r1 x"))).first()
    assert tuple(got) == ("AACGT", "XACgt", 228, "GTCA", 192, "1,234,567", "r1")
    with pytest.raises(ValueError):
        A.check_order("TGCA")


def test_hashes_wrap_and_invert():
    import numpy as np

    x = np.array([0, 1, 2**63, 2**64 - 1, 12345678901234567890], np.uint64)
    assert (H.inverse64(H.invertible64(x)) == x).all()
    y = np.array([0, 1, 2**31, 2**32 - 1], np.uint32)
    assert (H.inverse32(H.invertible32(y)) == y).all()

    def mix(v):
        m = 2**64 - 1
        v = (~v & m) + (v << 21) & m
        v ^= v >> 24
        v = v * 265 & m
        v ^= v >> 14
        v = v * 21 & m
        v ^= v >> 28
        return v + (v << 31) & m

    assert H.mix64(x).tolist() == [mix(int(v)) for v in x]


def test_solidity_rules(spark):
    v = spark.createDataFrame([("a", [5, 0], 5), ("b", [3, 3], 6), ("c", [0, 9], 9), ("d", [1, 1], 2)], "kmer string, counts array<long>, total long")

    def kept(*a, **k):
        return sorted(r.kmer for r in solidity.solid_kmers(v, *a, **k).collect())

    assert kept("sum", [6], 2) == ["b", "c"]
    assert kept("min", [1], 2) == ["b", "d"]
    assert kept("max", [4], 2) == ["a", "c"]
    assert kept("one", [5, 9], 2) == ["a", "c"]
    assert kept("all", [1, 3], 2) == ["b"]
    assert kept("custom", [3], 2, [True, False]) == ["a"]
    huge = spark.createDataFrame([("x", [1 << 40], 1 << 40)], "kmer string, counts array<long>, total long")
    assert solidity.solid_kmers(huge, "sum", [2], 1).count() == 1
    assert solidity.abundance_filter(huge.select("kmer", F.col("total").alias("n")), 2).count() == 1
    with pytest.raises(ValueError):
        solidity.complete_thresholds([1, 2, 3], 2)
    assert solidity.complete_thresholds([4], 3) == [(4, None)] * 3


def test_auto_cutoff(spark):
    h = {1: 1000, 2: 300, 3: 80, 4: 30, 5: 40, 6: 90, 7: 200, 8: 300, 9: 250, 10: 100}
    table = spark.createDataFrame(list(h.items()), "count long, n_kmers long")
    c = histogram.auto_cutoff(table, length=100)
    assert (c.cutoff, c.first_peak) == (4, 8)
    assert c.n_solid == sum(n for i, n in h.items() if i >= 4)
    falling = spark.createDataFrame([(1, 10), (2, 5)], "count long, n_kmers long")
    assert histogram.auto_cutoff(falling, length=2).cutoff == 2


def test_compare_and_lines(spark):
    a = spark.createDataFrame([("AA", 1), ("AC", 2), ("AG", 3)], "kmer string, n long")
    b = spark.createDataFrame([("AA", 1), ("AC", 5), ("AT", 3)], "kmer string, n long")
    d = compare.count_diff(a, b)
    assert rows(d) == {("AA", "same", 1, 1), ("AC", "changed", 2, 5), ("AG", "extra", 3, None), ("AT", "missing", None, 3)}
    assert rows(compare.diff_lines(d)) == {("+AG",), ("-AT",), ("-AC 2->5",)}
    assert compare.evaluation(a, b).first().undercounted == 1


def test_neighbours_and_tiles(spark):
    t = spark.createDataFrame([("AAC",), ("ACG",)], "kmer string")
    got = {r.kmer: (r.n_out, r.n_in) for r in kmers.neighbour_masks(t).collect()}
    assert got["AAC"][0] >= 1 and got["ACG"][1] >= 1
    tiles = kmers.tile(banks.from_strings(spark, ["ACGTACGTAC", "", "AC"]), 4, 1)
    assert [r.seq for r in tiles.where("seq_id = 0").orderBy("start").collect()] == ["ACGT", "TACG", "GTAC"]
    assert kmers.all_kmers(spark, 2).count() == 16
    assert rows(kmers.random_reads(spark, 5, 20, 1)) == rows(kmers.random_reads(spark, 5, 20, 1))


def test_stats(spark, reads):
    bank = banks.from_strings(spark, reads).withColumn("bank", F.lit("x"))
    r = stats.bank_stats(bank, 3, ["bank"]).first()
    assert r.n_seqs == len(reads) and r.valid_kmers == sum(brute([x.upper() for x in reads], 3).values())


# --- files -----------------------------------------------------------------------------------------


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 desc\nACGTAC\nGTTT\n>r2\r\nAC\r\n>r3\n")
    got = {r.comment: r.seq for r in banks.read_bank(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"r1 desc": "ACGTACGTTT", "r2": "AC", "r3": ""}
    (tmp_path / "l.album").write_text("a.fa\n")
    assert banks.read_bank(spark, str(tmp_path / "l.album")).count() == 3


@pytest.mark.parametrize("how", ["plain", "gzip", "zlib"])
def test_fastq_by_magic_bytes(spark, tmp_path, how):
    import gzip
    import zlib

    text = b"@r1 x\nACGT\n+\n@III\n@r2\nAC\nGG\n+r2\nII\nII\n>f\nAC\nGT\n"
    data = {"plain": text, "gzip": gzip.compress(text), "zlib": zlib.compress(text)}[how]
    (tmp_path / "reads").write_bytes(data)
    got = [tuple(r)[1:] for r in banks.read_fastx(spark, str(tmp_path / "reads")).orderBy("seq_id").collect()]
    assert got == [("r1 x", "ACGT", "@III"), ("r2", "ACGG", "IIII"), ("f", "ACGT", None)]
    assert banks.looks_like_fastx(str(tmp_path / "reads"))


def test_packed(spark):
    bank = banks.from_strings(spark, ["ACGTTNNNGGCANAC", "", "NNN"])
    assert sorted(r.seq for r in banks.from_packed(banks.to_packed(bank, 3)).collect()) == ["ACGTT", "GGCA"]


def test_count_files(spark, tmp_path):
    table = spark.createDataFrame([("AC", 3), ("GT", 1)], "kmer string, n long")
    counts.write_counts(table, str(tmp_path / "t"), " ")
    assert rows(counts.read_counts(spark, str(tmp_path / "t"))) == rows(table)
    counts.write_count_fasta(table, str(tmp_path / "f"))
    assert rows(counts.read_count_fasta(spark, str(tmp_path / "f"))) == rows(table)
    counts.write_properties(spark, {"k": 31}, str(tmp_path / "p"))
    assert counts.read_properties(spark, str(tmp_path / "p")) == {"k": 31}


# --- sketches --------------------------------------------------------------------------------------


def test_abundance_scale(spark):
    got = spark.createDataFrame([(0,), (69,), (70,), (99,), (100,), (499,), (49_999,), (10**9,)], "n long").select("n", sketches.abundance_code(F.col("n")).alias("c")).select("n", "c", sketches.abundance_of(F.col("c")).alias("a"))
    assert [(r.c, r.a) for r in got.orderBy("n").collect()] == [(0, 0), (69, 69), (70, 71), (84, 99), (85, 105), (124, 495), (254, 49_500), (255, 50_000)]


def test_dense_ids(spark):
    t = spark.createDataFrame([(c,) for c in "dbaacb"], "k string")
    assert {r.k: r.id for r in sketches.dense_ids(t, "k").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_whole_run(spark, reads):
    from basewise.plans.run import run

    seqs = banks.from_strings(spark, reads).withColumn("sample", F.when(F.col("seq_id") < 20, "x").otherwise("y"))
    r = run(seqs, 4, bank="sample", kind="all", thresholds=[2], processors=(lambda v: v.where("kmer != 'AAAA'"),))
    want = {}
    for name, part in (("x", reads[:20]), ("y", reads[20:])):
        for km, n in brute([s.upper() for s in part], 4).items():
            want.setdefault(km, {})[name] = n
    assert {x.kmer for x in r.solid.collect()} == {km for km, n in want.items() if min(n.get("x", 0), n.get("y", 0)) >= 2 and km != "AAAA"}
    assert r.properties["banks"] == ["x", "y"] and r.properties["n_distinct"] == len(want)
    assert run(seqs, 4).properties["thresholds"][0] >= 3
    cut = histogram.bank_cutoffs(counting.count_banks(seqs, 4, "sample"), ["x", "y"])
    assert set(cut) == {"x", "y"} and min(cut.values()) >= 3


def test_refilled_parts(spark):
    bins = spark.createDataFrame([(f"b{i}", 3) for i in range(4)], "bin string, size long")
    parts = lambda **x: [r.part for r in minimizers.grouped_partitions(bins, 2, ["bin"], **x).orderBy("bin").collect()]
    assert parts(rule="refill") == [0, 0, 0, 1] and parts() == [0, 0, 1, 1]
    many = spark.createDataFrame([(f"b{i:02}", s) for i, s in enumerate([9, 1, 9, 1, 1, 9, 9, 5])], "bin string, size long")
    assert [r.part for r in minimizers.grouped_partitions(many, 3, ["bin"], "refill").orderBy("bin").collect()] == [0, 0, 0, 1, 1, 1, 1, 2]
    with pytest.raises(ValueError):
        minimizers.grouped_partitions(bins, 2, ["bin"], rule="refill", most=3)


def test_samples_grow_until_they_are_enough(spark):
    import random

    rnd = random.Random(2)
    seqs = spark.createDataFrame([(i, "".join(rnd.choice("ACGT") for _ in range(120))) for i in range(800)], "id long, seq string")
    shares = []
    for enough in (1, 300, 10**9):
        bins, share = minimizers.sampled_bins(seqs, 9, 3, enough, "id")
        shares.append(share)
        assert bins.agg(F.sum("size")).first()[0] == pytest.approx(800 * 112, rel=0.35)
    assert shares[0] < shares[1] < shares[2] == 1.0
    supers = minimizers.super_kmers(seqs, 9, 3)
    few = spark.createDataFrame([("AAC", 10)], "bin string, size long").withColumn("part", F.lit(0))
    assert minimizers.route(supers, few, unseen=7).count() == supers.count() > minimizers.route(supers, few).count() > 0


def test_equal_super_kmers_are_spread(spark):
    hot = spark.createDataFrame([("A" * 60,)] * 3000 + [("ACGTTGCAAC",)] * 5, "seq string").repartition(6)
    got = {r.kmer: r.n for r in counting.count_through_super_kmers(hot, 5, 3).collect()}
    assert got == {r.kmer: r.n for r in counting.count_kmers(hot, 5).collect()} and got["AAAAA"] == 3000 * 56
    runs = minimizers.super_kmers(hot, 5, 3).groupBy("minimizer", "seq").count()
    assert runs.count() <= 10


def test_banned_minimizers_under_a_hash(spark):
    seqs = spark.createDataFrame([("".join("ACGT"[(i * i + i // 3) % 4] for i in range(200)),)], "seq string")
    rows = minimizers.minimizers(seqs, 9, 4, ban_aa=True, hashed=True, flags=True).collect()
    bad = lambda m: "AA" in m[1:]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    digits = lambda s: s.translate(str.maketrans("ACTG", "0123"))
    code = lambda s: int(digits(s), 4)
    from basewise.functions.hashing import mix64
    import numpy as np

    for r in rows:
        found = []
        for j in range(6):
            w = r.kmer[j : j + 4]
            c = min(w, rc(w), key=digits)
            found.append(((1 << 64) - 1 if bad(c) else int(mix64(np.array([code(c)], np.uint64))[0]), -j, "GGGG" if bad(c) else c, c != w))
        best = min(found)
        assert (r.minimizer, r.minimizer_at, r.minimizer_reversed, r.minimizer_tied) == (best[2], r.pos - best[1], best[3], sum(x[0] == best[0] for x in found) > 1)


def test_admitted_beyond_the_broadcast(spark, monkeypatch):
    seqs = spark.createDataFrame([("ACGTACGTTTACG",), ("ACGTN",)], "seq string")
    listed = counting.count_kmers(seqs, 4).where("n > 1").select("kmer")
    want = sorted(map(tuple, counting.count_kmers(seqs, 4).where("n > 1").collect()))
    for limit in (10**6, 0):
        monkeypatch.setattr(counting, "BROADCAST_KMERS", limit)
        assert sorted(map(tuple, counting.count_admitted(seqs, listed, 4).collect())) == want and want


def test_one_filter_for_many_groups(spark):
    names = [f"g{i}" for i in range(130)]
    rows = spark.createDataFrame([(f"k{i * 7 % 50}", names[i % 130]) for i in range(900)] + [("odd", "no group"), (None, "g1")], "key string, bank string")
    bits, hashes = sketches.bloom_size(900, 16)
    table = sketches.bloom_group_table(rows, "key", "bank", names, bits, hashes)
    found = {r.key: set(r.groups) for r in sketches.bloom_groups_of(rows, "key", table, names, bits, hashes).collect()}
    held = {}
    for r in rows.where("key is not null and bank != 'no group'").collect():
        held.setdefault(r.key, set()).add(r.bank)
    assert all(found[k] >= g for k, g in held.items())
    assert sum(len(found[k] - held.get(k, set())) for k in found) < 30


def test_cutoffs_of_banks(spark):
    rows = [("a", f"k{i}", 1) for i in range(90)] + [("a", f"m{i}", 8 + i % 3) for i in range(60)] + [("b", f"k{i}", 2) for i in range(9)]
    table = spark.createDataFrame(rows, "bank string, kmer string, n long")
    each = histogram.bank_cutoffs(table, ["a", "b", "none"])
    assert each["a"] == histogram.auto_cutoff(histogram.histogram(table.where("bank = 'a'")), floor=3).cutoff and each["none"] == 3 and list(each) == ["a", "b", "none"]
    assert {r.bank: r.cutoff for r in histogram.bank_cutoff_table(table).collect()} == {b: each[b] for b in "ab"}


def test_counts_leave_tasks_once_per_kmer(spark, reads):
    """A task keeps one count for each possible short k-mer, and sorts a bounded number of long ones, however many sequences it has."""
    from basewise.operators import packed

    bank = banks.from_strings(spark, [*reads, None, "", "acgtNACGTT"] * 3).coalesce(1)
    parts = packed.code_counts(bank, 5)
    assert parts.count() == parts.select("code").distinct().count() and packed.HELD <= 1 << 20 and packed.CHUNK <= 1 << 18
    assert rows(counting.task_counts(bank, 5)) == rows(counting.count_kmers(bank, 5)) == set(brute([r.upper() for r in [*reads, "", "acgtNACGTT"] * 3], 5).items())
    named = bank.withColumn("bank", F.when(F.col("seq_id") % 2 == 0, F.lit("even")))
    assert rows(counting.count_banks(named, 5, "bank").groupBy("kmer").agg(F.sum("n"))) == rows(counting.count_kmers(bank, 5))


def test_weighted_count_min(spark):
    one = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2, "x string")
    parts = spark.createDataFrame([("a", 3), ("b", 2), ("a", 2)], "x string, n long")
    table = sketches.count_min_table(parts, "x", 3, 64, n="n")
    assert rows(table) == rows(sketches.count_min_table(one, "x", 3, 64))
    assert rows(sketches.count_min_estimate(parts, "x", table, 3, 64)) == {("a", 5), ("b", 2)}


def test_minimizer_totals_and_parts_without_dealing(spark, reads, tmp_path):
    from basewise.sources import counts

    bank = banks.from_strings(spark, [*reads, None, "", "NN", "A" * 8, "ACGTACGTACGTNACGTACGTACGT"])
    supers = minimizers.super_kmers(bank, 9, 4)
    totals = minimizers.minimizer_totals(bank, 9, 4)
    assert rows(totals) == rows(supers.groupBy("minimizer").agg(F.count("*"), F.sum("n_kmers")))
    for text, own in supers.toPandas().groupby("seq_id"):
        assert sorted(own["run_id"]) == list(range(len(own)))
    bins = totals.select(F.col("minimizer").alias("bin"), F.col("n_kmers").alias("size"))
    table = minimizers.grouped_partitions(bins, 3, ["bin"])
    dealt, placed, summed = minimizers.route(supers, table), minimizers.route(supers, table, deal=False), minimizers.route(totals, table, deal=False)
    assert rows(dealt) == rows(placed) and placed.rdd.getNumPartitions() == supers.rdd.getNumPartitions()
    assert rows(minimizers.partition_stats(dealt)) == rows(minimizers.partition_stats(summed))
    for i, routed in enumerate((dealt, summed)):
        counts.write_partition_info(routed, str(tmp_path / f"info{i}"))
    assert rows(counts.read_partition_info(spark, str(tmp_path / "info0"))) == rows(counts.read_partition_info(spark, str(tmp_path / "info1")))
    counts.write_super_kmers(placed, str(tmp_path / "parts"))
    back = counts.read_super_kmers(spark, str(tmp_path / "parts"))
    assert rows(back.select(placed.columns)) == rows(placed)
