"""The ten operators against brute force, and on nulls, empty texts, repeated rows, empty tables and odd columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewise.llm import components, decontamination, encoding, packing, passages, quality_rules, sequences, sharding, simhash, site_quality, viterbi, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(11)
WORDS = ["the", "of", "Paris", "and", "runs", "42", "km", "blue,", "sky.", "Zürich", "日本", "x!!", "a|b"] + ["w" + str(i) for i in range(300)]


#: Columns that clash with names inside the operators.
ODD = ("bucket", "size", "fp", "hash", "id", "item", "pos", "quality", "n", "score", "shard", "_leak", "_spans", "_gone", "_q", "_text", "_id", "_fp", "_cut", "b", "a", "x.y", "words", "key", "base", "win", "n_pieces")


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a long text, equal rows, a null id, and extra columns with the operators' own names."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, prose(30_000)), (6, prose(60)), (6, "again"), (7, prose(80)), (7, prose(80)), (None, prose(70)), (8, "dup text here"), (8, "dup text here"), (9, "dup text here")]
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOC).withColumns({c: F.lit("own") for c in ODD})


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 9 quality rules ---------------------------------------------------------------------------------


def base_counts(text):
    w, t = split(text), text or ""
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def brute_llr(rows, trusted, buckets=1 << 18, a=10.0):
    """Mean bucket weight of each text, with counts in plain Python; a pair's hash is the chained XXH64 of the words' hashes."""
    import struct

    import xxhash

    def grams(text):
        w = split(text)
        one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        two = [xxhash.xxh64_intdigest(struct.pack("<Q", y), xxhash.xxh64_intdigest(struct.pack("<Q", x), 42)) for x, y in zip(one, one[1:])]
        return [(h - (1 << 64) if h >> 63 else h) % buckets for h in one + two]

    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        g = grams(t)
        raw.update(g)
        if i in trusted:
            target.update(g)
    ratio = sum(target.values()) / max(1, sum(raw.values()))
    out = []
    for i, t in rows:
        g = grams(t)
        out.append((i, sum(round(np.log((target[b] + a) / (raw[b] * ratio + a)) * (1 << 20)) for b in g), len(g)))
    return out


def test_quality_matches_brute_force(spark):
    texts = [prose(rnd.randint(0, 300)) for _ in range(30)] + ["a b c\na b c\nx " * 30, "", None, "JUNK!! MORE!! STUFF!! " * 40, "x\n\ny\nx\n \n", "a b a b", "a a a a", "\u00a0 é\x0b日本\x1f語\x85 z"] + [" ".join(rnd.choice("abcd") for _ in range(n)) for n in (5, 40, 300)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i,) for i in range(0, 30, 2)], "doc_id long")
    got = {r.doc_id: r for r in quality_rules.score_quality(docs, labels).select("doc_id", "quality.*").collect()}
    for i, total, n in brute_llr(list(enumerate(texts)), set(range(0, 30, 2))):
        r, base = got[i], base_counts(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert r.n_grams == n and abs(r.llr * max(1, n) * (1 << 20) - total) <= n
        if abs(total - n * round(quality_rules.THRESHOLD * (1 << 20))) > n:
            assert r.kept == (not r.base_failed and total >= n * round(quality_rules.THRESHOLD * (1 << 20)))
    assert sorted(r.doc_id for r in quality_rules.filter_quality(docs, labels).collect()) == sorted(i for i, r in got.items() if r.kept)


def test_all_trusted_documents_count(spark):
    docs = table(spark, [prose(120) for _ in range(40)])
    labels = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long")
    few, many = ({r.bucket: r.weight for r in quality_rules.bucket_weights(docs, quality_rules.trusted_ids(labels, n), 1 << 10, 10.0).collect()} for n in (100, 3))
    assert few == many and any(few.values())


def test_toxic_documents_are_no_target(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, 1, 1), (4, 1, 0), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(r.trusted_id for r in quality_rules.trusted_ids(labels).collect()) == [1, 2]
    assert sorted(r.trusted_id for r in quality_rules.trusted_ids(labels.drop("toxic"), 1).collect()) == [1, 2, 3, 4]


def test_quality_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long")
    got = quality_rules.filter_quality(odd, none)
    assert got.columns == odd.columns and {r.quality for r in got.collect()} == {"own"}
    assert sorted(str(r.doc_id) for r in got.collect()) == ["5", "6", "7", "7", "None"]
    assert quality_rules.filter_quality(odd.limit(0), none).count() == 0


def test_windows_of_one_prefix_are_told_apart(spark):
    low = 1 << 62  # two bits hold the positions of three windows, so this and low + 1 share their upper bits
    rows = [([5, 5 + low, 7], 0), ([5, 5 + low, 5], 5), ([5, 5 + low, 5 + low], 4), ([9, 9, 9], 5), ([1, 2, 3], 0)]
    df = spark.createDataFrame(rows, "win array<long>, want long")
    df = df.withColumn("packed", quality_rules.packed(F.col("win")))
    got = df.select(quality_rules.repeat_words(F.col("win"), F.col("packed")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


# --- 4 sharding --------------------------------------------------------------------------------------


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, fill = (low + high) // 2, 1, 0
        for s in sizes:
            used, fill = (used, fill + s) if fill + s <= mid else (used + 1, s)
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_shards_are_minimax(spark, shards):
    texts = [prose(rnd.randint(0, 40)) for _ in range(60)]
    texts += [texts[3]] * 20 + [None, "", None]
    rnd.shuffle(texts)
    got = sharding.assign_shards(table(spark, texts), shards).collect()
    groups = collections.OrderedDict()
    for t in texts:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 8
    load, slots, home = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        t = texts[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        home[t].add(r.shard)
    assert len(got) == len(texts) and max(load.values()) == brute_capacity(list(groups.values()), shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in home.values()) and max(load) < shards


def test_shards_odd_rows(spark, odd):
    got = sharding.assign_shards(odd, 4).collect()
    assert len(got) == 13 and all(0 <= r.shard < 4 for r in got)
    assert sharding.assign_shards(odd.limit(0), 4).count() == 0


# --- 6 simhash ---------------------------------------------------------------------------------------


def brute_components(fps, bits=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("leaves", [40, 10_000])
def test_trie_join_finds_all_links(spark, leaves):
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = sorted({*base, 0, 1, 2**64 - 1, *(b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for b in base[:20] for _ in range(3)), *((base[0] >> 6 << 6) | i for i in range(64))})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.linked_fingerprints(df, leaves=leaves).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    want, at = brute_components(fps), {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))
    for _ in range(len(fps)):
        before = list(root)
        for a, b in links:
            m = min(root[at[a]], root[at[b]])
            root[at[a]] = root[at[b]] = m
        if before == root:
            break
    assert root == want


def test_a_node_is_in_few_pairs(spark):
    """At depth d a full trie has d + 1 pairs to a node, itself included."""
    fps = spark.range(1 << 8).select(F.shiftleft("id", 56).alias("fp"))
    nodes = fps.groupBy(simhash._prefix(8).alias("node")).agg(F.count("*").alias("n"))
    start = spark.createDataFrame([(0, 0, 0, 256, 256)], "a long, b long, differing int, na long, nb long")
    pairs = simhash._children(simhash._children(start, fps.groupBy(simhash._prefix(4).alias("node")).agg(F.count("*").alias("n")), 4, simhash.budget(4, 3)), nodes, 4, simhash.budget(8, 3))
    assert pairs.count() == 256 + 256 * 8 // 2 and simhash.budget(32, 3) == 1 and simhash.budget(33, 3) == 3
    # three differing bits in either half, or one in one and two in the other
    spread = [(1 << 40) | (1 << 50) | (1 << 60), 7, (1 << 40) | 3, (1 << 40) | (1 << 63) | 1]
    for bits in spread:
        both = spark.createDataFrame([(5,), (5 ^ (bits - (1 << 64) if bits >> 63 else bits),)], "fp long")
        assert simhash.linked_fingerprints(both, leaves=1).distinct().count() >= 1


def test_fingerprints_and_components(spark, odd):
    def fp(text):
        import xxhash

        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = odd.select("doc_id", "text").collect()
    got = simhash.near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in got) == sorted((str(r.doc_id), fp(r.text)) for r in rows)
    fps = [fp(r.text) for r in rows]
    comp, least = brute_components(fps), {}
    for r, c in zip(rows, comp):
        least[c] = min(least.get(c, 10**9), r.doc_id if r.doc_id is not None else 10**9)
    want = sorted((str(r.doc_id), least[c] if least[c] < 10**9 else None) for r, c in zip(rows, comp))
    assert sorted(((str(r.doc_id), r.component_id) for r in got), key=str) == sorted(want, key=str)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(comp))
    one, two, three = prose(90), prose(95), prose(85)
    few = lambda rows: [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    got = few([(5, one), (5, two), (3, two), (None, three)])
    assert sorted(got, key=str) == sorted([(5, one), (3, two), (None, three)], key=str)
    assert sorted(few([(5, one), (5, two)])) == sorted([(5, one), (5, two)])
    assert sorted(few([(None, one), (None, one), (None, two)]), key=str) == sorted([(None, one), (None, two)], key=str)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 120)}}


# --- 5 passages --------------------------------------------------------------------------------------


def test_chain_scores_match_brute_force():
    for _ in range(30):
        n = rnd.randint(1, 25)
        b, a = (np.array([rnd.randint(0, 60) for _ in range(n)]) for _ in range(2))
        order = sorted(range(n), key=lambda i: (b[i], -a[i]))
        best = [1.0] * n
        for x, i in enumerate(order):
            for j in order[:x]:
                if b[j] < b[i] and a[j] < a[i]:
                    best[i] = max(best[i], 1 + best[j] - passages.GAP_COST * (b[i] - b[j] + a[i] - a[j]))
        path = passages.chain(b, a)[0]
        score = 1.0 + sum(1 - passages.GAP_COST * (b[j] - b[i] + a[j] - a[i]) for i, j in zip(path, path[1:]))
        assert all(b[i] < b[j] and a[i] < a[j] for i, j in zip(path, path[1:]))
        assert score == pytest.approx(max(best))


def test_planted_passages(spark):
    unique = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passage = [f"p{i}" for i in range(80)]
    fuzzy = [("zz" if i % 11 == 5 else w) for i, w in enumerate(passage)]
    texts = [unique("a", 90) + " " + " ".join(passage) + " " + unique("b", 40), unique("c", 30) + "\n" + " ".join(passage) + "\n" + unique("d", 60), " ".join(fuzzy), unique("e", 200), " ".join(passage[:45]) + " " + unique("f", 100), None, ""]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in passages.find_passages(docs).collect()}
    assert set(got) == {1, 2}
    assert (got[1].from_word, got[1].to_word, got[1].ref_id, got[1].ref_from, got[1].similarity) == (30, 110, 0, 90, 1.0)
    assert got[2].ref_id == 0 and got[2].n_words >= 75 and 0.8 <= got[2].similarity < 1
    cut = {r.doc_id: r for r in passages.cut_passages(docs).collect()}
    assert cut[0].text == texts[0] and cut[1].text == unique("c", 30) + "\n" + unique("d", 60) and cut[3].text == texts[3] and cut[1].n_chars == len(cut[1].text)


def edited(words, share, r):
    """The words with a share of them, but not the outer ones, substituted, deleted or preceded by a new one."""
    out = list(words)
    for i in sorted(r.sample(range(1, len(words) - 1), round(share * len(words))), reverse=True):
        new = f"z{r.getrandbits(40)}"
        out[i : i + 1] = r.choice([[new], [], [new, out[i]]])
    return out


def test_fuzzy_passages_are_recalled(spark):
    r, texts = random.Random(5), []
    fresh = lambda n: [f"u{r.getrandbits(40)}" for _ in range(n)]
    for n in (52, 56, 65, 80):
        for share in (0.10, 0.15, 0.18):
            for _ in range(10):
                passage = fresh(n)
                copy = edited(passage, share, r)
                if len(copy) >= 50:
                    texts += [fresh(60) + passage + fresh(60), fresh(60) + copy + fresh(60)]
    got = passages.find_passages(table(spark, [" ".join(t) for t in texts])).collect()
    assert all(x.ref_id == x.doc_id - 1 and x.doc_id % 2 and x.n_words >= 50 and x.similarity >= 0.8 for x in got)
    assert len({x.doc_id for x in got}) >= 0.97 * len(texts) / 2 > 50


def test_passages_whose_parts_are_older(spark):
    fresh = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    passage, fuzzy = fresh("p", 70), [("zz" if i in (3, 10, 60, 66) else w) for i, w in enumerate(fresh("p", 70))]
    bodies = [passage[:45], passage[25:], passage, passage, fuzzy]
    docs = table(spark, [" ".join(fresh(f"a{i}x", 60) + b + fresh(f"b{i}x", 60)) for i, b in enumerate(bodies)])
    got = passages.find_passages(docs).collect()
    assert {(r.doc_id, r.ref_id) for r in got} == {(3, 2), (4, 2)}
    assert {r.doc_id: r.n_words for r in got}[3] == 70


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["", None, "The the, (THE) ...", " a\tb\x0bc\x0cd\r\ne ", "é É \u00a0x...y 'q'", "x" * 900 + " " + "y" * 50, "w " * 500, "...", prose(400), "tail"]
    for chunk in (64, 1 << 18):
        got = [h.tolist() for h in passages.word_hashes(pa.array(["skipped", *texts])[1:], chunk)]
        flat = {}
        for t, h in zip(texts, got):
            w = passages.split_words(t)
            assert len(w) == len(h)
            for x, y in zip(w, h):
                assert flat.setdefault(x, y) == y
        assert len(set(flat.values())) == len(flat)


def test_edit_paths_are_cheapest():
    for _ in range(200):
        x, y = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 14))] for _ in range(2))
        cost = [[i + j if not i * j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                cost[i][j] = min(cost[i - 1][j - 1] + (x[i - 1] != y[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
        steps = passages.edit_path(x, y)
        assert (sum(s[0] for s in steps), sum(s[1] for s in steps)) == (len(x), len(y)) and sum(not s[2] for s in steps) == cost[-1][-1]
        for some in (steps, passages.edit_path(x, y, 3), passages.edit_path(x, y, 3, 9.0)):
            i = j = 0
            for dx, dy, same in some:
                assert same == (dx == dy == 1 and x[i] == y[j])
                i, j = i + dx, j + dy
            assert i <= len(x) and j <= len(y)


def test_whole_runs_are_found_though_their_parts_are_older(spark):
    fresh = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    passage = fresh("p", 120)
    bodies = {1: passage[:40], 2: passage[40:80], 3: passage[80:], 10: passage, 11: passage, 12: passage[10:110]}
    rows = [(i, " ".join(fresh(f"a{i}x", 60) + b + fresh(f"b{i}x", 60)), "en", None, 0) for i, b in bodies.items()]
    got = {}
    for r in passages.find_passages(spark.createDataFrame(rows, DOC)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.from_word, r.to_word))
    assert got == {11: set(range(60, 180)), 12: set(range(60, 160))}


def covered_words(texts, n=50):
    """Per text, the words inside runs of n words that an earlier text has: what exact passages must cover."""
    seen, out = set(), []
    for t in texts:
        w = passages.split_words(t)
        runs = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        out.append({i + d for i, g in enumerate(runs) if g in seen for d in range(n)})
        seen |= set(runs)
    return out


def test_exact_runs_against_brute_force(spark):
    """Boilerplate of all lengths, mixed: nearly every word of a repeated run of 50 words is covered, and nothing else in plenty."""
    r = random.Random(8)
    parts = [[f"q{k}x{i}" for i in range(r.choice([20, 35, 45, 55, 70, 120]))] for k in range(25)]
    texts = []
    for _ in range(150):
        body = []
        for _ in range(r.randint(1, 6)):
            body += r.choice(parts) if r.random() < 0.7 else [f"u{r.getrandbits(40)}" for _ in range(r.randint(5, 90))]
        texts.append(" ".join(body))
    want, got = covered_words(texts), collections.defaultdict(set)
    for x in passages.find_passages(table(spark, texts)).collect():
        got[x.doc_id] |= set(range(x.from_word, x.to_word))
    total = sum(map(len, want))
    assert total > 5000 and sum(len(w & got[i]) for i, w in enumerate(want)) >= 0.97 * total
    assert sum(len(got[i] - w) for i, w in enumerate(want)) <= 0.1 * total


def test_passages_odd_rows(spark, odd):
    assert passages.find_passages(odd).columns[0] == "doc_id"
    assert passages.cut_passages(odd).columns == odd.columns
    assert {None, 1, 2, 4, 5, 8} <= {r.doc_id for r in passages.cut_passages(odd).collect()}
    assert passages.find_passages(odd.limit(0)).count() == 0 and passages.cut_passages(odd.limit(0)).count() == 0
    long = prose(80)
    two = spark.createDataFrame([(1, long), (2, long), (2, "other text"), (3, "z " + long)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in passages.cut_passages(two).collect())
    assert got == [(1, long), (2, "other text"), (3, "z ")]


def test_passages_by_row_not_by_id(spark):
    p = prose(62)
    docs = spark.createDataFrame([(None, p + " y"), (2, p + " tail"), (1, p), (2, "zz " + p), (2, "other text")], "doc_id long, text string")
    got = sorted(((r.doc_id or 99), r.text) for r in passages.cut_passages(docs).collect())
    assert got == [(1, p), (2, "other text"), (2, "tail"), (2, "zz "), (99, "y")]
    found = passages.find_passages(docs)
    assert found.columns[0] == "doc_id" and sorted((str(r.doc_id), r.ref_id, r.n_words >= 62) for r in found.collect()) == [("2", 1, True), ("2", 1, True), ("None", 1, True)]


# --- 1 decontamination -------------------------------------------------------------------------------


def test_reparameterised_questions(spark):
    item = "a train leaves Boston at 60 mph and another train leaves Denver at 45 mph towards Boston so when do the two trains finally meet"
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "")], "item_id long, text string")
    swap = lambda *p: __import__("functools").reduce(lambda t, x: t.replace(*x), p, item)
    texts = ["Lead in. " + item + " and more", swap(("Boston", "Paris"), ("Denver", "Rome"), ("60", "80")), swap(("towards Boston", "towards Oslo"), ("leaves Boston", "leaves Paris"), ("Denver", "Rome")), prose(100), "has a short one inside it", None, ""]
    docs = table(spark, texts)
    for windows in (10**6, 0):  # with and without the broadcast
        got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(docs, bench, broadcast_windows=windows).collect()}
        assert set(got) == {(0, 1), (1, 1)}
        assert got[0, 1].exact and got[0, 1].n_changed == 0 and not got[1, 1].exact and got[1, 1].n_changed > 0
    assert sorted(r.doc_id for r in decontamination.drop_leaks(docs, bench).collect()) == [2, 3, 4, 5, 6]


def test_verbatim_copies_in_any_dress(spark):
    items = {
        1: "What is the boiling point of Gallium",
        2: "capital of Peru?",
        3: "Tom has 3 apples and 4 pears. Tom gives 2 of them to Mary. How many does Tom keep?",
        4: "Iron Lead Zinc Tin and Gold were sold by Ann Bob Cid Dan and Eve at noon.",
        5: "Hi there",
        6: " ".join(f"c{i}" for i in range(40)),
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    filler = "plain words go here and there without any sense at all "
    long = " ".join(f"w{i} x{i}" for i in range(20))
    texts = {
        10: ("x y. " + items[1], {1}), 11: (items[1].lower() + " " + filler, {1}), 12: (filler + items[3].upper(), {3}), 13: (items[3].replace(" ", "\t"), {3}),
        14: ("We asked them What is the boiling point of Gallium yesterday", {1}), 15: ("the Capital of Peru is Lima", {2}),
        16: (items[3].replace("Tom", "Ann").replace("Mary", "Bob").replace("3", "7").replace("4", "9"), {3}),
        17: (items[4], {4}), 18: (" ".join("Zoe" if w.strip(".") in "Iron Lead Zinc Tin Gold Ann Bob Cid Dan Eve".split() else w for w in items[4].split()), set()),
        19: (f"{items[3][:40]} {long} {items[3][40:]} {long}", set()), 20: (filler * 3, set()), 21: ("hi there", {5}), 22: ("oh hi there you", set()), 23: ("1 2 3 4 5 6 7 8 9 " * 40, set()),
        24: (" ".join([*items[6].split()[:20], "a whole sentence was put in here.", *items[6].split()[20:]]), {6}),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    for windows in (10**6, 0):
        got = collections.defaultdict(set)
        for r in decontamination.find_leaks(docs, bench, broadcast_windows=windows).collect():
            got[r.doc_id].add(r.item_id)
        assert {i: got[i] for i in texts} == {i: want for i, (_, want) in texts.items()}


def test_planted_items_against_brute_force(spark):
    """Every text that holds an item word for word is found, whatever the case and the white space, and no text without four fifths of one."""
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)] + ["Ada", "Bob", "Cid", "7", "12", "km", "the", "of"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [some(r.randint(5, 40)) for _ in range(40)]
    dress = [str, str.lower, str.upper]
    texts, want = [], {}
    for i in range(200):
        body = some(r.randint(0, 120))
        if i % 2:
            k = r.randrange(40)
            body += [r.choice(dress)(w) for w in items[k]] + some(r.randint(0, 60))
            want[i] = k
        texts.append(r.choice([" ", "\t", "\n", "  "]).join(body))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(table(spark, texts), bench).collect()}
    assert got == set(want.items())


def test_leaks_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "dup text here"), (None, "one")], "item_id long, text string")
    assert decontamination.drop_leaks(odd, bench).columns == odd.columns
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(odd, bench).collect()} >= {(8, 1), (9, 1), (4, None)}
    assert decontamination.find_leaks(odd, bench.limit(0)).count() == 0 and decontamination.find_leaks(odd.limit(0), bench).count() == 0


def test_leaks_by_row_not_by_id(spark):
    a, b, clean = (" ".join(f"{c}{i}" for i in range(10)) for c in "abc")
    half = spark.createDataFrame([(7, " ".join(a.split()[:7] + b.split()[-7:])), (8, a + " " + clean)], "doc_id long, text string")
    for ids in ((5, 5), (None, None), (5, 6)):
        bench = spark.createDataFrame([(ids[0], a), (ids[1], b)], "item_id long, text string")
        assert [(r.doc_id, r.item_id, r.coverage) for r in decontamination.find_leaks(half, bench).collect()] == [(8, ids[0], 1.0)]
        assert [r.doc_id for r in decontamination.drop_leaks(half, bench).collect()] == [7]
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    docs = spark.createDataFrame([(2, a, "x"), (2, "a wholly clean text " + clean, "y"), (None, a, "z"), (None, clean, "u")], "doc_id long, text string, key string")
    got = decontamination.drop_leaks(docs, bench)
    assert got.columns == docs.columns and sorted(r.key for r in got.collect()) == ["u", "y"]


# --- 2 WARC ------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    pages = [(1, "http://a/", "x"), (1, "http://a/", "x"), (2, None, "x"), (None, "u v", None), (5, "b", ""), (6, "c", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 50), (7, "é", "ü" * 5000)]
    df = spark.createDataFrame([(*p, "own") for p in pages], "page_id long, url string, html string, key string")
    got = warc.archive_pages(df).select("metadata.page_id", "response.*", F.col("metadata.refers_to").cast("long").alias("first"), F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("bytes"), "n_requests", "n_metadata").collect()
    seen = sorted((str(r.page_id), r.record_type, str(r.first), r.bytes, r.payload_digest) for r in got)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [("1", "revisit", "2", "x"), ("1", "revisit", "2", "x"), ("2", "response", "None", "x"), ("None", "revisit", "5", None), ("5", "response", "None", ""), ("6", "response", "None", pages[5][2]), ("7", "response", "None", pages[6][2])]
    assert seen == sorted((i, k, f, len((t or "").encode()), digest(t)) for i, k, f, t in want)
    assert all(r.n_requests == r.n_metadata == 1 for r in got)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_assembly_follows_links_both_ways(spark):
    rows = [("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("r2", "response", []), ("q2", "request", ["r2"]), ("q3", "request", ["r2"]), ("m9", "metadata", ["gone"]), ("w", "warcinfo", [])]
    records = spark.createDataFrame([(i, k, c, *([None] * 7)) for i, k, c in rows], warc.RECORD_SCHEMA)
    caps = warc.assemble(records)
    got = {r.capture_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id, r.n_requests) for r in caps.collect()}
    assert got == {"r1": ("q1", "m1", 1), "r2": ("q2", None, 2)}
    assert {r.record_id for r in warc.unassembled(records, caps).collect()} == {"q3", "m9", "w"}


# --- 3 site quality ----------------------------------------------------------------------------------


def test_sites_shrink_to_what_is_above(spark):
    good, bad = [prose(80) for _ in range(120)], ["JUNK!! %%% " * 40 + str(i) for i in range(120)]
    rows = [(i, t, "p", "h1", 0) for i, t in enumerate(good)] + [(200 + i, t, "p", "h2", 0) for i, t in enumerate(bad)] + [(900, good[0], "x", "rare", 0), (901, None, None, None, 0)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)] + [(200 + i, 0) for i in range(0, 120, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in site_quality.score_sites(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(120)) and not any(got[200 + i].kept for i in range(120)) and got[900].kept
    mean = sum(1 / (1 + np.exp(-r.evidence)) for r in got.values()) / len(got)
    assert abs(got[900].host_mean - mean) < 0.05 and got[5].host_mean > 0.9 > 0.1 > got[205].host_mean
    flat = site_quality.score_sites(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert all(r.probability == pytest.approx(0.5) and r.kept for r in flat)
    assert site_quality.score_sites(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0
    h, p = site_quality.url_site(F.lit("http://Ab.example/x/y?q"))
    assert tuple(spark.range(1).select(h, p).first()) == ("ab.example", "x")


def by_hand(rows):
    """host_mean, path_mean and log-odds of each (host, path, evidence), with shrinkage computed from the definitions."""
    odds = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    p = [1 / (1 + math.exp(-e)) for _, _, e in rows]
    n, mean = len(rows), sum(p) / len(p)
    groups = lambda key: [[q for q, r in zip(p, rows) if key(r) == g] for g in {key(r) for r in rows}]
    sq = lambda gs: sum(sum(g) ** 2 / len(g) for g in gs)
    paths, hosts = groups(lambda r: r[:2]), groups(lambda r: r[0])
    per_host = [groups_of for groups_of in ([[q for q, r in zip(p, rows) if r[0] == h and r[1] == path] for path in {r[1] for r in rows if r[0] == h}] for h in {r[0] for r in rows})]

    def k(groups_here, above_sq, n_above, n_sq):
        inside = max(0.0, sum(q * q for q in p) - sq(groups_here)) / max(1, n - len(groups_here))
        between = (max(0.0, sq(groups_here) - above_sq) - (len(groups_here) - n_above) * inside) / (n - n_sq) if n > n_sq else 0.0
        return min(1e9, inside / between) if between > 0 and inside > 0 else (1e9 if between <= 0 else 0.0)

    k_path = k(paths, sq(hosts), len(hosts), sum(sum(len(x) ** 2 for x in h) / sum(map(len, h)) for h in per_host))
    k_host = k(hosts, sum(p) ** 2 / n, 1, sum(len(h) ** 2 for h in hosts) / n)
    out = []
    for q, (host, path, e) in zip(p, rows):
        of_host, of_path = [x for x, r in zip(p, rows) if r[0] == host], [x for x, r in zip(p, rows) if r[:2] == (host, path)]
        host_mean = (sum(of_host) - q + k_host * mean) / (len(of_host) - 1 + k_host) if len(of_host) - 1 + k_host > 0 else mean
        path_mean = (sum(of_path) - q + k_path * host_mean) / (len(of_path) - 1 + k_path) if len(of_path) - 1 + k_path > 0 else mean
        out.append((host_mean, path_mean, e + odds(path_mean) - odds(mean)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_posteriors_by_hand(spark, seed):
    r = random.Random(seed)
    kinds = [lambda: prose(60), lambda: "JUNK!! %%% " * 20, lambda: prose(20) + " JUNK!! %%% " * r.randint(1, 5)]
    texts = [r.choice(kinds)() for _ in range(20)] + [kinds[i % 2]() for i in range(40)]
    docs = spark.createDataFrame([(i, t, None if i % 11 == 0 else f"h{i % 4}", f"p{i % 7}") for i, t in enumerate(texts)], "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(20 + i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    got = site_quality.score_sites(docs, labels, F.col("host"), F.col("path")).orderBy("doc_id").collect()
    want = by_hand([(g.host, g.path, g.evidence) for g in got])
    for g, (host_mean, path_mean, final) in zip(got, want):
        assert g.host_mean == pytest.approx(host_mean, abs=1e-4) and g.path_mean == pytest.approx(path_mean, abs=1e-4)
        assert g.probability == pytest.approx(1 / (1 + math.exp(-final)), abs=1e-3)


def test_sparse_sites_are_decided_by_their_host(spark):
    """A doubtful text on a path with no other document is kept on a host of good ones and rejected on a host of bad ones; alone on its host, its own evidence decides."""
    mixed = lambda: prose(rnd.randint(15, 25)) + " JUNK!! %%%" * rnd.randint(2, 4)
    good = [mixed() if i % 4 == 0 else prose(80) for i in range(300)]
    bad = [mixed() if i % 4 == 0 else "JUNK!! %%% " * 30 + f"w{i}" for i in range(300)]
    rows = [(i, t, "good.example", f"p{i % 30}") for i, t in enumerate(good)] + [(1000 + i, t, "bad.example", f"p{i % 30}") for i, t in enumerate(bad)]
    doubtful = [mixed() for _ in range(6)]
    for j, t in enumerate(doubtful):
        rows += [(5000 + 3 * j + i, t, h, f"only{j}") for i, h in enumerate(("good.example", "bad.example", f"lone{j}.example"))]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in rows if i < 5000], "doc_id long, quality int")
    got = {r.doc_id: r for r in site_quality.score_sites(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), labels, F.col("host"), F.col("path")).collect()}
    turned = 0
    for j in range(len(doubtful)):
        on_good, on_bad, alone = (got[5000 + 3 * j + i] for i in range(3))
        assert on_good.evidence == pytest.approx(on_bad.evidence) and on_bad.probability < alone.probability < on_good.probability
        turned += on_good.kept and not on_bad.kept
    assert turned >= 4
    right = [got[i].kept == (i < 1000) for i in got if i < 5000]
    alone = [(got[i].evidence >= 0) == (i < 1000) for i in got if i < 5000]
    assert sum(right) > sum(alone) + 30 and sum(right) > 0.97 * len(right)


def test_sites_odd_rows(spark, odd):
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, None), (8, 0, 0), (9, 0, 1), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    clash = odd.withColumns({c: F.lit(None).cast("string") for c in ("host", "path", "_h", "evidence", "weights", "p", "s", "hn", "label", "_id", "half")})
    got = site_quality.score_sites(clash, labels, F.col("source"), F.col("lang"))
    assert got.columns == ["doc_id", "host", "path", "evidence", "host_mean", "path_mean", "probability", "kept"]
    rows = got.collect()
    assert len(rows) == 13 and all(0 <= r.probability <= 1 for r in rows) and len({r.probability for r in rows if r.doc_id == 8}) == 1
    none = site_quality.score_sites(clash, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert len(none) == 13 and all(r.kept and r.probability == pytest.approx(0.5) for r in none)


# --- 7, 8, 10: tokens --------------------------------------------------------------------------------

TRICKY = ["", " ", "a", "x\n\u00a0\u00a0y", "x\r\n\u3000y\r\u00a0", "a  b", " a\n b", "a\n\nb", "x\n", "\nx", "tab\tand nbsp 　 end ", "it's don't 3.14 km", "日本語 ☃☃ 🤗x", "<|endoftext|>", "a <|endoftext|> b", "x" * 300, "WORD!! %%% a|b", "é" * 50, "foo,bar. Baz;\nQux?"]


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.vocabulary_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]


def test_encoder_is_exact(monkeypatch):
    spaces = " \n\t\r\x0b\x1c\x85\u00a0\u2003\u3000"
    texts = TRICKY + ["".join(rnd.choice(spaces + "ab.,é☃'1!A" * k) for _ in range(rnd.randint(0, 12 * k))) for k in (1, 3) for _ in range(3000)] + [prose(200)] * 3
    want = [x.tobytes() for x in library_ids(texts)]
    assert list(encoding.encoded(encoding.vocabulary_path(), texts)) == want
    monkeypatch.setattr(encoding, "MEMO_BYTES", 5)
    assert list(encoding.encoded(encoding.vocabulary_path(), texts)) == want


def test_sequences(spark, odd):
    texts = [*TRICKY, None, prose(5000), *[prose(rnd.randint(1, 60)) for _ in range(50)]]
    docs = table(spark, texts).orderBy(F.rand(1))
    manifest = sequences.write_sequences(docs, sequences.scratch(spark, "t"), length=64)
    got, start = {r.doc_id: r for r in sequences.read_documents(manifest).collect()}, 0
    for i, ids in enumerate(library_ids(texts)):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    stream = np.concatenate(library_ids(texts))
    before = 0
    for r in manifest.orderBy("part", "number").collect():
        f = sequences.SequenceFile(r.path + ".arrow")
        assert len(f) == r.n_rows == -(-r.n_tokens // 64)
        for k in range(len(f)):
            ids, mask, _ = f[k]
            n = sum(mask.to_pylist())
            assert len(ids) == 64 and (ids[:n] == stream[before + 64 * k : before + 64 * k + n]).all()
        before += r.n_tokens
    rolled = sequences.write_sequences(docs, sequences.scratch(spark, "t"), length=64, file_tokens=500)
    assert rolled.count() > manifest.count() and rolled.agg(F.max("n_tokens")).first()[0] < 30_000
    assert sorted(sequences.read_documents(rolled).collect()) == sorted(got.values())
    rolled = sequences.write_sequences(docs, sequences.scratch(spark, "t"), length=64, file_docs=7)
    assert rolled.agg(F.max("n_docs")).first()[0] == 7 and sorted(sequences.read_documents(rolled).collect()) == sorted(got.values())
    for kind in ("int", "string"):
        named = sequences.arrow_sequences(table(spark, texts[:9]).withColumn("doc_id", F.col("doc_id").cast(kind)))
        assert named.schema["doc_id"].dataType.simpleString() == kind and named.count() == 9
    assert sequences.arrow_sequences(odd).count() == 13 and sequences.arrow_sequences(odd.limit(0)).count() == 0


def test_best_fit_is_best_fit():
    for _ in range(50):
        lengths = sorted((rnd.randint(1, 60) for _ in range(rnd.randint(0, 60))), reverse=True)
        bins, offsets, fills = packing.best_fit(np.array(lengths, np.int64), 64)
        room = []
        for n in lengths:
            fit = [r for r in room if r >= n]
            if fit:
                room[room.index(min(fit))] -= n
            else:
                room.append(64 - n)
        assert sorted(64 - r for r in room) == sorted(fills.tolist())


@pytest.mark.parametrize("task_items", [50, 200_000])
def test_packing(spark, odd, monkeypatch, task_items):
    monkeypatch.setattr(packing, "TASK_ITEMS", task_items)
    texts = [*TRICKY, None, prose(3000), *[prose(rnd.randint(1, 400)) for _ in range(150)]]
    got = packing.pack_documents(table(spark, texts)).collect()
    ids, by_doc, by_seq = library_ids(texts), collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, x in enumerate(ids):
        pieces = sorted(by_doc[i])
        assert [p[0] for p in pieces] == list(range(-(-len(x) // 1024))) and sum(p[2] for p in pieces) == len(x) and all(p[2] == 1024 for p in pieces[1:])
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_seq) <= -(-sum(map(len, ids)) // 1024) * 1.05 + 2
    assert len({(r.doc_id, r.ids_crc32) for r in packing.pack_documents(odd.where("doc_id != 5")).collect()}) >= 8
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_viterbi_matches_the_library(spark, odd):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = encoding.vocabulary_path("piece_bpe_32k.model")
    pieces = viterbi.load_pieces(path)
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = TRICKY + ["▁x ▁▁y"] + ["".join(rnd.choice(" \nab.▁é☃'1") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    got = {r.doc_id: r.n_pieces for r in viterbi.count_tokens(table(spark, texts)).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    out = viterbi.count_tokens(odd)
    assert out.count() == 13 and {"doc_id", "n_pieces", "score", "bucket"} <= set(out.columns)
    assert {r.n_pieces for r in out.where("doc_id in (1, 2)").collect()} == {0}
    assert viterbi.count_tokens(odd.limit(0)).count() == 0


def test_passages_of_words_over_and_over_ask_for_few_spans(spark):
    """A run of two words over and over: spans and passages by its length in passages, not one for each place in it; all its words are found."""
    rng = np.random.default_rng(11)
    other = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**9, n))
    runs = [" ".join(["is onhe."] * 400) for _ in range(6)]
    docs = spark.createDataFrame([(i, f"{other(40)} {r} {other(40)}") for i, r in enumerate(runs)], "doc_id long, text string")
    linked = passages.chains(passages.matches(docs), passages.MIN_WORDS, span=35)
    spans = linked.where("span is not null").groupBy("b").count().collect()
    assert len(spans) == 6 and all(r[1] <= 800 // 35 * 2 for r in spans)
    found = passages.find_passages(docs).collect()
    assert all(r.ref_id == 0 for r in found) and len(found) <= 5 * 800 // 35 * 2
    for i in range(1, 6):
        assert set(range(40, 840)) <= {w for r in found if r.doc_id == i for w in range(r.from_word, r.to_word)}
