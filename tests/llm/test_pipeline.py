"""The pipeline's stages on real rows, and the entry's names."""

import collections

import corpus_pipeline
from basewise.llm import decontamination, passages, quality_rules, simhash
from basewise.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, len(QUERIES) + 1)]
    assert not set(ORACLES) - set(QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, SF).collect(), before.schema)
        assert docs.columns == columns
        seen.append(docs.count())
        if name == "quality rules":
            trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
            assert docs.count() == quality_rules.score_quality(before, trusted).where("quality.kept").count()
        elif name == "near-duplicates":
            groups = collections.Counter(r.component_id for r in simhash.near_duplicates(before).collect())
            assert docs.count() == len(groups) and {r.doc_id for r in docs.collect()} == set(groups)
        elif name == "substring dedup":
            cut = {r.doc_id for r in passages.find_passages(before).collect()}
            old = {r.doc_id: r.text for r in before.collect()}
            assert all(r.text == old[r.doc_id] or r.doc_id in cut for r in docs.collect())
        else:
            assert decontamination.find_leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert seen == sorted(seen, reverse=True) and seen[-1] > 50
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


def test_run_against_brute_force(spark, tmp_path):
    """All five stages over planted rows, against plain Python: rejected, copied, repeating and leaking documents, rows without an id, with one id, and without a text."""
    import random
    import zlib

    import xxhash
    from test_operators import base_counts, brute_components, brute_llr, library_ids

    rnd = random.Random(3)
    vocabulary = [f"{a}{b}{i}" for i in range(40) for a in "bdfgklmn" for b in ("a", "e", "i", "o")]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shingles = lambda w: [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []

    def fp(text):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles((text or "").lower().split())]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    passage, item = some(70), some(30)
    clean = [some(rnd.randint(80, 160)) for _ in range(30)]
    copies = [clean[0], clean[0], clean[4]]
    near = None
    while near is None or (fp(" ".join(near)) ^ fp(" ".join(clean[1]))).bit_count() > 3:
        near = list(clean[1])
        near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
    with_passage = [some(60) + passage + some(60) for _ in range(3)]
    with_item = [some(60) + [w.upper() for w in item] + some(60) for _ in range(2)]
    few, dull = some(30), ["same", "old", "words"] * 40
    odd = [" ".join(f"zz{rnd.randrange(9)}" for _ in range(90)) for _ in range(6)]
    texts = [" ".join(x) for x in [*clean, *copies, near, *with_passage, *with_item, few, dull]] + odd + ["", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, " ".join(some(70) + passage + some(20))), (None, " ".join(some(90))), (7, " ".join(some(100))), (8, " ".join(some(50) + item + some(50)))]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    trusted = set(range(0, 30, 2)) | {30, 34, 37}
    spark.createDataFrame([(i, int(i in trusted), 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item)), (2, " ".join(some(25)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # quality rules
    scores = brute_llr(rows, trusted)
    bar = round(quality_rules.THRESHOLD * (1 << 20))
    left = []
    for (i, t), (_, total, n) in zip(rows, scores):
        n_words, _, _, _, n_repeat = base_counts(t)
        good = n_words >= 50 and 100 * n_repeat <= 50 * n_words
        assert not good or abs(total - n * bar) > n
        if good and total >= n * bar:
            left.append((i, t))
    assert 30 <= len(left) < len(rows) - 8
    # one of each group of near-duplicates
    order = lambda r: (r[0] is None, r[0] or 0)
    groups = collections.defaultdict(list)
    for r, c in zip(left, brute_components([fp(t) for _, t in left])):
        groups[c].append(r)
    ranked = sorted((min(g, key=order) for g in groups.values()), key=order)
    assert len(ranked) <= len(left) - 4
    # passages that an earlier row has
    seen, cut = set(), []
    for i, t in ranked:
        w = t.split()
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {j for k, x in enumerate(runs) if x in seen for j in range(k, k + 50)}
        seen.update(runs)
        cut.append((i, " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert sum(len(a[1]) != len(b[1]) for a, b in zip(cut, ranked)) == 3
    # leaks, then pieces
    kept = [(i, t) for i, t in cut if " ".join(item) not in t.lower()]
    assert len(kept) == len(cut) - 3
    want = sorted((str(i), 0, 0, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(kept, library_ids([t for _, t in kept])) if len(x) <= 1024)
    assert len(want) == len(kept)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) + 1
    # no document at all
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
