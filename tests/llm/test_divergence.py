"""Operator 13 against plain Python, and on odd rows."""

import collections
import random
import re

import numpy as np
import pytest

from basewise.llm import divergence

SCHEMA = "text string, lang string, source string"


def brute(rows, min_docs=10):
    docs, count, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        own = [g for g in groups if g[0] == lang]
        n = {g: {t: count[g][t] for t in kept} for g in own}
        n[lang] = {t: sum(n[g][t] for g in own) for t in kept}
        p = {g: {t: 1 + 10**9 * (c + 2) // (sum(n[g].values()) + 2 * len(kept)) for t, c in n[g].items()} for g in n}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in own:
            pairs = [(h[1], sum(f(p[g][t], p[h][t]) for t in kept)) for h in own if h != g]
            terms = [(t, f(p[g][t], p[lang][t])) for t in kept if n[g][t] and p[g][t] > p[lang][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(*g, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def corpus(seed, n, sources, words):
    rnd = random.Random(seed)
    vocabulary = [rnd.choice(["w", "W", "é", "日本", "x'y", "ÀÉ", "a_"]) + chr(97 + i % 26) * (1 + i // 26) for i in range(words)]
    rows = []
    for _ in range(n):
        k = min(rnd.randrange(sources), rnd.randrange(sources))
        some = [vocabulary[min(len(vocabulary) - 1, int(rnd.expovariate(1 / (10 + k))))] for _ in range(rnd.randint(0, 60))]
        rows.append((rnd.choice([" ", "\n", ". ", "\t3"]).join(some), rnd.choice(["en", "de", "zz"]), f"source{k}"))
    return rows


@pytest.mark.parametrize("terms_of, groups_of, held", [(1024, 128, 400_000), (5, 3, 40), (1, 1, 1)])
def test_against_plain_python(spark, monkeypatch, terms_of, groups_of, held):
    monkeypatch.setattr(divergence, "HELD", held)
    n = 60 if held == 1 else 250
    rows = corpus(held, n, 4 if held == 1 else 8, 40) + [("", "en", "silent"), (None, None, None), ("rare words only", "one", "a"), ("other rare words", "one", "b"), (None, "alone", "x"), ("!!!", "en", "")]
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), terms_of=terms_of, groups_of=groups_of)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and {r[2] for r in want} == {"pair", "term"}
    assert [r for r in want if r[0] == "one"] == [("one", "a", "pair", "b", 0, 1), ("one", "b", "pair", "a", 0, 1)]


def test_hot_source_ties_and_odd_columns(spark):
    rows = [("same words here", "en", "hot")] * 400 + [("same words here", "en", f"s{i}") for i in range(12)] + [("été " * 3 + "ÉTÉ Same", "en", "hot")] * 10 + [("x" * 300_000 + " same " * 10_000, "en", "s1")]
    docs = spark.createDataFrame([(*r, 1, "n", "p") for r in rows], SCHEMA + ", n int, term string, lang2 string")
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == brute(rows)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_pair_sums_by_chunks(monkeypatch):
    rng = np.random.default_rng(3)
    p, q = rng.integers(1, 10**9, (9, 13)), rng.integers(1, 10**9, (4, 13))
    want = lambda a, b: [[sum((int(x) - int(y)) ** 2 // (int(x) + int(y)) for x, y in zip(r, s)) for s in b] for r in a]
    for chunk in (1, 30, 1 << 21):
        monkeypatch.setattr(divergence, "CHUNK", chunk)
        assert divergence.pair_sums(p, q).tolist() == want(p, q)
        assert np.triu(divergence.pair_sums(p), 1).tolist() == np.triu(np.array(want(p, p)), 1).tolist()


def test_large_counts_are_exact(spark):
    big = spark.createDataFrame([(10**17, 3 * 10**17 + 7)], "n long, size long").select(divergence._share("n", "size")).first()[0]
    assert big == 1 + 10**9 * (10**17 + 2) // (3 * 10**17 + 7)
