"""Operator 11 against all pairs, and on odd rows."""

import math

import numpy as np
import pytest

from basewise.llm import embeddings

COLUMNS = "vec_id long, label int, embedding array<float>"


def brute(rows, least=0.93):
    """(n_links, component_id) of each row, by comparing all pairs; rows are (vec_id, label, embedding)."""
    good = [label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, label, e in rows]
    unit = [np.array(e, np.float64) / np.abs(e).max() if ok else None for (_, _, e), ok in zip(rows, good)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links = [
        [j for j in range(len(rows)) if j != i and good[i] and good[j] and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(rows))
    ]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids, default=None)))
    return out


def planted(seed, width=64, groups=12, label=lambda g: g % 3):
    """Groups around a centre, from loose to tight, so that many cosines lie near the least one."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        centre = rng.normal(size=width)
        for _ in range(int(rng.integers(1, 30))):
            rows.append((len(rows), label(g), (centre + rng.normal(size=width) * rng.uniform(0.1, 0.35)).astype("f4").tolist()))
    return rows


@pytest.mark.parametrize("block, bucket_rows, width", [(1024, None, 64), (5, None, 64), (7, 2, 48), (1024, 1, 3)])
def test_links_against_all_pairs(spark, block, bucket_rows, width):
    rows = planted(block + width, width, label=lambda g: 1)
    rows += [(1000 + i, v[1], v[2]) for i, v in enumerate(rows[:9])] + [(2000 + i, v[1], [3.5 * x for x in v[2]]) for i, v in enumerate(rows[:5])] + [(3000 + i, 2, v[2]) for i, v in enumerate(rows[:5])]
    rows += [(4000 + i, 1, rows[3][2]) for i in range(40)]
    found = embeddings.near_duplicate_embeddings(spark.createDataFrame(rows, COLUMNS).repartition(3), block=block, bucket_rows=bucket_rows).collect()
    want = brute([(i, label, np.array(e, "f4").astype(float).tolist()) for i, label, e in rows])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_pairs_at_the_least_cosine_meet():
    for width, rows in ((64, 5_000), (64, 3_000_000), (100, 10_000), (768, 10**9)):
        tables, functions = embeddings.plan_tables(rows, width)
        share = embeddings.meeting_share(width, functions, 0.93, pairs=1000)
        assert (1 - share) ** tables < 1e-3 and (functions > 1) == (rows > 4096 * 256)


def test_hadamard_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = embeddings.hadamard(x) / 4
    assert np.allclose(y @ y.T, x @ x.T) and np.allclose(embeddings.hadamard(y) / 4, x)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, 1, None), (2, 1, []), (3, 1, [0.0, -0.0]), (4, 1, [1.0, None]), (5, 1, [inf, 1.0]), (6, 1, [nan, 1.0]), (7, None, [1.0, 1.0]), (8, None, [1.0, 1.0]), (9, 1, [1.0, 1.0]),
        (10, 1, [1.0, 1.0, 0.0]), (11, 1, [1.0, 1.01]), (None, 1, [2.0, 2.0]), (11, 1, [1.0, 1.0]), (12, 1, [1e-30, 1e-30]), (13, 1, [1e38, 1e38]), (14, 1, [-1.0, -1.0]), (15, 1, [5.0]), (16, 1, [5.0]), (17, 2, [-0.0, 1.0]), (18, 2, [0.0, 1.0]),
        (None, 3, [1.0, 2.0]), (1, 1, None), (1, 1, None),
    ]
    clash = "vec_id long, label int, embedding array<float>, class string, codes int, digest string, copies int"
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], clash)
    found = embeddings.near_duplicate_embeddings(df)
    assert found.columns == ["vec_id", "label", "n_links", "component_id", "kept"]
    key = lambda t: tuple(-1 if x is None else x for x in t)
    want = [(i, n, c) for i, n, c in brute(rows)]
    want = [(i, n, i if n == 0 else c) for i, n, c in want]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found.collect()), key=key) == sorted(want, key=key)
    assert embeddings.near_duplicate_embeddings(df.limit(0)).count() == 0
    wide = spark.createDataFrame([("b", "x", [1e-200, 1e-200]), ("a", "x", [1e200, 1e200]), ("c", "y", [1.0, 1.0])], "vec_id string, label string, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_embeddings(wide).collect()) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]
    whole = spark.createDataFrame([(1, "x", [1, 2]), (2, "x", [2, 4])], "vec_id int, label string, embedding array<int>")
    assert [r.n_links for r in embeddings.near_duplicate_embeddings(whole).collect()] == [1, 1]
