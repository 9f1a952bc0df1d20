"""Pruned pairs and the growing vocabulary against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from lexispark.operators import nearest, search

VECTORS = "id long, embedding array<double>"


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)


def clustered(rng, n, dim=8, centres=12, spread=0.05):
    middle = rng.normal(size=(centres, dim))
    return [(i, [float(x) for x in middle[i % centres] + spread * rng.normal(size=dim)]) for i in range(n)]


@pytest.mark.parametrize("spread, threshold, most", [(0.05, 0.97, 0.25), (5.0, 0.9, 1.0), (0.05, -1.0, 1.0)])
def test_pairs_against_all(spark, spread, threshold, most):
    rows = clustered(np.random.default_rng(1), 240, spread=spread)
    rows += [(900, rows[3][1]), (901, rows[3][1]), (902, [0.0] * 8), (903, None), (904, [1.0])]
    left = spark.createDataFrame(rows[:100] + rows[-5:], VECTORS)
    right = spark.createDataFrame(rows[60:], VECTORS)
    want = {}
    sound = lambda r: r[1] is not None and len(r[1]) == 8 and any(r[1])
    for a in filter(sound, rows[:100] + rows[-5:]):
        for b in filter(sound, rows[60:]):
            if (c := cosine(a[1], b[1])) >= threshold:
                want[str(a[0]), str(b[0])] = c
    how = {"pivots": 10, "rings": 3, "block": 20}
    got = {(r.left, r.right): r.similarity for r in nearest.within(left, right, threshold, **how).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert nearest.comparisons(left, right, threshold, **how) <= most * 104 * 188
    assert nearest.within(left, right.limit(0), threshold).count() == nearest.within(left.limit(0), right, threshold).count() == 0


def test_vectors_that_bounds_cannot_part_are_sent_seldom(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(rng.normal(size=(900, 16)))] + [(2000 + i, [1.0] * 16) for i in range(40)]
    df = spark.createDataFrame(rows, VECTORS)
    blocks = nearest.Blocks(df, 64, 16, 10)
    assert blocks.visits(1.0) > nearest.VISITS
    assert nearest._dealt(df, blocks.home, blocks.grid).count() == len(rows) * (nearest.GROUPS + nearest.COLUMNS)
    got = {(int(r.left), int(r.right)): r.similarity for r in nearest.within(df, df, 0.5, block=10).collect()}
    assert nearest.within(df, df, 0.5, block=10).count() == len(got)
    values = np.array([e for _, e in rows])
    units = values / np.linalg.norm(values, axis=1)[:, None]
    who, whom = np.nonzero(units @ units.T >= 0.5 - 1e-12)
    assert set(got) == {(rows[a][0], rows[b][0]) for a, b in zip(who, whom, strict=True)}
    assert all(abs(got[rows[a][0], rows[b][0]] - units[a] @ units[b]) < 1e-12 for a, b in zip(who[:500], whom[:500], strict=True))


def loop(candidates, terms, threshold):
    """Every candidate after those before it, as one thread would do it."""
    words, out = [(k, e) for k, e in terms], {}
    for i, _, name, e in sorted(candidates, key=lambda c: (c[1], c[0])):
        name = name.strip()
        exact = [k for k, _ in words if k.lower() == name.lower()]
        near = [(cosine(e, v), k) for k, v in words if e and v and cosine(e, v) >= threshold]
        if exact:
            out[i] = (min(exact), "exact")
        elif near:
            out[i] = (max(near)[1], "near")
        else:
            words.append((name, e))
            out[i] = (name, "new")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_growing_against_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    vectors = [[float(round(x, 2)) for x in e] for _, e in clustered(rng, 90, dim=4, centres=20, spread=0.25)]
    names = [f"{'N' if rng.random() < 0.5 else 'n'}ame {int(rng.integers(60))}" for _ in vectors]
    candidates = [(i, int(rng.integers(40)), f" {n} ", e) for i, (n, e) in enumerate(zip(names, vectors, strict=True))]
    candidates += [(1000 + i, 50 + i, candidates[i][2], candidates[i][3]) for i in range(20)] + [(2000, 5, "no vector", None), (2001, 6, "NO vector", None)]
    terms = [("name 3", vectors[7]), ("old", vectors[8]), ("none", None)]
    df = spark.createDataFrame(candidates, "cand_id long, place int, name string, embedding array<double>")
    known = spark.createDataFrame(terms, "keyword string, embedding array<double>")
    got = {r.cand_id: (r.keyword, r.kind) for r in search.grow_vocabulary(df, known, 0.93).collect()}
    want = loop(candidates, terms, 0.93)
    assert got == want
    assert {k for _, k in want.values()} == {"exact", "near", "new"}


def test_growing_in_batches_stores_no_pairs_of_one_direction(spark, monkeypatch):
    monkeypatch.setattr(search, "FIRST", 40, raising=False)
    sizes, keep = [], search.stored
    monkeypatch.setattr(search, "stored", lambda df, name: sizes.append((found := keep(df, name)).count()) or found)
    rng = np.random.default_rng(5)
    vectors = [[1.0, 0.0, round(float(rng.random()) / 8, 3)] if i % 3 else [0.0, 1.0, round(float(rng.random()) * 2, 3)] for i in range(500)]
    candidates = [(i, int(rng.integers(9)), f"name {int(rng.integers(30))}", e) for i, e in enumerate(vectors)]
    df = spark.createDataFrame(candidates, "cand_id long, place int, name string, embedding array<double>")
    known = spark.createDataFrame([], "keyword string, embedding array<double>")
    got = {r.cand_id: (r.keyword, r.kind) for r in search.grow_vocabulary(df, known, 0.97).collect()}
    assert got == loop(candidates, [], 0.97)
    assert max(sizes) <= 2 * len(candidates)


def test_a_chain_of_waiting_nodes_and_none(spark):
    chain = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}") for i in range(9)], "u string, v string")
    assert sorted(r.v for r in search._refused(chain).collect()) == ["01", "03", "05", "07", "09"]
    assert search._refused(chain.limit(0)).count() == 0
    empty = spark.createDataFrame([], "cand_id long, place int, name string, embedding array<double>")
    assert search.grow_vocabulary(empty, spark.createDataFrame([], "keyword string, embedding array<double>")).count() == 0


def test_frozen_vocabulary_with_repeats_and_ties(spark):
    terms = spark.createDataFrame([(f"k{i % 37}", [float(i % 37 % 5), float(i % 37 % 3), 1.0]) for i in range(40)] + [("tie", [1.0, 1.0, 1.0])], "keyword string, embedding array<double>")
    asked = spark.createDataFrame([(i, f" K{i}", [float(i % 7), float(i % 4), 0.5]) for i in range(30, 60)] + [(99, None, None)], "cand_id long, name string, embedding array<double>")
    held = [(r.keyword, r.embedding) for r in terms.collect()]
    got = {r.cand_id: (r.keyword, r.kind) for r in search.vocabulary_terms(asked, terms, 0.9).collect()}
    assert len(got) == 31
    for r in asked.where("name is not null").collect():
        near = [(cosine(r.embedding, e), k) for k, e in held if cosine(r.embedding, e) >= 0.9]
        exact = [k for k, _ in held if k == r.name.strip().lower()]
        best = max((s for s, _ in near), default=None)
        assert got[r.cand_id][1] == ("exact" if exact else "near" if near else "new")
        if not exact and near:
            assert got[r.cand_id][0] in {k for s, k in near if s > best - 1e-12}
