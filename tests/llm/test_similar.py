from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm import similar
from tests.llm import brute


def changed(rng, words, share):
    words = list(words)
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_planted_copies(spark):
    rng = random.Random(11)
    texts = {}
    for i in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(150, 400))]
        texts[10 * i] = " ".join(words)
        texts[10 * i + 1] = changed(rng, words, 0.01)
        texts[10 * i + 2] = changed(rng, words, 0.3)
    want = brute.similar(texts)
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_documents_against_all_pairs(spark, sf01):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    want = brute.similar(texts)
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.read.parquet(f"{sf01}/documents.parquet")).collect()}
    assert got == want


def test_odd_rows(odd, empty):
    rows = similar.similar_documents(odd).collect()
    assert len(rows) == odd.count()
    of = {r.doc_id: r.component_id for r in rows}
    assert of[3] == of[4] == of[5] == 3
    assert (of[2], of[7]) == (1, 7)  # the long texts have four shingles, three of them shared
    kept = similar.drop_similar(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.doc_id for r in rows if r.doc_id is None or of[r.doc_id] == r.doc_id})
    assert similar.similar_documents(empty).count() == 0
    assert similar.drop_similar(empty).count() == 0


def test_rows_decide_where_doc_ids_repeat(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, x, "a"), (5, x, "b"), (5, y, "c"), (7, z, "d"), (None, z, "e"), (None, "alone", "f"), (5, y, "g")]
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string, note string").coalesce(1)).collect()
    assert sorted(r.note for r in kept) == ["a", "c", "d", "f"]


def test_rows_of_a_join_keep_their_numbers(spark, sf_dir):
    from lexispark.llm import common
    from tests.llm.test_exact_and_mix import joined

    docs = joined(spark, sf_dir)
    assert common.in_order(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id > 3").select("doc_id", "text")).inputFiles()[0].endswith("documents.parquet")
    rows = similar.similar_documents(docs).collect()
    kept = [r.doc_id for r in similar.drop_similar(docs).collect()]
    assert sorted(kept) == sorted(r.doc_id for r in rows if r.doc_id == r.component_id)


def test_crowded_keys_are_spanned(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    texts = {i: changed(rng, base, 0.01) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(similar, "CROWD", 7)
    assert {r.component_id for r in similar.similar_documents(df).collect()} == {0}


def test_spanning_connects_what_pairs_connect():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (4, 2)).astype(np.uint64)
    rows = np.repeat(base, 30, axis=0)
    for _ in range(18):
        rows[np.arange(120), rng.integers(0, 2, 120)] ^= np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)
    edges = similar.spanning(rows[:, 0].copy(), rows[:, 1].copy())
    apart = np.bitwise_count(rows[:, None] ^ rows[None]).sum(axis=2)

    def parts(pairs):
        root = list(range(120))
        for i, j in pairs:
            x, y = root[i], root[j]
            root = [x if r == y else r for r in root]
        return [root.index(r) for r in root]

    assert len(edges) < 120
    for limit in (20, 30, similar.CLOSE):
        assert parts([(i, j) for i, j in edges if apart[i, j] <= limit]) == parts([(i, j) for i in range(120) for j in range(i) if apart[i, j] <= limit])


def family(rng, n, low, high):
    """Texts on one template, most of them below the similarity of their neighbours."""
    base = [f"w{i}" for i in range(200)]
    return [changed(rng, base, rng.uniform(low, high)) for _ in range(n)]


def exact(spark, texts):
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = brute.similar(texts)
    assert got == want
    return sum(want[i] != i for i in want)


def test_all_pairs_of_a_template_family(spark):
    """pipeline: a forest over members that are not similar hides similar ones."""
    rng = random.Random(13)
    assert exact(spark, dict(enumerate(family(rng, 300, 0.012, 0.035)))) > 50


def test_all_pairs_at_the_threshold_and_of_short_texts(spark):
    """pipeline: every pair of similarity 0.8 or a little more is found, at any length."""
    rng = random.Random(14)
    texts = {}
    for i in range(0, 1200, 2):
        n = (5, 6, 9, 13, 24, 60, 150, 500)[i // 2 % 8]  # shingles
        words = [f"v{rng.randrange(10**6)}" for _ in range(n + 4)]
        cut = max(1, n // 5) if n < 24 else int(n * rng.uniform(0.15, 0.2))
        texts[i], texts[i + 1] = " ".join(words), " ".join(words[:-cut])
    assert exact(spark, texts) == 600


def test_blocks_of_a_crowded_key_meet(spark, monkeypatch):
    """pipeline: partners in different blocks of a key that holds many unrelated families."""
    rng = random.Random(15)
    line = [f"c{i}" for i in range(8)]
    texts = {}
    for i in range(60):
        own = [f"x{rng.randrange(10**6)}" for _ in range(6)]
        texts[i], texts[100 + i] = " ".join([*line, *own]), " ".join([*line, *own, "end"])
    monkeypatch.setattr(similar, "CROWD", 7)
    monkeypatch.setattr(similar, "OFTEN", 2)
    assert exact(spark, texts) == 60

    ids = sorted(texts)
    sets = [similar.shingles(texts[i]) for i in ids]
    hot, n = np.unique(np.concatenate(sets), return_counts=True)

    def pairs(crowd):
        docs = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array([texts[i] for i in ids])], ["row_id", "root", "text"])
        # At similarity 0.01 the prefix is the whole set, so the hashes of the common line are keys too.
        rows = pa.Table.from_batches(similar._prefixes(5, 0.01, hot, n, crowd)(iter([docs]))).sort_by([("key", "ascending"), ("part", "ascending")])
        out = pa.Table.from_batches(similar._across(0.01, 10**9)(iter(rows.combine_chunks().to_batches(50))))
        return set(zip(out["u"].to_pylist(), out["v"].to_pylist(), strict=True)), rows

    whole, _ = pairs(10**9)
    blocked, rows = pairs(7)
    assert blocked == whole == {(i, j) for i in ids for j in ids if i < j}
    assert max(Counter(zip(rows["key"].to_pylist(), rows["part"].to_pylist(), strict=True)).values()) < 30  # of 120


@pytest.mark.parametrize("low, high", [(0.8, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 1.0)])
def test_components_of_planted_pairs_by_similarity(spark, low, high):
    """pipeline: in each band of similarity, all components are those of all pairs."""
    rng = random.Random(int(1000 * low))
    texts, planted = {}, 0
    while planted < 60:
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.choice((40, 120, 400)))]
        other = changed(rng, words, rng.uniform(0.0, 0.05))
        x, y = (set(zip(*(t[k:] for k in range(5)), strict=False)) for t in (words, other.split()))
        if low <= len(x & y) / len(x | y) < high:
            texts[2 * planted], texts[2 * planted + 1] = " ".join(words), other
            planted += 1
    assert exact(spark, texts) == 60


def test_two_interleaved_clusters_under_crowded_keys(spark, monkeypatch):
    """pipeline: members of one cluster in different blocks of a key."""
    rng = random.Random(16)
    bases = [[f"{c}{i}" for i in range(120)] for c in "ab"]
    texts = {i: changed(rng, bases["AABBAA"[i % 6] == "B"], 0.01) for i in range(60)}
    monkeypatch.setattr(similar, "CROWD", 2)
    monkeypatch.setattr(similar, "OFTEN", 2)
    assert exact(spark, texts) == 58


@pytest.mark.parametrize("most", [1, 3, 50])
def test_groups_come_whole_or_in_pieces(most):
    """pipeline: no group that a task holds is larger than it may be, and no row is lost."""
    rng = np.random.default_rng(17)
    keys = np.sort(rng.integers(0, 40, 400) ** 2 // 30)
    rows = pa.table({"key": keys, "part": np.zeros(400, np.int32), "n": np.arange(400)})
    sizes, seen, order = Counter(keys.tolist()), [], []
    for size in (1, 7, 64, 400):
        seen.clear()
        order.clear()
        for columns, crowded in similar._grouped(iter([*rows.to_batches(size), rows.to_batches()[0].slice(0, 0)]), 2, most):
            here = Counter(columns[0].tolist())
            assert all((sizes[k] > most) == crowded and (crowded or n == sizes[k]) for k, n in here.items())
            assert not crowded or len(here) == 1
            seen += columns[2].tolist()
            order.append((columns[0][0], crowded))
        assert sorted(seen) == list(range(400))
        assert [k for k, crowded in order if crowded] == sorted(k for k, crowded in order if crowded)


def test_hashes_found_crowded_by_a_task(spark, monkeypatch):
    """pipeline: hashes that nobody counted as frequent are dealt to blocks, and give the same candidates."""
    rng = random.Random(18)
    line = [f"c{i}" for i in range(8)]
    rows = []
    for i in range(60):
        own = [f"x{rng.randrange(10**6)}" for _ in range(6)]
        rows += [(i, i, " ".join([*line, *own])), (100 + i, 100 + i, " ".join([*line, *own, "end"]))]
    rows += [(200 + i, 200, " ".join(line)) for i in range(30)]  # of one root: crowded, but nothing to compare
    docs = spark.createDataFrame(rows, "row_id long, root long, text string")
    none = np.array([], np.uint64), np.array([], np.int64)
    keyed = docs.mapInArrow(similar._prefixes(5, 0.8, *none, 10**9), similar._PREFIX)
    want = {tuple(r) for r in similar._candidates(keyed, 0.8).collect()}
    names, plain = [], similar.stored
    monkeypatch.setattr(similar, "CROWD", 7)
    monkeypatch.setattr(similar, "ROOM", 1)
    monkeypatch.setattr(similar, "stored", lambda df, name: (names.append(name), plain(df, name))[1])
    got = [tuple(r) for r in similar._candidates(keyed, 0.8).collect()]
    assert "crowded" in names
    assert len(got) == len(set(got)) and set(got) == want and {(i, 100 + i) for i in range(60)} <= want


def test_crowded_keys_of_signatures_are_dealt(spark, monkeypatch):
    """pipeline: the first search deals a crowded key to blocks, and many keys together still connect a group."""
    rng = random.Random(19)
    base = [f"w{i}" for i in range(300)]
    texts = [changed(rng, base, 0.005) for _ in range(60)]
    prints = np.array([similar.signature(similar.shingles(t)) for t in texts], np.uint64).view(np.int64)
    names = [f"f{t}" for t in range(similar.TABLES)]
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(prints.tolist())], "node long, " + ", ".join(f"{n} long" for n in names))
    monkeypatch.setattr(similar, "CROWD", 20)
    pairs = {tuple(r) for r in similar._met(nodes, names).collect()}
    assert all(u < v < 60 for u, v in pairs)
    root = list(range(60))
    for u, v in pairs:
        root = [root[u] if r == root[v] else r for r in root]
    assert len(set(root)) == 1


def test_a_common_line_lists_rows_not_pairs(spark):
    """pipeline: what a hash of many unrelated sets lists grows with its rows, and sketches leave the similar pairs."""
    rng = random.Random(20)
    line = [f"c{i}" for i in range(60)]
    sizes = {}
    for n in (50, 200):
        texts = []
        for _ in range(n):
            own = [f"x{rng.randrange(10**6)}" for _ in range(140)]
            texts += [" ".join([*line, *own]), " ".join([*line, *own, "end"])]
        ids = range(len(texts))
        sets = [similar.shingles(t) for t in texts]
        docs = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts)], ["row_id", "root", "text"])
        none = np.array([], np.uint64), np.array([], np.int64)
        rows = pa.Table.from_batches(similar._prefixes(5, 0.8, *none, 10**9)(iter([docs]))).sort_by([("key", "ascending"), ("part", "ascending")]).combine_chunks()
        out = pa.Table.from_batches(similar._across(0.8, 10**9, similar.SHARE)(iter(rows.to_batches(50))))
        sizes[n] = len(out)
        keyed = spark.createDataFrame(rows.to_pandas())
        keyed = keyed.select(*[keyed[c.split()[0]].cast(c.split()[1]) for c in similar._PREFIX.split(", ")])
        sketches = spark.createDataFrame([(i, bytearray(similar.sketch(s).tobytes())) for i, s in enumerate(sets)], "row_id long, sketch binary")
        got = {(r.u, r.v) for r in similar._candidates(keyed, 0.8, sketches).collect()}
        assert got == {(i, i + 1) for i in ids if i % 2 == 0}
    assert sizes[200] < 6 * sizes[50]


def test_sketches_lose_no_similar_pair():
    """pipeline: sets differ in as many hashes as their sketches, or more, also where counts are cut off."""
    rng = np.random.default_rng(21)
    for n in (1, 3, 40, 700, 60_000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for share in (0.0, 0.1, 0.5, 1.0):
            other = base.copy()
            changed = rng.random(n) < share
            other[changed] = rng.integers(0, 2**63, changed.sum()).astype(np.uint64)
            x, y = np.unique(base), np.unique(other)
            apart = np.abs(similar.sketch(x).astype(int) - similar.sketch(y)).sum()
            assert apart <= len(np.setxor1d(x, y))
