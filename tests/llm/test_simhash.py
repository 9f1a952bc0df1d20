from __future__ import annotations

import random

import numpy as np

from lexispark.llm import simhash
from lexispark.llm.components import connected
from tests.llm import brute


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_against_brute_force(spark, sf_dir):
    prints = {r.doc_id: brute.fingerprint(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute.components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_odd_rows(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    of = {r.doc_id: r for r in rows}
    assert [of[i].fp for i in (3, 4, 5)] == [0, 0, 0]
    assert {of[i].component_id for i in (3, 4, 5)} == {3}
    assert of[2].component_id == 1
    assert simhash.near_duplicates(empty).count() == 0


def test_xxhash_is_sparks(spark):
    import xxhash

    texts = ["", "a", "some words here", "é" * 40]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert [g % 2**64 for g in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_the_code_is_perfect():
    words = np.arange(1 << 23)
    index = simhash.codeword_index(words)
    assert (np.bincount(index) == 2048).all()


def test_keys_cover_three_errors():
    rng = random.Random(4)
    for _ in range(300):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        ka, sa, _ = simhash.keys(np.array([signed(a)], np.int64))
        kb, sb, _ = simhash.keys(np.array([signed(b)], np.int64))
        assert set(ka[sa == 0]) & set(kb[sb == 1])


def test_links_and_hot_keys_on_dense_fingerprints(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(30):
            x = base
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            fps.add(x)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    order = sorted(signed(x) for x in fps)
    links = {(r.u, r.v) for r in simhash.links(df).collect()}
    assert links == {(a, b) for n, a in enumerate(order) for b in order[n + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    want = brute.components({x: x % 2**64 for x in order})
    crowded = simhash.links(df, hot=0)
    assert all(((r.u ^ r.v) % 2**64).bit_count() <= 3 for r in crowded.collect())
    for found in (crowded, simhash.links(df)):
        roots = {r.u: r.root for r in connected(found).collect()}
        assert {x: roots.get(x, x) for x in order} == want


def test_components_of_a_long_path(spark):
    rows = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.u: r.root for r in connected(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}
