"""Codes and codebooks against plain Lloyd rounds, and what the heaps spare."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from lexispark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def lloyd(rows, entries=vc.ENTRIES, rounds=vc.ROUNDS, parts=vc.PARTS):
    """rows (vec_id, embedding, label) -> {(vec_id, code, error, label_error): how often}, codebooks."""
    rows = [r for r in rows if r[1] and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    if not rows:
        return [], []
    width = len(rows[0][1]) // parts
    cut = [[tuple(math.floor(256 * x) for x in r[1][p * width : (p + 1) * width]) for p in range(parts)] for r in rows]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    codes = []
    for k in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v[p], books[p][e], strict=True)), e)) for p in range(parts)] for v in cut]
        if k < rounds:
            for p in range(parts):
                members = defaultdict(list)
                for v, code in zip(cut, codes, strict=True):
                    members[code[p]].append(v[p])
                for e, found in members.items():
                    books[p][e] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    errors = [sum(sum((a - b) ** 2 for a, b in zip(v[p], books[p][code[p]], strict=True)) for p in range(parts)) for v, code in zip(cut, codes, strict=True)]
    by_label = defaultdict(int)
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += e
    return sorted(((r[0], bytes(c).hex(), e, by_label[r[2]]) for r, c, e in zip(rows, codes, errors, strict=True)), key=repr), books


def got(df, **kw):
    coded, books = vc.compress(df, **kw)
    return sorted((tuple(r) for r in vc.with_label_errors(coded).select("vec_id", "code", "error", "label_error").collect()), key=repr), books.tolist()


def test_query_against_lloyd(spark, sf01):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf01}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = lloyd(rows)
    found = vc.op13_vector_codes(spark, sf01).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=repr) == want
    assert {r.codebooks_sha256 for r in found} == {hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()}


def test_many_rounds_small_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK", 37 * 32)
    rng = np.random.default_rng(13)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 32) / 256], int(i % 3)) for i in range(400)]
    rows += [(1000 + i, rows[5][1], None) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for entries, rounds in ((64, 2), (7, 6), (1, 2), (256, 3)):
        assert got(df, entries=entries, rounds=rounds) == lloyd(rows, entries, rounds)


def test_odd_rows(spark):
    v = [0.5, -0.25] * 8
    rows = [
        (1, v, 1), (1, v, 1), (None, v[::-1], None), (2, None, 1), (3, [], 1), (4, [None] + v[1:], 2), (5, [float("nan")] + v[1:], 2), (6, [float("inf")] + v[1:], 2),
        (7, v * 2, 3), (8, v[:5], 3), (9, [-0.001] * 16, None), (-4, [1e3] * 16, 4),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", code string, n int").repartition(3)
    assert got(df) == lloyd(rows)
    assert got(df.limit(0)) == ([], [[]] * vc.PARTS)
    huge = spark.createDataFrame([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, 1)], SCHEMA)
    assert [r[2] for r in got(huge)[0]] == [0, 0, 0]
    with pytest.raises(ValueError, match="hex"):
        vc.compress(df, entries=257)


def test_heaps_give_up_only_what_drift_has_reached():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (8, vc.PARTS, 4))
    which = rng.integers(0, 8, 2000)
    block = vc.Block((centres[which] + rng.integers(-3, 4, (2000, vc.PARTS, 4))).astype(np.int32), 8)
    books = centres.transpose(1, 0, 2).astype(np.int64)
    block.assign(books, np.zeros((vc.PARTS, 8)), first=True)
    assert block.rescanned == 2000 * vc.PARTS
    assert (block.delta[:, :, -1].sum(axis=1) == 2000).all()
    for keys, offsets in zip(block.keys, block.offsets, strict=True):
        for e in range(8):
            heap = keys[offsets[e] : offsets[e + 1]]
            assert all(heap[i] >= heap[(i - 1) // 2] for i in range(1, len(heap)))
    moved = books + 1
    step = np.full((vc.PARTS, 8), 2.0)
    block.assign(moved, 2 * step, first=False)
    assert block.rescanned < 2000 * vc.PARTS * 1.2
    own = ((block.vectors[:, :, None].astype(np.int64) - moved[None]) ** 2).sum(axis=3)
    assert (block.codes() == own.argmin(axis=2)).all()


def test_violated_equals_a_scan_of_the_keys():
    rng = np.random.default_rng(4)
    block = vc.Block(rng.integers(-50, 50, (500, vc.PARTS, 2)).astype(np.int32), 9)
    block.assign(rng.integers(-50, 50, (vc.PARTS, 9, 2)), np.zeros((vc.PARTS, 9)), first=True)
    reach = rng.random(9) * 20
    for part in range(vc.PARTS):
        entry = np.repeat(np.arange(9), np.diff(block.offsets[part]))
        assert sorted(block.violated(part, reach)) == np.flatnonzero(block.keys[part] <= reach[entry]).tolist()


def test_codes_restore_vectors(spark, sf01):
    df = spark.read.parquet(f"{sf01}/embeddings.parquet")
    coded, books = vc.compress(df)
    rows = {r.vec_id: r.embedding for r in df.collect()}
    found = coded.collect()
    codes = np.array([list(bytes.fromhex(r.code)) for r in found])
    apart = ((vc.restored(codes, books) - np.array([rows[r.vec_id] for r in found])) ** 2).sum(axis=1).mean()
    assert apart < 0.35 * np.mean([np.square(v).sum() for v in rows.values()])
