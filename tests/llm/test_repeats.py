from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lexispark.llm import repeats
from tests.llm import brute


def held(df):
    return {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.cut_repeats(df).collect()}


def synthetic(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "be", "gämma", "delta,", "of", "the", "x" * 30]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    common = [line(15) for _ in range(4)]
    texts = {}
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.5 else line(rng.randint(1, 30)) for _ in range(rng.randint(0, 5))]
        texts[i * 3] = " ".join(parts)
        if rng.random() < 0.2 and i:
            texts[i * 3] = texts[rng.randrange(i) * 3] + rng.choice(["", "!"])
    return texts


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_documents_against_a_set_of_strings(spark, sf_dir, scale):
    sf_dir = sf_dir.replace("sf0.001", scale)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute.repeats(texts)
    for r in repeats.op10_repeats(spark, sf_dir).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(texts[r.doc_id].encode()), *want[r.doc_id][:2], hashlib.sha256(want[r.doc_id][2]).hexdigest())


@pytest.mark.parametrize("case", ["plain", "split", "small pieces", "few rows", "all hashes meet"])
def test_synthetic(spark, case, monkeypatch):
    texts = synthetic(150, 9)
    if case == "split":
        monkeypatch.setattr(repeats, "CROWD", 1)
    if case == "small pieces":
        monkeypatch.setattr(repeats, "BATCH", 2000)
        monkeypatch.setattr(repeats, "READ", 3)
        monkeypatch.setattr(repeats, "GATHERED", 50)
    if case == "few rows":
        monkeypatch.setattr(repeats, "ROWS", 7)
        monkeypatch.setattr(repeats, "TOGETHER", 3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    if case == "all hashes meet":  # what hashes say alike is still told apart by its bytes
        got, data = {i: bytearray(len((t or "").encode())) for i, t in texts.items()}, {i: (t or "").encode() for i, t in texts.items()}
        order = sorted(i for i in texts if len(data[i]) >= 50)
        windows = [(i, at) for i in order for at in range(len(data[i]) - 49)]
        size = np.full(len(windows), 50)
        flat = np.frombuffer(b"".join(data[i][at : at + 50] for i, at in windows), np.uint8)
        doc, place = np.array([i for i, _ in windows]), np.array([at for _, at in windows])
        zero = np.zeros(len(windows), np.int64)
        for marks in repeats.settle(zero, zero, doc, doc, place, np.cumsum(size) - 50, size, flat):
            for i, at, n in zip(*(c.tolist() for c in marks), strict=True):
                got[i][at : at + n + 49] = b"\1" * (n + 49)
        assert {i: sum(g) for i, g in got.items()} == {i: n for i, (n, _, _) in brute.repeats(texts).items()}
        return
    assert held(df) == brute.repeats(texts)


def test_marks_come_from_the_merge_or_from_compared_bytes(spark, monkeypatch):
    """Without the merge and the comparison of bytes nothing at all is removed."""
    texts = synthetic(60, 4)
    rows = [(i, i, t) for i, t in texts.items() if t]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"row_id": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "text": [r[2] for r in rows]})
    records = pa.Table.from_batches(repeats._classes(1, 1)(iter([batch])))
    marked = sum(len(n) for a, n in zip(records["anchor"].to_pylist(), records["n"].to_pylist(), strict=True) if a is None)
    assert marked
    sifted = pa.Table.from_batches(repeats._sift(1)(iter(records.to_batches())))
    assert sum(len(n) for g, n in zip(sifted["grp"].to_pylist(), sifted["n"].to_pylist(), strict=True) if g is None) == marked  # hashes that meet only route
    monkeypatch.setattr(repeats, "same_bytes", lambda data, first, second, size: np.zeros(len(first), bool))
    none = pa.Table.from_batches(repeats._classes(1, 1)(iter([batch])))
    assert None not in none["anchor"].to_pylist()


def test_a_task_sends_a_repeated_class_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "BATCH", 1000)
    rng = random.Random(2)
    line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    texts = [f"{i:08x} {line}" for i in range(200)]

    def sent(ids):
        batch = pa.RecordBatch.from_pydict({"row_id": ids, "doc_id": ids, "text": [texts[i] for i in ids]})
        out = pa.Table.from_batches(repeats._classes(1, 1)(iter([batch])))
        return sum(len(n) for a, n in zip(out["anchor"].to_pylist(), out["n"].to_pylist(), strict=True) if a is not None)

    contexts = sent([0])
    assert sent(list(range(200))) < 200 * contexts / 2
    assert sent(list(range(200))) < sent(list(range(200))[::-1])  # smaller documents that come later go out again


def test_pieces_cover_every_window(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "BATCH", 400)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (0, 49, 50, 51, 399, 400, 401, 1234)]
    batch = pa.RecordBatch.from_pydict({"row_id": list(range(len(texts))), "doc_id": list(range(len(texts))), "text": texts})
    seen: dict[tuple[int, int], int] = {}
    for data, sizes, of in repeats._pieces([batch]):
        found = repeats.Contexts(data, sizes)
        for begin, n, text, start in zip(found.begin, found.n, found.text, found.start, strict=True):
            for at in range(begin, begin + n):
                place = of[text][0], of[text][2] + at - start
                assert bytes(data[at : at + 50]) == texts[place[0]].encode()[place[1] : place[1] + 50]
                seen[place] = seen.get(place, 0) + 1
    assert seen == {(i, at): 1 for i, t in enumerate(texts) for at in range(len(t) - 49)}


def test_odd_rows(spark, odd, empty):
    got = repeats.cut_repeats(odd).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    want = brute.repeats(texts)
    for r in got:
        if r.doc_id is None:
            assert (r.n_removed, r.n_spans) == (0, 0)
        else:
            assert (r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    assert repeats.cut_repeats(empty).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merged_intervals_and_common_prefixes(shards):
    rng = random.Random(shards)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(30)]
    texts += texts[:5]
    given, where = [], []
    for part in np.array_split(np.arange(len(texts)), shards):
        joined = b"\xff".join([texts[i] for i in part]) + b"\xff"
        given.append(np.frombuffer(joined, np.uint8))
        where += [(joined[k:] + joined * 12)[:12] for k in range(len(joined))]
    found, interval, common = repeats.merged_intervals(given, depth=12)
    groups: dict[bytes, list[int]] = {}
    for i, w in enumerate(where):
        groups.setdefault(w, []).append(i)
    got: dict[int, list[int]] = {}
    for i, k in zip(found.tolist(), interval.tolist(), strict=True):
        got.setdefault(k, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(g for g in groups.values() if len(g) > 1)
    assert [where[got[k][0]] for k in got] == sorted(where[got[k][0]] for k in got)  # intervals come in order
    for i, w in enumerate(where):
        shared = max(next((k for k in range(12) if w[k] != v[k]), 12) for j, v in enumerate(where) if j != i)
        assert common[i] == shared // 2 * 2
