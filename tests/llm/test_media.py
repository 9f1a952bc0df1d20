from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter
from itertools import pairwise
from math import log2

import pytest
from pyspark.sql import functions as F

from lexispark.llm import media


def padded(text):
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 if data else 64)


def described(payload):
    """Distinct samples, mean and entropy."""
    counts = Counter(payload)
    entropy = -sum(n / len(payload) * log2(n / len(payload)) for n in counts.values()) + 0.0
    return f"{len(counts)}:{sum(payload) / len(payload):.6f}:{entropy:.6f}"


def test_round_trip_of_odd_rows(spark, odd):
    rows = media.read_media(media.write_store(odd)).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), padded(r.text)) for r in odd.collect()), key=str)
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.payload)) for r in rows), key=str) == want
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (3, 4)}) == 1


def test_query_columns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in media.op1_media_chunks(spark, sf_dir).collect():
        data, p = (texts[r.doc_id] or "").encode(), padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        chunks = [p[begin:end] for begin, end in pairwise([0, *media.cuts(p)])]
        form = struct.pack("<4sQI", b"CDC1", len(data), len(chunks)) + b"".join(hashlib.sha256(c).digest() + struct.pack("<I", len(c)) for c in chunks) + p
        assert (r.media_bytes, r.media_sha256, r.n_chunks) == (len(form), hashlib.sha256(form).hexdigest(), len(chunks))
        assert r.feature == described(p)


def test_the_stored_bytes_are_the_form(spark):
    """What stands in the table, row by row, gives manifest and samples; each distinct chunk stands there once."""
    rng = random.Random(3)
    part = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common = [part(9000) for _ in range(3)]
    texts = [part(rng.randint(0, 5000)) + rng.choice(common) + part(rng.randint(0, 5000)) for _ in range(40)] + [common[0]] * 30
    store = media.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    kept: dict[bytes, bytes] = {}
    for r in store.rows.collect():
        at = 0
        for (digest, size), whose in zip(media.entries(r.manifest), r.whose, strict=True):
            if whose != media.FOREIGN:
                assert digest not in kept
                kept[digest] = bytes(r.samples[at : at + size])
                at += size
        assert at == len(r.samples)
    assert any(r.n_foreign and len(r.samples) for r in store.rows.collect())
    got = {r.doc_id: r for r in media.read_media(store).collect()}
    for r in store.rows.collect():
        form = bytes(r.manifest) + b"".join(kept[d] for d, _ in media.entries(r.manifest))
        assert (got[r.doc_id].media_bytes, got[r.doc_id].media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        assert bytes(got[r.doc_id].payload) == padded(texts[r.doc_id])


def test_many_marks_are_joined_without_a_broadcast(spark, odd, monkeypatch):
    monkeypatch.setattr(media, "MODEST", 0)
    assert media.read_media(media.write_store(odd)).count() == odd.count()


def test_empty(spark, empty):
    assert media.read_media(media.write_store(empty)).count() == 0


def test_gear_is_a_plain_rolling_hash():
    data = random.Random(1).randbytes(500)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(media.GEAR[b])) % 2**32
        want.append(h)
    import numpy as np

    assert media.gear(np.frombuffer(data, np.uint8)).tolist() == want


def test_cuts_follow_content(monkeypatch):
    rng = random.Random(2)
    body = rng.randbytes(200_000)
    whole = {d for d, _ in media.chunks_of(body)}
    shifted = {d for d, _ in media.chunks_of(b"x" * 37 + body)}
    assert len(whole & shifted) >= len(whole) - 3
    sizes = [len(c) for _, c in media.chunks_of(body)]
    assert max(sizes) <= media.LARGEST
    assert min(sizes[:-1]) >= media.SMALLEST
    monkeypatch.setattr(media, "BLOCK", 5000)
    assert {d for d, _ in media.chunks_of(body)} == whole


@pytest.mark.parametrize("damage", ["other samples", "an owner is gone", "no chunk list"])
def test_damage_is_noticed(spark, odd, damage):
    store = media.write_store(odd)
    rows = {
        "other samples": store.rows.withColumn("samples", F.when(F.col("doc_id") == 1, F.lit(b"x" * 64)).otherwise(F.col("samples"))),
        "an owner is gone": store.rows.where("n_shared = 0"),
        "no chunk list": store.rows.withColumn("manifest", F.lit(b"CDC1")),
    }[damage]
    with pytest.raises(Exception, match="lacks|manifest|unpack"):
        media.read_media(media.Store(rows, store.heavy)).collect()
    store.drop()
