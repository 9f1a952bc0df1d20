"""Token counts against the library, and what the cache spares."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexispark.llm import token_counts
from lexispark.llm.common import scratch_path

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def spec():
    with open(token_counts.vocabulary(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(token_counts.vocabulary())


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pieces_against_the_library(spec, library):
    rng = random.Random(12)
    parts = list("abAB 12.!?'\"\n\t\r-_") + ["'s", "'ll", " the", "  ", "\n\n", "é", "ß", "Ж", "中", "か", "ア", "½", "²", " ", "\u0085", " ", "​", "\x1c", "\x00", "🙂", "́", "ǅ", "<|endoftext|>", "　", "…"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", " ", "a" * 5000, "!" * 5000, " " * 5000, "ab " * 3000]
    counter = token_counts.PieceCounter(spec, limit=200)
    assert [counter.count(t) for t in texts] == wanted(library, texts)


def test_every_safe_character_alone_and_between_others(spec, library):
    counter = token_counts.PieceCounter(spec)
    safe = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and token_counts.SAFE.fullmatch(chr(c))]
    texts = [t for c in safe for t in (f"a{c}b", f"1{c}2 {c}{c}", f" {c}")]
    assert [counter.count(t) for t in texts] == wanted(library, texts)


def test_query_against_the_library(spark, sf01, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    got = token_counts.op12_token_counts(spark, sf01).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    counts = dict(zip(texts, wanted(library, list(texts.values())), strict=True))
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), counts[r.doc_id], counts[r.doc_id] > 512)


def test_odd_rows(spark, odd, empty, library):
    cache = scratch_path(spark, "odd")
    got = token_counts.count_tokens(odd, token_counts.vocabulary(), cache).collect()
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = [(i, len(t.encode()), n) for (i, t), n in zip(texts, wanted(library, [t for _, t in texts]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(empty, token_counts.vocabulary(), scratch_path(spark, "none")).count() == 0


def test_only_distinct_misses_are_encoded(spark, library, monkeypatch):
    seen = []
    plain = token_counts._encoded
    monkeypatch.setattr(token_counts, "_encoded", lambda texts, spec: seen.append(sorted(r.text for r in texts.collect())) or plain(texts, spec))
    cache, path = scratch_path(spark, "counts"), token_counts.vocabulary()
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None), (4, ""), (5, "three"), (5, "three"), (None, "four"), (None, "four")], SCHEMA).repartition(3)
    two, three, four = wanted(library, ["one two", "three", "four"])
    assert sorted(map(tuple, token_counts.count_tokens(first, path, cache).collect()), key=repr) == sorted(
        [(1, 7, two), (2, 7, two), (3, 0, 0), (4, 0, 0), (5, 5, three), (5, 5, three), (None, 4, four), (None, 4, four)], key=repr
    )
    assert seen == [["", "four", "one two", "three"]]
    again = first.unionByName(spark.createDataFrame([(9, "new")], SCHEMA))
    assert token_counts.count_tokens(again, path, cache).count() == 9
    assert seen[1:] == [["new"]]
    token_counts.count_tokens(again, path, cache)
    assert len(seen) == 2


def test_a_digest_stored_twice_counts_once_and_other_tokenizers_are_apart(spark, tmp_path):
    cache = str(tmp_path / "cache")
    spark.createDataFrame([("x", 3, "t"), ("x", 3, "t"), ("x", 9, "u")], token_counts.CACHE_SCHEMA).write.partitionBy("tokenizer").parquet(cache)
    assert [tuple(r) for r in token_counts.read_cache(spark, cache, "t").collect()] == [("x", 3)]


def test_a_third_of_all_rows_alike(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = token_counts.count_tokens(rows, token_counts.vocabulary(), scratch_path(spark, "hot"))
    assert got.count() == 3000
    assert got.where("doc_id % 3 = 0").select("n_tokens").distinct().count() == 1
