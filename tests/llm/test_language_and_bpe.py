from __future__ import annotations

import hashlib
import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import bpe, language_id
from tests.llm import brute


def test_held_out_accuracy(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    got = language_id.op8_language_id(spark, sf01).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    right = held.where("lang_pred = lang").count()
    assert right >= 0.98 * held.count()
    assert got.where("score < 0 or score > 1").count() == 0
    assert held.count() == docs.where("crc32(cast(doc_id as string)) % 3 = 1").count()


def test_language_of_odd_rows(odd, empty):
    model = language_id.fit_on_training_rows(odd)
    got = language_id.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 8)} == {"und"}
    kept = language_id.keep_identified(odd, model)
    assert kept.columns == odd.columns
    assert not {3, 4, 5, 8} & {r.doc_id for r in kept.collect()}
    assert language_id.fit(empty) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_pieces_count_like_the_whole(monkeypatch):
    texts = ["abc déf " * 400, "x", "", "ghi " * 30]
    whole = np.concatenate(list(language_id.counted(texts)))
    monkeypatch.setattr(language_id, "GROUP_BYTES", 100)
    assert (np.concatenate(list(language_id.counted(texts))) == whole).all()
    assert whole.sum(axis=1).tolist() == [len(t.encode()) for t in texts]


@pytest.mark.parametrize("n", [*range(1, 51), 200])
def test_codewords_differ(n):
    code = language_id.code(n)
    assert len({tuple(row) for row in code}) == n
    columns = {tuple(c * c[0]) for c in code.T}
    assert len(columns) == code.shape[1]  # no dichotomy twice
    assert n == 1 or (1.0,) * n not in columns
    if n > 1:
        assert min(int((a != b).sum()) for i, a in enumerate(code) for b in code[i + 1 :]) >= min(3, n - 1)


def test_seven_languages(spark):
    rng = random.Random(7)
    rows = []
    for i in range(420):
        letters = "abcdefghijklmnopqrstuvwxyz"[3 * (i % 7) : 3 * (i % 7) + 6]
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40)), f"l{i % 7}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.fit_on_training_rows(docs)).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_predictions_against_loops(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = brute.languages([(r.doc_id, r.text, r.lang) for r in rows], language_id.code)
    for r in language_id.op8_language_id(spark, sf_dir).collect():
        held_out, lang, score, ambiguous = want[r.doc_id]
        assert (r.held_out, r.lang_pred, r.ambiguous) == (held_out, lang, ambiguous)
        assert abs(r.score - score) < 1e-9


def test_a_wrong_bit_is_corrected():
    counts = np.zeros((4, language_id.BUCKETS))
    for i in range(4):
        counts[i, i * 100 : i * 100 + 50] = 10
    model = language_id.Model(list("abcd"), counts)
    assert model.radius >= 1
    best, score, unsure = model.decode(counts)
    assert best.tolist() == [0, 1, 2, 3]
    assert (score > 0.9).all()
    assert not unsure.any()


@pytest.fixture(scope="module")
def spec():
    with open(bpe.vocabulary(), encoding="utf-8") as f:
        return json.load(f)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.vocabulary())


def agree(encoder, library, texts):
    for text, (ids, shown), want in zip(texts, encoder.texts(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want.ids, text[:80]
        assert shown == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_against_the_library(spec, library, monkeypatch):
    rng = random.Random(8)
    parts = list("abcdeABC'Σσßİıéàü 12½\t\n!?.<|>{}中文字한국어🙂👍ſﬁ") + ["\u00a0", "\u2028", "\u200b", "\u0301", "\u0345", "\x1c", "\x85", "\x00", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "the", "ation", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["", "a" * 3000, "ab" * 2000, "!" * 500, "the " * 2000]
    agree(bpe.TrieEncoder(spec), library, texts)
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "TOGETHER", 20)
    agree(bpe.TrieEncoder(spec), library, texts[:300])


def test_bpe_on_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op9_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_rows(odd, empty, library):
    got = bpe.bpe_encode(odd, bpe.vocabulary()).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        assert bytes(r.ids) == struct.pack(f"<{len(i := library.encode(texts[r.doc_id], add_special_tokens=False).ids)}I", *i)
    assert bpe.bpe_encode(empty, bpe.vocabulary()).count() == 0


@pytest.mark.parametrize("part, value", [("normalizer", None), ("decoder", {"type": "ByteLevel"}), ("pre_tokenizer", {"type": "Whitespace"}), ("added_tokens", [{"id": 1, "content": "<s>"}])])
def test_other_tokenizer_files_are_refused(spec, part, value):
    with pytest.raises(ValueError, match=part):
        bpe.TrieEncoder(spec | {part: value})


def test_prefixes_are_shared(spec):
    encoder = bpe.TrieEncoder(spec)
    words = ["running", "runner", "runners", "run", "rung"]
    assert encoder.encode(words) == {w: encoder.encode([w])[w] for w in words}
    assert bpe.digests  # the query's columns come from ids and decoded text
    assert F
