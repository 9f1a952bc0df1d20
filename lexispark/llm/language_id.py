"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits; for each bit a binary naive Bayes
classifier over hashed byte trigrams predicts its sign. Training is one pass that
counts trigrams per label over all labelled training rows (no sample): partial
counts per task, one row per label and bucket after the shuffle, BUCKETS rows per
language on the driver whatever the corpus.

A text's margin for a bit is its mean log odds per trigram. Decoding adds, for
each codeword, the logistic losses of all margins against its bits, weighted by
how far the classifier separates that language in training, and takes the
codeword of least loss. `score` is that codeword's share of exp(-loss). A result
is ambiguous if the signs lie outside the code's correction radius around the
winner and its score is below AMBIGUOUS.

Null text or text without a letter gives `und` with score 0. So does every text
when there is no training row. Repeated rows give repeated results; very long
texts are counted in pieces; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, table, tidily

#: Trigram buckets.
BUCKETS = 8192
#: Bits of a codeword for each doubling of the languages, if there are so many dichotomies.
CODE_BITS = 12
#: Up to this many languages their dichotomies are listed, beyond it drawn.
FEW = 12
AMBIGUOUS = 0.5
UNKNOWN = "und"
#: Losses are scaled by this before the shares are taken.
SHARPNESS = 6.0
#: Texts are counted together up to this many bytes or rows.
GROUP_BYTES, GROUP_ROWS = 1 << 20, 128

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def trigrams(data: bytes) -> np.ndarray:
    """The bucket of each byte trigram; ASCII other than letters counts as blank."""
    b = _FOLD[np.frombuffer(data, np.uint8)].astype(np.uint32)
    mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)


def counted(texts: list[str]) -> Iterator[np.ndarray]:
    """Matrices of trigram counts, a row per text, for a few texts at a time."""
    group: list[bytes] = []
    size = 0
    for i, text in enumerate(texts, 1):
        data = b" " + text.lower().encode("utf-8", "replace") + b" "
        if len(data) > GROUP_BYTES:
            if group:
                yield _matrix(group)
            row = np.zeros((1, BUCKETS))
            for at in range(0, len(data) - 2, GROUP_BYTES):
                row += np.bincount(trigrams(data[at : at + GROUP_BYTES + 2]), minlength=BUCKETS)
            yield row
            group, size = [], 0
        else:
            group.append(data)
            size += len(data)
        if group and (size >= GROUP_BYTES or len(group) >= GROUP_ROWS or i == len(texts)):
            yield _matrix(group)
            group, size = [], 0


def _matrix(group: list[bytes]) -> np.ndarray:
    sizes = np.array([len(d) for d in group])
    buckets = trigrams(b"".join(group)).astype(np.int64)
    of = np.repeat(np.arange(len(group)), sizes)[: len(buckets)]
    ends = np.cumsum(sizes)[:-1]  # trigrams across two texts don't count
    inside = np.ones(len(buckets), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return np.bincount(of[inside] * BUCKETS + buckets[inside], minlength=len(group) * BUCKETS).reshape(len(group), BUCKETS).astype(float)


def code(languages: int) -> np.ndarray:
    """A codeword of +1/-1 for each language; every column splits the languages another way.

    n languages have 2^(n-1) - 1 dichotomies. Where those are no more than the bits
    wanted all of them are used, else a seeded choice of distinct ones, of which
    there are then always enough. Two languages have one dichotomy only and three
    have three, so their codewords differ in one and two bits; from four languages
    on they differ in three at least.
    """
    if languages < 2:
        return np.ones((languages, 1))
    wanted = CODE_BITS * int(np.ceil(np.log2(languages)))
    rng = np.random.Generator(np.random.PCG64(languages))
    if languages <= FEW:
        # Bit i - 1 of a number tells whether language i is on the other side than language 0.
        numbers = np.arange(1, 1 << languages - 1)
        if len(numbers) > wanted:
            uneven = np.abs(2 * np.bitwise_count(numbers).astype(int) - languages)
            numbers = numbers[np.lexsort((rng.permutation(len(numbers)), uneven))][:wanted]
        sides = (numbers[None] >> np.arange(languages - 1)[:, None]) & 1
        return np.concatenate((np.ones((1, len(numbers))), 1.0 - 2 * sides))
    found: dict[bytes, np.ndarray] = {}
    while len(found) < wanted:  # more than half a thousand halvings to choose from
        column = np.ones(languages)
        column[rng.permutation(languages)[: languages // 2]] = -1
        column *= column[0]
        found[column.tobytes()] = column
    return np.array(list(found.values())).T


class Model:
    """Bit classifiers and codewords made from trigram counts per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, code(len(languages))
        share = (counts + 1.0) / (counts + 1.0).sum(axis=1, keepdims=True)  # each language counts alike, however many rows it has
        ones = (self.code > 0).astype(float)
        zeros = 1 - ones
        p1 = (ones.T @ share) / np.maximum(ones.sum(axis=0), 1)[:, None] + 1e-12
        p0 = (zeros.T @ share) / np.maximum(zeros.sum(axis=0), 1)[:, None] + 1e-12
        self.odds = (np.log(p1) - np.log(p0)).T
        apart = self.code * (share @ self.odds)  # mean margin that a language has in training
        self.scale = 1 / np.maximum(np.abs(apart).mean(axis=0), 1e-9)
        weight = np.maximum(apart * self.scale, 1e-3)
        self.weight = weight / weight.sum(axis=1, keepdims=True)
        apart_by = [int((a != b).sum()) for a, b in combinations(self.code, 2)]
        self.radius = (min(apart_by, default=1) - 1) // 2

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and ambiguity of each row of counts."""
        margin = counts @ self.odds / np.maximum(counts.sum(axis=1, keepdims=True), 1) * self.scale
        loss = (np.logaddexp(0, -2 * margin[:, None, :] * self.code[None]) * self.weight[None]).sum(axis=2)
        best = loss.argmin(axis=1)
        share = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
        score = 1 / share.sum(axis=1)
        off = (np.sign(margin) != self.code[best]).sum(axis=1)
        return best, score, (off > self.radius) & (score < AMBIGUOUS)


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (lang, text)."""
    ship(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))], ["lang", "bucket", "n"])

        for batch in batches:
            pairs = [(lang, text) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if lang is not None and has_letter(text)]
            done = 0
            for matrix in counted([text for _, text in pairs]):
                for row, (lang, _) in zip(matrix, pairs[done : done + len(matrix)], strict=True):
                    total[lang] = total[lang] + row if lang in total else row.copy()
                done += len(matrix)
            if len(total) > 200:
                yield from rows()
                total.clear()
        yield from rows()

    return labelled.select("lang", "text").mapInArrow(tidily(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame) -> Model | None:
    """BUCKETS rows per language come to the driver."""
    got = trigram_counts(labelled).toArrow().to_pydict()
    languages = sorted(set(got["lang"]))
    if not languages:
        return None
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    counts[[at[x] for x in got["lang"]], got["bucket"]] = got["n"]
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every document; reads doc_id and text only."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            known = [i for i, text in enumerate(texts) if model is not None and has_letter(text)]
            done = 0
            for matrix in counted([texts[i] for i in known]):
                for i, b, s, a in zip(known[done:], *model.decode(matrix), strict=False):
                    lang[i], score[i], unsure[i] = model.languages[b], float(s), bool(a)
                done += len(matrix)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidily(run), "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose language is known and not ambiguous, with all their columns; nothing is shuffled."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        model = held.value
        found = [t if model is not None and has_letter(t) else None for t in texts.to_pylist()]
        keep = [t is not None for t in found]
        at = [i for i, k in enumerate(keep) if k]
        done = 0
        for matrix in counted([found[i] for i in at]):
            for i, unsure in zip(at[done:], model.decode(matrix)[2], strict=False):
                keep[i] = not unsure
            done += len(matrix)
        return pa.array(keep, pa.bool_())

    return docs.where(known("text"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_training_rows(docs: DataFrame) -> Model | None:
    return fit(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_on_training_rows(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
