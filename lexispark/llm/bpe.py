"""BPE encoding and decoding by prefix-sharing trie traversal.

The tokenizer file (JSON of the `tokenizers` library; its path is a parameter)
is read on the driver and broadcast: a vocabulary, not data. Each batch of texts
is cut at white space into chunks, chunks into words, and the distinct words not
seen before are encoded together:

* Sorted, the words are the depth-first order of their trie. A stack holds, for
  each symbol of the current path, the last token of that prefix's encoding;
  a word keeps the stack up to the prefix it shares with the one before, so each
  shared prefix is computed once.
* The last token of a prefix is the one token ending there that can follow the
  last token of what precedes it: a pair of tokens can stand side by side if
  merging their symbols gives the two tokens back. Walking back over the last
  tokens yields the encoding.
* A word's final symbol carries the end-of-word mark, so it is a leaf of its own.

A text's ids are its chunks' ids in order; nothing crosses white space. Work is
linear in the text; memory is bounded by a batch and by caches that are emptied
at CACHE entries.

Null text counts as empty and gives no ids and the empty string. Repeated rows
give repeated results. Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table, tidily

#: Words, pairs and chunks that a Python worker remembers before it starts afresh.
CACHE = 350_000
#: New chunks that go into one trie, and chunks that wait for it at most.
TOGETHER, WAITING = 8_000, 40_000
#: Bytes of results sent to the JVM at once.
OUT_BYTES = 1 << 20
SCHEMA = "doc_id long, ids binary, decoded string"
END = "</w>"

#: Fixed values of the tokenizer format: white space (that of its pattern language) and the pieces of a chunk.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
_SPACES = re.compile(f"[{SPACE}]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")  # str.split() takes these four for white space, the tokenizer doesn't


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    symbols = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [symbols[b] for b in range(256)]


def check(spec: dict) -> None:
    """Raises ValueError for a tokenizer file of another kind than the one encoded here."""
    model, normalizer, before = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [s["type"] for s in normalizer.get("normalizers", [])]
    parts = [(s["type"], s.get("behavior"), s.get("invert")) for s in before.get("pretokenizers", [])]
    wanted = {
        "model": model.get("type", "BPE") == "BPE" and model.get("end_of_word_suffix") == END and not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("ignore_merges"),
        "normalizer": steps == ["NFC", "Replace", "Lowercase"],
        "pre_tokenizer": [p[0] for p in parts] == ["Split", "ByteLevel"] and bool(parts[0][2]),
        "decoder": not spec.get("decoder"),
        "added_tokens": all("<|" in t["content"] for t in spec["added_tokens"]),
    }
    wrong = [name for name, fits in wanted.items() if not fits]
    if wrong:
        raise ValueError(f"this tokenizer file has another {', '.join(wrong)}")


class TrieEncoder:
    """Encodes sets of distinct words that share prefixes."""

    def __init__(self, spec: dict, limit: int | None = None):
        check(spec)
        self.limit = CACHE if limit is None else limit
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        every = self.vocab | self.special
        self.token = [""] * (max(every.values()) + 1)
        for token, i in every.items():
            self.token[i] = token
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.token))]
        self.byte = dict(enumerate(byte_symbols()))
        # The merge that makes a token: its rank (a symbol has none), and the two ids that it joins.
        self.rank = [-1] * len(self.token)
        self.halves = [(i, i) for i in range(len(self.token))]
        self.joins: dict[int, int] = {}  # left << 20 | right -> rank
        for rank, merge in enumerate(model["merges"]):
            left, right = (self.vocab[t] for t in (merge if isinstance(merge, list) else merge.split(" ", 1)))
            made = self.vocab[self.token[left] + self.token[right]]
            self.joins[left << 20 | right] = rank
            self.rank[made], self.halves[made] = rank, (left, right)
        self.fits: dict[int, bool] = {}
        single = {i for t, i in self.vocab.items() if t and t != END and len(t.removesuffix(END)) == 1}
        # Tokens that their own symbols merge to: the halves can stand side by side until this very merge.
        whole = {t: i for t, i in self.vocab.items() if i in single or self.rank[i] >= 0 and self._apart(*self.halves[i], self.rank[i])}
        self.plain = {t: i for t, i in whole.items() if not t.endswith(END)}
        self.final = {t.removesuffix(END): i for t, i in whole.items() if t.endswith(END)}
        self.reach, self.reach_final = self._reach(self.plain), self._reach(self.final)
        self.words: dict[str, bytes] = {}
        self.ids: dict[str, bytes] = {}

    def _apart(self, left: int, right: int, limit: int = 1 << 30) -> bool:
        """Whether no merge with a rank below limit crosses the border between two tokens.

        Their merges are undone from the last one back. What then touches the border is
        what stood there before that merge; had the two a merge of a lower rank, it would
        have come first. Of equal ranks the leftmost comes first.
        """
        rank, halves, joins = self.rank, self.halves, self.joins
        while True:
            crossing = joins.get(left << 20 | right)
            if crossing is not None and crossing < limit:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                limit, left = rank[left], halves[left][1]
            else:
                limit, right = rank[right] + 1, halves[right][0]

    def beside(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2 * self.limit:
                self.fits.clear()
            known = self.fits[key] = self._apart(left, right)
        return known

    @staticmethod
    def _reach(tokens: Iterable[str]) -> dict[str, int]:
        """By its last three symbols, the length of the longest token that ends so."""
        out: dict[str, int] = {}
        for token in tokens:
            out[token[-3:]] = max(out.get(token[-3:], 2), len(token))
        return out

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each word (words in byte symbols)."""
        plain, final, fits, beside = self.plain, self.final, self.fits, self.beside
        reach, reach_final, out = self.reach, self.reach_final, {}
        last, begin = [-1], [0]  # of each prefix of the current path: its last token and where that begins
        before = ""
        for word in sorted(words):
            size, shared = len(word), 0
            most = min(len(before), size) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            for upto in range(shared + 1, size):
                longest = reach.get(word[upto - 3 if upto > 3 else 0 : upto], 2)
                for start in range(upto - longest if upto > longest else 0, upto):
                    token = plain.get(word[start:upto])
                    if token is not None:
                        if not start:
                            break
                        fit = fits.get(last[start] << 20 | token)
                        if fit or fit is None and beside(last[start], token):
                            break
                last.append(token)
                begin.append(start)
            # The final symbol is a leaf: its token isn't part of the path of the next word.
            longest = reach_final.get(word[-3:], 2)
            for start in range(size - longest if size > longest else 0, size):
                token = final.get(word[start:])
                if token is not None:
                    if not start:
                        break
                    fit = fits.get(last[start] << 20 | token)
                    if fit or fit is None and beside(last[start], token):
                        break
            ids = [token]
            while start:
                ids.append(last[start])
                start = begin[start]
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space and at special tokens."""
        if self.special_at and "<|" in text:
            text = self.special_at.sub(r" \1 ", text)
        return text.split() if not _SEPARATORS.search(text) else [c for c in _SPACES.split(text) if c]

    def _symbols(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.byte)

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk in byte symbols."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk if chunk.islower() else chunk.lower()]
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1]]
            return [self._symbols(p) for p in PIECES.findall(chunk.lower())]
        clean = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()  # no final sigma
        if clean.isalpha():
            return [self._symbols(clean)]
        if clean[-1] in ".,;:!?" and clean[:-1].isalpha():
            return [self._symbols(clean[:-1]), clean[-1]]
        return [self._symbols(p) for p in PIECES.findall(clean)]

    def learn(self, new: set[str]) -> None:
        """Makes ids hold these chunks."""
        ids, packed = self.ids, self.packed
        held = lambda word: ids if word.isascii() else self.words  # noqa: E731  an ASCII word is a chunk, too
        pieces = {chunk: self.pieces(chunk) for chunk in new if chunk not in self.special}
        for word, found in self.encode({p for ps in pieces.values() for p in ps if p not in held(p)}).items():
            held(word)[word] = b"".join([packed[i] for i in found])
        for chunk, ps in pieces.items():
            if len(ps) == 1:
                ids[chunk] = held(ps[0])[ps[0]]
            else:
                ids[chunk] = b"".join([held(p)[p] for p in ps])
        for chunk in new & self.special.keys():
            ids[chunk] = packed[self.special[chunk]]

    def decode(self, ids: bytes) -> str:
        """This file names no decoder: tokens are joined by blanks."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def texts(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text.

        The new chunks of many texts share one trie; the texts follow as soon as it is full.
        """
        held: list[list[str]] = []
        new: set[str] = set()
        size = 0
        for text in texts:
            held.append(self.chunks(text or ""))
            new.update(set(held[-1]).difference(self.ids))
            size += len(held[-1])
            if len(new) > TOGETHER or size > WAITING:
                yield from self._flush(held, new)
                held, new, size = [], set(), 0
        yield from self._flush(held, new)

    def _flush(self, held: list[list[str]], new: set[str]) -> Iterator[tuple[bytes, str]]:
        if len(self.ids) + len(new) > self.limit:
            self.ids.clear()
            self.words.clear()
            new = {c for chunks in held for c in chunks}
        self.learn(new)
        for chunks in held:
            ids = b"".join(map(self.ids.__getitem__, chunks))
            yield ids, self.decode(ids)


_loaded: dict[int, TrieEncoder] = {}


def _encoder(spec: str, limit: int) -> TrieEncoder:
    key = hash((spec, limit))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = TrieEncoder(json.loads(spec), limit)
    return _loaded[key]


def bpe_encode(docs: DataFrame, path: str, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit) and decoded text of every document.

    cache bounds what a worker remembers: fewer entries need less memory and more time.
    Without keep a worker forgets its encoder at the end of each task, for steps that follow.
    """
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value, cache)
        for batch in batches:
            texts = batch.column(1)
            begin, ids, shown, held = 0, [], [], 0
            for i, (packed, decoded) in enumerate(encoder.texts(text.as_py() for text in texts), 1):
                ids.append(packed)
                shown.append(decoded)
                held += len(packed) + len(decoded)
                if held > OUT_BYTES or i == len(texts):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i - begin), pa.array(ids, pa.binary()), pa.array(shown, pa.string())], ["doc_id", "ids", "decoded"])
                    begin, ids, shown, held = i, [], [], 0
        if not keep:
            del encoder
            _loaded.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidily(run), SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Token ids of all documents."""
    return digests(bpe_encode(table(spark, sf_dir, "documents"), vocabulary()))
