"""Models as pluggable functions, with deterministic stand-ins that need none.

The only Python functions of the core: each works on Arrow batches, and a model
is loaded once for a worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedder(dim: int = 64) -> Embedder:
    """Signed word hashes, L2-normalised; letters are lower-cased one by one, wherever they stand in a word."""

    def embed(texts: list[str]) -> np.ndarray:
        words = [[w for w in re.split("[ \t\n]+", (text or "").replace("İ", "i").replace("Σ", "σ").lower()) if w] for text in texts]
        hashes = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in {w for line in words for w in line}}  # each word of a batch once
        found = np.array([hashes[w] for line in words for w in line], np.int64)
        row = np.repeat(np.arange(len(texts)), [len(line) for line in words])
        out = np.zeros((len(texts), dim))
        np.add.at(out, (row, found % dim), np.where(found >> 31 == 1, 1, -1))
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(size == 0, 1, size)).astype(np.float32)

    return embed


def embedding(text: Column, load: Callable[[], Embedder] = hashed_embedder) -> Column:
    """text as array<float>; load() is called once for a task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for texts in batches:
            yield pd.Series(list(embed(texts.fillna("").tolist())))

    return run(text)


def jaccard(a: Column, b: Column) -> Column:
    """The offline reranker: shared distinct tokens over all distinct tokens."""
    left, right = (F.array_distinct(F.filter(F.split(F.lower(x), "[ \t\n]+"), lambda w: w != "")) for x in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))), F.lit(0.0))


def enrich(rows: DataFrame, call: Callable[[dict], dict], schema: str, tries: int = 3, wait: float = 0.0, workers: int = 20) -> DataFrame:
    """Adds the fields of call(row) to each row; a failing or empty reply is tried again, then left null.

    Each task has so many calls under way at once.
    """

    def ask(row: dict) -> str:
        reply: dict = {}
        for n in range(tries):
            if n:
                time.sleep(wait * 2 ** (n - 1))
            try:
                reply = call(row) or {}
            except Exception:  # a model's failure costs this row one try
                reply = {}
            if reply:
                break
        return json.dumps(reply, ensure_ascii=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                yield pdf.assign(_reply=list(pool.map(ask, pdf.to_dict("records"))))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    replied = rows.mapInPandas(run, f"{fields}, _reply string").withColumn("_reply", F.from_json("_reply", schema))
    return replied.select(*rows.columns, "_reply.*")


def answer(candidates: DataFrame, choose: Callable[[list[dict]], tuple[int, str]] | None = None) -> dict | None:
    """One answer from at most three candidates (X5, J13): the model's choice, an index out of range is the first; without a model the first with its summary."""
    rows = [r.asDict() for r in candidates.limit(3).collect()]
    if not rows:
        return None
    if choose is None:
        return rows[0] | {"answer": rows[0].get("explanation", "")}
    index, text = choose(rows)
    return rows[index if 0 <= index < len(rows) else 0] | {"answer": text}
