"""The divergence audit against loops."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from lexispark.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def loops(rows, least_docs, most):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(low))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        each = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(each[s][t] - each[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((whole[t] - each[s][t], t.encode()) for t in kept if counts[lang, s][t] and each[s][t] > whole[t])[:most]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, n) for n, (value, item) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_against_loops(spark):
    rng = random.Random(11)
    words = ["the", "The", "ÉTÉ", "été", "中文", "a1b", "x", "y", "zz", "ß", "🙂", "don't"]
    rows = []
    for _ in range(300):
        lang, source = rng.choice(["en", "de", None, "", "no terms"]), rng.choice(["a", "b", "é", "Z", None])
        text = None if rng.random() < 0.05 else " ".join(rng.choices(words, range(1, 13), k=rng.randint(0, 30)))
        rows.append((text if lang != "no terms" else "123", lang, source))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    for least, most in ((1, 50), (30, 2), (1000, 50)):
        assert got(divergence.divergence(df, least, most)) == loops(rows, least, most)


def test_odd_rows(odd, empty):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert got(divergence.divergence(odd, 1)) == loops(rows, 1, 50)
    assert divergence.divergence(empty).count() == 0


def test_documents_against_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = loops([(r.text, r.lang, r.source) for r in docs.collect()], divergence.LEAST_DOCS, divergence.MOST)
    assert got(divergence.op11_divergence(spark, sf_dir)) == want
    assert {r[2] for r in want} == {"pair", "term"}


@pytest.mark.parametrize("count", [10**12, 3 * 10**14])
def test_shares_of_large_counts_are_exact(spark, count):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence._share(F.lit(count), F.lit(7 * count), F.lit(11)).alias("p")).first()
    assert row.p == 1 + 10**9 * (count + 5) // (7 * count + 55)
