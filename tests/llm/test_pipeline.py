from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter

import corpus_pipeline
from lexispark.llm import bpe, language_id
from tests.llm import brute


def stages(docs):
    """The rows that the first three stages leave, by plain loops."""
    every = docs.collect()
    found = brute.languages([(r.doc_id, r.text, r.lang) for r in every], language_id.code, ambiguous=language_id.AMBIGUOUS)
    rows = {r.doc_id: (r.text, r.source) for r in every if found[r.doc_id][1] != "und" and not found[r.doc_id][3]}
    last: dict[str, int] = {}
    for i, (text, _) in rows.items():
        key = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        last[key] = max(last.get(key, -1), i)
    rows = {i: rows[i] for i in last.values()}
    true = brute.similar({i: t for i, (t, _) in rows.items()})
    return {i: rows[i] for i in rows if true[i] == i}


def taken(rows):
    """doc_id -> copies: a level for all sources that aren't capped, found by halving, then the document's draw."""
    size = {i: len(re.findall("[^\x20\x09-\x0D]+", t or "")) for i, (t, _) in rows.items()}
    sources = sorted({s for _, s in rows.values()}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, (_, of) in rows.items() if of == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    budget, low, high = 1.5 * sum(total.values()), 0.0, 4.0 * sum(total.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * total[s], level * weight[s]) for s in sources) < budget else (low, level)
    out = {}
    for i, (_, s) in rows.items():
        rate = min(2 * total[s], low * weight[s]) / total[s] if total[s] else 0
        draw = int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:8], 16) / 2**32
        out[i] = int(rate + 1e-9) + (draw < rate - int(rate + 1e-9))
    return out


def test_pipeline_against_loops(spark, sf_dir):
    rows = stages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == +Counter(taken(rows))
    import tokenizers

    library = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    for r in got:
        ids = library.encode(rows[r.doc_id][0], add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, str(tmp_path))
        assert out.count() >= 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns
            assert stage(spark, empty, str(tmp_path)).count() == 0
