from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexispark.llm import exact_dedup, mixing


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("support", [1 / 512, 0.2, 0.9])
def test_exact_against_a_loop(odd, support):
    rows = odd.collect()
    size = Counter(folded(r.text) for r in rows)
    keep = {}
    for r in rows:
        keep[folded(r.text)] = max(keep.get(folded(r.text), -1), -1 if r.doc_id is None else r.doc_id)
    text = {r.doc_id: folded(r.text) for r in rows}
    got = exact_dedup.exact_duplicates(odd, support).collect()
    assert len(got) == len(rows)
    assert Counter(g.text_sha256 for g in got if g.kept) == Counter({g.text_sha256: 1 for g in got})
    for g in got:
        assert (g.keep_id if g.keep_id is not None else -1, g.group_size) == (keep[text[g.doc_id]], size[text[g.doc_id]])
    kept = exact_dedup.drop_exact_duplicates(odd, support)
    assert kept.columns == odd.columns
    assert Counter(folded(r.text) for r in kept.collect()) == Counter(set(size))


def joined(spark, sf_dir):
    """Documents with a second, large column from a join, in small partitions that depend on what is read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.select("doc_id", F.repeat("text", 3).alias("more"))
    return docs.hint("merge").join(more, "doc_id")


@pytest.mark.parametrize("size", ["20k", "200k"])
def test_rows_of_a_join_keep_their_numbers(spark, sf_dir, sf01, size):
    from lexispark.llm.common import setting

    with setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", size), setting(spark, "spark.sql.adaptive.coalescePartitions.minPartitionSize", size), setting(spark, "spark.sql.shuffle.partitions", "60"):
        docs = joined(spark, sf01)
        rows = docs.collect()
        last = {}
        for r in rows:
            last[folded(r.text)] = max(last.get(folded(r.text), -1), r.doc_id)
        kept = exact_dedup.drop_exact_duplicates(docs).collect()
        assert sorted(r.doc_id for r in kept) == sorted(last.values())


def test_heavy_digests_are_found(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same").otherwise(F.col("id").cast("string")).alias("text"))
    heavy = exact_dedup.heavy_winners(exact_dedup._digests(rows), 0.1).collect()
    assert [(h.keep_id, h.group_size) for h in heavy] == [(2997, 1000)]
    got = exact_dedup.exact_duplicates(rows, 0.1).where("group_size > 1").agg(F.count("*"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (1000, 1)


def test_exact_plan_has_no_python(odd):
    plan = exact_dedup.exact_duplicates(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_and_mix_of_nothing(empty):
    for op in (exact_dedup.exact_duplicates, exact_dedup.drop_exact_duplicates, mixing.mixed_sizes, mixing.mix):
        assert op(empty).count() == 0


def filled(sizes, weights, share=1.5, cap=2.0):
    """Shares, stops and shares the excess again."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        part = {s: left * weights[s] / total for s in open_}
        left = 0.0
        for s, more in part.items():
            target[s] += more
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_targets_against_sharing_rounds(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, "é": 300, None: 70}
    weights = dict(zip(sizes, (3, 1, 2, 3, 1, 2), strict=True))
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = filled(sizes, weights)
    assert {r.source: pytest.approx(r.target, abs=1e-5) for r in got} == want


def test_mix_takes_what_it_says(odd):
    said = mixing.mixed_sizes(odd).collect()
    taken = Counter(r.n_chars for r in mixing.mix(odd).collect())
    rows = {r.n_chars: r for r in odd.collect()}
    assert len(said) == odd.count()
    assert all(r.copies <= 2 and r.taken == r.copies * r.size for r in said)
    assert mixing.mix(odd).columns == odd.columns
    by_id = Counter()
    for n, k in taken.items():
        by_id[rows[n].doc_id] += k
    want = Counter()
    for r in said:
        want[r.doc_id] += r.copies
    assert +want == by_id


def test_sources_come_near_their_targets(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    got = mixing.mixed_sizes(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).agg(F.sum("taken"), F.sum("target")).first()
    assert abs(got[0] - got[1]) < 0.1 * got[1]
