from __future__ import annotations

import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lexispark import providers
from lexispark.operators import browse, learning, review, search
from lexispark.plans import source_queries
from lexispark.sources import feedback, tables
from lexispark.streaming import feedback as stream


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'a "quoted", cell\nand a line', "null"), ("2", " padded ", "NA"), ("3", "", "x"), ("4", "", "")]
    df = spark.createDataFrame(rows, tables.strings("id", "poem", "category")).coalesce(1)
    tables.write_csv(df, f"{tmp_path}/out")
    back = tables.read_csv(spark, f"{tmp_path}/out", tables.strings("id", "poem", "category"))
    assert sorted(tuple(r) for r in back.collect()) == rows[:3]


def test_ordinals_follow_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,poem\n1,"x\ny"\n2,z\n')
    df = tables.with_ordinal(tables.read_csv(spark, f"{tmp_path}/a.csv", tables.strings("id", "poem")))
    assert [(r.id, r.ordinal) for r in tables.row_at(df, 1).collect()] == [("2", 1)]


def test_swap_and_bootstrap(spark, tmp_path):
    for n in (3, 5):
        tables.swap_in(spark.range(n), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_learning_round_trip(spark, tmp_path):
    tree = [
        {"topic": "A", "poems": [{"poem_text": "p0", "blanks": [{"word": "w", "options": ["w", "v"]}], "introduction": "i0", "interpretation": "t0"}]},
        {"topic": "B", "poems": [{"poem_text": "p1", "blanks": [], "introduction": "", "interpretation": "t1"}, {"poem_text": "p2", "blanks": [], "introduction": "i2", "interpretation": ""}]},
    ]
    (tmp_path / "l.json").write_text(json.dumps(tree))
    doc = tables.read_json(spark, f"{tmp_path}/l.json", tables.LEARNING)
    topics = doc.select(F.posexplode("doc").alias("topic_place", "t")).select("topic_place", "t.*")
    flat = topics.select("topic_place", "topic", F.posexplode("poems").alias("place", "p")).select("topic_place", "topic", "place", "p.*")
    numbered = learning.numbered(flat, "topic_place", "place")
    assert {(r.poem_text, r.number) for r in numbered.collect()} == {("p0", 0), ("p1", 1), ("p2", 2)}
    nested = learning.topics(numbered.select(F.col("number").alias("ordinal"), "topic", "poem_text", "blanks", "introduction", "interpretation"))
    assert [json.loads(j) for j in nested.select(F.to_json(F.struct("topic", "poems"))).toPandas().iloc[:, 0]] == tree
    text = "\n".join(r.value for r in learning.blocks(numbered).orderBy("number").collect()).replace("i2", "new intro")
    changes = learning.updates(spark.createDataFrame([(text,)], "value string"))
    got = {r.poem_text: (r.introduction, r.interpretation) for r in learning.updated(numbered.select("number", "poem_text", "introduction", "interpretation"), changes).collect()}
    assert got == {"p0": ("i0", "t0"), "p1": ("", "t1"), "p2": ("new intro", "")}


def test_feedback_batch_and_stream_agree(spark, tmp_path):
    reports = spark.createDataFrame([(1, "", "like", "a|b\nc"), (2, "u", "dislike", ""), (3, "u", "other", "x"), (None, "u", "like", "x")], "poem_id int, username string, status string, interpretation string")
    feedback.append(reports, f"{tmp_path}/log")
    batch = sorted(tuple(r) for r in feedback.read(spark, f"{tmp_path}/log").collect())
    assert batch == [(1, "Ẩn danh", "like", "a b c"), (2, "u", "dislike", "")]
    assert feedback.read(spark, f"{tmp_path}/log", strict=True).count() == 1
    query = stream.append_to(stream.reports(spark, f"{tmp_path}/log"), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == batch


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    got = {r.id: r.e for r in df.select("id", providers.embedding(F.col("text")).alias("e")).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-5
    assert set(got[2]) == {0.0}

    def call(row):
        if row["id"] == 2:
            raise RuntimeError
        return {"type": "x"}

    assert {(r.id, r.type) for r in providers.enrich(df, call, "type string").collect()} == {(1, "x"), (2, None)}
    assert providers.answer(df.orderBy("id").withColumn("explanation", F.lit("e")), lambda rows: (9, "t"))["id"] == 1


def test_hybrid_search_with_text_fallback(spark):
    vectors = spark.createDataFrame([(0, 0, 0, [1.0, 0.0]), (1, 1, 0, [0.0, 1.0])], "vec_id long, entry_ord long, facet int, embedding array<float>")
    entries = spark.createDataFrame([(0, ["k"], "(A)", "one"), (1, ["l"], "(B)", "two words")], "ordinal long, keywords array<string>, category string, poem string")
    words = spark.createDataFrame([("k", 0, [1.0, 0.0]), ("l", 1, [0.0, 1.0])], "keyword string, vec_id long, embedding array<float>")
    near = search.search(vectors, words, entries, [1.0, 0.0], k=5).collect()
    assert [(r.entry_ord, r.match_type) for r in near] == [(0, "poem")]
    assert search.search(vectors, words, entries, [1.0, 0.0], category="b").count() == 0
    none = search.search(vectors, words.limit(0), entries, [0.0, 0.0], text=" TWO ").collect()
    assert [(r.entry_ord, r.match_type) for r in none] == [(1, "text")]
    with pytest.raises(ValueError, match="k starts at 1"):
        search.search(vectors, words, entries, [1.0, 0.0], k=0)


def test_search_patterns_are_not_escapes(spark):
    rows = spark.createDataFrame([("a", "A", "x\\y", "c"), ("b", "A", "x%", "c")], "id string, base_alphabet string, poem string, category string")
    assert {r.id for r in browse.matching(rows, search="\\").collect()} == {"a"}
    assert browse.matching(rows, search="x_").count() == 2


def test_new_terms_fold_in_order():
    got = search.fold_new_terms([("New", [1.0, 0.0]), ("near", [0.99, 0.1]), ("OLD", [0.0, 1.0])], [("old", [0.0, 1.0])])
    assert got == {"New": "New", "near": "New", "OLD": "old"}


def test_state_defaults(spark):
    state = spark.createDataFrame([([], ["k"]), (None, None)], "types array<string>, keywords array<string>")
    got = review.state_with_defaults(state, {"types": ["t"], "keywords": ["d"]}).collect()
    assert [(r.types, r.keywords) for r in got] == [(["t"], ["k"]), (["t"], ["d"])]


def test_index_rows(spark):
    entries = spark.createDataFrame([(0, "a", "", "c"), (1, "d", "e", "f")], "ordinal long, poem string, meaning string, keywords string")
    rows = search.index_rows(entries, ("poem", "meaning", "keywords"), providers.embedding)
    assert sorted((r.vec_id, r.entry_ord, r.facet) for r in rows.collect()) == [(0, 0, 0), (2, 0, 2), (3, 1, 0), (4, 1, 1), (5, 1, 2)]


def odd_documents(spark, folder, texts):
    rows = [(i, x, "en" if i % 3 else None, "s" if i % 4 else None) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return con


def test_odd_texts_are_embedded_as_in_sql(spark, tmp_path):
    con = odd_documents(spark, tmp_path, ["\n", "\t\n ", "İstanbul x", "ΟΔΟΣ b", "w5 w16", "a\rb\x0bc d", "Straße ẞ", None, "", "\r"])
    got = source_queries.embedded_texts(spark, str(tmp_path)).collect()
    assert sum(math.isnan(r.embedding[0]) for r in got) == 1  # w5 and w16 cancel out
    want = con.execute(source_queries.ORACLES["embedded_texts"]).fetchall()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(r) for r in want)


def test_json_documents_keep_all_topics_and_nulls(spark, tmp_path):
    con = odd_documents(spark, tmp_path, [f"poem {i}" for i in range(700)] + [None, "", 'a "b"\\\n\u2028'])
    got = sorted(repr(tuple(r)) for r in source_queries.json_round_trip(spark, str(tmp_path)).collect())
    want = con.execute(source_queries.ORACLES["json_round_trip"]).fetchall()
    assert got == sorted(repr(r) for r in want)


def test_a_file_of_several_json_documents(spark, tmp_path):
    df = spark.createDataFrame([([i],) for i in range(5)], "doc array<int>")
    tables.write_json(df.coalesce(1), f"{tmp_path}/json")
    assert sorted(r.doc for r in tables.read_json(spark, f"{tmp_path}/json", "array<int>", lines=True).collect()) == [[i] for i in range(5)]


def test_each_written_file_is_listed_and_odd_values_stay(spark, tmp_path):
    """files_listing: no folder for each file, one task writes many; nulls have no file, blanks and line breaks stay."""
    rows = [(0, "t", " en ", "s"), (3, "t", None, "s"), (6, "t", "e\nn", "s"), (9, "t", "", "s"), (-3, "t", "d\u00e9", "s"), (None, "t", "en", "s"), (7, "t", "en", "s")]
    rows += [(i, "t", "en", "s") for i in range(300, 900, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = source_queries.files_listing(spark, str(tmp_path))
    made = tables._made[-1][1].removeprefix("file://")
    want = con.execute(source_queries.ORACLES["files_listing"]).fetchall()
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(r) for r in want)
    names = [(folder, f) for folder, _, names in os.walk(made) for f in names]
    assert len(names) == 204 and len({folder for folder, _ in names}) <= tables.FOLDERS
    assert {f for _, f in names} == {f"i{i}.txt" for i, _, lang, _ in rows if i is not None and i % 3 == 0 and lang is not None}
