"""Versions, page directories, postings, the reply log and the restarted stream."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import batch, browse, enrich, postings
from lexispark.sources import feedback, tables, versions
from lexispark.streaming import feedback as stream


def test_versions_are_whole_or_not_there(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    assert versions.bootstrap(spark.range(3), root)
    assert not versions.bootstrap(spark.range(9), root)
    pinned = versions.read(spark, root)
    assert versions.publish(spark.range(5), root) == 2
    assert (versions.read(spark, root).count(), pinned.count(), versions.read(spark, root, 1).count()) == (5, 3, 3)
    monkeypatch.setattr(versions, "_point", lambda *a: 1 / 0)  # the writer dies between the table and its pointer
    with pytest.raises(ZeroDivisionError):
        versions.publish(spark.range(7), root)
    monkeypatch.undo()
    assert versions.read(spark, root).count() == 5
    (tmp_path / "t" / "_pointers" / "000000000003").write_text("")  # or while it writes the pointer
    assert versions.read(spark, root).count() == 5
    assert versions.publish(spark.range(8), root) == 4
    assert versions.versions(spark, root) == [1, 2, 4]
    versions.prune(spark, root, keep=1)
    assert (versions.versions(spark, root), versions.read(spark, root).count()) == ([4], 8)


def test_two_writers_never_share_a_number(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    versions.publish(spark.range(1), root)
    monkeypatch.setattr(versions, "_pointers", lambda *a: [])  # both have looked before either wrote
    assert versions.publish(spark.range(2), root) == 2
    assert versions.publish(spark.range(3), root) == 3
    monkeypatch.undo()
    assert versions.read(spark, root).count() == 3


@pytest.fixture(scope="module")
def entries(spark):
    rng = random.Random(3)
    rows = [(f"{i:03}", rng.choice([None, "A", "B", "é"]), rng.choice([None, "x", "y " * rng.randint(0, 4), "Zoë–z"]), i) for i in range(150)]
    return spark.createDataFrame(rows + [rows[0]], "id string, Alphabet string, poem string, ordinal long").repartition(5)


def test_any_page_of_a_directory(spark, tmp_path, entries):
    browse.write_pages(entries, f"{tmp_path}/pages", 9)
    pages = browse.read_pages(spark, f"{tmp_path}/pages")
    every = [tuple(r) for r in entries.orderBy(*browse.ORDER).collect()]
    assert pages.total == 151
    for size in (1, 7, 200):
        for number in (1, 2, 13, 22, 151, 152, 900):
            assert [tuple(r) for r in pages.page(number, size).collect()] == every[(number - 1) * size : number * size]
    for at in (0, 40, 75, 149):
        row = dict(zip(("id", "Alphabet", "poem", "ordinal"), every[at], strict=True))
        want = [r for r in every[at + 1 :] if r[:3] != every[at][:3]][:6]
        assert [tuple(r) for r in pages.after(row, 6).collect()] == want
    plan = pages.page(13, 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan
    with pytest.raises(ValueError, match="start at 1"):
        pages.page(0)
    browse.write_pages(entries.limit(0), f"{tmp_path}/none", 3)


def test_postings_find_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abAB é🙂") for _ in range(rng.randint(0, 12))) if i % 9 else None, rng.choice(["aba", None, "", "zz"])) for i in range(200)]
    entries = spark.createDataFrame(rows, "ordinal long, poem string, note string")
    postings.write(entries, ("poem", "note"), f"{tmp_path}/p")
    index = spark.read.parquet(f"{tmp_path}/p")
    for query in ("aba", "ABAB", " a🙂b ", "é", "", "ab", "zz", "bbbbbbbbbbbbb", "nothing", "a b"):
        got = postings.literal(entries, index, query, ("poem", "note"), 20).collect()
        assert got == browse.literal(entries, query, ("poem", "note"), 20).collect(), query
    plan = postings.candidates(index, "aba")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(gram" in plan or "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram)" in plan


def test_long_texts_have_their_trigrams_in_linear_time(spark):
    import time

    began = time.monotonic()
    assert spark.createDataFrame([("é" * 300_000 + "ab",)], "t string").select(F.size(postings.trigrams(F.col("t")))).first()[0] == 3
    assert time.monotonic() - began < 30


def test_a_run_that_dies_asks_again_only_for_what_it_lost(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"p{i}", "e", None if i % 10 else "done", None if i % 10 else "done") for i in range(60)], "id string, poem string, explanation string, searchable_explanation string, keywords string")
    calls = f"{tmp_path}/calls"

    def model(row):
        with open(calls, "a") as f:
            f.write(row["id"] + "\n")
        return {} if row["id"] == "13" else {"meaning": "m" + row["id"], "keywords": ["k"]}

    enrich.run(rows, model, f"{tmp_path}/log", chunk=10, most=3, tries=1)
    first = open(calls).read().split()
    assert 0 < len(first) < 54
    found = enrich.run(rows, model, f"{tmp_path}/log", chunk=10, tries=1)
    asked = open(calls).read().split()
    assert sorted(set(asked), key=int) == [str(i) for i in range(60) if i % 10]
    assert all(asked.count(i) == 1 for i in set(asked) - {"13"})
    assert found.count() == 53
    merged = enrich.merged(rows, found, found.select("id", F.array_join("keywords", ",").alias("keywords")))
    assert {r.id for r in enrich.pending(merged).collect()} == {"13"}


def test_a_run_has_few_chunks_however_many_rows(spark, tmp_path, monkeypatch):
    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("poem"), F.lit("e").alias("explanation"), *[F.lit(None).cast("string").alias(c) for c in ("searchable_explanation", "keywords")])
    asked = []
    monkeypatch.setattr(enrich, "replies", lambda some, *how: asked.append(some) or some.select("id", F.lit("m").alias("meaning"), F.array("poem").alias("keywords")))
    found = enrich.run(rows, None, f"{tmp_path}/log", chunk=2)
    assert sorted(int(r.id) for r in found.collect()) == list(range(300))
    assert len(asked) <= 32
    assert sum(some.count() for some in asked) == 300


def test_keywords_of_a_run_grow_the_vocabulary(spark):
    found = spark.createDataFrame([("1", "m", ["Love", " hope"]), ("2", "m", ["affection", "love", "HOPE"]), ("3", "m", None), ("4", "m", ["fear", "hope"])], enrich.LOGGED)
    terms = spark.createDataFrame([("fear", [0.0, 0.0, 1.0])], "keyword string, embedding array<double>")
    near = lambda name: F.when(F.lower(F.trim(name)).isin("love", "affection"), F.array(F.lit(1.0), F.lit(0.1), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    got = {r.id: (r.keywords, r.new_terms) for r in enrich.resolved(found, terms, near, grow=True).collect()}
    assert got == {"1": ("Love, hope", ["Love", "hope"]), "2": ("Love, hope", []), "4": ("fear, hope", [])}
    frozen = {r.id: r.keywords for r in enrich.resolved(found, terms, near).collect()}
    assert frozen["2"] == "affection, love, HOPE"


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    row = lambda i: spark.createDataFrame([(i, "u", "like", f"t{i}")], "poem_id int, username string, status string, interpretation string")
    log, out, state = (f"{tmp_path}/{n}" for n in ("log", "out", "state"))
    for n in range(3):
        feedback.append(row(2 * n).unionByName(row(2 * n + 1)).repartition(2), log)
        stream.append_to(stream.reports(spark, log, files=1), out, state).awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == sorted(tuple(r) for r in feedback.read(spark, log).collect())
    assert spark.read.parquet(out).count() == 6


def test_scratch_is_deleted(spark):
    path = tables.scratch(spark, "x")
    spark.range(2).write.parquet(path)
    held = [m for m in tables._made if m[1] != path]
    tables._made[:] = [m for m in tables._made if m[1] == path]
    tables.clear(spark)
    tables._made[:] = held
    import os

    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_carried_text_and_corrections(spark):
    box = lambda y, h: {"x": 0.0, "y": y, "w": 1.0, "h": h}
    shape = "struct<x:double,y:double,w:double,h:double>"
    line = lambda p, i, y, text: ("b", p, i, text, 0.1, y, 0.5, 0.01)
    lines = spark.createDataFrame(
        [line(1, 0, 0.1, "Verse one"), line(1, 1, 0.12, "goes on"), line(1, 2, 0.2, "CA DAO"), line(1, 3, 0.3, "Told."), line(2, 0, 0.05, "Second verse"), line(3, 0, 0.05, "third part"), line(4, 0, 0.05, "• last..")],
        "book string, page int, line_idx int, text string, x double, y double, w double, h double",
    )
    layout = spark.createDataFrame([("b", 1, 0, "poem", box(0.09, 0.06)), ("b", 1, 0, "category", box(0.19, 0.03)), ("b", 1, 0, "explanation", box(0.25, 0.2)), ("b", 1, 1, "poem", None)], f"book string, page int, entry_idx int, role string, box {shape}")
    pages = spark.createDataFrame([("b", p, 10 + p, stitch, box(0.0, 0.1) if p > 1 else None) for p, stitch in ((1, None), (2, True), (3, False), (4, False))], f"book string, page int, page_num int, stitch_poem boolean, orphan_box {shape}")
    kept = lambda rows: spark.createDataFrame(rows, "book string, page int, entry_idx int, poem string, explanation string")

    def rows(layout, human, force=False):
        return {r.entry_idx: (r.poem, r.category, r.explanation, r.pages, [p.place for p in r.parts]) for r in batch.exported(lines, layout, pages, kept(human), ["book"], "page", force).collect()}

    one = layout.where("entry_idx = 0")
    assert rows(one, []) == {0: ("Verse one goes on\nSecond verse", "CA DAO", "Told. third part  last.", "11,12,13,14", [1, 2, 3, 4])}
    assert rows(one, [("b", 1, 0, "Mine", None)])[0][0] == "Mine"
    assert rows(one, [("b", 1, 0, "Verse one goes on", " ")])[0][0] == "Verse one goes on\nSecond verse"  # what the machine had is no correction
    assert rows(one, [("b", 1, 0, "Mine", "Told. third part")], force=True)[0][0] == "Verse one goes on\nSecond verse"
    assert rows(one, [("b", 1, 0, None, "Told. third part")])[0][2] == "Told. third part  last."
    assert rows(layout, [])[1] == ("Second verse", "", "third part  last.", "11,12,13,14", [2, 3, 4])
    front = rows(layout.limit(0), [])
    assert front == {None: ("", "", "Second verse third part  last.", "12,13,14", [2, 3, 4])}
