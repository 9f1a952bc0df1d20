from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexispark import providers
from lexispark.api import Corpus
from lexispark.operators import browse, enrich, search
from lexispark.sources import index


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [("0", 0, "A", "mother love", "(CA DAO)", "about a mother", ["love"]), ("1", 1, "Đ", "rice field", "(TỤC NGỮ)", "about work", ["work", "rice"]), ("2", 2, "Â", "river boat", "(CA DAO)", "about travel", [])]
    entries = browse.with_letters(spark.createDataFrame(rows, "id string, ordinal long, Alphabet string, poem string, category string, explanation string, keywords array<string>"))
    path = str(tmp_path_factory.mktemp("index") / "v")
    index.write(search.index_rows(entries, ("poem", "explanation"), providers.embedding), path)
    words = search.vocabulary(entries).withColumn("vec_id", F.monotonically_increasing_id()).withColumn("embedding", providers.embedding(F.col("keyword")))
    return Corpus(entries, index.read(spark, path), words, providers.hashed_embedder())


def test_search(corpus):
    got = corpus.search("Mother LOVE ").collect()
    assert (got[0].id, got[0].matched_keyword) == ("0", "poem")
    assert [r.id for r in corpus.search("rice").collect()][0] == "1"
    assert corpus.search("mother love", category="TỤC NGỮ").where("id = '0'").count() == 0
    with pytest.raises(ValueError, match="empty"):
        corpus.search(" ")


def test_browse(corpus):
    page, totals = corpus.browse(alphabet="A", per_page=1)
    assert [r.id for r in page.collect()] == ["0"]
    assert tuple(totals.first()) == (2, 2)
    assert corpus.browse(text="RIVER")[0].count() == 1


def test_answer(corpus):
    assert corpus.answer("about work")["id"] == "1"
    assert corpus.answer("about work", lambda rows: (1, "text"))["answer"] == "text"


def test_feedback(corpus, tmp_path):
    corpus.report(f"{tmp_path}/log", 1, "like", text="a|b")
    assert [r.interpretation for r in corpus.feedback(f"{tmp_path}/log", 1).collect()] == ["a b"]
    with pytest.raises(ValueError, match="status"):
        corpus.report(f"{tmp_path}/log", 1, "maybe")


def test_images(corpus, tmp_path):
    (tmp_path / "1.png").write_bytes(b"x")
    assert {r.id: r.image is not None for r in corpus.images(str(tmp_path)).collect()} == {"0": False, "1": True, "2": False}


def test_enrichment_resumes(spark):
    rows = spark.createDataFrame(
        [("1", "p", "e", "", ""), ("2", "p", "e", "done", "k"), ("3", "", "e", "", ""), ("4", "p", "fails", None, None)],
        "id string, poem string, explanation string, searchable_explanation string, keywords string",
    )

    def call(row):
        return {} if row["explanation"] == "fails" else {"meaning": "m", "keywords": ["LOVE", "new one", "love"]}

    todo = enrich.pending(rows)
    assert {r.id for r in todo.collect()} == {"1", "4"}
    found = enrich.replies(todo, call, tasks=2).cache()
    terms = spark.createDataFrame([("love",)], "keyword string").withColumn("embedding", providers.embedding(F.col("keyword")))
    words = enrich.resolved(found, terms)
    assert [tuple(r) for r in words.collect()] == [("1", "love, new one", ["new one"])]
    done = {r.id: (r.searchable_explanation, r.keywords) for r in enrich.merged(rows, found, words).collect()}
    assert done == {"1": ("m", "love, new one"), "2": ("done", "k"), "3": ("", ""), "4": (None, None)}


def test_review(spark):
    from lexispark.api import Review

    row = "id string, poem string, keywords string"
    base = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("uuid", "c", "")], row)
    edits = spark.createDataFrame([("2", "B", "x"), ("11", "new", "x"), ("9", "newer", "y"), ("z", "last", "")], row)
    deleted = spark.createDataFrame([("1",)], "id string")
    found = Review(base, edits, deleted, ("poem", "keywords"), ["x", "y"])
    assert tuple(found.progress().first()) == (11, 4)
    assert tuple(found.new({"keywords": "x"}).first()) == ("12", "", "x")
    assert [r.id for r in found.export().collect()][-3:] == ["9", "11", "z"]
    assert {r.id: r.poem for r in found.export().collect()} == {"2": "B", "uuid": "c", "11": "new", "9": "newer", "z": "last"}
    assert {r.id for r in found.delete("2").collect()} == {"1", "2"}
    assert found.restore("1").count() == 0
    assert found.entry("2").first().is_reviewed
    good = spark.createDataFrame([("1", "A", "x, y")], row)
    assert {r.id: r.poem for r in found.save(good).collect()}["1"] == "A"
    with pytest.raises(Exception, match="unknown keywords: q"):
        found.save(spark.createDataFrame([("1", "A", "x, q")], row)).collect()


def test_review_writes_its_export_once_and_then_versions(spark, tmp_path):
    from lexispark.api import Review
    from lexispark.sources import versions

    row = "id string, poem string, keywords string"
    base, none = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], row), spark.createDataFrame([], row)
    first = Review(base, none, none.select("id"), ("poem", "keywords"), ["x", "y"])
    later = Review(base, spark.createDataFrame([("2", "B", "x")], row), none.select("id"), ("poem", "keywords"), ["x", "y"])
    assert first.start(f"{tmp_path}/reviewed")
    assert not later.start(f"{tmp_path}/reviewed")
    assert {r.poem for r in versions.read(spark, f"{tmp_path}/reviewed").collect()} == {"a", "b"}
    assert later.save_export(f"{tmp_path}/reviewed") == 2
    assert {r.poem for r in versions.read(spark, f"{tmp_path}/reviewed").collect()} == {"a", "B"}


def test_catalog(spark, tmp_path):
    from lexispark.sources.tables import Catalog

    paths = Catalog(f"{tmp_path}/")
    assert paths.source("../../etc/one.pdf") == f"{tmp_path}/source/one.pdf"
    assert paths.ensure(spark, paths.path("wiki", "new")) == f"{tmp_path}/wiki/new"
    assert (tmp_path / "wiki" / "new").is_dir()
    with pytest.raises(ValueError, match="no such"):
        paths.path("elsewhere")


def test_audit_of_equal_and_null_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, None)], "entry_ord long, embedding array<double>")
    items = spark.range(1, 8).withColumnRenamed("id", "entry_ord")
    row = search.audit(vectors, items).first()
    assert (row.n_vectors, row.n_duplicate, row.n_zero, row.n_entries, row.n_astray, row.n_missing) == (6, 4, 1, 5, 0, 2)
    assert search.audit(vectors.limit(0), items).first().n_duplicate == 0
