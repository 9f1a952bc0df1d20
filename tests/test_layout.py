from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import layout
from lexispark.plans import entries as entries_

SCHEMA = "page int, line_idx int, text string, x double, y double, w double, h double, heading boolean"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(7)
    rows = []
    for page in range(120):
        y = 0.0
        for i in range(rng.randint(1, 14)):
            text = rng.choice(["Abc", "abc", "Abc.", "12", "(Abc)", "Đa!"])
            rows.append((page, i, text, rng.choice([0.1, 0.12, 0.2]), round(y, 6), 0.5, 0.01, rng.random() < 0.25))
            y += 0.01 + rng.choice([0.001, 0.003, 0.005, 0.0075, 0.012, 0.015])
    return rows


#: Pages as (text, gap to the line above, heading) and the letters of their roles: Category, Poem, Explanation, Orphan.
PAGES = [
    ([("Một", 0, 0), ("(CA DAO)", 0.001, 1)], "PC"),
    ([("(CA DAO)", 0, 1), ("Nghĩa", 0.001, 0)], "CE"),
    ([("lost", 0, 0), ("text", 0.001, 0)], "OO"),
    ([("Xa", 0, 0), ("Gần", 0.015, 0), ("(CA DAO)", 0.001, 1)], "OPC"),  # far above: stops
    ([("xa", 0, 0), ("Gần", 0.001, 0), ("(CA DAO)", 0.02, 1)], "PPC"),  # the line right above never stops; close lines go on
    ([("nhỏ", 0, 0), ("Gần", 0.004, 0), ("(CA DAO)", 0.001, 1)], "OPC"),  # a small letter and a gap
    ([("Hoa", 0, 0), ("Gần", 0.004, 0), ("(CA DAO)", 0.001, 1)], "PPC"),  # a capital needs a wider gap
    ([("Hoa", 0, 0), ("Gần", 0.008, 0), ("(CA DAO)", 0.001, 1)], "OPC"),
    ([("Hoa.", 0, 0), ("Gần", 0.0055, 0), ("(CA DAO)", 0.001, 1)], "OPC"),  # less after the end of a sentence
    ([("12", 0, 0), ("Gần", 0.008, 0), ("(CA DAO)", 0.001, 1)], "PPC"),  # no letter at all
    ([("A", 0, 0), ("(CA DAO)", 0.001, 1), ("(TỤC NGỮ)", 0.001, 1)], "PCC"),
    ([("A", 0, 0), ("(CA DAO)", 0.001, 1), ("nghĩa", 0.02, 0), ("B", 0.02, 0), ("(TỤC NGỮ)", 0.001, 1)], "PCEPC"),
]


def test_segments_of_small_pages(spark):
    rows = []
    for page, (lines, _) in enumerate(PAGES):
        y = 0.0
        for i, (text, gap, heading) in enumerate(lines):
            y += gap + 0.01 * (i > 0)
            rows.append((page, i, text, 0.1, y, 0.5, 0.01, bool(heading)))
    df = layout.segments(spark.createDataFrame(rows, SCHEMA), ["page"], F.col("heading"))
    got = {(r.page, r.line_idx): r.role[0].upper() for r in df.collect()}
    assert ["".join(got[page, i] for i in range(len(lines))) for page, (lines, _) in enumerate(PAGES)] == [roles for _, roles in PAGES]


def test_segments_of_any_page(spark, pages):
    """Each line has one role; a poem stands right above its heading, and none of its lines but the last two stops; what explains comes after its heading."""
    df = layout.segments(spark.createDataFrame(pages, SCHEMA), ["page"], F.col("heading"))
    by_page: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r.page, r.line_idx)):
        by_page.setdefault(r.page, []).append(r)
    assert sum(map(len, by_page.values())) == len(pages)
    for lines in by_page.values():
        heads = [r.line_idx for r in lines if r.heading]
        assert [r.entry_idx for r in lines if r.role == "category"] == list(range(len(heads)))
        for r in lines:
            assert (r.role == "category") == r.heading
            if r.role == "poem":
                below = lines[r.line_idx + 1]
                assert below.entry_idx == r.entry_idx
                assert below.role in ("poem", "category")
                assert r.stop_rule == 0
            elif r.role == "explanation":
                assert heads[r.entry_idx] < r.line_idx
            elif r.role == "orphan":
                assert not heads or r.line_idx < heads[0]


def test_export_of_a_book(spark):
    rows = [
        (0, 0, "tiếp theo", 0.1, 0.00, 0.5, 0.01, False),
        (1, 0, "Câu một", 0.1, 0.00, 0.5, 0.01, False),
        (1, 1, "(CA DAO)", 0.1, 0.012, 0.5, 0.01, False),
        (1, 2, "Nghĩa là..", 0.1, 0.03, 0.5, 0.01, False),
        (2, 0, "• còn nữa", 0.1, 0.00, 0.5, 0.01, False),
        (3, 0, "và nữa.", 0.1, 0.00, 0.5, 0.01, False),
        (3, 1, "Câu hai", 0.1, 0.05, 0.5, 0.01, False),
        (3, 2, "(TỤC NGỮ)", 0.1, 0.062, 0.5, 0.01, False),
    ]
    lines = spark.createDataFrame([("b", *r) for r in rows], f"book string, {SCHEMA}")
    got = {tuple(r)[1:] for r in layout.exported(lines, ["book"], "page").collect()}
    assert got == {
        ("", "", "tiếp theo", "0"),
        ("Câu một", "(CA DAO)", "Nghĩa là. còn nữa và nữa.", "1,2,3"),
        ("Câu hai", "(TỤC NGỮ)", "", "3"),
    }
    parts = layout.parts(layout.segments(lines, ["book", "page"]), ["book", "page"], ["book"], "page").collect()
    assert {(r.entry_place, r.entry_idx, r.page) for r in parts} == {(1, 0, 1), (1, 0, 2), (1, 0, 3), (3, 0, 3), (None, None, 0)}


def test_verses_and_paragraphs(spark):
    rows = [
        (0, 0, "First verse", 0.1, 0.00, 0.5, 0.01, False),
        (0, 1, "goes on.", 0.1, 0.02, 0.5, 0.01, False),
        (0, 2, "Second", 0.1, 0.06, 0.5, 0.01, False),
        (0, 3, "Indented", 0.15, 0.08, 0.5, 0.01, False),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.text for r in layout.verses(df, ["page"]).orderBy("verse").collect()] == ["First verse goes on.", "Second Indented"]
    assert [r.text for r in layout.paragraphs(df, ["page"]).orderBy("paragraph").collect()] == ["First verse goes on.", "Second Indented"]


def test_entries(spark):
    rows = [
        (0, 0, "orphan text", 0.1, 0.00, 0.5, 0.01, False),
        (0, 1, "• Verse one", 0.1, 0.05, 0.5, 0.01, False),
        (0, 2, "(CA DAO)", 0.1, 0.062, 0.2, 0.01, False),
        (0, 3, "It means.. this", 0.1, 0.08, 0.5, 0.01, False),
    ]
    got = layout.entries(layout.segments(spark.createDataFrame(rows, SCHEMA), ["page"]), ["page"]).collect()
    assert [(r.category, r.poem, r.explanation) for r in got] == [("(CA DAO)", "Verse one", "It means. this")]


def test_stitching_conserves_text(spark):
    rows = [("b", 0, None, None, "lost"), ("b", 1, "e1", "one", "more"), ("b", 2, None, None, "two"), ("b", 3, None, None, "three"), ("b", 4, "e2", "four", "")]
    df = spark.createDataFrame(rows, "book string, page int, entry string, text string, orphan string")
    got = layout.stitched(df, ["book"], "page", F.col("entry"), F.col("text"), F.col("orphan")).collect()
    assert {(r.entry, r.text, tuple(r.pages)) for r in got} == {(None, "lost more", (0, 1)), ("e1", "one two three", (1, 2, 3)), ("e2", "four", (4,))}


def test_boxes(spark):
    df = spark.createDataFrame([(0, 0, "a", 0.0, 0.001, 0.5, 0.01, False), (0, 1, "b", 0.1, 0.5, 0.9, 0.5, False)], SCHEMA)
    spots = spark.createDataFrame([(0, 0, "poem", (0.0, 0.0, 1.0, 0.1))], "page int, entry_idx int, role string, box struct<x:double,y:double,w:double,h:double>")
    got = {r.line_idx: (r.entry_idx, r.role) for r in layout.assigned(df, spots, ["page"]).collect()}
    assert got == {0: (0, "poem"), 1: (None, None)}
    assert layout.residue(layout.assigned(df, spots, ["page"]), spots, ["page"]).count() == 0


def test_an_export_segments_its_pages_once(spark, sf_dir):
    lines = entries_.lines(spark, sf_dir).withColumn("book", F.col("page") % 3)
    plan = layout.exported(lines, ["book"], "page", F.col("heading"))._jdf.queryExecution().optimizedPlan().toString()
    assert "stop_rule" in plan and "documents.parquet" not in plan and plan.count("lead(") == 0
