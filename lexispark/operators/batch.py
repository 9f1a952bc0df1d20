"""A batch of pages with adjusted boxes, from lines to export in one plan (2.11, J8, J11, J12, U6, B18).

Lines: page columns, text, x, y, w, h. Layout: page columns, entry_idx, role, box. Pages:
book columns, place, page_num, stitch_poem, orphan_box. Everything is grouped by page
or by the entry that carries text on; only the carry itself looks at more than one
page, and it does so over one row a page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import geometry as g
from lexispark.functions import text as t
from lexispark.operators import layout as lay

ADDED = "array<struct<place:bigint,page_num:bigint,stitch_poem:boolean,orphan:string,orphan_box:struct<x:double,y:double,w:double,h:double>>>"


def _text(rows: DataFrame, keys: Sequence[str], order: str, name: str, by: str = "\n") -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"])
    return rows.groupBy(*keys).agg(F.array_join(ordered, by).alias(name))


def _inside(lines: DataFrame, boxes: DataFrame, page: Sequence[str]) -> DataFrame:
    """Each line with each box of its page that holds its centre."""
    spots = boxes.select(*page, *[F.col(c).alias(f"_{c}") for c in boxes.columns if c not in page])
    return lines.join(spots, list(page)).where(g.holds_centre(F.col("_box"), F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def extracted(lines: DataFrame, layout: DataFrame, page: Sequence[str]) -> DataFrame:
    """(page, entry_idx, poem, category, explanation): the texts that each entry's boxes hold, from top to bottom and left to right.

    An entry's category box takes a line before its poem box, and that before its
    explanation box; boxes of different entries don't share out their lines.
    """
    keys = [*page, "entry_idx"]
    read = lay.read_order(lines, page)
    rank = F.when(F.col("_role") == "category", 0).when(F.col("_role") == "poem", 1).otherwise(2)
    hits = _inside(read, layout, page).groupBy(*page, "line_idx", F.col("_entry_idx").alias("entry_idx")).agg(
        F.min_by("_role", rank).alias("role"), *[F.first(c).alias(c) for c in ("text", "x", "y", "w", "h")]
    )
    of = lambda role: hits.where(F.col("role") == role)
    poem = _text(lay.verses(of("poem"), keys), keys, "verse", "poem")
    told = _text(lay.paragraphs(of("explanation"), keys), keys, "paragraph", "explanation")
    heads = _text(of("category").withColumn("text", t.strip(F.col("text"))), keys, "line_idx", "category", " ")
    found = layout.select(*keys).distinct().join(poem, keys, "left").join(heads, keys, "left").join(told, keys, "left")
    return found.select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in ("poem", "category", "explanation")])


def orphans(lines: DataFrame, layout: DataFrame, pages: DataFrame, page: Sequence[str]) -> DataFrame:
    """(page, orphan): the text of a page that no entry of its own takes.

    The lines in the page's orphan box; where it has none, the lines in no box and above
    the poem box of the page's first entry (J12).
    """
    read = lay.read_order(lines, page)
    boxed = pages.where("orphan_box is not null").select(*page, F.col("orphan_box").alias("box"))
    in_box = _inside(read, boxed, page).select(read.columns)
    first = layout.groupBy(*page).agg(F.min_by(F.struct("entry_idx"), F.col("entry_idx")).alias("_first"))
    poems = layout.where("role = 'poem'").join(first, list(page)).where("entry_idx = _first.entry_idx").select(*page, F.col("box.y").alias("_top"))
    free = pages.where("orphan_box is null").select(*page)
    taken = _inside(read, layout.select(*page, "box"), page).select(*page, "line_idx").distinct()
    above = read.join(free, list(page)).join(poems, list(page)).where(F.col("y") + F.col("h") / 2 < F.col("_top")).join(taken, [*page, "line_idx"], "left_anti").select(read.columns)
    return _text(lay.paragraphs(in_box.unionByName(above), page), page, "paragraph", "orphan")


def _joined(own: Column, more: Column, by: str) -> Column:
    parts = F.filter(F.concat(F.array(t.strip(own)), more), lambda x: x != "")
    return F.array_join(parts, by)


def _states(own: Column, more: Column, by: str, clean) -> Column:
    """The text as it was after none, one, two, ... of what was added."""
    return F.transform(F.sequence(F.lit(0), F.size(more)), lambda n: F.when(n == 0, t.strip(own)).otherwise(clean(_joined(own, F.slice(more, F.lit(1), n), by))))


def _kept(states: Column, corrected: Column, force: bool) -> Column:
    """The last state, unless a human has written something that none of those before was."""
    last = F.element_at(states, -1)
    if force:
        return last
    human = t.strip(F.coalesce(corrected, F.lit("")))
    earlier = F.when(F.size(states) > 1, F.slice(states, F.lit(1), F.size(states) - 1)).otherwise(F.array().cast("array<string>"))
    return F.when((human == "") | F.array_contains(earlier, human), last).otherwise(human)


def exported(lines: DataFrame, layout: DataFrame, pages: DataFrame, kept: DataFrame, book: Sequence[str], place: str, force: bool = False) -> DataFrame:
    """The rows of the export: id, book, place, entry_idx, poem, category, explanation, pages and parts (where it stands).

    A page's orphan text goes to the last entry of the pages before it: to its poem where
    the page says stitch_poem, else to its explanation, page after page. kept: page columns,
    entry_idx, poem, explanation, as humans have corrected them (null: not); such a text stays
    as it is and takes in nothing. With force it doesn't. Orphan text before the first entry
    of a book is one row, without an entry.
    """
    page, keys = [*book, place], [*book, place, "entry_idx"]
    found = extracted(lines, layout, page)
    bounds = layout.groupBy(*keys).agg(g.union_bounds(F.col("box")).alias("own_box"))
    entries = found.join(bounds, keys, "left").join(pages.select(*page, "page_num"), page, "left")
    last = layout.groupBy(*page).agg(F.max("entry_idx").alias("_last"))
    chain = pages.join(orphans(lines, layout, pages, page), page, "left").join(last, page, "left")
    active = F.when(F.col("_last").isNotNull(), F.struct(F.col(place).cast("long").alias("place"), F.col("_last").alias("entry_idx")))
    lost = lay.carried(chain, book, place, active).where(F.trim(F.coalesce("orphan", F.lit(""))) != "")
    added = F.struct(F.col(place).cast("long").alias("place"), F.col("page_num").cast("long").alias("page_num"), F.coalesce("stitch_poem", F.lit(False)).alias("stitch_poem"), "orphan", "orphan_box")
    more = lost.groupBy(*book, "active").agg(F.array_sort(F.collect_list(added)).alias("added"))
    onto = more.where("active is not null").select(*book, F.col("active.place").alias(place), F.col("active.entry_idx").alias("entry_idx"), "added")
    human = kept.select(*keys, F.col("poem").alias("_poem"), F.col("explanation").alias("_explanation"))
    rows = entries.join(onto, keys, "left").join(human, keys, "left").withColumn("added", F.coalesce("added", F.array().cast(ADDED)))
    to = lambda poem: F.transform(F.filter("added", lambda a: a["stitch_poem"] == poem), lambda a: t.strip(a["orphan"]))
    poem = _kept(_states(F.col("poem"), to(True), "\n", t.clean_poem), F.col("_poem"), force)
    told = _kept(_states(F.col("explanation"), to(False), " ", t.clean_explanation), F.col("_explanation"), force)
    part = lambda at, box: F.struct(at.cast("long").alias("place"), box.alias("box"))
    own = F.when(F.col("own_box").isNotNull(), F.array(part(F.col(place), F.col("own_box")))).otherwise(F.array().cast("array<struct<place:bigint,box:struct<x:double,y:double,w:double,h:double>>>"))
    others = F.transform(F.filter("added", lambda a: a["orphan_box"].isNotNull()), lambda a: part(a["place"], a["orphan_box"]))
    numbers = F.array_sort(F.array_distinct(F.concat(F.array(F.col("page_num").cast("long")), F.transform("added", lambda a: a["page_num"]))))
    name = lambda *more: F.sha2(F.concat_ws("/", *[F.col(k).cast("string") for k in book], *more), 256)
    whole = rows.select(
        name(F.col(place).cast("string"), F.col("entry_idx").cast("string")).alias("id"), *keys, t.clean_poem(poem).alias("poem"), t.strip(F.col("category")).alias("category"),
        t.clean_explanation(told).alias("explanation"), F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",").alias("pages"), F.concat(own, others).alias("parts"),
    )
    front = more.where("active is null").select(
        name(F.lit("front")).alias("id"), *book, F.lit(None).cast(layout.schema["entry_idx"].dataType).alias("entry_idx"), F.element_at("added", 1)["place"].alias(place), F.lit("").alias("poem"), F.lit("").alias("category"),
        t.clean_explanation(F.array_join(F.transform("added", lambda a: t.strip(a["orphan"])), " ")).alias("explanation"),
        F.array_join(F.transform("added", lambda a: a["page_num"].cast("string")), ",").alias("pages"), others.alias("parts"),
    )
    return whole.unionByName(front.withColumn(place, F.col(place).cast(pages.schema[place].dataType)))
