"""Lines of a page to entries: segments, verses, paragraphs, boxes, stitching (family F).

Lines are page columns, line_idx, text, x, y, w, h; every window is partitioned by page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import geometry as g
from lexispark.functions import text as t
from lexispark.sources.tables import stored

# Gaps and indents in page heights and widths.
FAR, LETTER_GAP, AFTER_END, IN_VERSE = 0.012, 0.003, 0.005, 0.0075
INDENT = 0.045
TYPICAL, LEAST, WIDE, PARAGRAPH = 0.008, 0.004, 1.4, 0.015


def read_order(lines: DataFrame, page: Sequence[str]) -> DataFrame:
    """line_idx from top to bottom and left to right."""
    return lines.withColumn("line_idx", (F.row_number().over(Window.partitionBy(*page).orderBy("y", "x")) - 1).cast("int"))


def split_headings(lines: DataFrame) -> DataFrame:
    """A line that begins with a heading becomes two, 0.4 and 0.5 of its height."""
    others = [c for c in lines.columns if c not in ("text", "y", "h")]
    lines, found = lines.withColumn("_heading", t.inline_category(F.col("text"))), F.col("_heading")
    whole = F.array(F.struct(F.col("text").alias("text"), F.col("y").alias("y"), F.col("h").alias("h")))
    two = F.array(
        F.struct(found["category"].alias("text"), F.col("y").alias("y"), (F.col("h") * 0.4).alias("h")),
        F.struct(found["rest"].alias("text"), (F.col("y") + F.col("h") * 0.5).alias("y"), (F.col("h") * 0.5).alias("h")),
    )
    return lines.select(*others, F.posexplode(F.when(found.isNotNull(), two).otherwise(whole)).alias("part", "l")).select(*others, "part", "l.*")


def gaps(lines: DataFrame, page: Sequence[str]) -> DataFrame:
    """Distance to the line above and below."""
    order = Window.partitionBy(*page).orderBy("line_idx")
    end = F.col("y") + F.col("h")
    return lines.withColumn("gap_above", F.col("y") - F.lag(end).over(order)).withColumn("gap_below", F.lead("y").over(order) - end)


def segments(lines: DataFrame, page: Sequence[str], is_category: Column | None = None) -> DataFrame:
    """Adds role (poem, category, explanation, orphan), entry_idx and stop_rule.

    A category line closes a segment. Going up from it, lines belong to its poem
    until one stops: a gap of FAR; a line that starts in lower case; a line that
    starts with a capital and ends a sentence, or is too far away. The line right
    above never stops. What is left of a segment explains the entry before, or is
    orphan text if there is none.
    """
    heading = t.is_category(F.col("text")) if is_category is None else is_category
    down = Window.partitionBy(*page).orderBy("line_idx")
    marked = gaps(lines, page).withColumn("_cat", F.coalesce(heading, F.lit(False)))
    marked = marked.withColumn("_seg", F.coalesce(F.sum(F.col("_cat").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marked = marked.withColumn("_next_cat", F.coalesce(F.lead("_cat").over(down), F.lit(False)))
    gap, text = F.col("gap_below"), F.col("text")
    near = F.when(text.rlike(t.VERSE_END), AFTER_END).otherwise(IN_VERSE)
    rule = (
        F.when(F.col("_cat") | F.col("_next_cat"), 0)
        .when(gap >= FAR, 1)
        .when((gap >= LETTER_GAP) & t.starts_lower(text), 2)
        .when((gap >= LETTER_GAP) & t.starts_upper(text) & (gap >= near), 3)
        .otherwise(0)
    )
    up = Window.partitionBy(*page, "_seg").orderBy(F.desc("line_idx"))
    of_segment = Window.partitionBy(*page, "_seg")
    ruled = marked.withColumn("stop_rule", rule).withColumn("_closed", F.max("_cat").over(of_segment))
    ruled = ruled.withColumn("_stopped", F.max("stop_rule").over(up.rowsBetween(Window.unboundedPreceding, 0)) > 0)
    role = F.when(F.col("_cat"), "category").when(F.col("_closed") & ~F.col("_stopped"), "poem").when(F.col("_seg") > 0, "explanation").otherwise("orphan")
    entry = F.when(role.isin("category", "poem"), F.col("_seg")).when(F.col("_seg") > 0, F.col("_seg") - 1)
    return ruled.withColumn("role", role).withColumn("entry_idx", entry.cast("int")).drop("_cat", "_seg", "_next_cat", "_closed", "_stopped", "gap_above", "gap_below")


def _joined(column: str, order: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda s: s[column]), by)


def verses(lines: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, verse, text): wrapped lines join the verse before if they start in lower case or are indented."""
    order = Window.partitionBy(*group).orderBy("line_idx")
    text = t.strip(F.col("text"))
    left = lines.withColumn("_left", F.min("x").over(Window.partitionBy(*group))).withColumn("text", text).where("text <> ''")
    letter = t.first_letter(F.col("text")) != ""
    goes_on = letter & (t.starts_lower(F.col("text")) | (F.col("x") - F.col("_left") >= INDENT))
    begins = (F.row_number().over(order) == 1) | ~goes_on
    islands = left.withColumn("_new", begins.cast("int")).withColumn("verse", F.sum("_new").over(order))
    return islands.groupBy(*group, "verse").agg(_joined("text", "line_idx", " ").alias("text"))


def paragraphs(lines: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, paragraph, text): a break needs the end of a sentence and a wide gap."""
    order = Window.partitionBy(*group).orderBy("line_idx")
    end = F.col("y") + F.col("h")
    spaced = lines.withColumn("gap", F.col("y") - F.lag(end).over(order)).withColumn("before", F.lag(t.strip(F.col("text"))).over(order))
    g_ = F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))).over(Window.partitionBy(*group)))  # in the partitions that the order has made
    usual = F.when(F.size(g_) > 0, F.greatest(F.lit(LEAST), F.try_element_at(g_, F.floor(F.size(g_) / 2).cast("int") + 1))).otherwise(TYPICAL)
    rows = spaced.withColumn("usual", usual).withColumn("text", t.strip(F.col("text"))).where("text <> ''")
    wide = (F.col("gap") >= WIDE * F.col("usual")) | (F.col("gap") >= PARAGRAPH)
    breaks = F.coalesce(F.col("before").rlike(t.SENTENCE_END) & wide, F.lit(False))
    islands = rows.withColumn("paragraph", F.sum(breaks.cast("int")).over(order))
    return islands.groupBy(*group, "paragraph").agg(_joined("text", "line_idx", " ").alias("text"))


def boxes(segmented: DataFrame, page: Sequence[str]) -> DataFrame:
    """The padded box of each role of each entry."""
    bounds = g.padded_bounds(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return segmented.groupBy(*page, "entry_idx", "role").agg(bounds.alias("box"))


def assigned(lines: DataFrame, layout: DataFrame, page: Sequence[str]) -> DataFrame:
    """Lines to the first entry's box that holds their centre, category before poem before explanation.

    layout: page columns, entry_idx, role, box. An equi join on the page; a page has few boxes.
    """
    priority = F.when(F.col("role") == "category", 0).when(F.col("role") == "poem", 1).otherwise(2)
    spots = layout.select(*page, F.col("entry_idx").alias("_entry"), F.col("role").alias("_role"), F.col("box").alias("_box"), priority.alias("_priority"))
    inside = g.holds_centre(F.col("_box"), F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    hits = lines.select(*page, "line_idx", "x", "y", "w", "h").join(spots, list(page)).where(inside)
    first = hits.groupBy(*page, "line_idx").agg(F.min(F.struct("_entry", "_priority", "_role")).alias("_hit"))
    joined = lines.join(first, [*page, "line_idx"], "left")
    return joined.withColumn("entry_idx", F.col("_hit._entry")).withColumn("role", F.col("_hit._role")).drop("_hit")


def residue(assigned_lines: DataFrame, layout: DataFrame, page: Sequence[str]) -> DataFrame:
    """Lines in no box and above the first poem."""
    tops = layout.where("role = 'poem'").groupBy(*page).agg(F.min("box.y").alias("_top"))
    return assigned_lines.where("entry_idx is null").join(tops, list(page), "left").where("_top is null or y + h / 2 < _top").drop("_top", "entry_idx", "role")


def entries(segmented: DataFrame, page: Sequence[str]) -> DataFrame:
    """An entry a row: deterministic id, category, joined and cleaned poem and explanation."""
    keys = [*page, "entry_idx"]
    poem = verses(segmented.where("role = 'poem'"), keys).groupBy(*keys).agg(_joined("text", "verse", "\n").alias("poem"))
    explained = paragraphs(segmented.where("role = 'explanation'"), keys).groupBy(*keys).agg(_joined("text", "paragraph", "\n").alias("explanation"))
    heads = segmented.where("role = 'category'").select(*keys, t.strip(F.col("text")).alias("category"))
    joined = heads.join(poem, keys, "left").join(explained, keys, "left")
    return joined.select(
        F.sha2(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), 256).alias("id"),
        *keys,
        "category",
        t.clean_poem(F.col("poem")).alias("poem"),
        t.clean_explanation(F.col("explanation")).alias("explanation"),
    )


def carried(pages: DataFrame, book: Sequence[str], place: str, entry: Column) -> DataFrame:
    """Adds `active`: the last entry of the pages before each page."""
    before = Window.partitionBy(*book).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("active", F.last(entry, ignorenulls=True).over(before))


def stitched(pages: DataFrame, book: Sequence[str], place: str, entry: Column, text: Column, orphan: Column, by: Column | None = None) -> DataFrame:
    """An entry's text followed by the orphan texts that it carries, in order.

    pages: one row a page; entry: its last entry or null, text: that entry's text,
    orphan: text before its first entry; by: the separator, a blank unless given.
    Orphans before any entry make a row with a null entry.
    """
    rows = carried(pages.select("*", entry.alias("_entry"), text.alias("_text"), orphan.alias("_orphan"), (by if by is not None else F.lit(" ")).alias("_by")), book, place, F.col("_entry"))
    own = rows.where("_entry is not null").select(*book, F.col("_entry").alias("entry"), F.col(place).alias("_place"), F.lit(0).alias("_n"), F.lit("").alias("_by"), F.col("_text").alias("_part"))
    more = rows.where("_orphan is not null and _orphan <> ''").select(*book, F.col("active").alias("entry"), F.col(place).alias("_place"), F.lit(1).alias("_n"), "_by", F.col("_orphan").alias("_part"))
    parts = own.unionByName(more).groupBy(*book, "entry").agg(F.array_sort(F.collect_list(F.struct("_n", "_place", "_by", "_part"))).alias("_parts"))
    whole = F.aggregate("_parts", F.lit(""), lambda s, p: F.when(s == "", p["_part"]).otherwise(F.concat(s, p["_by"], p["_part"])))
    pages_of = F.array_sort(F.array_distinct(F.transform("_parts", lambda p: p["_place"])))
    return parts.select(*book, "entry", whole.alias("text"), pages_of.alias("pages"))


def without_pages(pages: DataFrame, listed: str, number: str = "page_num") -> DataFrame:
    """Pages that a list like "1,2,51-53" doesn't name (F20, U3, A22): a filter, however long the ranges are."""
    gone = F.exists(t.page_ranges(F.lit(listed)), lambda r: F.col(number).between(r["low"], r["high"]))
    return pages.where(F.col(number).isNull() | ~gone)


def orphans(segmented: DataFrame, page: Sequence[str]) -> DataFrame:
    """The text in front of each page's first entry, as paragraphs."""
    lines = segmented.where("role = 'orphan'")
    return paragraphs(lines, page).groupBy(*page).agg(_joined("text", "paragraph", "\n").alias("orphan"))


def parts(segmented: DataFrame, page: Sequence[str], book: Sequence[str], place: str) -> DataFrame:
    """(book, entry page and number, page, box): where each entry stands, on its own page and on those that carry it on.

    Orphan lines belong to the last entry of the pages before, or to none.
    """
    own = segmented.where("entry_idx is not null").select(*book, place, F.col(place).alias("entry_place"), "entry_idx", "x", "y", "w", "h")
    lost = segmented.where("role = 'orphan'").select(*book, place, "x", "y", "w", "h").join(last_entries(segmented, book, place), [*book, place])
    every = own.unionByName(lost.select(*book, place, F.col("active.place").alias("entry_place"), F.col("active.entry_idx").alias("entry_idx"), "x", "y", "w", "h"))
    box = g.padded_bounds(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return every.groupBy(*book, "entry_place", "entry_idx", place).agg(box.alias("box"))


def last_entries(segmented: DataFrame, book: Sequence[str], place: str) -> DataFrame:
    """A row a page: its last entry, and the last one of the pages before it as `active`."""
    pages = segmented.groupBy(*book, place).agg(F.max("entry_idx").alias("last"))
    return carried(pages, book, place, F.when(F.col("last").isNotNull(), F.struct(F.col(place).alias("place"), F.col("last").alias("entry_idx"))))


def exported(lines: DataFrame, book: Sequence[str], place: str, is_category: Column | None = None) -> DataFrame:
    """All pages of a book to entries as they are exported: id, poem, category, explanation, pages.

    A page's orphan text carries on the explanation of the last entry before it;
    without such an entry it is a row of its own with blank poem and category.
    """
    page = [*book, place]
    segmented = stored(segments(lines, page, is_category), "segments")
    found = entries(segmented, page)
    more = orphans(segmented, page).join(last_entries(segmented, book, place), page)
    joined = more.where("active is not null").groupBy(*book, "active").agg(F.array_sort(F.collect_list(F.struct(place, "orphan"))).alias("more"))
    joined = joined.select(*book, F.col("active.place").alias(place), F.col("active.entry_idx").alias("entry_idx"), "more")
    texts = F.concat(F.array(F.coalesce("explanation", F.lit(""))), F.coalesce(F.transform("more", lambda m: t.clean_explanation(m["orphan"])), F.array().cast("array<string>")))
    pages = F.concat(F.array(F.col(place).cast("string")), F.coalesce(F.transform("more", lambda m: m[place].cast("string")), F.array().cast("array<string>")))
    whole = found.join(joined, [*page, "entry_idx"], "left").select(
        "id", F.coalesce("poem", F.lit("")).alias("poem"), "category", F.array_join(F.filter(texts, lambda x: x != ""), " ").alias("explanation"), F.array_join(pages, ",").alias("pages")
    )
    first = more.where("active is null").groupBy(*book).agg(F.array_sort(F.collect_list(F.struct(place, "orphan"))).alias("more"))
    blank = first.select(
        F.sha2(F.concat_ws("/", *[F.col(k).cast("string") for k in book], F.lit("front")), 256).alias("id"),
        F.lit("").alias("poem"),
        F.lit("").alias("category"),
        F.array_join(F.filter(F.transform("more", lambda m: t.clean_explanation(m["orphan"])), lambda x: x != ""), " ").alias("explanation"),
        F.array_join(F.transform("more", lambda m: m[place].cast("string")), ",").alias("pages"),
    )
    return whole.unionByName(blank)
