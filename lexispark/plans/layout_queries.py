"""Queries of layout and stitching, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import geometry as g
from lexispark.functions import text as t
from lexispark.operators import layout
from lexispark.plans import entries as e
from lexispark.plans.text_queries import _ALL_WS, _poem, _told

PAGE = ["page"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.lines(spark, sf_dir)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.segments(_lines(spark, sf_dir), PAGE, F.col("heading"))


def _box(name: str) -> list:
    return [F.round(F.col(f"{name}.{c}"), 6).alias(c) for c in "xywh"]


def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, K8."""
    rows = layout.gaps(layout.read_order(_lines(spark, sf_dir).drop("line_idx"), PAGE), PAGE)
    return rows.select("page", "line_idx", (F.round("gap_above", 6) + 0.0).alias("gap_above"), (F.round("gap_below", 6) + 0.0).alias("gap_below"))


def segment_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, W8, W12, F29."""
    return _segments(spark, sf_dir).select("page", "line_idx", "role", "entry_idx", "stop_rule")


def verse_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, G18."""
    return layout.verses(_lines(spark, sf_dir), PAGE)


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, G14, G18."""
    return layout.paragraphs(_lines(spark, sf_dir), PAGE)


def layout_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments to exported entries (F5, F6, F26, G18), with their texts."""
    return layout.entries(_segments(spark, sf_dir), PAGE).select("id", "page", "entry_idx", "category", "poem", "explanation")


def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12, G13."""
    boxes = layout.boxes(_segments(spark, sf_dir), PAGE)
    return boxes.groupBy("page").agg(g.union_bounds(F.col("box")).alias("b"), F.count("*").alias("n")).select("page", "n", *_box("b"))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping boxes a page."""
    pages = e.documents(spark, sf_dir).select(F.col("doc_id").alias("page"))
    box = lambda y, h: F.struct(F.lit(0.0).alias("x"), F.lit(y).alias("y"), F.lit(0.3).alias("w"), F.lit(h).alias("h"))
    spots = F.array(
        F.struct(F.lit(0).alias("entry_idx"), F.lit("poem").alias("role"), box(0.035, 0.1).alias("box")),
        F.struct(F.lit(0).alias("entry_idx"), F.lit("explanation").alias("role"), box(0.1, 0.2).alias("box")),
        F.struct(F.lit(1).alias("entry_idx"), F.lit("category").alias("role"), box(0.12, 0.4).alias("box")),
    )
    return pages.select("page", F.explode(spots).alias("s")).select("page", "s.*")


def box_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8."""
    return layout.assigned(_lines(spark, sf_dir), _layout(spark, sf_dir), PAGE).select("page", "line_idx", "entry_idx", "role")


def box_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    spots = _layout(spark, sf_dir)
    return layout.residue(layout.assigned(_lines(spark, sf_dir), spots, PAGE), spots, PAGE).select("page", "line_idx", "text")


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24, F25, B17."""
    rows = _lines(spark, sf_dir).select("page", "line_idx", g.points(g.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")), F.lit(595.0), F.lit(842.0)).alias("p"), g.flipped(F.col("y"), F.col("h")).alias("f"))
    return rows.select("page", "line_idx", *[F.round(F.col(f"p.{c}"), 4).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round("f", 6).alias("flipped"))


def stitch_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn starts an entry, all others carry it on."""
    user = F.col("role") == "user"
    rows = layout.stitched(e.turns(spark, sf_dir), ["conv_id"], "turn", F.when(user, F.col("turn")), F.when(user, F.col("text")), F.when(~user, F.col("text")))
    return rows.select("conv_id", "entry", "text", "pages")


def categories_of_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of segments per page, cleaned."""
    heads = _segments(spark, sf_dir).where("role = 'category'")
    return heads.groupBy("page").agg(F.array_sort(F.array_distinct(F.collect_list(t.clean_category(F.col("text"))))).alias("headings"))


QUERIES = {
    f.__name__: f
    for f in (line_gaps, segment_entries, verse_islands, paragraphs, layout_entries, bbox_union, box_assign, box_residue, coordinates, stitch_orphans, categories_of_headings)
}

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_LINES = """l0 AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_idx FROM documents),
lines AS (SELECT page, line_idx, text, ((length(text) % 3) * 30 + 50)::DOUBLE / 1000 AS x, (line_idx * 20 + (length(text) % 9) * 2) / 1000 AS y,
  (length(text) % 700) / 1000 AS w, 0.01::DOUBLE AS h, length(text) < 25 AS heading FROM l0)"""
_SEGMENTS = f"""{_LINES},
s1 AS (SELECT *, lead(y) OVER p - (y + h) AS gap, coalesce(sum(heading::INT) OVER (PARTITION BY page ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS seg,
         coalesce(lead(heading) OVER p, false) AS next_heading, regexp_extract(text, '\\p{{L}}') AS letter FROM lines WINDOW p AS (PARTITION BY page ORDER BY line_idx)),
s2 AS (SELECT *, CASE WHEN heading OR next_heading THEN 0 WHEN gap >= 0.012 THEN 1 WHEN gap >= 0.003 AND regexp_matches(letter, '^\\p{{Ll}}') THEN 2
         WHEN gap >= 0.003 AND regexp_matches(letter, '^\\p{{Lu}}') AND gap >= CASE WHEN regexp_matches(text, '[.!?:”"»)]\\s*$') THEN 0.005 ELSE 0.0075 END::DOUBLE THEN 3 ELSE 0 END AS stop_rule FROM s1),
s3 AS (SELECT *, bool_or(heading) OVER (PARTITION BY page, seg) AS closed, max(stop_rule) OVER (PARTITION BY page, seg ORDER BY line_idx DESC ROWS UNBOUNDED PRECEDING) > 0 AS stopped FROM s2),
s4 AS (SELECT *, CASE WHEN heading THEN 'category' WHEN closed AND NOT stopped THEN 'poem' WHEN seg > 0 THEN 'explanation' ELSE 'orphan' END AS role FROM s3),
seg AS (SELECT *, CASE WHEN role IN ('category', 'poem') THEN seg WHEN seg > 0 THEN seg - 1 END AS entry_idx FROM s4)"""
_BOXES = """boxes AS (SELECT page, entry_idx, role, greatest(0.0::DOUBLE, min(x) - 0.004::DOUBLE) AS x, greatest(0.0::DOUBLE, min(y) - 0.004::DOUBLE) AS y,
  least(1.0::DOUBLE, max(x + w) - min(x) + 0.008::DOUBLE) AS w, least(1.0::DOUBLE, max(y + h) - min(y) + 0.008::DOUBLE) AS h FROM seg GROUP BY ALL)"""
_SPOTS = """spots(entry_idx, role, y, h, priority) AS (VALUES (0, 'poem', 0.035::DOUBLE, 0.1::DOUBLE, 1), (0, 'explanation', 0.1::DOUBLE, 0.2::DOUBLE, 2), (1, 'category', 0.12::DOUBLE, 0.4::DOUBLE, 0)),
hits AS (SELECT page, line_idx, min((entry_idx, priority, role)) AS hit FROM lines l, spots s
  WHERE l.x + l.w / 2 BETWEEN 0 AND 0.3::DOUBLE AND l.y + l.h / 2 BETWEEN s.y AND s.y + s.h GROUP BY ALL)"""
_PARAGRAPHS = """g AS (SELECT *, y - lag(y + h) OVER (PARTITION BY {k} ORDER BY line_idx) AS gap, lag(trim(text, {ws})) OVER (PARTITION BY {k} ORDER BY line_idx) AS before FROM {src}),
u AS (SELECT {k}, greatest(0.004::DOUBLE, list_sort(list(gap) FILTER (gap > 0))[(len(list(gap) FILTER (gap > 0)) // 2 + 1)::BIGINT]) AS usual FROM g GROUP BY ALL),
b AS (SELECT g.*, coalesce(regexp_matches(before, '[.!?:”"»]\\s*$') AND (gap >= 1.4::DOUBLE * coalesce(usual, 0.008::DOUBLE) OR gap >= 0.015::DOUBLE), false) AS breaks FROM g JOIN u USING ({k})),
i AS (SELECT *, sum(breaks::INT) OVER (PARTITION BY {k} ORDER BY line_idx) AS paragraph FROM b WHERE trim(text, {ws}) <> ''),
paras AS (SELECT {k}, paragraph::BIGINT AS paragraph, string_agg(trim(text, {ws}), ' ' ORDER BY line_idx) AS text FROM i GROUP BY ALL)"""
_ENTRIES = f"""{_PARAGRAPHS.format(k='page, entry_idx', ws=_WS, src="(SELECT page, entry_idx, line_idx, text, x, y, w, h FROM seg WHERE role = 'explanation') e")},
told AS (SELECT page, entry_idx, string_agg(text, chr(10) ORDER BY paragraph) AS text FROM paras GROUP BY ALL),
vt AS (SELECT page, entry_idx, line_idx, x - min(x) OVER (PARTITION BY page, entry_idx) AS indent, trim(text, {_WS}) AS text, regexp_extract(text, '\\p{{L}}') AS letter FROM seg WHERE role = 'poem'),
vn AS (SELECT *, (row_number() OVER (PARTITION BY page, entry_idx ORDER BY line_idx) = 1 OR NOT (letter <> '' AND (regexp_matches(letter, '\\p{{Ll}}') OR indent >= 0.045::DOUBLE)))::INT AS fresh FROM vt WHERE text <> ''),
vi AS (SELECT *, sum(fresh) OVER (PARTITION BY page, entry_idx ORDER BY line_idx) AS verse FROM vn),
vs AS (SELECT page, entry_idx, verse, string_agg(text, ' ' ORDER BY line_idx) AS text FROM vi GROUP BY ALL),
poems AS (SELECT page, entry_idx, string_agg(text, chr(10) ORDER BY verse) AS text FROM vs GROUP BY ALL),
entries AS (
  SELECT h.page, h.entry_idx::INT AS entry_idx, trim(h.text, {_ALL_WS}) AS category, {_poem("coalesce(p.text, '')")} AS poem, {_told("coalesce(e.text, '')")} AS explanation
  FROM seg h LEFT JOIN poems p ON p.page = h.page AND p.entry_idx = h.entry_idx LEFT JOIN told e ON e.page = h.page AND e.entry_idx = h.entry_idx WHERE role = 'category')"""

ORACLES = {
    "line_gaps": f"""WITH {_LINES}, o AS (SELECT *, (row_number() OVER (PARTITION BY page ORDER BY y, x) - 1)::INT AS i FROM lines)
SELECT page, i AS line_idx, round(y - lag(y + h) OVER p, 6) + 0.0::DOUBLE AS gap_above, round(lead(y) OVER p - (y + h), 6) + 0.0::DOUBLE AS gap_below FROM o WINDOW p AS (PARTITION BY page ORDER BY i)""",
    "segment_entries": f"WITH {_SEGMENTS} SELECT page, line_idx, role, entry_idx::INT AS entry_idx, stop_rule::INT AS stop_rule FROM seg",
    "verse_islands": f"""WITH {_LINES},
t AS (SELECT page, line_idx, x - min(x) OVER (PARTITION BY page) AS indent, trim(text, {_WS}) AS text, regexp_extract(text, '\\p{{L}}') AS letter FROM lines),
n AS (SELECT *, (row_number() OVER (PARTITION BY page ORDER BY line_idx) = 1 OR NOT (letter <> '' AND (regexp_matches(letter, '\\p{{Ll}}') OR indent >= 0.045::DOUBLE)))::INT AS fresh FROM t WHERE text <> ''),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY line_idx) AS verse FROM n)
SELECT page, verse::BIGINT AS verse, string_agg(text, ' ' ORDER BY line_idx) AS text FROM i GROUP BY ALL""",
    "paragraphs": f"WITH {_LINES}, {_PARAGRAPHS.format(k='page', ws=_WS, src='lines')} SELECT * FROM paras",
    "layout_entries": f"""WITH {_SEGMENTS}, {_ENTRIES}
SELECT sha256(page || '/' || entry_idx) AS id, page, entry_idx, category, poem, explanation FROM entries""",
    "bbox_union": f"""WITH {_SEGMENTS}, {_BOXES}
SELECT page, count(*) AS n, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x + w) - min(x), 6) AS w, round(max(y + h) - min(y), 6) AS h FROM boxes GROUP BY page""",
    "box_assign": f"WITH {_LINES}, {_SPOTS} SELECT page, line_idx, hit[1] AS entry_idx, hit[3] AS role FROM lines LEFT JOIN hits USING (page, line_idx)",
    "box_residue": f"WITH {_LINES}, {_SPOTS} SELECT page, line_idx, text FROM lines LEFT JOIN hits USING (page, line_idx) WHERE hit IS NULL AND y + h / 2 < 0.035::DOUBLE",
    "coordinates": f"""WITH {_LINES}, c AS (SELECT page, line_idx, y, h, greatest(0, x * 595) AS x0, greatest(0, y * 842) AS y0, least(595, (x + w) * 595) AS x1, least(842, (y + h) * 842) AS y1 FROM lines)
SELECT page, line_idx, CASE WHEN x1 > x0 AND y1 > y0 THEN round(x0, 4) END AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN round(y0, 4) END AS y0,
       CASE WHEN x1 > x0 AND y1 > y0 THEN round(x1, 4) END AS x1, CASE WHEN x1 > x0 AND y1 > y0 THEN round(y1, 4) END AS y1, round(1 - y - h, 6) AS flipped FROM c""",
    "stitch_orphans": """WITH a AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entry FROM conversations)
SELECT conv_id, entry, string_agg(text, ' ' ORDER BY turn) AS text, list(turn ORDER BY turn) AS pages FROM a GROUP BY conv_id, entry""",
    "categories_of_headings": f"""WITH {_LINES} SELECT page, list_sort(list(DISTINCT lower(trim(translate(text, '()', ''), {_WS})))) AS headings FROM lines WHERE heading GROUP BY page""",
}
