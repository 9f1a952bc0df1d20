"""The query of a whole batch of pages, with its SQL: full texts, both flags, orphan boxes and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators import batch
from lexispark.plans import entries as e
from lexispark.plans.layout_queries import _LINES, _PARAGRAPHS, _WS
from lexispark.plans.text_queries import _ALL_WS, _poem, _told

#: entry, role, top and height of the boxes of a page; all begin at the left edge.
BOXES = (
    (0, "category", 0.018, 0.008), (0, "poem", 0.035, 0.1), (0, "explanation", 0.1, 0.2),
    (1, "category", 0.12, 0.06), (1, "poem", 0.15, 0.08), (1, "explanation", 0.22, 0.4),
)
WIDTH, ORPHAN = 0.3, 0.03


def _box(y: float, h: float):
    return F.struct(F.lit(0.0).alias("x"), F.lit(y).alias("y"), F.lit(WIDTH).alias("w"), F.lit(h).alias("h"))


def batch_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11, J8, J11, J12, U6, B18: lines and boxes of all pages to the export; each fifth page has no boxes, each third an orphan box."""
    page = F.col("page")
    lines = e.lines(spark, sf_dir).drop("heading").withColumn("book", page % 4)
    docs = e.documents(spark, sf_dir).select(F.col("doc_id").alias("page"), (F.col("doc_id") % 4).alias("book"))
    spots = F.array(*[F.struct(F.lit(n).alias("entry_idx"), F.lit(role).alias("role"), _box(y, h).alias("box")) for n, role, y, h in BOXES])
    layout = docs.where("page % 5 <> 0").select("book", "page", F.explode(spots).alias("s")).select("book", "page", "s.*")
    pages = docs.select("book", "page", (page + 1).alias("page_num"), (F.floor(page / 4) % 2 == 0).alias("stitch_poem"), F.when(page % 3 == 0, _box(0.0, ORPHAN)).alias("orphan_box"))
    entry = F.explode(F.array(F.lit(0), F.lit(1))).alias("entry_idx")
    kept = docs.where("page % 7 < 3").select("book", "page", entry, F.when(page % 7 == 0, F.concat(F.lit("Fixed "), page)).when(page % 7 == 1, F.lit(" ")).alias("poem"), F.when(page % 7 == 2, F.lit("Told")).alias("explanation"))
    found = batch.exported(lines, layout, pages, kept, ["book"], "page")
    shown = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["place"].cast("string"), F.round(p["box"]["y"] * 1000).cast("long").cast("string"), F.round(p["box"]["h"] * 1000).cast("long").cast("string"))), ",")
    return found.select("id", "book", "entry_idx", "poem", "category", "explanation", "pages", shown.alias("parts"))


QUERIES = {"batch_export": batch_export}


def _paragraphs(keys: str, source: str) -> str:
    return f"WITH {_PARAGRAPHS.format(k=keys, ws=_WS, src=source)} SELECT {keys}, string_agg(text, chr(10) ORDER BY paragraph) AS text FROM paras GROUP BY {keys}"


def _stitched(own: str, more: str, by: str, clean) -> str:
    """The text after the first k additions."""
    return f"list_transform(range(0, len({more}) + 1), lambda k: CASE WHEN k = 0 THEN {own} ELSE {clean(f'''array_to_string(list_filter([{own}] || {more}[1:k], lambda z: z <> ''), {by})''')} END)"


def _last(states: str, human: str) -> str:
    return f"CASE WHEN trim(coalesce({human}, '')) = '' OR list_contains({states}[1:len({states}) - 1], trim({human})) THEN {states}[len({states})] ELSE trim({human}) END"


_SPOTS = ", ".join(f"({n}, '{role}', {y}::DOUBLE, {h}::DOUBLE, {('category', 'poem', 'explanation').index(role)})" for n, role, y, h in BOXES)
_TOP = next(y for n, role, y, _ in BOXES if (n, role) == (0, "poem"))
_OWN = [(round(min(y for n, _, y, _ in BOXES if n == k) * 1000), round((max(y + h for n, _, y, h in BOXES if n == k) - min(y for n, _, y, _ in BOXES if n == k)) * 1000)) for k in (0, 1)]

ORACLES = {
    "batch_export": f"""WITH {_LINES},
spots(entry_idx, role, y, h, rank) AS (VALUES {_SPOTS}),
mid AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM lines),
boxed AS (
  SELECT l.page, l.line_idx, s.entry_idx, arg_min(role, rank) AS role, any_value(text) AS text, any_value(l.x) AS x, any_value(l.y) AS y, any_value(l.w) AS w, any_value(l.h) AS h
  FROM mid l JOIN spots s ON cx BETWEEN 0 AND {WIDTH}::DOUBLE AND cy BETWEEN s.y AND s.y + s.h WHERE page % 5 <> 0 GROUP BY ALL),
t AS (SELECT page, entry_idx, line_idx, x - min(x) OVER (PARTITION BY page, entry_idx) AS indent, trim(text, {_WS}) AS text, regexp_extract(text, '\\p{{L}}') AS letter FROM boxed WHERE role = 'poem'),
n AS (SELECT *, (row_number() OVER (PARTITION BY page, entry_idx ORDER BY line_idx) = 1 OR NOT (letter <> '' AND (regexp_matches(letter, '\\p{{Ll}}') OR indent >= 0.045::DOUBLE)))::INT AS fresh FROM t WHERE text <> ''),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY page, entry_idx ORDER BY line_idx) AS verse FROM n),
verses AS (SELECT page, entry_idx, verse, string_agg(text, ' ' ORDER BY line_idx) AS text FROM v GROUP BY ALL),
poems AS (SELECT page, entry_idx, string_agg(text, chr(10) ORDER BY verse) AS poem FROM verses GROUP BY ALL),
heads AS (SELECT page, entry_idx, string_agg(trim(text, {_WS}), ' ' ORDER BY line_idx) AS category FROM boxed WHERE role = 'category' GROUP BY ALL),
told AS ({_paragraphs("page, entry_idx", "(SELECT * FROM boxed WHERE role = 'explanation') e")}),
lost AS ({_paragraphs("page", f'''(SELECT page, line_idx, text, x, y, w, h FROM mid WHERE page % 3 = 0 AND cx BETWEEN 0 AND {WIDTH}::DOUBLE AND cy BETWEEN 0 AND {ORPHAN}::DOUBLE
  UNION ALL SELECT page, line_idx, text, x, y, w, h FROM mid m WHERE page % 3 <> 0 AND page % 5 <> 0 AND cy < {_TOP}::DOUBLE AND NOT EXISTS (SELECT 1 FROM boxed b WHERE b.page = m.page AND b.line_idx = m.line_idx)) o''')}),
pages AS (
  SELECT doc_id AS page, doc_id % 4 AS book, doc_id // 4 % 2 = 0 AS to_poem, trim(l.text) AS orphan,
         last_value(CASE WHEN doc_id % 5 <> 0 THEN doc_id END IGNORE NULLS) OVER (PARTITION BY doc_id % 4 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active
  FROM documents d LEFT JOIN (SELECT page, text FROM lost) l ON l.page = doc_id),
more AS (
  SELECT book, active AS page, coalesce(list(orphan ORDER BY page) FILTER (to_poem), []) AS verse, coalesce(list(orphan ORDER BY page) FILTER (NOT to_poem), []) AS prose,
         list(page ORDER BY page) AS others FROM pages WHERE coalesce(orphan, '') <> '' GROUP BY ALL),
entries AS (
  SELECT p.page, p.book, entry_idx, coalesce(trim(poem, {_ALL_WS}), '') AS poem, coalesce(category, '') AS category, coalesce(trim(x.text, {_ALL_WS}), '') AS told,
         coalesce(m.verse, []) AS verse, coalesce(m.prose, []) AS prose, coalesce(m.others, []) AS others,
         CASE p.page % 7 WHEN 0 THEN 'Fixed ' || p.page END AS fixed, CASE p.page % 7 WHEN 2 THEN 'Told' END AS retold
  FROM pages p CROSS JOIN (VALUES (0), (1)) k(entry_idx) LEFT JOIN poems USING (page, entry_idx) LEFT JOIN heads USING (page, entry_idx) LEFT JOIN told x USING (page, entry_idx)
  LEFT JOIN more m ON m.page = p.page AND entry_idx = 1 WHERE p.page % 5 <> 0),
states AS (SELECT *, {_stitched("poem", "verse", "chr(10)", _poem)} AS ps, {_stitched("told", "prose", "' '", _told)} AS ts FROM entries),
chosen AS (SELECT *, {_last("ps", "fixed")} AS p, {_last("ts", "retold")} AS e FROM states)
SELECT sha256(book || '/' || page || '/' || entry_idx) AS id, book, entry_idx, {_poem("p")} AS poem, category, {_told("e")} AS explanation,
       array_to_string(list_transform([page] || others, lambda z: (z + 1)::VARCHAR), ',') AS pages,
       array_to_string([page || CASE entry_idx WHEN 0 THEN ':{_OWN[0][0]}:{_OWN[0][1]}' ELSE ':{_OWN[1][0]}:{_OWN[1][1]}' END]
         || list_transform(list_filter(others, lambda z: z % 3 = 0), lambda z: z || ':0:{round(ORPHAN * 1000)}'), ',') AS parts
FROM chosen
UNION ALL SELECT sha256(book || '/front'), book, NULL, '', '', {_told("array_to_string(orphans, ' ')")}, array_to_string(list_transform(others, lambda z: (z + 1)::VARCHAR), ','),
       array_to_string(list_transform(list_filter(others, lambda z: z % 3 = 0), lambda z: z || ':0:{round(ORPHAN * 1000)}'), ',')
FROM (SELECT book, list(orphan ORDER BY page) AS orphans, list(page ORDER BY page) AS others FROM pages WHERE active IS NULL AND coalesce(orphan, '') <> '' GROUP BY book)""",
}
