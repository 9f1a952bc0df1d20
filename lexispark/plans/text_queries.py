"""Queries of the scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as t
from lexispark.plans import entries as e
from lexispark.sources import tables

LABELS = {"en": "English", "de": "Deutsch", "fr": "Français"}


def syllable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18."""
    return e.documents(spark, sf_dir).select("doc_id", t.syllables(F.col("text")).alias("syllables"))


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number in front of headings with recognition errors."""
    heads = ["(CA DAO)", "CA ĐAO", "thành ngữ", "(THANH NGU HAN VIET)", "TỤC NGỮ", "tuc  ngu.", "(TỰC NGỮ HÁN VIỆT)", "Ca dao mẹ", "KA DÃO I", "câu đố", "THÀNH\u00a0NGỮ", "\u2028TỤC\u2003NGỮ\u00a0"]
    docs = e.documents(spark, sf_dir)
    return docs.select("doc_id", F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 12 + 1).cast("int")).alias("line"), "text")


def category_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    rows = _headings(spark, sf_dir)
    return rows.select("doc_id", t.is_category(F.col("line")).alias("is_category"), t.is_category(F.col("text")).alias("of_text"))


def category_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, J14."""
    rows = _headings(spark, sf_dir).join(e.documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return rows.select("doc_id", t.clean_category(F.col("line")).alias("category"), tables.labels(F.col("lang"), LABELS).alias("label"))


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = e.documents(spark, sf_dir)
    return rows.select("doc_id", F.concat(F.lit("• * ~a.."), F.regexp_replace("text", "\\. ", "..\n+ "), F.lit("\n\n--• x...y..\n\u00a0*\u00a0 Abc\u2028Def.. g\u0085 \u3000• hij K\u00a0")).alias("text"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, F7 on noisy lines; F5 is tested against a plain loop."""
    return _noisy(spark, sf_dir).select("doc_id", t.clean_explanation(F.col("text")).alias("explanation"))


def clean_poem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    return _noisy(spark, sf_dir).select("doc_id", t.clean_poem(F.col("text")).alias("poem"))


def dots_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    dotted = F.concat(F.repeat(F.lit("."), (F.col("doc_id") % 5).cast("int")), F.regexp_replace("text", "[,\\n]", ".."), F.lit("a..b...c.."))
    return e.documents(spark, sf_dir).select("doc_id", t.two_dots(dotted).alias("text"))


def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    marked = F.concat(F.lit("## **"), F.regexp_replace("text", "\\n", "**\n- [a](b) *c*\n12. "), F.lit("\n# [end](x)"))
    return e.documents(spark, sf_dir).select("doc_id", t.strip_markdown(marked).alias("text"))


def inline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4."""
    from lexispark.operators import layout

    marked = F.when(F.col("line_idx") % 3 == 0, F.concat(F.lit(" \"(CA DAO): "), "text")).otherwise(F.col("text"))
    rows = e.lines(spark, sf_dir).select("page", "line_idx", marked.alias("text"), (F.col("line_idx") / 1000).alias("y"), F.lit(0.02).alias("h"))
    return layout.split_headings(rows).select("page", "line_idx", "part", "text", F.round("y", 6).alias("y"), F.round("h", 6).alias("h"))


def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, F11, F16, B13, U5."""
    from lexispark.operators import review

    parts = e.read(spark, sf_dir, "part").select("p_partkey", t.split_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(" ,")), F.lit(", ,"), F.col("p_type"))).alias("k"))
    allowed = F.array(*map(F.lit, ("steel", "brass", "tin")))
    return parts.select("p_partkey", t.join_list(F.array_distinct("k")).alias("joined"), F.size(review.unknown(F.col("k"), allowed)).cast("long").alias("n_unknown"), F.size(review.with_item(F.col("k"), F.lit("tin"))).cast("long").alias("n_with"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, U3."""
    from lexispark.operators import layout

    pages = e.read(spark, sf_dir, "pages").select(F.col("page_id").cast("int").alias("page_num"), "url")
    return layout.without_pages(pages, "1,2, 11-13,x,30-20,7-,100000")


def blanks_and_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21, F22, F28, F17."""
    every = F.split("text", "[ .,\n]+")
    words = F.array_compact(F.array(F.try_element_at(every, F.lit(2)), F.try_element_at(every, F.lit(-2))))
    rows = e.documents(spark, sf_dir).select("doc_id", "text", "n_chars", words.alias("words"))
    given = F.when(F.col("doc_id") % 2 == 0, F.col("words")).otherwise(F.reverse("words"))
    return rows.select(
        "doc_id",
        t.blanked(F.col("text"), F.col("words")).alias("gapped"),
        t.all_correct(given, F.col("words")).alias("correct"),
        t.last_number(F.concat(F.lit("p. 12, "), F.col("doc_id").cast("string"), F.lit(" x"))).alias("page_num"),
        t.percent(F.round(F.col("doc_id") / 1024, 3)).alias("percent"),
    )


QUERIES = {
    f.__name__: f
    for f in (syllable_counts, category_classify, category_normalize, clean_text, clean_poem, dots_rule, markdown_strip, inline_split, keyword_lists, page_ranges, blanks_and_answers)
}

_HEADS = "['(CA DAO)', 'CA ĐAO', 'thành ngữ', '(THANH NGU HAN VIET)', 'TỤC NGỮ', 'tuc  ngu.', '(TỰC NGỮ HÁN VIỆT)', 'Ca dao mẹ', 'KA DÃO I', 'câu đố', 'THÀNH\u00a0NGỮ', '\u2028TỤC\u2003NGỮ\u00a0'][doc_id % 12 + 1]"
_ALL_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(8195) || chr(12288)"


def _category(column: str) -> str:
    clean = f"regexp_replace(trim(regexp_replace(upper({column}), '[^Ç{t.CAPITALS}{t.BLANK}]', '', 'g'), {_ALL_WS}), '[{t.BLANK}]+', ' ', 'g')"
    return "(" + " OR ".join(f"regexp_matches({clean}, '{p}')" for p in t.CATEGORY_PATTERNS) + ")"


_WS = "' ' || chr(9) || chr(10) || chr(13)"
_DOTS = "array_to_string(list_transform(regexp_extract_all({x}, '\\.+|[^.]+'), lambda p: CASE WHEN p = '..' THEN '.' ELSE p END), '')"
_NOISY = "SELECT doc_id, '• * ~a..' || regexp_replace(text, '\\. ', '..' || chr(10) || '+ ', 'g') || chr(10) || chr(10) || '--• x...y..' || chr(10) || '\u00a0*\u00a0 Abc\u2028Def.. g\u0085 \u3000• hij K\u00a0' AS text FROM documents"
_ENDS = t.LINE_END


def _told(x: str) -> str:
    """F6 as an expression."""
    lines = f"list_transform(regexp_split_to_array(replace({x}, '•', ''), '{t.LINE_END}'), lambda l: {_DOTS.format(x=f'''regexp_replace(trim(l, {_ALL_WS}), '^[{t.BULLETS}]+', '')''')})"
    return f"trim(array_to_string(list_filter({lines}, lambda l: l <> ''), chr(10)), {_ALL_WS})"


def _poem(x: str) -> str:
    """F5 as an expression."""
    body = f"regexp_replace(regexp_replace(trim({x}, {_ALL_WS}), '^[•{t.BULLETS}]+', ''), '^-+[•{t.BULLETS}]*', '-')"
    line = f"(CASE WHEN i > 1 THEN regexp_replace(trim(l, {_ALL_WS}), '^[•{t.BULLETS}]+', '') ELSE trim(l, {_ALL_WS}) END)"
    kept = f"list_transform(regexp_split_to_array({body}, '{t.LINE_END}'), lambda l, i: regexp_extract({_DOTS.format(x=line)}, '(?s)^[^\\p{{Lu}}\\p{{Ll}}\\-(]*([\\p{{Lu}}\\-(].*)$', 1))"
    return f"trim(array_to_string(list_filter({kept}, lambda l: l <> ''), chr(10)), {_ALL_WS})"


ORACLES = {
    "syllable_counts": """SELECT doc_id, list_transform(string_split(text, chr(10)),
  lambda l: len(list_filter(regexp_split_to_array(l, '[ \\t\\r\\f\\v]+'), lambda w: w <> ''))::BIGINT) AS syllables FROM documents""",
    "category_classify": f"SELECT doc_id, {_category('line')} AS is_category, {_category('text')} AS of_text FROM (SELECT *, {_HEADS} AS line FROM documents) d",
    "category_normalize": f"""SELECT doc_id, lower(trim(translate({_HEADS}, '()', ''), {_ALL_WS})) AS category,
  CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Français' ELSE lang END AS label FROM documents""",
    "clean_text": f"""WITH n AS ({_NOISY}),
l AS (SELECT doc_id, unnest(regexp_split_to_array(replace(text, '•', ''), '{_ENDS}')) AS line, generate_subscripts(regexp_split_to_array(replace(text, '•', ''), '{_ENDS}'), 1) AS i FROM n),
c AS (SELECT doc_id, i, regexp_replace(trim(line, {_ALL_WS}), '^[{t.BULLETS}]+', '') AS line FROM l)
SELECT doc_id, trim(coalesce(string_agg({_DOTS.format(x="line")}, chr(10) ORDER BY i) FILTER (line <> ''), ''), {_ALL_WS}) AS explanation FROM c GROUP BY doc_id""",
    "clean_poem": f"""WITH n AS ({_NOISY}),
b AS (SELECT doc_id, regexp_replace(regexp_replace(trim(text, {_ALL_WS}), '^[•{t.BULLETS}]+', ''), '^-+[•{t.BULLETS}]*', '-') AS text FROM n),
l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{_ENDS}')) AS line, generate_subscripts(regexp_split_to_array(text, '{_ENDS}'), 1) AS i FROM b),
c AS (SELECT doc_id, i, CASE WHEN i > 1 THEN regexp_replace(trim(line, {_ALL_WS}), '^[•{t.BULLETS}]+', '') ELSE trim(line, {_ALL_WS}) END AS line FROM l),
k AS (SELECT doc_id, i, regexp_extract({_DOTS.format(x="line")}, '(?s)^[^\\p{{Lu}}\\p{{Ll}}\\-(]*([\\p{{Lu}}\\-(].*)$', 1) AS line FROM c)
SELECT doc_id, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (line <> ''), ''), {_ALL_WS}) AS poem FROM k GROUP BY doc_id""",
    "dots_rule": f"SELECT doc_id, {_DOTS.format(x='x')} AS text FROM (SELECT doc_id, repeat('.', (doc_id % 5)::INT) || regexp_replace(text, '[,\\n]', '..', 'g') || 'a..b...c..' AS x FROM documents) d",
    "markdown_strip": f"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  '## **' || replace(text, chr(10), '**' || chr(10) || '- [a](b) *c*' || chr(10) || '12. ') || chr(10) || '# [end](x)',
  '[*_]{{1,3}}', '', 'g'), '(?m)^#+\\s+', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '(?m)^\\s*[-*+]\\s+', '', 'g'), '(?m)^\\s*\\d+\\.\\s+', '', 'g'), {_WS}) AS text FROM documents""",
    "inline_split": r"""WITH l0 AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_idx FROM documents),
l AS (SELECT page, line_idx, line_idx / 1000 AS y, CASE WHEN line_idx % 3 = 0 THEN ' "(CA DAO): ' || text ELSE text END AS text FROM l0),
c AS (SELECT *, trim(text, QUOTES) AS clean FROM l),
h AS (SELECT *, trim(regexp_extract(clean, '^\(([^)]+)\)', 1)) AS content,
             regexp_replace(trim(regexp_replace(clean, '^\([^)]+\)', '')), '^[.:]\s*', '') AS rest FROM c),
s AS (SELECT *, upper(content) = content AND lower(content) <> content AND length(content) BETWEEN 3 AND 25 AND rest <> '' AS two FROM h)
SELECT page, line_idx, 0 AS part, CASE WHEN two THEN '(' || content || ')' ELSE text END AS text, round(y, 6) AS y, CASE WHEN two THEN 0.008 ELSE 0.02 END::DOUBLE AS h FROM s
UNION ALL SELECT page, line_idx, 1, rest, round(y + 0.01, 6), 0.01::DOUBLE FROM s WHERE two""".replace("QUOTES", "' ' || chr(9) || chr(10) || chr(13) || '\"''“”‘’«»'"),
    "keyword_lists": """WITH k AS (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ' ,') || ', ,' || p_type, ','), lambda x: trim(x)), lambda x: x <> '') AS k FROM part),
d AS (SELECT p_partkey, k, list_reduce(list_prepend([]::VARCHAR[], list_transform(k, lambda x: [x])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS u FROM k)
SELECT p_partkey, array_to_string(u, ', ') AS joined, len(list_filter(u, lambda x: x NOT IN ('steel', 'brass', 'tin'))) AS n_unknown,
       len(u) + (NOT list_contains(u, 'tin'))::BIGINT AS n_with FROM d""",
    "page_ranges": "SELECT page_id::INT AS page_num, url FROM pages WHERE page_id NOT IN (1, 2, 11, 12, 13, 100000)",
    "blanks_and_answers": """WITH RECURSIVE w AS (
  SELECT doc_id, text, regexp_split_to_array(text, '[ .,\\n]+') AS all_words FROM documents),
d AS (SELECT doc_id, text, CASE WHEN len(all_words) >= 2 THEN [all_words[2], all_words[-2]] ELSE [] END AS words FROM w),
one AS (SELECT *, CASE WHEN len(words) >= 1 AND words[1] <> '' AND contains(text, words[1]) THEN substr(text, 1, instr(text, words[1]) - 1) || '____' || substr(text, instr(text, words[1]) + length(words[1])) ELSE text END AS a FROM d),
two AS (SELECT *, CASE WHEN len(words) >= 2 AND words[2] <> '' AND contains(a, words[2]) THEN substr(a, 1, instr(a, words[2]) - 1) || '____' || substr(a, instr(a, words[2]) + length(words[2])) ELSE a END AS b FROM one)
SELECT doc_id, b AS gapped, CASE WHEN doc_id % 2 = 0 THEN true ELSE list_reverse(words) = words END AS correct, doc_id::INT AS page_num,
       printf('%.1f', round(doc_id / 1024, 3) * 100) AS percent FROM two""",
}
