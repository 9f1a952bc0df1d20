"""Queries of review, enrichment, nested data and the feedback log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators import learning, review
from lexispark.plans import entries as e
from lexispark.sources import feedback

FIELDS = ("text", "lang", "source")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as base rows, quality labels as edits (some of new rows), toxic rows as deleted."""
    base = e.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), *FIELDS)
    labels = e.read(spark, sf_dir, "labels")
    edited = labels.select("doc_id", F.concat(F.lit("edited "), F.col("quality").cast("string")).alias("text"), F.when(F.col("quality") == 1, "xx").alias("lang"), F.lit(None).cast("string").alias("source"))
    new = edited.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 10_000_000)
    return base, edited.unionByName(new).withColumnRenamed("doc_id", "id"), labels.where("toxic = 1").select(F.col("doc_id").alias("id"))


def review_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12, J6, J7, U2."""
    return review.applied(*_tables(spark, sf_dir), FIELDS)


def review_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17."""
    return review.entry(*_tables(spark, sf_dir), 7, FIELDS)


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17."""
    base, edits, deleted = (t.withColumn("id", F.col("id").cast("string")) for t in _tables(spark, sf_dir))
    odd = edits.limit(1).withColumn("id", F.lit("3f2a-not-a-number"))
    return review.progress(base, edits.unionByName(odd), deleted)


def review_next_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, W13."""
    base, edits, deleted = _tables(spark, sf_dir)
    return review.next_live(base, deleted, 40).crossJoin(F.broadcast(review.new_id(base, edits)))


def review_invalid_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B13, B14."""
    allowed = F.array(*map(F.lit, ("steel", "brass", "tin", "copper", "blue")))
    rows = e.tagged(spark, sf_dir).withColumn("bad", review.unknown(F.col("keywords"), allowed))
    return rows.where(F.size("bad") > 0).select("ordinal", "bad", review.suggestions(allowed, F.col("keywords"), "E").alias("offered"))


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B9, B10."""
    labels = e.read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("a"), F.when(F.col("toxic") == 0, 0).alias("b"))
    return review.pending(e.documents(spark, sf_dir).join(labels, "doc_id", "left"), ("a", "b")).select("doc_id", "lang")


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B18, U7."""
    base, edits, _ = _tables(spark, sf_dir)
    merged = review.upserted(base.select("id", "lang"), edits.select("id", "lang"), "id")
    return merged.select("id", "lang", review.kept_correction(F.col("lang"), F.lit("xx"), F.lit("new")).alias("kept"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = e.read(spark, sf_dir, "lineitem")
    return learning.regroup(lines, "l_orderkey", ["l_linenumber"], ["l_linenumber", "l_partkey", "l_returnflag"])


def nested_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, G16, G18."""
    return _nested(spark, sf_dir).select("l_orderkey", F.size("items").cast("long").alias("n"), F.transform("items", lambda i: i["l_partkey"]).alias("parts"), F.array_join(F.transform("items", lambda i: i["l_returnflag"]), "").alias("flags"))


def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return learning.flatten(_nested(spark, sf_dir), "l_orderkey", "items").select("l_orderkey", "place", "l_linenumber", "l_partkey", "l_returnflag")


def global_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, A18."""
    rows = e.documents(spark, sf_dir).select("doc_id", "lang")
    return learning.numbered(rows, "lang", "doc_id")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of events; some have no text, some no numeric id, some a fifth part."""
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("k "), k))
    line = F.concat_ws(" | ", F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.col("user_id") % 50).cast("string")), F.concat(F.lit("u"), F.col("user_id").cast("string")), "event_type", text)
    return e.read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 == 0, F.concat(line, F.lit(" | more"))).otherwise(line).alias("value"))


def feedback_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, Q11, Q12."""
    return feedback.parse(_reports(spark, sf_dir))


def feedback_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is trimmed before it is split."""
    return feedback.of_poem(feedback.parse(_reports(spark, sf_dir), strict=True), 7)


def feedback_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11, G4."""
    return feedback.by_status(feedback.parse(_reports(spark, sf_dir)))


def feedback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, F19, B15."""
    parsed = feedback.parse(_reports(spark, sf_dir))
    liked = parsed.select("poem_id", F.when(F.col("poem_id") > 10, F.col("username")).otherwise("").alias("username"), F.when(F.col("status") == "click", "like").otherwise(F.col("status")).alias("status"), F.concat(F.lit("a|b\n"), "interpretation").alias("interpretation"))
    return feedback.lines(liked)


def random_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row at random, and whether it is one of the table's."""
    docs = e.documents(spark, sf_dir).select("doc_id", "lang")
    picked = docs.orderBy(F.rand(42)).limit(1).withColumnRenamed("lang", "picked")
    return picked.join(docs, "doc_id").agg(F.count("*").alias("n"), F.bool_and(F.col("lang").eqNullSafe(F.col("picked"))).alias("member"))


def option_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in random order; sorted again here, so that the multiset can be held against SQL."""
    shuffled = learning.options(e.tagged(spark, sf_dir).select("ordinal", F.col("keywords").alias("options")))
    return shuffled.select("ordinal", F.array_sort("options").alias("options"))


QUERIES = {
    f.__name__: f
    for f in (
        review_overlay, review_entry, review_progress, review_next_live, review_invalid_keywords, resume_pending, corrections, nested_regroup, nested_flatten, global_ordinal,
        feedback_parse, feedback_strict, feedback_by_status, feedback_lines, random_fallback, option_shuffle,
    )
}

_TABLES = """base AS (SELECT doc_id AS id, text, lang, source FROM documents),
ed AS (SELECT doc_id AS id, 'edited ' || quality AS text, CASE WHEN quality = 1 THEN 'xx' END AS lang, NULL::VARCHAR AS source FROM labels),
edits AS (SELECT * FROM ed UNION ALL SELECT id + 10000000, text, lang, source FROM ed WHERE id % 10 = 0),
deleted AS (SELECT doc_id AS id FROM labels WHERE toxic = 1)"""
_LOG = """log AS (SELECT CASE WHEN event_id % 7 = 0 THEN 'x' ELSE (user_id % 50)::VARCHAR END || ' | u' || user_id || ' | ' || event_type || ' | '
  || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'k ' || json_extract_string(props, '$.k') END || CASE WHEN event_id % 11 = 0 THEN ' | more' ELSE '' END AS value FROM events),
parsed AS (SELECT try_cast(trim(p[1]) AS INT) AS poem_id, p[2] AS username, p[3] AS status, trim(p[4]) AS interpretation
  FROM (SELECT string_split(value, ' | ') AS p FROM log) s WHERE len(p) >= 4 AND try_cast(trim(p[1]) AS INT) IS NOT NULL)"""

ORACLES = {
    "review_overlay": f"""WITH {_TABLES}
SELECT b.id, coalesce(x.text, b.text) AS text, coalesce(x.lang, b.lang) AS lang, coalesce(x.source, b.source) AS source FROM base b LEFT JOIN edits x USING (id) WHERE b.id NOT IN (SELECT id FROM deleted)
UNION ALL SELECT * FROM edits WHERE id NOT IN (SELECT id FROM base) AND id NOT IN (SELECT id FROM deleted)""",
    "review_entry": f"""WITH {_TABLES}
SELECT b.id, coalesce(x.text, b.text) AS text, coalesce(x.lang, b.lang) AS lang, coalesce(x.source, b.source) AS source, x.id IS NOT NULL AS is_reviewed, b.id IN (SELECT id FROM deleted) AS is_deleted
FROM base b LEFT JOIN edits x USING (id) WHERE b.id = 7""",
    "review_progress": f"""WITH {_TABLES}
SELECT (SELECT greatest((SELECT count(*) FROM base), (SELECT max(id) FROM edits))) AS total, (SELECT count(DISTINCT id) FROM edits WHERE id NOT IN (SELECT id FROM deleted)) + 1 AS reviewed""",
    "review_next_live": f"""WITH {_TABLES}, live AS (SELECT id FROM base WHERE id NOT IN (SELECT id FROM deleted))
SELECT coalesce(min(id) FILTER (id > 40), max(id) FILTER (id < 40), 1) AS next_id, (SELECT greatest((SELECT count(*) FROM base), (SELECT max(id) FROM edits)) + 1) AS new_id FROM live""",
    "review_invalid_keywords": """WITH k AS (SELECT p_partkey AS ordinal, string_split(p_name, ' ') AS k, ['steel', 'brass', 'tin', 'copper', 'blue'] AS allowed FROM part),
b AS (SELECT ordinal, k, allowed, CASE WHEN len(k) = 2 AND k[1] = k[2] THEN k[1:1] ELSE k END AS u FROM k)
SELECT ordinal, list_filter(u, lambda x: x NOT IN ('steel', 'brass', 'tin', 'copper', 'blue')) AS bad,
       list_filter(allowed, lambda x: NOT list_contains(k, x) AND contains(x, 'e')) AS offered
FROM b WHERE len(list_filter(u, lambda x: x NOT IN ('steel', 'brass', 'tin', 'copper', 'blue'))) > 0""",
    "resume_pending": "SELECT d.doc_id, lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL OR toxic IS NULL OR toxic <> 0",
    "corrections": f"""WITH {_TABLES}, m AS (SELECT coalesce(b.id, x.id) AS id, CASE WHEN x.id IS NOT NULL THEN x.lang ELSE b.lang END AS lang FROM base b FULL JOIN edits x ON b.id = x.id)
SELECT id, lang, CASE WHEN coalesce(lang, '') IN ('', 'xx') THEN 'new' ELSE lang END AS kept FROM m""",
    "nested_regroup": """SELECT l_orderkey, count(*) AS n, list(l_partkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS parts, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey, l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey""",
    "nested_flatten": """SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1)::INT AS place, l_linenumber, l_partkey, l_returnflag FROM lineitem""",
    "global_ordinal": "SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS number FROM documents",
    "random_fallback": "SELECT 1::BIGINT AS n, true AS member",
    "option_shuffle": "SELECT p_partkey AS ordinal, list_sort(list_distinct(string_split(p_name, ' '))) AS options FROM part",
    "feedback_parse": f"WITH {_LOG} SELECT * FROM parsed",
    "feedback_strict": f"""WITH {_LOG}
SELECT try_cast(trim(p[1]) AS INT) AS poem_id, p[2] AS username, p[3] AS status, trim(p[4]) AS interpretation
FROM (SELECT string_split(trim(value), ' | ') AS p FROM log) s WHERE len(p) >= 4 AND try_cast(trim(p[1]) AS INT) = 7""",
    "feedback_by_status": f"WITH {_LOG} SELECT status, count(*) AS n FROM parsed GROUP BY status",
    "feedback_lines": f"""WITH {_LOG}
SELECT poem_id || ' | ' || CASE WHEN poem_id > 10 AND username <> '' THEN username ELSE 'Ẩn danh' END || ' | like | ' || 'a b ' || interpretation AS value
FROM parsed WHERE status IN ('click', 'like')""",
}
