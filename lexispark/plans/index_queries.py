"""Queries of record offsets, pruned pairs, growing vocabularies, postings, page directories and versions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import providers
from lexispark.operators import browse, enrich, nearest, postings, raster, search
from lexispark.plans import entries as e
from lexispark.plans.search_queries import _ENTRIES, _KEYWORDS, _VECTORS, ORACLES as _SEARCH
from lexispark.sources import feedback, records, tables
from lexispark.streaming import feedback as stream

SHELVES = 4
RECORD = tables.strings("id", "text")


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Documents as quoted CSV with line breaks in cells, a folder for each shelf, in the order of their ids; its files are parts of one with one header."""
    path = tables.scratch(spark, "records")
    shelf = F.pmod("doc_id", F.lit(SHELVES)).alias("shelf")
    rows = e.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.concat(F.col("text"), F.lit('\n"q", ')).alias("text"), shelf, F.lit(1).alias("row"), "doc_id")
    heads = spark.range(SHELVES).select(F.lit("id").alias("id"), F.lit("text").alias("text"), F.col("id").alias("shelf"), F.lit(0).alias("row"), F.lit(None).cast("long").alias("doc_id"))
    order = ("shelf", "row", "doc_id")
    ordered = heads.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order).drop("row", "doc_id")
    ordered.write.options(header="false", quoteAll="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").partitionBy("shelf").csv(path)
    return path


def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the records of quoted CSV with line breaks, read in ranges of bytes, each with its number and offset."""
    return records.read(spark, _written(spark, sf_dir), RECORD, parts=True)


def csv_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: records by number, each read where the stored index says that it lies."""
    path, at = _written(spark, sf_dir), tables.scratch(spark, "offsets")
    records.record_index(spark, path, parts=True).repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.parquet(at)
    index = spark.read.parquet(at)
    return records.record_at(index, 0, RECORD).unionByName(records.record_at(index, 137, RECORD))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors with a cosine of at least 0.4, pruned by pivots."""
    rows = e.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = nearest.within(rows, rows, 0.4, block=100).select(F.col("left").cast("long").alias("u"), F.col("right").cast("long").alias("v"), F.round("similarity", 6).alias("similarity"))
    return found.where("u < v")


def vocab_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding a candidate, one after the other, onto a vocabulary that grows."""
    name = F.concat(F.lit("term "), (F.col("vec_id") % 350).cast("string"))
    rows = e.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cand_id"), (-F.col("vec_id") % 7).alias("place"), F.when(F.col("vec_id") % 2 == 1, F.upper(name)).otherwise(name).alias("name"), "embedding")
    terms = e.keyword_vectors(spark, sf_dir).where("vec_id < 20")
    return search.grow_vocabulary(rows, terms.select("keyword", "embedding"), 0.4)


WANTED, FIELDS = " All rights Reserved ", ("poem", "category", "source", "Alphabet")


def literal_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal search through an index of trigrams, made of all documents."""
    entries, path = e.entries(spark, sf_dir), tables.scratch(spark, "postings")
    postings.write(entries, FIELDS, path)
    return postings.literal(entries, spark.read.parquet(path), WANTED, FIELDS).select("id", "category", "source")


def browse_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a page far back, and the rows behind its last one by that row's own values."""
    path = tables.scratch(spark, "pages")
    browse.write_pages(e.entries(spark, sf_dir), path, 32)
    pages = browse.read_pages(spark, path)
    shown = pages.page(90, 2)
    last = shown.orderBy(*[F.desc(c) for c in browse.ORDER]).first()
    more = shown if last is None else shown.unionByName(pages.after(last.asDict(), 3))
    return more.select("id", "Alphabet", "category", "poem")


def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9, A12, A13, F19: events as a log in three drops of files, read by a stream that is stopped and started again between them; each report once."""
    log, out, state = (tables.scratch(spark, name) for name in ("log", "reports", "state"))
    status = F.when(F.col("event_id") % 5 == 0, "seen").when(F.col("event_id") % 2 == 0, "like").otherwise("dislike")
    text = F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.concat("props", F.lit(" | a\nb ")))
    rows = e.read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("int").alias("poem_id"), "event_type", status.alias("status"), text.alias("interpretation"))
    reports = rows.select("event_id", "poem_id", F.when(F.col("event_id") % 7 > 0, F.col("event_type")).alias("username"), "status", "interpretation")
    for drop in range(3):
        feedback.append(reports.where(F.col("event_id") % 3 == drop), log)
        query = stream.append_to(stream.reports(spark, log, files=2), out, state)
        query.awaitTermination()
    return spark.read.parquet(out)


def enrich_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending rows through a model in two runs over one log, keywords onto a vocabulary, merged into all rows."""

    def model(row: dict) -> dict:
        return {} if row["id"].endswith("7") else {"meaning": row["poem"] + "!", "keywords": [row["poem"].upper(), row["explanation"], "no " + row["explanation"]]}

    done = F.when(F.col("doc_id") % 4 == 0, F.lit("kept"))
    rows = e.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("poem"), F.col("source").alias("explanation"), done.alias("searchable_explanation"), done.alias("keywords"))
    log = tables.scratch(spark, "replies")
    enrich.run(rows, model, log, chunk=100, most=2)
    found = enrich.run(rows, model, log, chunk=300)
    names = e.documents(spark, sf_dir).select(F.col("lang").alias("keyword")).distinct()
    terms = names.withColumn("embedding", providers.embedding(F.col("keyword")))
    return enrich.merged(rows, found, enrich.resolved(found, terms)).select("id", "searchable_explanation", "keywords")


DPI = 256


def column_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of whole texts as rasters; capitals, blanks and marks are ink. The column with the least of it."""
    docs = e.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("samples"), F.lit(DPI).alias("width"))
    return raster.separator(docs, ink=97).select(F.col("id").cast("long").alias("doc_id"), "x")


QUERIES = {f.__name__: f for f in (csv_records, csv_record, vector_pairs, vocab_grow, literal_postings, browse_deep, feedback_stream, enrich_resumed, column_separator)}

_RECORDS = f"""records AS (
  SELECT doc_id::VARCHAR AS id, text || chr(10) || '"q", ' AS text, doc_id % {SHELVES} AS shelf, doc_id FROM documents),
sized AS (SELECT *, strlen('"' || id || '","' || replace(text, '"', '""') || '"') + 1 AS size FROM records),
placed AS (
  SELECT (row_number() OVER (ORDER BY shelf, doc_id) - 1)::BIGINT AS ordinal, id, text,
         (12 + coalesce(sum(size) OVER (PARTITION BY shelf ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM sized)"""
_COSINE = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"

ORACLES = {
    "csv_records": f"""WITH {_RECORDS} SELECT ordinal, "offset", id, text FROM placed""",
    "csv_record": f"""WITH {_RECORDS} SELECT ordinal, id, text FROM placed WHERE ordinal IN (0, 137)""",
    "vector_pairs": f"""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS u, b.vec_id AS v, {_COSINE} AS s FROM x a JOIN x b ON a.vec_id < b.vec_id)
SELECT u, v, round(s, 6) AS similarity FROM p WHERE s >= 0.4""",
    "vocab_grow": f"""WITH RECURSIVE {_VECTORS}, {_KEYWORDS},
terms AS (SELECT keyword, embedding::DOUBLE[] AS e FROM kv JOIN embeddings USING (vec_id) WHERE vec_id < 20),
cand AS (
  SELECT vec_id AS cand_id, row_number() OVER (ORDER BY -vec_id % 7, vec_id) AS i, CASE WHEN vec_id % 2 = 1 THEN upper(n) ELSE n END AS name, lower(n) AS norm, embedding::DOUBLE[] AS e
  FROM (SELECT *, 'term ' || vec_id % 350 AS n FROM embeddings) x),
old AS (
  SELECT a.cand_id, max({{'s': s, 'keyword': keyword}}) AS near FROM (SELECT a.cand_id, b.keyword, {_COSINE} AS s FROM cand a, terms b) a WHERE s >= 0.4 GROUP BY a.cand_id),
pairs AS (
  SELECT u, v, name, norm_u = norm_v AS equal, s FROM (
    SELECT a.cand_id AS u, b.cand_id AS v, a.name, a.norm AS norm_u, b.norm AS norm_v, {_COSINE} AS s FROM cand a JOIN cand b ON a.i < b.i) x WHERE s >= 0.4 OR norm_u = norm_v),
steps AS (
  SELECT i, cand_id, old.near IS NOT NULL AS shut, coalesce(p.earlier, []) AS earlier
  FROM cand LEFT JOIN old USING (cand_id) LEFT JOIN (SELECT v, list(u) AS earlier FROM pairs GROUP BY v) p ON v = cand_id),
walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS taken
  UNION ALL SELECT s.i, CASE WHEN shut OR list_has_any(earlier, taken) THEN taken ELSE list_append(taken, cand_id) END FROM walk JOIN steps s ON s.i = walk.i + 1),
new AS (SELECT unnest(taken) AS u FROM (SELECT taken FROM walk ORDER BY i DESC LIMIT 1) w),
best AS (SELECT v, max({{'s': CASE WHEN equal THEN 2.0::DOUBLE ELSE s END, 'keyword': name}}) AS near FROM pairs JOIN new USING (u) GROUP BY v),
found AS (
  SELECT c.cand_id, c.name, n.u IS NOT NULL AS own, CASE WHEN o.near IS NULL THEN b.near WHEN b.near IS NULL OR o.near > b.near THEN o.near ELSE b.near END AS near
  FROM cand c LEFT JOIN old o ON o.cand_id = c.cand_id LEFT JOIN best b ON b.v = c.cand_id LEFT JOIN new n ON n.u = c.cand_id)
SELECT cand_id, CASE WHEN own THEN name ELSE near.keyword END AS keyword, CASE WHEN own THEN 'new' WHEN near.s = 2.0 THEN 'exact' ELSE 'near' END AS kind FROM found""",
    "literal_postings": _SEARCH["literal_search"],
    "browse_deep": f"""WITH {_ENTRIES}
SELECT id, "Alphabet", category, poem FROM entries ORDER BY "Alphabet" NULLS FIRST, poem NULLS FIRST, id NULLS FIRST LIMIT 5 OFFSET 178""",
    "feedback_stream": """SELECT user_id::INT AS poem_id, CASE WHEN event_id % 7 > 0 THEN event_type ELSE 'Ẩn danh' END AS username, CASE WHEN event_id % 2 = 0 THEN 'like' ELSE 'dislike' END AS status,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE trim(replace(replace(props || ' | a' || chr(10) || 'b ', '|', ' '), chr(10), ' ')) END AS interpretation FROM events WHERE event_id % 5 <> 0 AND user_id IS NOT NULL""",
    "enrich_resumed": """WITH h AS (SELECT w, ('0x' || md5(w)[1:8])::BIGINT % 64 AS dim, ('0x' || md5(w)[1:8])::BIGINT >= 2147483648 AS up FROM (SELECT DISTINCT lang AS w FROM documents UNION SELECT source FROM documents) x),
near AS (
  SELECT a.w AS name, max(b.w) AS term FROM h a JOIN h b USING (dim, up) WHERE b.w IN (SELECT lang FROM documents) AND a.w NOT IN (SELECT lang FROM documents) GROUP BY a.w)
SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN 'kept' WHEN doc_id % 10 <> 7 THEN lang || '!' END AS searchable_explanation,
       CASE WHEN doc_id % 4 = 0 THEN 'kept' WHEN doc_id % 10 <> 7 THEN lang || CASE WHEN coalesce(term, source) = lang THEN '' ELSE ', ' || coalesce(term, source) END || ', no ' || source END AS keywords
FROM documents LEFT JOIN near ON name = source""",
    "column_separator": f"""WITH b AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) // {DPI} * {DPI} AS n FROM documents),
p AS (SELECT doc_id, unnest(range(n)) AS i, h FROM b),
ink AS (SELECT doc_id, i % {DPI} AS x, sum((('0x' || substr(h, 2 * i + 1, 2))::INT < 97)::INT) AS ink FROM p GROUP BY ALL),
every AS (SELECT doc_id, x FROM documents, range({int(DPI * 0.35)}, {int(DPI * 0.65)}) r(x)),
prof AS (SELECT doc_id, list(coalesce(ink, 0) ORDER BY x) AS v FROM every LEFT JOIN ink USING (doc_id, x) GROUP BY doc_id),
m AS (
  SELECT doc_id, list_transform(range(len(v)), lambda i: list_sum(list_transform([-2, -1, 0, 1, 2], lambda d:
    [1, 4, 6, 4, 1][d + 3] * v[CASE WHEN i + d < 0 THEN -i - d WHEN i + d > len(v) - 1 THEN 2 * (len(v) - 1) - i - d ELSE i + d END + 1]))) AS s FROM prof)
SELECT doc_id, ({int(DPI * 0.35)} + list_position(s, list_min(s)) - 1)::INT AS x FROM m""",
}
