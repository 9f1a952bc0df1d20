"""WARC not-modified revisits: an as-of join to the latest earlier full response.

A revisit takes, among the captures of its canonical URL, the last full response
with an earlier time. Validators must agree: entity tags if both have one (a weak
mark doesn't count), else modification times, else payload digests; with nothing
to compare the revisit is `unvalidated`. A resolved revisit has the response's
headers, in which its own replace or add the PERMITTED ones only; the length and
type of a bodiless answer never do.

The as-of join works on the distinct times of a URL: responses of one time are
reduced to the one with the largest record_id where they are read, revisits to the
fact that the time is asked for. One window over these times finds the last
response before each, and the revisits join the answers by URL and time. A URL with
more than 1/HEAVY of all times (HEAVY such URLs at most, hence a broadcast of
proven size) is cut into QUANTILES spans of time; the last response of each span
is carried into the spans after it, so no task holds a hot URL alone. Captures of
one URL and time, however many, meet one row in the join, which Spark splits.

Captures of other kinds are left out. Rows are told apart by record_id; of captures with one time, responses count as
later than revisits. A null URL or time gives `no_response`. A null record_id or
header map is kept as it is (a null map counts as empty). Payloads are never
moved. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

#: Headers of a not-modified answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't tell pages apart.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"
HEAVY = 1024
QUANTILES = 128
#: Time from a page's capture to the query's second revisit.
LATER = 1000.0


def canonical_url(url: Column) -> Column:
    """Without scheme, default port, leading www., fragment, tracking parameters, .html and final slashes; the host in lower case."""
    rest = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(ascii_lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"(\.html)?/*$", "")
    params = F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(params), "&"))).otherwise("")
    return F.when(rest != "", F.concat(host, path, query))


def _spans(captures: DataFrame, heavy: int) -> DataFrame:
    """Adds span: 0, or the part of its times that a heavy URL's time lies in."""
    counts = captures.groupBy("key").agg(F.count("*").alias("n"))
    total = captures.agg(F.count("*").alias("total"))
    hot = counts.join(F.broadcast(total), F.col("n") * heavy > F.col("total")).select("key")
    cuts = [i / QUANTILES for i in range(1, QUANTILES)]
    bounds = stored(
        captures.join(F.broadcast(hot), "key", "left_semi").groupBy("key").agg(F.percentile_approx("ts", cuts, 10 * QUANTILES).alias("bounds")), "bounds"
    )
    span = F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("ts"))), F.lit(0))
    return captures.join(F.broadcast(bounds), "key", "left").withColumn("span", F.when(F.col("bounds").isNull(), 0).otherwise(span)).drop("bounds")


def _tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(response: Column, revisit: Column) -> Column:
    own = F.map_filter(F.coalesce(revisit, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k).isin(*PERMITTED))
    names = F.transform(F.map_keys(own), F.lower)
    return F.map_concat(F.map_filter(F.coalesce(response, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(names, F.lower(k))), own)


def resolve(captures: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """record_id, key, status, response_id and headers of every revisit.

    captures: record_id, url, ts double, kind ('response' or 'revisit'), etag,
    last_modified, digest, headers map<string,string>.
    """
    keyed = captures.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("key"), "ts", (F.col("kind") == "response").alias("full"), "etag", "last_modified", "digest", "headers")
    rows = stored(keyed, "captures")
    placed = rows.where("key is not null and ts is not null")
    answer = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    at_times = placed.groupBy("key", "ts").agg(F.max_by(F.when(F.col("full"), answer), F.when(F.col("full"), F.struct("record_id"))).alias("answer"), F.max(~F.col("full")).alias("asked"))
    times = _spans(stored(at_times, "times"), heavy)
    ends = times.where("answer is not null").groupBy("key", "span").agg(F.max_by("answer", "ts").alias("last_answer"))
    # What was answered last before a span: from the ends of the spans of a URL, of which there are QUANTILES at most.
    all_spans = times.where("asked").select("key", "span").distinct().join(ends, ["key", "span"], "full")
    before = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_spans.select("key", "span", F.last("last_answer", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("key", "span").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    answered = (
        times.withColumn("near", F.last("answer", ignorenulls=True).over(within))
        .where("asked")
        .join(carried, ["key", "span"], "left")
        .select("key", "ts", F.coalesce("near", "carried").alias("of"))
    )
    found = placed.where("not full").join(answered, ["key", "ts"])
    lost = rows.where("(key is null or ts is null) and not full").withColumn("of", F.lit(None).cast(found.schema["of"].dataType))
    columns = ["record_id", "key", "etag", "last_modified", "digest", "headers", "of"]
    every = found.select(columns).unionByName(lost.select(columns))
    tags = F.col("etag").isNotNull() & F.col("of.etag").isNotNull()
    times = F.col("last_modified").isNotNull() & F.col("of.last_modified").isNotNull()
    sums = F.col("digest").isNotNull() & F.col("of.digest").isNotNull()
    agrees = F.when(tags, _tag(F.col("etag")) == _tag(F.col("of.etag"))).when(times, F.col("last_modified") == F.col("of.last_modified")).when(sums, F.col("digest") == F.col("of.digest"))
    status = F.when(F.col("of").isNull(), "no_response").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("validator_mismatch")
    return every.withColumn("status", status).select(
        "record_id",
        "key",
        "status",
        F.col("of.record_id").alias("response_id"),
        F.when(F.col("status") == "resolved", merged_headers(F.col("of.headers"), F.col("headers"))).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def captures_of(pages: DataFrame) -> DataFrame:
    """Three captures of each page: a response at time page_id, a revisit just before it and one LATER on.

    Which validators they carry goes by page_id % 6: an entity tag and a digest, a
    modification time, a digest, none, a tag that the revisits give as a weak one
    (with another modification time), and a tag that has changed.
    """
    html, kind = F.coalesce("html", F.lit("")), F.col("page_id") % 6
    tag, size = F.md5(html), F.length(html).cast("string")
    given = pages.select(
        "page_id", "url", size.alias("size"), F.col("page_id").cast("string").alias("date"), F.col("page_id").cast("double").alias("at"),
        F.when(kind.isin(0, 4, 5), tag).alias("tag"), F.when(kind.isin(1, 4), size).alias("modified"), F.when(kind.isin(0, 2), F.md5(tag)).alias("digest"),
        F.when(kind == 0, tag).when(kind == 4, F.concat(F.lit("W/"), tag)).when(kind == 5, F.concat(F.lit("new "), tag)).alias("tag_again"),
        F.when(kind == 1, size).when(kind == 4, F.lit("never")).alias("modified_again"),
    )

    def record(kind: str, n: int, shift: float, etag: str, modified: str, *headers) -> Column:
        return F.struct(
            (F.col("page_id") * 3 + n).alias("record_id"), "url", (F.col("at") + shift).alias("ts"), F.lit(kind).alias("kind"), F.col(etag).alias("etag"),
            F.col(modified).alias("last_modified"), "digest", F.map_filter(F.create_map(*headers), lambda _, v: v.isNotNull()).alias("headers"),
        )

    again = (F.lit("Date"), F.concat(F.lit("again "), "date"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0"))
    first = (F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size"), F.lit("Date"), F.col("date"), F.lit("ETag"), F.col("tag"))
    return given.select(
        F.explode(
            F.array(
                record("response", 0, 0.0, "tag", "modified", *first),
                record("revisit", 1, -0.5, "tag_again", "modified_again", *again),
                record("revisit", 2, LATER, "tag_again", "modified_again", *again),
            )
        ).alias("r")
    ).select("r.*")


def op7_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Revisits of all pages."""
    found = resolve(captures_of(table(spark, sf_dir, "pages")))
    return found.select("record_id", F.col("key").alias("canonical_url"), "status", "response_id", header_text(F.col("headers")).alias("headers"))


ORACLE = r"""
WITH c AS (
  SELECT page_id, page_id % 6 AS v, md5(coalesce(html, '')) AS tag, length(coalesce(html, ''))::VARCHAR AS size,
         regexp_extract(url, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) AS rest FROM pages),
k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)?$', ''), '^www\.', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '(\.html)?/*$', '')
            || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END AS key
  FROM (SELECT *, list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'),
                              lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')) AS params FROM c) x),
r AS (
  SELECT page_id * 3 + n AS record_id, key, page_id + CASE n WHEN 0 THEN 0 WHEN 1 THEN -0.5 ELSE 1000.0 END AS ts, n = 0 AS is_full, page_id, size,
         CASE WHEN v IN (0, 4, 5) THEN CASE WHEN n = 0 OR v = 0 THEN tag WHEN v = 4 THEN 'W/' || tag ELSE 'new ' || tag END END AS etag,
         CASE WHEN v = 1 OR v = 4 AND n = 0 THEN size WHEN v = 4 THEN 'never' END AS modified,
         CASE WHEN v IN (0, 2) THEN md5(tag) END AS digest
  FROM k, (VALUES (0), (1), (2)) AS t(n)),
w AS (
  SELECT *, last_value(CASE WHEN is_full THEN struct_pack(id := record_id, etag := etag, modified := modified, digest := digest, size := size) END IGNORE NULLS)
              OVER (PARTITION BY key ORDER BY ts, is_full, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS of_
  FROM r),
s AS (
  SELECT *, CASE WHEN of_ IS NULL THEN 'no_response'
                 WHEN etag IS NOT NULL AND of_.etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(of_.etag, '^W/', '') THEN 'resolved' ELSE 'validator_mismatch' END
                 WHEN modified IS NOT NULL AND of_.modified IS NOT NULL THEN CASE WHEN modified = of_.modified THEN 'resolved' ELSE 'validator_mismatch' END
                 WHEN digest IS NOT NULL AND of_.digest IS NOT NULL THEN CASE WHEN digest = of_.digest THEN 'resolved' ELSE 'validator_mismatch' END
                 ELSE 'unvalidated' END AS status
  FROM w WHERE NOT is_full)
SELECT record_id, key AS canonical_url, status, of_.id AS response_id,
       CASE WHEN status = 'resolved' THEN
         'Cache-Control: max-age=60' || chr(10) || 'Content-Length: ' || of_.size || chr(10) || 'Content-Type: text/html' || chr(10)
         || 'Date: again ' || page_id || CASE WHEN of_.etag IS NOT NULL THEN chr(10) || 'ETag: ' || of_.etag ELSE '' END END AS headers
FROM s
"""
