"""Source divergence audit: how far the sources of a language use its words differently. DataFrame functions only.

A text's terms are runs of letters A-Z and of characters beyond ASCII, A-Z
lower-cased. A language keeps its V terms that stand in at least LEAST_DOCS of its
documents. A group is a (lang, source) that occurs, with or without terms. Of each
kept term the language and each of its groups have a smoothed share
p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), N the sum of the counts
of its kept terms; quotients are taken of decimals, so nothing is rounded twice.

* Texts are read once. Matches are exploded together with the distinct matches of
  each text, and summed by (lang, source, term) in each task before the shuffle,
  so neither a frequent word nor a large source comes to one task.
* Groups are crossed with the kept terms of their language to make zeros dense.
  The join's key is the language and one of SALTS parts of its terms, so that a
  language is dealt to as many tasks. One empty term with share 0 is added to each
  language: groups meet each other by it where no term is kept.
* The dense table joins itself on language and term. Each pair of sources is
  summed once and then listed from both ends. Rows of a term are as many as the
  language's sources; the result itself has that many squared.
* Windows rank by descending value, then by item (UTF-8). Of terms only those with
  a greater share in the group than in the language count, MOST of them a group.

Null text, lang and source count as ''. Repeated rows are separate documents.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The same characters of a lower-cased text, listed instead of excluded: Java tests two ranges faster than three that are negated.
LOWER_TERM = r"[a-z\x{80}-\x{10FFFF}]+"
LEAST_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
MOST = 50
SALTS = 64


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and the documents that have it."""
    text, lang, source = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "lang", "source"))
    terms = F.regexp_extract_all(ascii_lower(text), F.lit(LOWER_TERM), F.lit(0))
    # The matches are a variable of transform(), so that they are looked for once.
    bags = F.flatten(F.transform(F.array(terms), lambda t: F.array(F.struct(t.alias("terms"), F.lit(0).alias("once")), F.struct(F.array_distinct(t).alias("terms"), F.lit(1).alias("once")))))
    bag = docs.select(lang.alias("lang"), source.alias("source"), F.explode(bags).alias("bag"))
    rows = bag.select("lang", "source", F.col("bag.once").alias("once"), F.explode("bag.terms").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    wide = lambda c: c.cast("decimal(27,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(count + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + SMOOTH * kept))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most: int = MOST) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of every group."""
    counts = stored(term_counts(docs), "terms")
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "total"), "kept")
    used = stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "used")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sized = named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(sized.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "kept", "all")]), "groups")

    part = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    terms = kept.select("lang", "term", part.alias("part"))
    none = groups.select("lang").distinct().select("lang", F.lit("").alias("term"), F.lit(0).alias("part"))
    dealt = groups.select("lang", "source", "size", "kept", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    crossed = dealt.join(terms.unionByName(none), ["lang", "part"]).drop("part")
    dense = crossed.join(used.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    share = F.when(F.col("term") == "", F.lit(0).cast("long")).otherwise(_share(F.coalesce("n", F.lit(0)), F.col("size"), F.col("kept")))
    dense = stored(dense.select("lang", "source", "term", share.alias("p")), "dense")

    other = dense.select("lang", F.col("source").alias("item"), "term", F.col("p").alias("q"))
    apart = dense.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    ends = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = apart.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    shares = used.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("size"), F.col("kept")).alias("p"), _share(F.col("total"), F.col("all"), F.col("kept")).alias("q"))
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(above.select("*", rank).where(F.col("rank") <= most))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS kept, sum(total) AS size FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(n, 0) + {SMOOTH}) // (coalesce(s.size, 0)::HUGEINT + {SMOOTH} * l.kept) AS p,
         1 + {SCALE}::HUGEINT * (k.total + {SMOOTH}) // (l.size::HUGEINT + {SMOOTH} * l.kept) AS q
  FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {MOST}
"""
