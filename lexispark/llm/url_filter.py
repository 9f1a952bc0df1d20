"""URL filters: a blocked Bloom filter before an exact hash join.

Entries are rules (host, path, verdict) and listed URLs in canonical form. The
hosts of rules and the listed URLs become keys; the filter holds their XXH64 in
blocks of 512 bits, 8 bits a key, one in each 64-bit word of one block, so a probe
touches one cache line. Its blocks are aggregated by Spark and number
entries * BITS / 512, MAX_BYTES at most: a longer list makes the filter pass more,
never lose a hit.

A URL gives one key for its canonical form and one for each suffix of its host that
is as long as the host of some rule: a host of a million labels costs no more keys
than rules' hosts have lengths. Keys that the filter passes go to a hash join with the entries,
which removes false positives. A host that has rules brings the lengths of their
paths; the URL's path, cut to each length that it has, is joined with the rules
themselves. So a URL costs as many rows as rules' hosts and lengths can fit it,
however many rules there are. Entries are broadcast only up to BROADCAST_ROWS of
them. Of the rules that fit, the longest wins (host and path together; then the
longer host; then block). Without a rule the list decides: block if the URL is
listed.

A null URL, or one without `://`, has an empty host and path, fits no rule and
is never listed, so it is allowed. Repeated rows each get their result; only
page_id and url are read; an empty table gives an empty result, and without
entries everything is allowed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ship, stored, table

BITS = 16
BLOCK_BITS = 512
MAX_BYTES = 32 << 20
BROADCAST_ROWS = 100_000
#: Odd multipliers that choose a bit in each word of a block, unrelated to one another.
SALTS = tuple(int.from_bytes(hashlib.sha256(b"word %d" % i).digest()[:8], "little") | 1 for i in range(8))

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The query's list: of these hosts, in these languages, every STEP-th page number from FIRST on; and pages below them, which none of the URLs is.
LISTED_HOSTS = (
    "tionsh.example.net", "blog.tionsh.example.net", "thther.example.org", "m.thther.example.org", "ththre.example.com", "blog.ththre.example.org",
    "spam-farm.example.org", "www.spam-farm.example.net", "ththed.example.org.org", "xblog.ththly.example.org",
)
LISTED_LANGS = ("en", "de")
FIRST, STEP, LAST = 3, 7, 60_000


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(F.regexp_extract(url, r"(?s)://(.*)", 1), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_extract(url, r"(?s)://(.*)", 1), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without default port and final dot, path without final slashes; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(F.regexp_replace(host, r":(80|443)?\z", ""), r"\.\z", ""), F.lit("/"), F.btrim(path, F.lit("/")))


def _suffixes(host: Column, lengths: list[int]) -> Column:
    """What is left of the host after some of its labels, the host itself included, of these lengths only.

    One look at the host's end for each length, so a host costs time in proportion to its length, whatever its labels.
    """
    longest = max(lengths, default=0)
    end = F.right(host, F.lit(longest + 1))
    fits = lambda n: (F.length(end) == n) | ((F.length(end) > n) & (F.substring(end, F.length(end) - n, F.lit(1)) == "."))
    return F.transform(F.filter(F.lit(lengths).cast("array<int>"), fits), lambda n: F.right(end, n))


def _rule_key(host: Column, path: Column) -> Column:
    """Two rules may spell alike together (a.b + c/ and a.bc + /), so the key holds the host's length."""
    return F.concat(F.length(host).cast("string"), F.lit(" "), host, path)


def _rules(rules: DataFrame) -> DataFrame:
    """(rule_key, rule, rank) with distinct keys."""
    ranked = rules.select(
        _rule_key(F.col("host"), F.col("path")).alias("rule_key"),
        F.concat("host", "path").alias("rule"),
        F.struct((F.length("host") + F.length("path")).alias("all"), F.length("host").alias("host"), F.col("verdict").alias("verdict")).alias("rank"),
    )
    return ranked.groupBy("rule_key").agg(F.max_by("rule", "rank").alias("rule"), F.max("rank").alias("rank"))


def _entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, lengths): hosts of rules with the lengths of their paths, and listed URLs with none; distinct keys."""
    hosts = rules.groupBy("host").agg(F.array_sort(F.collect_set(F.length("path"))).alias("lengths"))
    urls = listed.select(F.concat(F.lit("listed "), "url").alias("key")).distinct()
    return hosts.select(F.concat(F.lit("host "), "host").alias("key"), "lengths").unionByName(urls, allowMissingColumns=True)


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and its eight words."""
    h = hashes.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    words = np.stack([np.uint64(1) << ((h * np.uint64(s)) >> np.uint64(58)) for s in SALTS], axis=1)
    return block.astype(np.int64), words


def bloom(entries: DataFrame, n: int) -> np.ndarray:
    """The filter's words: 8 for each block. Blocks are or-ed together before they come to the driver."""
    blocks = max(1, min(n * BITS // BLOCK_BITS + 1, MAX_BYTES * 8 // BLOCK_BITS))

    def run(batches):
        for pdf in batches:
            block, words = _places(pdf["h"].to_numpy(), blocks)
            yield pd.DataFrame({"block": block} | {f"w{i}": words[:, i].view(np.int64) for i in range(8)})

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(8))
    rows = entries.select(F.xxhash64("key").alias("h")).mapInPandas(run, schema).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    got = rows.toArrow()
    words = np.zeros((blocks, 8), np.uint64)
    words[got["block"].to_numpy()] = np.stack([got[f"w{i}"].to_numpy().view(np.uint64) for i in range(8)], axis=1)
    return words


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict for each page; rules (host, path, verdict), listed (url: canonical)."""
    spark = pages.sparkSession
    ship(spark)
    rules = rules.where("host <> ''").select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    entries, ruled = stored(_entries(rules, listed), "entries"), stored(_rules(rules), "rules")
    n = entries.count()
    lengths = sorted(r.n for r in rules.select(F.length("host").alias("n")).distinct().collect())
    held = spark.sparkContext.broadcast(bloom(entries, n))

    def bounded(few: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(few) if rows <= BROADCAST_ROWS else few

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        filter_ = held.value
        block, words = _places(hashes.to_numpy(), len(filter_))
        return pd.Series((filter_[block] & words == words).all(axis=1))

    base = stored(
        pages.select(F.monotonically_increasing_id().alias("row_id"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")),
        "urls",
    )
    host, path = F.col("host"), F.col("path")
    own = F.struct(F.concat(F.lit("listed "), canonical(host, path)).alias("key"), F.lit(None).cast("string").alias("suffix"))
    keys = F.array_append(F.transform(_suffixes(host, lengths), lambda s: F.struct(F.concat(F.lit("host "), s).alias("key"), s.alias("suffix"))), own)
    asked = base.where("host <> ''").select("row_id", "path", F.explode(keys).alias("k")).select("row_id", "path", "k.*")
    met = stored(asked.where(maybe(F.xxhash64("key"))).join(bounded(entries, n), "key").select("row_id", "suffix", "lengths", F.when(F.col("suffix").isNotNull(), path).alias("path")), "met")
    fitting = F.explode(F.filter("lengths", lambda n: n <= F.length("path")))
    cut = met.where("suffix is not null").select("row_id", "suffix", "path", fitting.alias("n"))
    cut = cut.select("row_id", _rule_key(F.col("suffix"), F.substring("path", F.lit(1), F.col("n"))).alias("rule_key"))
    fits = cut.join(bounded(ruled, ruled.count()), "rule_key").select("row_id", "rule", "rank", F.lit(False).alias("listed"))
    on_list = met.where("suffix is null").select("row_id", F.lit(True).alias("listed"))
    hits = fits.unionByName(on_list, allowMissingColumns=True).groupBy("row_id").agg(
        F.max_by("rule", "rank").alias("rule"), F.max("rank").alias("rank"), F.max("listed").alias("listed")
    )
    by_list = F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")
    return base.join(hits, "row_id", "left").select("page_id", "host", "path", "rule", F.coalesce("rank.verdict", by_list).alias("verdict"))


def listed_urls(spark) -> DataFrame:
    """The query's list: canonical URLs, made of the constants above and of no table."""
    numbers = spark.range(FIRST, LAST, STEP).select(F.col("id").cast("string").alias("n"))
    sites = numbers.select("n", F.explode(F.array(*[F.lit(f"{host}/{lang}/") for host in LISTED_HOSTS for lang in LISTED_LANGS])).alias("site"))
    return sites.select(F.explode(F.array(F.concat("site", "n"), F.concat("site", "n", F.lit("/more")))).alias("url"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, spark.createDataFrame(list(RULES), "host string, path string, verdict string"), listed_urls(spark))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM u),
r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n),
listed AS (
  SELECT host || '/' || lang || '/' || i || tail AS url
  FROM (VALUES HOSTS) h(host), (VALUES LANGS) l(lang), range(FIRST, LAST, STEP) r(i), (VALUES (''), ('/more')) t(tail)),
c AS (
  SELECT n, regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '\.$', '') || '/' || regexp_replace(path, '^/+|/+$', '', 'g') AS url FROM p WHERE host <> '')
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN n IN (SELECT n FROM c JOIN listed USING (url)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (n)
"""
for _name, _values in (("HOSTS", LISTED_HOSTS), ("LANGS", LISTED_LANGS)):
    ORACLE = ORACLE.replace(_name, ", ".join(f"('{v}')" for v in _values))
for _name, _number in (("FIRST", FIRST), ("LAST", LAST), ("STEP", STEP)):
    ORACLE = ORACLE.replace(_name, str(_number))
