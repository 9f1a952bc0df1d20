from __future__ import annotations

import random

import pytest

from lexispark.llm import url_filter, warc


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for end in "#?":
        rest = rest.split(end, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if c.isascii() else c for c in host), slash + path


def judged(url, rules, listed):
    host, path = parse(url)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], max(fits)[2]
    return host, path, None, "block" if url in listed else "allow"


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://example.com/en", "http://a.b.net/es/1", "http://net/es/", "http://xnet/es/",
    "ftp://spam.org:80/bad/", "http://spam.org/bad", "http://spam.org/bad?x=1", "http://spam.org./bad#f", "http://spam.org/badly", "a://b://c/d", "http://é.com/ü", "http://com?x", "x://a.com/#", "http://a/" + "y" * 50_000,
]


def test_urls_against_loops(spark):
    rules = [*url_filter.RULES, ("a.com", "", "block"), ("com", "/ü", "block"), ("org", "/b", "allow")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, "h")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("spam.org/bad",), ("spam.org/bad",)], "url string")
    for used in (rules, rules[:-1]):
        got = url_filter.judge(pages, spark.createDataFrame(used, "host string, path string, verdict string"), listed).collect()
        assert len(got) == len(URLS) + 1
        on_list = {u for u in URLS if u and "spam.org" in u and "badly" not in u}
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == judged(URLS[r.page_id], used, on_list), URLS[r.page_id]


def test_long_hosts_and_paths_cost_in_proportion(spark):
    import time

    long_hosts = ["a." * 500_000 + "com", "x" * 1_000_000 + ".net", "a." * 500_000, "." * 1_000_000, "é." * 300_000 + "www.example.com"]
    urls = [f"http://{h}/es/{'/' * 200_000}x/" for h in long_hosts] + [f"http://{h}/en/" for h in long_hosts]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [*url_filter.RULES, (long_hosts[0], "/es/", "block")]
    began = time.monotonic()
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([], "url string")).collect()
    assert time.monotonic() - began < 60
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(urls[r.page_id], rules, set()), r.page_id


def test_many_rules_of_many_shapes(spark):
    hosts = ["a.b.org", "b.org", "org", "x.b.org"]
    rules = [(h, "/" + "p" * n, "block" if n % 2 else "allow") for h in hosts for n in range(0, 120, 3)]
    urls = [f"http://{h}/{'p' * n}{t}" for h in (*hosts, "y.a.b.org", "zb.org", "b.org.") for n in (0, 1, 5, 50, 200) for t in ("", "/q", "?p")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([], "url string")).collect():
        assert (r.host, r.path, r.rule, r.verdict) == judged(urls[r.page_id], rules, set())


def test_the_list_meets_near_misses(spark, sf_dir):
    listed = {r.url for r in url_filter.listed_urls(spark).collect()}
    assert len(listed) > 100_000
    assert "tionsh.example.net/en/10" in listed
    assert not {"tionsh.example.net/en/11", "onsh.example.net/en/10", "tionsh.example.net/fr/10"} & listed


def test_urls_without_entries_or_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    listed = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages, rules, listed).collect()] == ["allow"]
    assert url_filter.judge(pages.limit(0), rules, listed).count() == 0


def test_the_filter_has_no_false_negatives_and_few_false_positives(spark, monkeypatch):
    import numpy as np

    keys = spark.range(20_000).selectExpr("concat('k', id) as key")
    for most in (32 << 20, 4096):
        monkeypatch.setattr(url_filter, "MAX_BYTES", most)
        words = url_filter.bloom(keys, 20_000)
        inside = keys.selectExpr("xxhash64(key) as h").toPandas()["h"].to_numpy()
        block, bits = url_filter._places(inside, len(words))
        assert (words[block] & bits == bits).all()
        block, bits = url_filter._places(np.random.default_rng(1).integers(-(2**63), 2**63, 20_000), len(words))
        false = (words[block] & bits == bits).all(axis=1).mean()
        assert false < 0.01 or most == 4096


SCHEMA = "record_id long, url string, ts double, kind string, etag string, last_modified string, digest string, headers map<string,string>, n int"


def merged(response, revisit):
    own = {k: v for k, v in (revisit or {}).items() if k.lower() in warc.PERMITTED}
    names = {k.lower() for k in own}
    return {k: v for k, v in (response or {}).items() if k.lower() not in names} | own


def resolved(rows):
    out = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        earlier = [o for o in rows if o[3] == "response" and o[1] == r[1] and r[1] is not None and None not in (o[2], r[2]) and o[2] < r[2]]
        if not earlier:
            out[r[0]] = ("no_response", None, None)
            continue
        of = max(earlier, key=lambda o: (o[2], o[0]))
        status = "unvalidated"
        for mine, theirs in ((r[4], of[4]), (r[5], of[5]), (r[6], of[6])):
            if mine is not None and theirs is not None:
                status = "resolved" if mine.removeprefix("W/") == theirs.removeprefix("W/") else "validator_mismatch"
                break
        out[r[0]] = (status, of[0], merged(of[7], r[7]) if status == "resolved" else None)
    return out


@pytest.mark.parametrize("heavy", [1, 1024])
def test_revisits_against_loops(spark, heavy):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        url = rng.choice(["http://hot.org/x"] * 3 + ["http://a.org/1", "http://b.org/", None])
        pick = lambda *values: rng.choice([None, *values])
        headers = rng.choice([None, {}, {"ETag": str(i), "Content-Length": "1", "X": "y"}, {"date": str(i), "Content-Type": "t"}])
        rows.append((i, url, rng.choice([None, *[float(t) for t in range(60)]]), rng.choice(["response", "revisit", "request"]), pick("a", "W/a", "b"), pick("m", "n"), pick("d", "e"), headers, i))
    rows += rows[:40]  # repeated rows
    found = warc.resolve(spark.createDataFrame(rows, SCHEMA), heavy).collect()
    assert len(found) == sum(r[3] == "revisit" for r in rows)
    assert {r.record_id: (r.status, r.response_id, r.headers) for r in found} == resolved(rows)


def test_a_hot_url_of_one_time(spark):
    rows = [(i, "http://hot.org/" + "x" * (50_000 * (i > 90)), 5.0, "response" if i % 10 == 0 else "revisit", "a", None, None, {}, 0) for i in range(100)]
    rows.append((100, "http://hot.org/", 6.0, "revisit", "a", None, None, {}, 0))
    got = {r.record_id: (r.status, r.response_id) for r in warc.resolve(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert got.pop(100) == ("resolved", 90)
    assert set(got.values()) == {("no_response", None)}


def test_canonical_urls(spark):
    from pyspark.sql import functions as F

    given = ["http://WWW.A.com:80/x.html?utm_source=f&b=2&a=1#t", "https://a.com/x/?a=1&b=2", "http://a.com", "a.com", None, "http://a.com/?ref=x", "https://a.com:443/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in given], "u string").select(warc.canonical_url(F.col("u"))).collect()]
    assert got == ["a.com/x?a=1&b=2", "a.com/x?a=1&b=2", "a.com", None, None, "a.com", "a.com"]


def test_no_captures(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
