import random
import re

import pytest

from moodlake.llm import url_cascade

URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.net", "https://example.net/", "http://a.example.net/en/x?y#z", "http://example.net/en",
        "http://notexample.net/en/", "http://x.example.com/de/1", "ftp://Example.COM/de/", "http://example.com/DE/", "http://b.org/fr/", "http://b.org/en/",
        "http://cheap-pills.example.com/x", "http://a.cheap-pills.org?q=/fr/", "http://xcheap-pills.org/", "a://b://c/d", "http://host\n.net/p",
        "http://ÄÖ.net/x", "http://u.net#frag/en/", "http://u.net?x", "x" * 5000 + "://long.org/fr/" + "y" * 5000]


def brute(url, listed):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    for said, rule_host, rule_path in sorted(url_cascade.RULES, key=lambda r: -len(r[1] + r[2])):
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            return host, path, rule_host + rule_path, said
    return host, path, None, "block" if host in listed else "allow"


def html(url):
    return None if "EXAMPLE" in (url or "") else "x" * (900 if "xcheap" in (url or "") else 9000)


@pytest.mark.parametrize(("bound", "parts"), [(1 << 25, 1), (8, 3)])
def test_rules_and_list(spark, monkeypatch, bound, parts):
    """With filters of 8 bytes the list goes into partitions with a cascade each."""
    monkeypatch.setattr(url_cascade, "MAX_FILTER_BYTES", bound)
    pages = spark.createDataFrame([(i, u, html(u), "clash", "clash", "clash") for i, u in enumerate(URLS + URLS[:6])],
                                  "page_id long, url string, html string, verdict string, host string, part string").repartition(2)
    listed = {r["key"] for r in url_cascade.listed_hosts(pages).collect()}
    assert listed == {"cheap-pills.example.com", "a.cheap-pills.org", "xcheap-pills.org"}
    assert url_cascade.partitions(url_cascade.listed_hosts(pages)) == (2 if parts > 1 else 1)
    out = url_cascade.filter_urls(pages, url_cascade.listed_hosts(pages))
    assert out.columns == ["page_id", "url", "html", "part", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == pages.count() and {r["part"] for r in rows} == {"clash"}
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], listed)


def test_partitions_of_a_long_list(spark, monkeypatch):
    """Every partition has its cascade, and no plan joins pages with the list."""
    monkeypatch.setattr(url_cascade, "MAX_FILTER_BYTES", 500)
    pages = spark.createDataFrame([(i, f"http://h{i % 900}.se/p") for i in range(1800)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.se",) for i in range(0, 2000, 3)], "key string")
    assert url_cascade.partitions(listed) >= 5
    out = url_cascade.filter_urls(pages, listed)
    assert not re.search("Python|Pandas|Arrow|Join", out._jdf.queryExecution().executedPlan().toString())
    assert {(r["host"], r["verdict"]) for r in out.collect()} == {(f"h{i}.se", "allow" if i % 3 else "block") for i in range(900)}


def test_membership_is_exact_over_many_keys(spark):
    rng = random.Random(9)
    keys = [f"k{i}" for i in range(5000)]
    listed = set(rng.sample(keys, 400))
    universe = spark.createDataFrame([(k,) for k in keys + keys[:50]] + [(None,)], "key string")
    levels = url_cascade.build_cascade(universe, spark.createDataFrame([(k,) for k in listed] + [("elsewhere",), (None,)], "key string"))
    assert len(levels) > 1
    got = {r["key"] for r in universe.filter("key IS NOT NULL").filter(url_cascade.is_listed(universe["key"], levels)).collect()}
    assert got == listed


def test_all_or_nothing_listed_and_no_pages(spark):
    universe = spark.createDataFrame([(f"k{i}",) for i in range(100)], "key string")
    assert url_cascade.build_cascade(universe, universe.limit(0)) == []
    levels = url_cascade.build_cascade(universe, universe)
    assert universe.filter(url_cascade.is_listed(universe["key"], levels)).count() == 100
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_cascade.filter_urls(pages, url_cascade.listed_hosts(pages)).count() == 0


def test_main_path_is_native(spark):
    pages = spark.createDataFrame([(0, URLS[6], "x")], "page_id long, url string, html string")
    plan = url_cascade.filter_urls(pages, url_cascade.listed_hosts(pages))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)
