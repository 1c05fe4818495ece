"""Host, path and rule of each url against plain string code; the trees' features and verdicts."""

import math
from collections import Counter

import pytest
from pyspark.sql import Row

from facetledger.llm import url_filter as op
from facetledger.llm.queries import QUERIES, URL_RULES

LOWER = str.maketrans(op.UPPER, op.LOWER)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    return host.translate(LOWER), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def rule_of(host, path):
    fits = []
    for r in URL_RULES:
        name, rest = r.pattern.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append(r)
    return max(fits, key=lambda r: len(r.pattern), default=None)


ODD = [
    None, "", "example.net/en/1", "http://", "https://EXAMPLE.net/en/x", "http://a.example.net/de/?q=://b.org/fr/", "http://net", "http://net/", "http://x.net?/", "http://notexample.com/de/1",
    "http://b.EXAMPLE.com/de/", "http://example.com/de", "http://x.org/fr/é?ü#://", "http://x.org\n/fr/", "a://b://c.net/d", "http://ÉX.net/a", "x" * 5000 + "://y.net/" + "z" * 5000, "http://org/fr/", "://a.b.net/",
]


def test_whole_tables(spark, small):
    rows = QUERIES["op5_url_filter"](spark, small).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path = split(urls[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.pattern)
        assert r.verdict == (rule.verdict if rule else "block" if r.block_probability >= 0.5 else "allow")
    assert {r.verdict for r in rows} == {"allow", "block"}


def test_odd_urls(spark):
    pages = spark.createDataFrame([Row(page_id=i, url=u, path="clash", extra=i) for i, u in enumerate(ODD)] * 2, "page_id long, url string, path string, extra long")
    rows = op.judge(pages, URL_RULES).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        rule = rule_of(*split(ODD[r.page_id]))
        assert (r.host, r.path, r.rule) == (*split(ODD[r.page_id]), rule and rule.pattern), ODD[r.page_id]
        assert r.extra == r.page_id and r.verdict in ("allow", "block")
        assert rule is None or r.verdict == rule.verdict


def test_nothing_or_one_verdict_to_learn(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in op.judge(pages, URL_RULES).collect()} == {"allow"}
    more = pages.unionByName(spark.createDataFrame([(3, "http://a.net/x")], "page_id long, url string"))
    assert {r.verdict for r in op.judge(more, URL_RULES).collect()} == {"block"}
    assert op.judge(pages.limit(0), URL_RULES).count() == 0


def test_features(spark):
    pages = spark.createDataFrame([(1, "http://a-b.c1.com/x/2?p=1&q=22#t"), (2, "http://z.com"), (3, "http://y.z.com/"), (4, "http://q.org/")], "page_id long, url string")
    rows = {r.page_id: r for r in op.with_features(op.split_url(pages)).collect()}
    a, url = rows[1], "http://a-b.c1.com/x/2?p=1&q=22#t"
    n = Counter(url)
    assert a.entropy == pytest.approx(-sum(k / len(url) * math.log2(k / len(url)) for k in n.values()))
    assert (a.url_length, a.host_depth, a.path_depth, a.hyphens, a.n_parameters, a.has_fragment, a.longest_label) == (len(url), 2, 2, 1, 2, 1, 3)
    assert a.digit_ratio == pytest.approx(5 / len(url)) and a.host_digit_ratio == pytest.approx(1 / 10)
    assert (a.suffix_share, a.domain_share, rows[2].domain_share) == (0.75, 0.25, 0.5)


def test_trees_learn_from_rules(spark):
    rows = [(i, f"http://site{i}.{'net' if i % 2 else 'org'}/fr/{'9' * 12 if i % 2 else 'abc'}{i}") for i in range(300)]
    rows += [(1000 + i, f"http://other{i}.com/{'9' * 12 if i % 2 else 'abc'}{i}") for i in range(40)]
    judged = op.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).where("rule is null").collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in judged) >= 36
