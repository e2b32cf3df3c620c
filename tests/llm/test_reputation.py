import pytest
from pyspark.sql import functions as F

from pathloom.llm import reputation
from pathloom.llm.queries import URL_RULES

URLS = "page_id long, url string"


@pytest.mark.parametrize("url, host, path", [
    ("http://A.Example.COM/x/Y?q=1#f", "a.example.com", "/x/Y"), ("https://a.b", "a.b", ""), ("https://a.b?x=/y", "a.b", ""), ("https://a.b#/z", "a.b", ""),
    ("nothing", "", ""), ("", "", ""), (None, "", ""), ("x://y/z://w/v", "y", "/z://w/v"), ("://", "", ""), ("http://é.Ü/\nz", "é.Ü", "/\nz"),
])
def test_parts(spark, url, host, path):
    row = spark.createDataFrame([(1, url)], URLS).select(
        reputation.url_host(F.col("url")).alias("h"), reputation.url_path(F.col("url")).alias("p")).first()
    assert (row.h, row.p) == (host, path)


def expected_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules(spark):
    urls = ["http://org/", "http://x.org", "http://notorg/", "http://example.org/es/1", "http://a.example.org/en/123", "http://badexample.org/en/1", "http://b.com/de/x",
            "http://b.com/fr/", "http://b.com/en/", "http://com/de/", None, "zz"]
    pages = spark.createDataFrame(list(enumerate(urls)), URLS).withColumns({"host": F.lit(1), "rule": F.lit(2), "by_rule": F.lit(3)})
    found = reputation.judge_urls(pages, URL_RULES).collect()
    assert len(found) == len(urls)
    for row in found:
        rule, verdict = expected_rule(row.host, row.path)
        assert row.rule == rule and row.verdict in ("allow", "block") and (verdict is None or row.verdict == verdict)


def test_shrinkage(spark):
    """Few bad outcomes on a new host weigh little, many weigh much, and a new host takes the rate of its domain."""
    rows = [(f"h{i}.good.net", j % 50 == 0) for i in range(20) for j in range(50)] + [(f"h{i}.bad.net", j % 10 != 0) for i in range(20) for j in range(50)]
    rows += [("one.good.net", True), ("two.bad.net", None), ("three.good.net", None), ("other.org", None)] + [("many.good.net", True)] * 300
    outcomes = spark.createDataFrame(rows, "host string, bad boolean")
    found = {r.host: r for r in reputation.host_reputation(outcomes).collect()}
    assert found["three.good.net"].posterior_rate < found["one.good.net"].posterior_rate < 0.9 < found["many.good.net"].posterior_rate
    assert found["two.bad.net"].posterior_rate > 0.6 and found["h1.bad.net"].posterior_rate > 0.8
    assert all(r.posterior_rate <= r.posterior_bound <= 1 for r in found.values())


def test_empty(spark):
    assert reputation.judge_urls(spark.createDataFrame([], URLS), URL_RULES).collect() == []
