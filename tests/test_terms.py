import re
from urllib.parse import urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom import explode_terms, python_sorter, split_url, split_urls
from tests.plans import explained

GOLDEN = [
    ("https://shop.kite.org", ["shop"]),
    ("http://de.shop-2.kite.org", ["de", "shop-2"]),
    ("http://de.shop-2.kite.org/", ["de", "shop-2"]),
    ("http://kite.org/", []),
    ("https://shop.kite.org/?lang=fr", ["shop", "?", "lang", "fr"]),
    ("https://shop.kite.org/red/big-kites/7", ["shop", "red", "big", "kites", "7"]),
    ("https://shop.kite.org/red/big-kites/7?sort", ["shop", "red", "big", "kites", "7", "?", "sort"]),
    ("https://shop.kite.org/red/big-kites/7?sort=price&page=3&all", ["shop", "red", "big", "kites", "7", "?", "sort", "price", "page", "3", "all"]),
    ("https://shop.kite.org/red?sort=price&all&page=3", ["shop", "red", "?", "sort", "price", "all", "page", "3"]),
]

EDGES = [
    ("www.example.com/a/b", ["www.example.com", "a", "b"]),
    ("http://u:p@a.b.example.com:8080/x", ["u:p@a", "b", "x"]),
    ("http://10.0.0.1/x", ["10", "0", "x"]),
    ("http://a.b.c.co.uk/x", ["a", "b", "c", "x"]),
    ("http://a.example.com/x;p=1/y;q=2?z=3", ["a", "x;p=1", "y", "?", "z", "3"]),
    ("foo://a.b.c/x;p", ["a", "x;p"]),
    ("HTTP://a.b.c/x;p;q", ["a", "x"]),
    ("x;p", ["x"]),
    ("http://a.example.com/x y+z--w#frag?q=1", ["a", "x", "y", "z", "w"]),
    ("http://a.example.com/?", ["a"]),
    ("http://a.example.com/?&=&", ["a"]),
    ("http://a.example.com/?u=http://z.com/a-b", ["a", "?", "u", "http://z.com/a-b"]),
    ("http://a.example.com/x?y?z=1", ["a", "x", "?", "y?z", "1"]),
    ("  http://a.example.com/x", ["a", "x"]),
    ("\x01\thttp://a.exa\nmple.com/x\r\ny\t", ["a", "xy"]),
    ("http://a.example.com/x ", ["a", "x "]),
    ("http://a.example.com/x;p\u0085", ["a", "x"]),
    ("//a.b.c/x", ["a", "x"]),
    ("http:/a/b", ["a", "b"]),
    ("mailto:me@a.b.c", ["me@a.b.c"]),
    ("http://[a", []),
    ("http://..a.b.c//x", ["a", "x"]),
    ("http://bücher.beispiel.example.de/ä-ö?ü=ß", ["bücher", "beispiel", "ä", "ö", "?", "ü", "ß"]),
    ("", []),
    (None, None),
]


def terms_of(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "id long, url string")
    return [r.split_url for r in split_urls(df).orderBy("id").collect()]


def test_golden_urls(spark):
    assert terms_of(spark, [url for url, _ in GOLDEN]) == [terms for _, terms in GOLDEN]


def test_edge_urls(spark):
    assert terms_of(spark, [url for url, _ in EDGES]) == [terms for _, terms in EDGES]


def by_standard_library(url):
    parts = urlparse(url)
    host = parts.netloc.split(".")
    pieces = host[: max(len(host) - 2, 0)] + re.split("[-/ +]", parts.path)
    named = [piece for piece in re.split("[&=]", parts.query) if piece]
    return [piece for piece in pieces if piece] + (["?", *named] if named else [])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abZ09.:/?#&=;-+ @%|<_\t\nä", max_size=40), min_size=40, max_size=80),
       st.sampled_from(["", "http://", "https://a.b.c", "foo:", "//"]))
def test_agrees_with_the_standard_library(spark, tails, head):
    urls, expected = [], []
    for tail in tails:
        try:
            expected.append(by_standard_library(head + tail))
            urls.append(head + tail)
        except ValueError:
            continue
    assert terms_of(spark, urls) == expected


@pytest.mark.parametrize(
    "sorter, expected",
    [(F.array_sort, ["?", "b", "q", "v", "x"]), (F.reverse, ["v", "q", "?", "b", "x"]),
     (python_sorter(lambda terms: sorted(terms, reverse=True)), ["x", "v", "q", "b", "?"])],
)
def test_term_sorter(spark, sorter, expected):
    df = spark.createDataFrame([(1, "http://x.example.com/b?q=v"), (2, None)], "id long, url string")
    rows = split_urls(df, sorter).orderBy("id").collect()
    assert [r.split_url for r in rows] == [expected, None]


def test_explode_keeps_positions_and_drops_empty(spark):
    df = spark.createDataFrame([(1, "http://a.example.com/b/a"), (2, "http://example.com")], "id long, url string")
    rows = explode_terms(split_urls(df)).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(1, "http://a.example.com/b/a", p, w) for p, w in enumerate("aba")]


def test_splitting_is_pure_projection(spark):
    plan = spark.range(1).select(split_url(F.lit("http://a.b.c/d").alias("url")))
    text = explained(plan)
    assert "Exchange" not in text and "Python" not in text


def test_splitting_works_on_a_stream(spark, tmp_path):
    urls = spark.createDataFrame([(1, "http://a.example.com/b")], "id long, url string")
    urls.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(urls.schema).parquet(str(tmp_path / "in"))
    query = (
        split_urls(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().split_url == ["a", "b"]
