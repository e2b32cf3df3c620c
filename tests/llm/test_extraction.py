import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.llm import extraction, joins
from pathloom.llm.extraction import BESIDE, KEPT, OPEN, OUTSIDE, SuffixArray, blocks, candidates, decide, main_texts

from .conftest import words

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("html, kept", [
    ("<article><p>a &amp; b<p>c&#160;&eacute;</article>", ["a & b", "c é"]),
    ("<nav>x</nav><article><h1>T</h1> <p>one\n  two<br>three</p><aside>no</aside><p>f<i>o</i>o</p></article><footer>y</footer>", ["T", "one two three", "foo"]),
    ('<main><div class="cookie-notice"><p>no</p></div><div>yes</div><form>no<input></form></main>', ["yes"]),
    ('<article>a<script>var x = "</p><p>";</script><style>p{}</style><!-- <p>no</p> -->b</article>', ["a", "b"]),
    ('<article><p>keep</p><section id="comments"><article class="comment"><p>no</p></article></section></article>', ["keep"]),
    ('<div role="main">a</div><div>b</div>', ["a"]),
    ("<article><p>unclosed <b>bold<div>next</div>", ["unclosed bold", "next"]),
    ('<article><p hidden>no</p><p style="display: none">no</p><p title="a > b">x < y &lt; z</p></article>', ["x < y < z"]),
    ("<ARTICLE><P CLASS='Ad'>no</P><UL><LI>1<LI>2</UL></ARTICLE>", ["1", "2"]),
    ("<article></article>", []), ("", []), ("<<<>>> <article", []),
])
def test_blocks(html, kept):
    assert [text for kind, text in blocks(html) if kind == KEPT] == kept


@settings(deadline=None)
@given(st.text(st.sampled_from("<>/abp \"'=!-&;article"), max_size=80))
def test_any_text_is_parsed(html):
    for kind, text in blocks(html):
        assert text == " ".join(text.split()) != ""


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=20), max_size=8))
def test_suffix_array(blocks_):
    tokens = np.array([t for b in blocks_ for t in b], np.uint64)
    segment = np.repeat(np.arange(len(blocks_)), [len(b) for b in blocks_])
    array = SuffixArray(tokens, segment, 4)
    suffix = lambda i: tuple(tokens[i:i + 4].tolist())
    whole = [i for i in range(len(tokens) - 3) if segment[i] == segment[i + 3]]
    assert sorted(array.order.tolist()) == whole
    assert [suffix(i) for i in array.order] == sorted(suffix(i) for i in whole)
    for i in whole:
        for j in whole:
            assert (array.ranks[i] == array.ranks[j]) == (array.hashes[i] == array.hashes[j]) == (suffix(i) == suffix(j))


def brute_force(rows, run=8, min_pages=3):
    seen = {}
    for number, (host, html) in enumerate(rows):
        for kind, text in blocks(html):
            if kind != KEPT:
                w = text.lower().split()
                for i in range(len(w) - run + 1):
                    seen.setdefault((host, tuple(w[i:i + run])), set()).add(number)
    out = []
    for host, html in rows:
        lines = []
        found = blocks(html)
        for kind, text in found:
            w = text.split()
            covered = set()
            for i in range(len(w) - run + 1):
                if kind == OPEN and len(seen[host, tuple(x.lower() for x in w[i:i + run])]) >= min_pages:
                    covered.update(range(i, i + run))
            left = " ".join(x for i, x in enumerate(w) if i not in covered)
            if left and kind in (KEPT, OPEN):
                lines.append(left)
        out.append("\n".join(lines))
    return out


def test_shared_runs_of_a_host(spark):
    menu, legal = words(12, 1), words(30, 2)
    rows = [(f"h{i % 2}.net", f"<p>{menu if i % 2 else words(12, i + 50)}</p><div>{words(40, 100 + i)} {legal if i < 9 else ''} tail {i}</div>") for i in range(14)]
    rows += [("h0.net", f"<article><p>{legal}</p></article>"), ("h1.net", f"<article><p>{words(5, 7)}</p></article><footer>{menu}</footer>")]
    pages = spark.createDataFrame([(i, f"http://{h}/x", t) for i, (h, t) in enumerate(rows)], PAGES).repartition(5)
    found = {r.page_id: r.text for r in main_texts(pages).collect()}
    want = brute_force(rows)
    assert [found[i] for i in range(len(rows))] == want
    assert menu not in found[1] and legal in found[14]


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "http://a/", "<article>x</article>"), (2, "http://a/", ""), (2, "http://a/", ""), (3, "u", "<p>open</p>"), (4, "u", "just text"),
            (5, "u", "<article>" + "<p>word</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({n: F.lit(1) for n in ("host", "places", "text", "n_chars", "page_key")})
    found = sorted(((r.page_id, r.url, r.text[:9], r.n_chars) for r in main_texts(pages).collect()), key=repr)
    assert found == sorted([(1, None, "", 0), (None, "http://a/", "x", 1), (2, "http://a/", "", 0), (2, "http://a/", "", 0), (3, "u", "open", 4),
                            (4, "u", "just text", 9), (5, "u", "word\nword", 99_999)], key=repr)
    assert main_texts(spark.createDataFrame([], PAGES)).collect() == []


def texts_of(spark, rows):
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", t) for i, (h, t) in enumerate(rows)], PAGES).repartition(4)
    return {r.page_id: r.text for r in main_texts(pages).collect()}


def test_short_blocks_that_pages_of_a_host_share(spark):
    menu = "<ul><li>Home<li>About us<li>Contact</ul>"
    rows = [("a.net", f"{menu}<p>{words(30, i)}</p><p>Accept all cookies</p><td>{words(20, i + 50)}</td><div>All rights reserved</div>") for i in range(4)]
    rows += [("b.net", f"<p>{words(30, 9)}</p><p>Accept all cookies</p>")]
    # Too short to be a run on either side of a block's end.
    edge, next_ = words(5, 70), words(5, 71)
    rows += [("c.net", f"<p>{words(30, 80 + i)} {edge}</p><p>{next_} {words(30, 90 + i)}</p>") for i in range(3)]
    found = texts_of(spark, rows)
    for i in range(4):
        assert found[i] == f"{words(30, i)}\n{words(20, i + 50)}"
    assert found[4] == f"{words(30, 9)}\nAccept all cookies"
    for i in range(3):
        assert found[5 + i] == f"{words(30, 80 + i)}\n{words(30, 90 + i)}"


def test_copies_of_a_page_are_one_content(spark):
    notice = words(12, 3)
    page = f"<div>{words(40, 1)}</div><p>Short line</p>"
    rows = [("a.net", page)] * 6 + [("a.net", page.replace("div", "section").upper())] + [("b.net", f"<p>{notice}</p>{page}")] * 4
    rows += [("b.net", f"<p>{notice}</p><p>{words(30, i)}</p>") for i in range(2)]
    found = texts_of(spark, rows)
    whole = f"{words(40, 1)}\nShort line"
    assert [found[i] for i in range(11)] == [whole] * 6 + [whole.upper()] + [whole] * 4
    assert [found[11 + i] for i in range(2)] == [words(30, i) for i in range(2)]


@pytest.mark.parametrize("html, kept", [
    ('<div class="layout with-sidebar"><article><p>a</p><div class="ad">no</div><p>b</p></article></div><div>no</div>', ["a", "b"]),
    ('<div id="no-comments"><div><main>a<form>no</form></main></div></div>', ["a"]),
    ('<form action="/"><nav>no</nav><article>a</article><div itemprop="articleBody">b</div>no</form>', ["a", "b"]),
    ('<div class="with-sidebar"><div role="main"><article>a</article><section class="comments"><article>no</article></section></div></div>', ["a"]),
    ('<div class="with-sidebar"><article class="promo">no</article></div>', []),
    ('<div class="with-sidebar"><aside><article>no</article></aside><div hidden><main>no</main></div></div>', []),
    ('<article>a</article><div class="related"><article>no</article></div>', ["a"]),
    ('<main></main><div class="with-sidebar"><article>a</article></div>', ["a"]),
    ('<article><p class="ad">no<p>a<p class="ad">no<div>b</div><p class="ad">no<b>no<hr>c</article>', ["a", "b", "c"]),
    ('<article><ul><li class="promo">no<div>no</div><p>no<li>a<ul><li class="ad">no</ul>b</ul></article>', ["a", "b"]),
    ('<article><ul><li>a<ul class="share"><li>no</li></ul>b<li class="ad">no<ul><li>no</ul>no<li>c</ul></article>', ["a", "b", "c"]),
    ('<article><table><tr><td class="ad">no<p>no<td>a<th class="ad">no<tr><td>b<tr class="ad"><td>no<tbody><tr><td>c</table></article>', ["a", "b", "c"]),
    ('<article><table><tr><td class="ad">no<table><tr><td>no</table>no<td>a</table></article>', ["a"]),
    ('<article><dl><dt class="ad">no<dd>a<dd class="ad">no<dt>b</dl><datalist><option class="ad">no<option>c</datalist></article>', ["a", "b", "c"]),
])
def test_marked_wrappers_and_unclosed_elements(html, kept):
    assert [text for kind, text in blocks(html) if kind == KEPT] == kept
    assert {kind for kind, _ in blocks(html)} <= {KEPT, OUTSIDE} or not kept


@pytest.mark.parametrize("broadcast", [True, False])
def test_parts_that_pages_of_a_host_share_give_way(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(extraction, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    promo = f"<h2>Join us</h2><p>{words(20, 1)}</p>"
    rows = [("a.net", f"<article><p>{words(30, 10 + i)}</p></article><article>{promo}</article>") for i in range(3)] * 2
    # The same article on a host where fewer contents have it, and as the only part of a page, and longer than the other part.
    rows += [("b.net", rows[0][1])] * 4
    rows += [("a.net", f"<article>{promo}</article>"), ("a.net", f"<article>{promo}</article><article>{words(10, 20)}</article>")]
    # One shared paragraph is a quotation.
    rows += [("a.net", f"<article><p>{words(20, 1)}</p><p>{words(4, 21)}</p></article><article>{words(50, 22)}</article>")]
    found = texts_of(spark, rows)
    for i in range(6):
        assert found[i] == words(30, 10 + i % 3)
    whole = f"Join us\n{words(20, 1)}"
    assert [found[i] for i in range(6, 10)] == [f"{words(30, 10)}\n{whole}"] * 4
    assert found[10] == whole and found[11] == f"{whole}\n{words(10, 20)}"
    assert found[12] == f"{words(20, 1)}\n{words(4, 21)}\n{words(50, 22)}"


def test_what_stands_beside_a_shared_part(spark):
    notice = f"<main><p>{words(12, 1)}</p></main>"
    menu = f"<ul><li>Home<li>About us</ul><div>{words(15, 2)}</div>"
    rows = [("a.net", f"{menu}{notice}<div>{words(30, 10 + i)}</div>") for i in range(3)]
    rows += [("a.net", f"{menu}{notice}<div>{words(10, 20)}</div>"), ("a.net", f"{menu}{notice}"), ("a.net", f"{menu}<main></main><p>Too short</p>")]
    # A part within a marked element, and what tags leave out, which never counts.
    rows += [("a.net", f'{notice}<div class="with-sidebar"><article>{words(20, 30)}</article></div>'), ("a.net", f"{notice}<nav>{words(40, 31)}</nav>")]
    rows += [("b.net", f"{notice}<div>{words(30, 40)}</div>")]
    found = texts_of(spark, rows)
    assert [found[i] for i in range(3)] == [words(30, 10 + i) for i in range(3)]
    assert [found[3], found[4], found[5]] == [words(12, 1), words(12, 1), ""]
    assert [found[6], found[7], found[8]] == [words(20, 30), words(12, 1), words(12, 1)]


def test_candidates_and_their_choice():
    page = candidates('<p>x y</p><main>a<article>b c d</article>e</main><div class="ad">no<article>f</article></div>')
    assert page == [(OUTSIDE, "x y", BESIDE), (KEPT, "a", 1), (KEPT, "b c d", 2), (KEPT, "e", 1), (OUTSIDE, "no", 0), (OUTSIDE, "f", 3)]
    assert decide(page, set(), []) == decide(page, {1, 2}, []) == decide(page, {2}, []) == ["a", "b c d", "e"]
    assert decide(page, {1}, []) == ["b c d"]
    assert decide([(KEPT, "a", 1), (OUTSIDE, "f g", 2)], {1}, []) == ["f g"]
    assert decide([(KEPT, "a", 1), (OUTSIDE, "f g", 2)], {1, 2}, []) == ["a"]
    beside = [(OUTSIDE, words(9, 1), BESIDE), (KEPT, "a", 1)]
    assert decide(beside, {1}, []) == [words(9, 1)] and decide(beside, {1}, [{"place": 2, "size": 2}]) == ["a"]
