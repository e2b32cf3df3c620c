"""The main text of web pages, by structure and by a suffix array over the pages of each host.

Structure proposes: what stands in an article or main element is a part of the main text, except menus, adverts, comments and the like within it;
a page without such an element has only open blocks. The suffix array decides on every page: the token streams of everything outside articles are
concatenated, suffixes are sorted by their first ``RUN`` tokens (prefix doubling), and a run of tokens that pages of ``MIN_PAGES`` different contents
of the host share is boilerplate. Runs go on from block to block of a page. A block of fewer tokens is also a run of its own, and so is every block
of a part, of any length. Covered tokens of open blocks are removed, unique runs are kept. A part whose blocks are all shared is boilerplate and gives
way to parts or unmarked blocks of the page that are not, if these have more words; other parts stay whole, as an article may quote. Pages
with the same words in the same order have one content, so an article is not boilerplate because its page was stored several times.

Each task builds the array of its pages; intervals of equal suffixes are then merged by host and tokens, so a very large host or a very
common run is at most ``MIN_PAGES`` rows of each array.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.joins import BROADCAST_BYTES, left_join
from pathloom.llm.reputation import url_host
from pathloom.llm.text import mix, plain, releasing, word_hashes
from pathloom.scale import broadcast_size, cut_lineage

RUN = 8
MIN_PAGES = 3
_TOKENS_AT_ONCE = 1 << 19

KEPT, OPEN, OUTSIDE = "kept", "open", "outside"
# The parts of a page are numbered from 1. Other blocks are of no part, or unmarked ones beside parts.
NO_PART, BESIDE = 0, -1

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noembed noframes iframe xmp".split())
DROPPED = frozenset(
    "head nav menu aside footer form button select noscript template svg math canvas audio video object dialog script style textarea "
    "title iframe noembed noframes".split())
# Words of a class, an id or a role that mark something other than the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login sidebar aside rail widget widgets menu nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager toc toolbar topbar header masthead footer copyright legal disclaimer comment comments "
    "disqus respond replies reply share sharing social related recommended recommendations search complementary contentinfo dialog "
    "form hidden".split())
MAIN = frozenset("article main".split())
# Elements that a start tag ends, by its name, and the elements it doesn't look beyond.
_TABLE = frozenset("table template object button".split())
_ITEMS = frozenset(
    "ul ol dl menu dir table caption tbody thead tfoot tr td th article aside blockquote button center details fieldset figcaption figure footer form "
    "header main nav object section select template body".split())
_P = (frozenset(["p"]), _TABLE | {"caption", "td", "th"})
_P_ENDS = (
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li main menu nav ol p pre search section summary table ul xmp").split()
ENDS: dict[str, list[tuple[frozenset, frozenset]]] = {name: [_P] for name in _P_ENDS}
ENDS["li"] = [(frozenset(["li"]), _ITEMS), _P]
ENDS["dt"] = ENDS["dd"] = [(frozenset(["dt", "dd"]), _ITEMS), _P]
ENDS["td"] = ENDS["th"] = [(frozenset(["td", "th"]), _TABLE | {"tr"})]
ENDS["tr"] = [(frozenset(["tr", "caption", "colgroup"]), _TABLE), (frozenset(["td", "th"]), _TABLE)]
ENDS["tbody"] = ENDS["thead"] = ENDS["tfoot"] = [(frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), _TABLE), *ENDS["tr"]]
ENDS["option"] = [(frozenset(["option"]), _ITEMS | {"optgroup", "datalist"})]
ENDS["optgroup"] = [(frozenset(["option", "optgroup"]), _ITEMS | {"datalist"})]
# How an element is left out: not at all, by a word or as a form, so that a main part in it counts nevertheless, or for good.
IN, MARKED, OUT = 0, 1, 2

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:_-]*+)(?P<attributes>(?:"[^"]*"|'[^']*'|[^<>"'])*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:_-]*+)(?P<attributes2>[^<>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORD = re.compile(r"[a-z]+")


def _marked(name: str, attributes: str) -> tuple[int, bool]:
    """How the attributes of an element mark it as no part of the article, and whether as its main part."""
    out, main = IN, False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id", "role"):
            if name not in ("html", "body") and not MARKS.isdisjoint(_NAME_WORD.findall(value)):
                out = max(out, MARKED)
            main |= key == "role" and value.strip() in ("main", "article")
        elif key == "itemprop":
            main |= value.strip() == "articlebody"
        elif key == "hidden" or key == "aria-hidden" and value.strip() == "true":
            out = OUT
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out = OUT
    return out, main


def blocks(page: str) -> list[tuple[str, str]]:
    """The blocks of a page in order as structure proposes them, each ``(kept, open or outside, text)``."""
    return [(kind, text) for kind, text, _ in candidates(page)]


def candidates(page: str) -> list[tuple[str, str, int]]:
    """The blocks of a page in order, each ``(kept, open or outside, text, part)``; character references decoded, white space one space.

    A page with an article or main part has no open blocks; each main element is a part, without those in it. A main part within a form, or within
    an element that a word marks, is proposed if no main part outside such elements has text. What is outside and has a part, or is ``BESIDE``
    parts, may take the place of what is proposed. Unclosed paragraphs, list items, table cells, rows and options end where HTML ends
    them, other unclosed elements with what encloses them.
    """
    found: list[tuple[str, str, int]] = []
    stack: list[tuple[str, int, str, int]] = []  # name, how it is left out, the kind of the main part it is within, its number
    texts: list[str] = []
    at, size, parts = 0, len(page), 0
    inner = "inner"  # the kind of blocks of main parts within marked elements

    def close_block() -> None:
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            texts.clear()
            if text:
                dropped, main, part = stack[-1][1:] if stack else (IN, "", NO_PART)
                found.append((OUTSIDE, text, NO_PART) if dropped else (main or OPEN, text, part))

    while at < size:
        tag = _TAG.search(page, at)
        if tag is None:
            texts.append(page[at:])
            break
        if tag.start() > at:
            texts.append(page[at:tag.start()])
        at = tag.end()
        name = tag["name"] or tag["name2"]
        if name is None:
            if tag[0].startswith("<![CDATA["):
                texts.append(tag[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        attributes = tag["attributes"] or tag["attributes2"] or ""
        if name == "br" or name == "hr":
            texts.append(" ")
        if tag["end"] or tag["end2"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is None:
                continue
            if name not in INLINE or stack[depth][1] != (stack[depth - 1][1] if depth else IN):
                close_block()
            del stack[depth:]
            continue
        for ended, beyond in ENDS.get(name, ()):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ended:
                    close_block()
                    del stack[depth:]
                    break
                if stack[depth][0] in beyond:
                    break
        dropped, main, part = stack[-1][1:] if stack else (IN, "", NO_PART)
        marked, is_main = _marked(name, attributes) if attributes else (IN, False)
        is_main = (is_main or name in MAIN) and not marked and dropped != OUT and not (dropped and main)
        if is_main:
            dropped, main = IN, main or (inner if dropped else KEPT)
        out = max(dropped, marked, MARKED if name == "form" else OUT if name in DROPPED or name == "header" and not main else IN)
        if name not in INLINE or out != (stack[-1][1] if stack else IN):
            close_block()
        if is_main:
            part = parts = parts + 1
        if name in VOID or attributes.rstrip().endswith("/") and name not in INLINE:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append((name, out, main, part))
    close_block()
    chosen = KEPT if any(kind == KEPT for kind, _, _ in found) else inner
    found = [(KEPT if kind == chosen else OUTSIDE if kind == inner else kind, text, part) for kind, text, part in found]
    if parts:
        found = [(OUTSIDE, text, BESIDE) if kind == OPEN else (kind, text, part) for kind, text, part in found]
    return found


Page = list[tuple[str, str, int]]


class SuffixArray:
    """Suffixes of a token sequence sorted by their first ``depth`` tokens (a power of two).

    ``tokens`` are 64-bit hashes; ``segment`` numbers the stretch of each token, and a suffix ends with its stretch.
    """

    def __init__(self, tokens: np.ndarray, segment: np.ndarray, depth: int = RUN):
        n = len(tokens)
        self.ranks = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
        self.hashes = mix(tokens)
        step = 1
        while step < depth:  # rank by twice as many tokens; 0 stands for the end of the stretch
            ranks, hashes = np.zeros(n, np.int64), np.zeros(n, np.uint64)
            whole = np.zeros(n, bool)
            if n > step:
                whole[:-step] = (segment[step:] == segment[:-step]) & (self.ranks[:-step] > 0) & (self.ranks[step:] > 0)
                pair = self.ranks[:-step] * (n + 2) + self.ranks[step:]
                ranks[:-step][whole[:-step]] = np.unique(pair[whole[:-step]], return_inverse=True)[1] + 1
                hashes[:-step] = mix(self.hashes[:-step] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[step:])
            self.ranks, self.hashes, step = ranks, hashes, 2 * step
        order = np.argsort(self.ranks, kind="stable")
        #: Starts of suffixes with at least ``depth`` tokens, in order; ``ranks`` are equal where ``depth`` tokens are.
        self.order = order[self.ranks[order] > 0]


def _stream(pages: list[Page], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, stretch and page number of all blocks outside articles; then first token, size and hash of each block shorter than ``run``.

    A stretch ends with its page and where an article begins.
    """
    texts, owner, stretch, number = [], [], [], 0
    for i, page in enumerate(pages):
        number += 1
        for kind, text, _ in page:
            if kind == KEPT:
                number += 1
                continue
            texts.append(text)
            owner.append(i)
            stretch.append(number)
    hashes, first = word_hashes(pa.array(texts, pa.string()))
    sizes = np.diff(first)
    short = np.flatnonzero(sizes < run)
    starts, lengths = first[:-1][short], sizes[short]
    whole = lengths.astype(np.uint64)
    for j in range(run - 1):
        more = lengths > j
        whole[more] = mix(whole[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[starts[more] + j])
    return hashes, np.repeat(np.array(stretch, np.int64), sizes), np.repeat(np.array(owner, np.int64), sizes), starts, lengths, mix(whole)


def _part_blocks(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Page number, part, tokens and hash of every block of a part."""
    texts, owner, parts = [], [], []
    for i, page in enumerate(pages):
        for _, text, part in page:
            if part > NO_PART:
                texts.append(text)
                owner.append(i)
                parts.append(part)
    hashes, first = word_hashes(pa.array(texts, pa.string()))
    sizes = np.diff(first)
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], sizes).astype(np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(mix(hashes + place * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64))
    # Not the hashes of runs outside articles, which are counted apart.
    whole = mix((sums[first[1:]] - sums[first[:-1]]) ^ np.uint64(0x5851F42D4C957F2D))
    return np.array(owner, np.int64), np.array(parts, np.int32), sizes.astype(np.int64), whole


def _content(page: Page) -> int:
    """The same for pages with the same words in the same order."""
    words = " ".join(text for _, text, _ in page).lower().encode()
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)


def _pages(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[Page]]]:
    for start in range(0, len(batch), 256):
        part = batch.slice(start, 256)
        yield part, [candidates(text) for text in plain(part.column("html")).to_pylist()]


_RUNS = "host long, run long, content long"


def _shared_runs(run: int, min_pages: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hosts, contents, size = [], [], [], 0

        def counted() -> pa.RecordBatch:
            tokens, segment, owner, whole_owner, whole_runs = (np.concatenate(x) for x in zip(*held))
            array = SuffixArray(tokens, segment, run)
            order = array.order
            # An interval of equal suffixes, by host; of each content one suffix counts, and more than ``min_pages`` tell nothing more.
            owners, runs = np.append(owner[order], whole_owner), np.append(array.hashes[order], whole_runs)
            host, content = np.array(hosts, np.int64)[owners], np.array(contents, np.int64)[owners]
            by = np.lexsort((content, runs, host))
            host, runs, content = host[by], runs[by], content[by]
            begins = np.append(True, (host[1:] != host[:-1]) | (runs[1:] != runs[:-1]))[:len(by)]
            new = begins | np.append(True, content[1:] != content[:-1])[:len(by)]
            host, runs, content, begins = host[new], runs[new], content[new], begins[new]
            starts = np.flatnonzero(begins)
            some = np.arange(len(begins)) - np.repeat(starts, np.diff(np.append(starts, len(begins)))) < min_pages
            return pa.RecordBatch.from_arrays(
                [pa.array(host[some]), pa.array(runs[some].view(np.int64)), pa.array(content[some])], names=["host", "run", "content"])

        segments = 0
        for batch in batches:
            for part, pages in _pages(batch):
                tokens, segment, owner, starts, _, short_runs = _stream(pages, run)
                block_owner, _, _, block_runs = _part_blocks(pages)
                held.append((tokens, segment + segments, owner + len(hosts), np.append(owner[starts], block_owner) + len(hosts), np.append(short_runs, block_runs)))
                segments += int(segment[-1]) + 1 if len(segment) else 0
                hosts += part.column("host").to_pylist()
                contents += map(_content, pages)
                size += len(tokens) + len(block_runs)
                if size > _TOKENS_AT_ONCE:
                    yield counted()
                    held, hosts, contents, size, segments = [], [], [], 0, 0
        if held:
            yield counted()

    return work


_PLACES = "page_key long, host long, run long, part int, place long, size long, words long, choices int"


def _runs_of_pages(run: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every run that may decide a page: those of pages with open or unmarked blocks with their place and size, as of no part, and the blocks of parts
        with their tokens. A row more for each part has its words, and how many parts, or unmarked blocks as one, the page has."""
        for batch in batches:
            for part, pages in _pages(batch):
                streamed = [page if any(kind == OPEN or number == BESIDE for kind, _, number in page) else [] for page in pages]
                tokens, segment, owner, starts, lengths, short_runs = _stream(streamed, run)
                array = SuffixArray(tokens, segment, run)
                order = np.sort(array.order)
                at, hashes = np.append(order, starts), np.append(array.hashes[order], short_runs)
                sizes = np.append(np.full(len(order), run), lengths)
                first = np.searchsorted(owner, np.arange(len(pages)))
                block_owner, block_part, block_sizes, block_runs = _part_blocks(pages)
                # Blocks of a part do not always stand together.
                by = np.lexsort((block_part, block_owner))
                new = np.append(True, (np.diff(block_owner[by]) != 0) | (np.diff(block_part[by]) != 0))[:len(by)]
                begins = np.flatnonzero(new)
                words = np.add.reduceat(block_sizes[by], begins) if len(begins) else np.empty(0, np.int64)
                part_owner, part_number = block_owner[by][new], block_part[by][new]
                choices = np.bincount(part_owner, minlength=len(pages)) + [any(number == BESIDE for *_, number in page) for page in pages]
                n, m, k = len(at), len(block_runs), len(words)
                owners = np.concatenate([owner[at], block_owner, part_owner])
                rows = part.take(pa.array(owners, pa.int64()))
                # The hash of a part's row is its own, so that these rows are spread.
                runs = np.concatenate([hashes, block_runs, mix(np.arange(k, dtype=np.uint64) ^ (block_runs[by][new]))]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_key"), rows.column("host"), pa.array(runs),
                     pa.array(np.concatenate([np.full(n, NO_PART), block_part, part_number]), pa.int32()),
                     pa.array(np.concatenate([at - first[owner[at]], np.zeros(m + k, np.int64)]), pa.int64()),
                     pa.array(np.concatenate([sizes, block_sizes, np.zeros(k, np.int64)]), pa.int64()),
                     pa.array(np.concatenate([np.zeros(n + m, np.int64), words]), pa.int64()),
                     pa.array(choices[owners], pa.int32())],
                    names=["page_key", "host", "run", "part", "place", "size", "words", "choices"])

    return work


def _uncovered(page: Page, places: list[dict], run_on: Callable[[str, int], bool]) -> list[str]:
    """The blocks of a page's stream that ``run_on`` takes, without the tokens that shared runs cover."""
    words = [(kind, number, text.split()) for kind, text, number in page if kind != KEPT]
    covered = np.zeros(sum(len(block) for *_, block in words), bool)
    for place in places:
        covered[place["place"]:place["place"] + place["size"]] = True
    lines, at = [], 0
    for kind, number, block in words:
        line = " ".join(w for w, gone in zip(block, covered[at:at + len(block)]) if not gone)
        at += len(block)
        if line and run_on(kind, number):
            lines.append(line)
    return lines


def decide(page: Page, shared_parts: set[int], places: list[dict], run: int = RUN) -> list[str]:
    """The blocks of a page's main text.

    ``shared_parts`` are those whose blocks are all shared; ``places`` are the shared runs of the tokens outside proposed parts, of pages with open
    or unmarked blocks. Shared parts give way to proposed ones that are not shared, or else to other parts, or else to what shared runs leave of
    unmarked blocks, if these have more words (of unmarked blocks also ``run`` at least); so no page loses its text to a short remark.
    """
    if any(kind == OPEN for kind, _, _ in page):
        return _uncovered(page, places, lambda kind, _: kind == OPEN)
    proposed = [(text, number) for kind, text, number in page if kind == KEPT]
    own = [text for text, number in proposed if number not in shared_parts]
    others = [text for kind, text, number in page if kind != KEPT and number > NO_PART and number not in shared_parts]

    def count(texts: list[str]) -> int:
        return sum(len(text.split()) for text in texts)

    common = [text for text, number in proposed if number in shared_parts]
    if own:
        return own if count(own) > count(common) else [text for text, _ in proposed]
    if count(others) > count(common):
        return others
    beside = _uncovered(page, places, lambda _, number: number == BESIDE)
    if count(beside) > max(count(common), run - 1):
        return beside
    return common


_TEXTS = "page_id long, url string, text string, n_chars long"


def _texts(run: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pages in _pages(batch):
                shared, places = part.column("shared_parts").to_pylist(), part.column("places").to_pylist()
                texts = ["\n".join(decide(page, set(a or ()), b or [], run)) for page, a, b in zip(pages, shared, places)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return work


def main_texts(pages: DataFrame, *, run: int = RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """The main text of each row of ``pages (page_id, url, html)``; other columns are ignored.

    Blocks are joined by a newline in page order. A null or empty html, and a page of nothing but boilerplate, give an empty text. Rows that repeat
    give a row each. Returns ``page_id, url, text, n_chars`` (code points). An empty table gives an empty one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    keyed = rows.withColumns({"host": F.xxhash64(url_host(F.col("url"))), "page_key": F.xxhash64("page_id", "url", "html")})
    # One shuffle for both counts; a task sends a run at most ``min_pages`` times for each of its arrays.
    contents = keyed.select("host", "html").mapInArrow(releasing(_shared_runs(run, min_pages)), _RUNS).repartition("host", "run").distinct()
    shared = cut_lineage(contents.groupBy("host", "run").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages).select("host", "run", F.lit(True).alias("hit")))
    if broadcast_size(shared, "run") <= BROADCAST_BYTES:
        shared = F.broadcast(shared)
    found = keyed.select("page_key", "host", "html").mapInArrow(releasing(_runs_of_pages(run)), _PLACES).join(shared, ["host", "run"], "left").filter("hit or words > 0")
    # Rows that repeat add the same to both sums.
    judged = found.groupBy("page_key", "part").agg(
        F.sum("size").alias("shared_words"), F.sum("words").alias("words"), F.max("choices").alias("choices"),
        F.collect_set(F.when(F.col("part") == NO_PART, F.struct("place", "size"))).alias("places"))
    # What changes a page: runs that cover its open or unmarked blocks, and wholly shared parts beside something else. No more than two runs for each word.
    changes = judged.filter((F.col("part") == NO_PART) | (F.col("shared_words") == F.col("words")) & (F.col("choices") > 1))
    by_page = cut_lineage(changes.groupBy("page_key").agg(
        F.collect_list(F.when(F.col("part") != NO_PART, F.col("part"))).alias("shared_parts"), F.flatten(F.collect_list("places")).alias("places")))
    return left_join(keyed, by_page, "page_key", 8 * F.size("shared_parts") + 32 * F.size("places")).select(
        "page_id", "url", "html", "shared_parts", "places").mapInArrow(releasing(_texts(run)), _TEXTS)
