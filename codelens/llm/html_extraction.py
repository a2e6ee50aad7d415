"""Main-text extraction from web pages by consensus of a host's pages.

Two passes.  First every page scores its containers and votes for the one that
holds its article: the smallest with most of its text, widened to the article, main
or other container around it that has the rest (title, lead, notes).  The vote is under a generalised path (tags with their class words,
digits masked, of any depth; its digest is the key).  Spark adds up the votes per host and path.  Then
every page is extracted again with that of its own containers' paths that has most votes on its
host, widened in the same way; a page on which none occurs falls back to its own best container.  So a
page that is cut short, or has little text, is read where its host keeps articles.

Elements whose class, id or role names them as a menu, advert, comment and the like are
left out, but the host's vote stands above the names: where most pages of a host that have such an
element have no text outside it, it is read as any other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.llm.store import few, materialize

# Element classes of HTML.
BLOCK_TAGS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section
summary table tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "noscript", "template", "iframe", "svg", "object", "textarea", "select", "title")
# never part of an article, wherever they stand
SKIP_TAGS = frozenset("head nav footer aside form button menu dialog fieldset label canvas audio video map".split())
_LISTS = frozenset("ul ol dl".split())
CONTAINER_TAGS = frozenset("body article main section div td".split())
#: An open p is ended by the start of these, other elements by their own kind.
_SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                 "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table body article section div main aside nav header footer blockquote form".split())
#: Words of a class, id or role that mark what is not article text, where they stand alone or with words of place only
#: (``comment-list``, ``site-footer``; but not ``share-prices`` or ``related-work``).
SKIP_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist
cookie cookies consent copyright discussion disqus footer foot masthead menu menubar nav navbar navigation newsletter notice
notification popup modal overlay promo promotion promoted related recommended respond reply replies share sharing sidebar
sidebox social sponsor sponsored subscribe subscription toolbar widget widgets contentinfo complementary search skip skiplink
login signup pagination pager""".split())
PLACE_WORDS = frozenset("""area bar block body bottom box button buttons column container content fixed form global group head header
holder icons inner item items left link links list main module outer page panel placeholder posts primary region right row secondary
section site slot sticky thread top unit wrap wrapper zone""".split())
#: Pages of a host on which a named element must be all there is before the names are overruled.
MIN_ALONE = 3
#: Voted paths (of 100 bytes each) that are broadcast; more are joined.
MAX_VOTED = 100_000

_TOKEN = re.compile(
    # a self-closed svg has no end tag; the annotation of a formula repeats it in another notation and is not shown
    r"<!--.*?(?:-->|\Z)|<(?:svg|annotation(?:-xml)?)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<annotation(?:-xml)?(?=[\s>])[^>]*>.*?(?=</(?:annotation|semantics|math)|\Z)|<(?P<raw>" + "|".join(RAW_TAGS) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class _Node:
    __slots__ = ("tag", "path", "depth", "skip", "region", "first", "inside", "listed")

    def __init__(self, tag: str, path: str, depth: int, skip: bool, region: int, first: int, inside: bool, listed: int):
        self.tag, self.path, self.depth, self.skip = tag, path, depth, skip
        self.region, self.first, self.inside, self.listed = region, first, inside, listed


@dataclass
class _Container:
    """An element that may hold the article: the digest of its path, and its range of blocks."""
    path: str
    kind: str
    depth: int
    first: int
    end: int


def _marks(token: str) -> bool:
    """Whether a single name says that its element is no article text."""
    words = [w.lower() for w in _SPLIT.split(token) if w]
    return any(w in SKIP_WORDS for w in words) and all(w in SKIP_WORDS or w in PLACE_WORDS for w in words)


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """(generalised tag with classes, whether its names mark it as no article text)."""
    if not attrs:
        return tag, False
    classes, named = [], False
    for name, a, b, c in _ATTR.findall(attrs):
        tokens = (a or b or c).split()
        named = named or any(map(_marks, tokens))
        if name.lower() == "class":
            classes += [re.sub(r"\d+", "#", x.lower()) for x in tokens]
    return ".".join([tag, *sorted(set(classes))]), named


def _child(path: str, label: str) -> str:
    """Digest of a path one element longer."""
    return blake2b(f"{path}>{label}".encode(), digest_size=16).hexdigest()


def parse(page: str | None, released: frozenset = frozenset()) -> tuple[list[tuple[str, int, int]], list[_Container], list[tuple[str, int]]]:
    """(blocks, containers, regions) of a page: the text blocks outside everything that
    is skipped, with their link characters and the number of the outermost list that
    they stand in (0: in none, or in an article or main); for every container its path and
    range of blocks; and for every element that was skipped for its names its path and
    characters outside links.  Elements with a path in ``released`` are not skipped for their names.
    One pass over the tokens; markup that the page's end cuts off is dropped."""
    blocks: list[tuple[str, int, int]] = []
    containers: list[_Container] = []
    regions: list[list] = []
    stack: list[_Node] = [_Node("", "", 0, False, -1, 0, False, 0)]
    text: list[str] = []
    links = 0
    anchors = 0
    lists = 0

    def flush() -> None:
        nonlocal links
        if text:
            block = " ".join("".join(text).split())
            if block:
                blocks.append((block, links, 0 if stack[-1].inside else stack[-1].listed))
            text.clear()
        links = 0

    def close() -> None:
        nonlocal anchors
        node = stack[-1]
        if node.tag in BLOCK_TAGS:
            flush()
        stack.pop()
        if node.tag == "a":
            anchors -= 1
        elif node.tag in BLOCK_TAGS:
            if node.tag in CONTAINER_TAGS and not node.skip:
                containers.append(_Container(node.path, node.tag, node.depth, node.first, len(blocks)))

    for m in _TOKEN.finditer(page or ""):
        piece = m.group("text")
        if piece is not None:
            if not stack[-1].skip:
                piece = html.unescape(piece) if "&" in piece else piece
                text.append(piece)
                if anchors:
                    links += len(piece)
            elif stack[-1].region >= 0 and not anchors:
                regions[stack[-1].region][1] += len(piece.strip())
            continue
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("end"):
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if at:
                while len(stack) > at:
                    close()
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag == "br" or tag == "wbr":
            if not stack[-1].skip and tag == "br":
                text.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            ends = _SELF_CLOSING.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in ends:
                    while len(stack) > i:
                        close()
                    break
                if stack[i].tag in _SCOPE:
                    break
        if tag in VOID_TAGS:
            continue
        if m.group("attrs").endswith("/") and (tag == "math" or any(n.tag == "math" for n in stack)):
            continue
        top = stack[-1]
        label, named = _label(tag, m.group("attrs"))
        inside = top.inside or tag in ("article", "main")
        path = _child(top.path, label) if tag in BLOCK_TAGS else top.path
        # names count on blocks only: a marked word in a paragraph is part of it
        named = named and tag in BLOCK_TAGS and tag not in ("html", "body", "main") and path not in released
        plain = tag in SKIP_TAGS or (tag == "header" and not inside)
        region = -1 if plain else top.region
        if named and not plain and not top.skip:
            region = len(regions)
            regions.append([path, 0])
        skip = top.skip or plain or named
        if skip and not top.skip:
            flush()
        if tag == "a":
            anchors += 1
        if tag in _LISTS and not top.listed:
            lists += 1
        stack.append(_Node(tag, path, top.depth + 1, skip, region, len(blocks), inside, top.listed or (lists if tag in _LISTS else 0)))
    while len(stack) > 1:
        close()
    flush()
    return blocks, containers, [(p, n) for p, n in regions]


def _score(block: tuple[str, int, int]) -> int:
    """Characters that are not in links; a block that is mostly links counts nothing."""
    text, links, _list = block
    return 0 if 2 * links > len(text) else len(text) - links


def _sums(blocks: list) -> list[int]:
    sums = [0]
    for b in blocks:
        sums.append(sums[-1] + _score(b))
    return sums


def _widener(blocks: list, containers: list, sums: list[int]) -> Callable[[int], int]:
    """For a container that holds most of an article, the one that holds all of it.

    That is the outermost article or main around it, where there is one.  Else the
    smallest one around it with all the text that any container below body has;
    and body itself if it adds text that stands in no container of its own."""
    chars = [sums[c.end] - sums[c.first] for c in containers]
    parent, open_ = [-1] * len(containers), []
    for i in range(len(containers) - 1, -1, -1):               # outer ones are closed later
        while open_ and containers[open_[-1]].first > containers[i].first:
            open_.pop()
        parent[i] = open_[-1] if open_ else -1
        open_.append(i)
    edges = [0] * (len(blocks) + 1)
    for c in containers:
        if c.kind != "body":
            edges[c.first] += 1
            edges[c.end] -= 1
    own = any(depth == 0 and sums[i + 1] > sums[i] for i, depth in zip(range(len(blocks)), accumulate(edges)))

    def widen(at: int) -> int:
        best, body, i = at, -1, at
        named = -1
        while i >= 0 and containers[at].first < containers[at].end:
            if containers[i].kind in ("article", "main"):
                named = i
            elif containers[i].kind == "body":
                body = i
            elif chars[i] > chars[best]:
                best = i
            i = parent[i]
        if named >= 0:
            return named
        return body if body >= 0 and own and chars[body] > chars[best] else best

    return widen


def best_container(blocks: list, containers: list[_Container]) -> tuple[_Container, int] | None:
    """The container with the page's article, and its score.  It is the
    smallest one with at least 80 % of the page's text, or the one around it that
    holds what else belongs to the article (``_widener``)."""
    sums = _sums(blocks)
    if not sums[-1]:
        return None
    good = [i for i, c in enumerate(containers) if 10 * (sums[c.end] - sums[c.first]) >= 8 * sums[-1]]
    if not good:
        return None
    best = min(good, key=lambda i: (containers[i].end - containers[i].first, -containers[i].depth))
    found = containers[_widener(blocks, containers, sums)(best)]
    return found, sums[found.end] - sums[found.first]


def _menus(blocks: list) -> set[int]:
    """Numbers of the lists outside articles of which every block is mostly links."""
    found = {n for _text, _links, n in blocks if n}
    return found - {n for text, links, n in blocks if 2 * links <= len(text)}


def _range(container: _Container) -> tuple[int, int, bool]:
    """(first, end, whether it is an article's container, not the body)."""
    return container.first, container.end, container.kind != "body"


def extract(page: str | None, rank: Callable[[str], tuple | None] = lambda path: None, released: frozenset = frozenset()) -> str:
    """Text of the containers under that path of the page which ``rank`` puts highest
    (None: no vote; several containers under it follow each other, nested ones count once), else of the
    page's own best container.  All text of an article container is kept, lists of
    links too.  Where a page has none but body, or no container at all, lists outside articles
    that are links throughout are menus and left out."""
    blocks, containers, _regions = parse(page, released)
    found: list[tuple[int, int, bool]] = []
    voted = {c.path: r for c in containers if (r := rank(c.path)) is not None}
    if voted:
        path = max(voted, key=lambda p: (voted[p], p))
        widen = _widener(blocks, containers, _sums(blocks))
        found = [_range(containers[widen(i)]) for i, c in enumerate(containers) if c.path == path]
    if not found:
        best = best_container(blocks, containers)
        found = [_range(best[0])] if best else [(0, len(blocks), False)]
    out: list[str] = []
    done = 0
    menus = _menus(blocks)
    for a, b, article in sorted(set(found)):
        out += [t for t, _links, n in blocks[max(a, done):b] if article or n not in menus]
        done = max(done, b)
    return "\n\n".join(out)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; '' for anything else and for null."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _host_key(url: Column) -> Column:
    return F.md5(host_of(url))


_VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("region", pa.bool_()), ("chars", pa.int64()), ("alone", pa.int64())])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            blocks, containers, regions = parse(page.as_py())
            best = best_container(blocks, containers)
            if best:
                rows.append((host, best[0].path, False, best[1], 0))
            # a named element is alone where nothing stands outside it and no other has more text
            most = max(regions, key=lambda r: r[1], default=None)
            rows += [(host, path, True, 0, int(not blocks and (path, n) == most and n > 0)) for path, n in set(regions)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _VOTES)], schema=_VOTES)


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, region, votes, chars): by digest of the host, the paths that its pages
    voted for as article (region false), with the text under them, and those of named elements that are
    to be read nevertheless (region true).

    Votes are added up before and after the shuffle, so a host with a third of
    all pages is no hot spot; every path that got a vote is kept."""
    votes = (pages.select(_host_key(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, region boolean, chars long, alone long")
             .groupBy("host", "path", "region").agg(F.count(F.lit(1)).alias("votes"), F.sum("chars").alias("chars"), F.sum("alone").alias("alone")))
    return votes.where(~F.col("region") | ((F.col("alone") >= MIN_ALONE) & (2 * F.col("alone") > F.col("votes")))).drop("alone")


def _paths_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) -> the page's digest and every path on it, of containers and named elements."""
    for batch in batches:
        rows = {}
        for key, host, page in zip(batch.column("key").to_pylist(), batch.column("host").to_pylist(), batch.column("html")):
            if key not in rows:
                _blocks, containers, regions = parse(page.as_py())
                rows[key] = {(key, host, p, False) for p in {c.path for c in containers}} | {(key, host, p, True) for p, _n in regions}
        flat = [r for x in rows.values() for r in x]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else [[]] * 4, (pa.string(), pa.string(), pa.string(), pa.bool_()))],
                                         ["key", "host", "path", "region"])


def extract_pages(pages: DataFrame, max_voted: int = MAX_VOTED) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty page has the text ''.  Repeated rows are extracted alike; a
    null or odd URL belongs to the host ''; other columns are not read; an empty
    table gives an empty result.  Up to ``max_voted`` paths are broadcast; more are joined to
    the paths that each page has itself, with the same result.
    """
    votes = materialize(host_votes(pages))
    rows = pages.select("page_id", "url", "html", _host_key(F.col("url")).alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def told(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                           pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if few(votes, max_voted):
        by_host: dict[str, tuple[dict, set]] = {}
        for r in votes.toLocalIterator():
            ranks, released = by_host.setdefault(r["host"], ({}, set()))
            if r["region"]:
                released.add(r["path"])
            else:
                ranks[r["path"]] = (r["votes"], r["chars"])
        shared = pages.sparkSession.sparkContext.broadcast({h: (ranks, frozenset(x)) for h, (ranks, x) in by_host.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = (shared.value.get(h, ({}, frozenset())) for h in batch.column("host").to_pylist())
                yield told(batch, [extract(page.as_py(), ranks.get, released) for page, (ranks, released) in zip(batch.column("html"), known)])

        return rows.mapInArrow(run, schema)

    rows = rows.withColumn("key", F.sha2(F.concat_ws(" ", "host", F.coalesce("html", F.lit(""))), 256))
    own = rows.select("key", "host", "html").mapInArrow(_paths_on, "key string, host string, path string, region boolean").distinct()
    met = own.join(votes, ["host", "path", "region"])
    best = met.groupBy("key").agg(
        F.max(F.when(~F.col("region"), F.struct("votes", "chars", "path")))["path"].alias("best"),
        F.collect_set(F.when(F.col("region"), F.col("path"))).alias("released"))
    joined = rows.join(best.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), lambda p, path=path: (0,) if p == path else None, frozenset(released or ()))
                     for page, path, released in zip(batch.column("html"), batch.column("best").to_pylist(), batch.column("released").to_pylist())]
            yield told(batch, texts)

    return joined.select("page_id", "url", "html", "best", "released").mapInArrow(read, schema)
