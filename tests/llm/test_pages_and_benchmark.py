"""HTML extraction and benchmark decontamination."""

import html
import re

import brute
import numpy as np
import pytest

from codelens.llm import decontamination as D
from codelens.llm import html_extraction as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="<p>no</p>";</script></head>
<body class="home page-12"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="cookie-notice">We use cookies</div>
<div class="layout col-%d"><div class='post entry'><h2>Title &amp; more</h2><p>First   para%s with <b>bold<br>and</b>
<a href=x>link</a>.<p>Second &lt;tag&gt; &#233; &eacute; para that goes on for a while.
<div class="share">Share this</div><ul><li>one item of text</li><li>two items of text</li></ul>
<!-- <p>hidden</p> --><form><p>Your mail</p><input name=a></form><table><tr><td>cell a<td>cell b</table></div>
<div class="sidebar"><p>Side text that is long enough to count as text, twice over, and again.</p></div>
<div class="comments"><p>A reader writes a long comment here that is no article text at all.</p></div></div>
<footer>Foot &copy;</footer></body></html>"""
TEXT = ["Title & more", "First para{} with bold and link.", "Second <tag> é é para that goes on for a while.",
        "one item of text", "two items of text", "cell a", "cell b"]


def extract(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r for r in H.extract_pages(df).collect()}


def test_article_without_boilerplate(spark):
    rows = [(i, f"https://User@Example.com:80/p/{i}", PAGE % (i, i)) for i in range(6)]
    # cut off in the middle, and inside a tag
    cut = PAGE % (9, 9)
    rows += [(10, "http://example.com/", cut[:cut.index("Second")]), (11, "http://example.com/", cut[:cut.index("<b>bold") + 2]),
             (12, "http://example.com/x", None), (13, None, ""), (14, "no url", "just text &amp"), (14, "no url", "just text &amp"),
             (15, "http://example.com/", "<body><nav>menu</nav>")]
    out = extract(spark, rows)
    for i in range(6):
        assert out[i]["text"] == "\n\n".join(TEXT).format(i)
        assert out[i]["n_chars"] == len(out[i]["text"])
    assert out[10]["text"] == "Title & more\n\nFirst para9 with bold and link."
    assert out[11]["text"] == "Title & more\n\nFirst para9 with"
    assert out[12]["text"] == out[13]["text"] == out[15]["text"] == ""
    assert out[14]["text"] == "just text &"


def test_host_consensus_beats_the_single_page(spark):
    """A page whose article is shorter than something else is read where its host keeps articles."""
    article = "<body><div class=story><p>{}</p></div><div class=extra><p>{}</p></div></body>"
    rows = [(i, "http://h.org/", article.format("long story text " * 20, "x")) for i in range(8)]
    rows.append((8, "http://h.org/", article.format("short.", "something else that is much longer than the story " * 9)))
    assert extract(spark, rows)[8]["text"] == "short."


@pytest.mark.parametrize("frame", ["<body><article>{}</article></body>", "<body><main><section>{}</section></main></body>",
                                   "<body><div id=wrap><div class=post>{}</div></div></body>", "<body>{}</body>"])
def test_articles_in_parts(spark, frame):
    """Title, lead and notes belong to the article though one container holds most of its text."""
    parts = "<h1>Title</h1><div class=lead><p>{}</p></div><div class=body><p>{}</p><p>{}</p></div><div class=notes><p>{}</p></div>"
    texts = [["lead " * 20, "body text " * 60, "more text " * 50, "note " * 9], ["a lead as long as the text", "short", "text", "n"]]
    rows = [(i, "http://h.org/", frame.format(parts.format(*texts[0]))) for i in range(6)]
    rows.append((6, "http://h.org/", frame.format(parts.format(*texts[1]))))
    rows += [(i, "http://h.org/", frame.format("<div class=body><p>only the body</p></div>")) for i in range(7, 20)]
    out = extract(spark, rows)
    for i, want in [(0, texts[0]), (5, texts[0]), (6, texts[1]), (9, None)]:
        assert out[i]["text"] == ("\n\n".join(["Title", *(" ".join(x.split()) for x in want)]) if want else "only the body")


def test_links_formulas_and_drawings_in_articles(spark):
    story = "<p>" + "story text " * 30 + "</p>"
    told = ("story text " * 30).strip()
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul>"
    mixed = "<ul><li><a href=/>Book</a></li><li>a note without link</li></ul>"
    pages = {
        "<article>" + story + "<h2>Sources</h2>" + menu + "<p>end</p></article>": [told, "Sources", "Home", "About", "end"],
        "<div class=post>" + story + menu + "</div>": [told, "Home", "About"],
        menu + story: [told],
        mixed + story: ["Book", "a note without link", told],
        "<article>" + menu + "</article>" + story: ["Home", "About", told],
        "<article><p>one<svg viewBox='0 0 > 1' /> two</p><p>three</p><svg><text>no</text></svg>four</article>": ["one two", "three", "four"],
        "<article><svg/><p>one</p></article>": ["one"],
        "<article><p>so <math><mi>a</mi><mspace width='1'/><mo>=</mo><mn>2</mn></math> holds</p><math/><p>b</p></article>": ["so a=2 holds", "b"],
        "<article><p>so <math><semantics><mi>a</mi><annotation encoding=x>\\alpha</annotation></semantics></math> holds</p></article>":
            ["so a holds"],
    }
    rows = [(i, f"http://h{i}.org/", f"<body>{page}</body>") for i, page in enumerate(pages)]
    out = extract(spark, rows)
    assert [out[i]["text"].split("\n\n") for i in range(len(rows))] == list(pages.values())


STORY = "story text " * 30


def texts_of(spark, pages, **more):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in H.extract_pages(df, **more).orderBy("page_id").collect()]


def test_names_of_single_tokens_only(spark):
    pages = {
        "<main><article><p>%s</p></article><article class=comment><p>reader says</p></article></main>": STORY.strip(),
        "<div class=share-prices><p>%s</p></div>": STORY.strip(),
        "<article><p>%s</p><section class=related-work><p>work</p></section></article>": STORY.strip() + "\n\nwork",
        "<article><p>a <span class=search-term>term</span> and <code class=ad>code</code> %s</p></article>": "a term and code " + STORY.strip(),
        "<article><p>%s</p><div class='comment-list'>no</div><div id=siteFooter>no</div><p class=ad>no</p></article>": STORY.strip(),
    }
    assert texts_of(spark, [(f"http://h{i}.org/", p % STORY) for i, p in enumerate(pages)]) == list(pages.values())


def test_the_host_overrules_a_name(spark):
    """Where a named element is all that most pages of a host have, it is the article; elsewhere it stays out."""
    only = "<body><div class=discussion><p>%s</p></div></body>"
    pages = [("http://a.org/", only % f"talk {i}") for i in range(4)] + [("http://b.org/", only % "cut off before the article")]
    pages += [("http://c.org/", "<body><div class=ad>buy</div><article><p>%s</p></article></body>" % STORY)] * 4
    pages += [("http://c.org/", "<body><div class=ad>buy")] * 3
    for more in ({}, {"max_voted": 0}):
        assert texts_of(spark, pages, **more) == [f"talk {i}" for i in range(4)] + [""] + [STORY.strip()] * 4 + [""] * 3


@pytest.mark.parametrize("max_voted", [H.MAX_VOTED, 0])
def test_many_templates_and_deep_paths(spark, max_voted):
    """Every template of a host has its own consensus, however many there are and however deep they lie."""
    names = [chr(97 + i // 10) + chr(97 + i % 10) for i in range(30)]
    page = "<body><div class=t%s>" + "<div>" * 40 + "<p>{}</p>" + "</div>" * 40 + "</div><div class=e%s>" + "<div>" * 40 + "<p>{}</p></div></body>"
    pages = [("http://h.org/", (page % (n, n)).format(STORY, "x")) for n in names for _ in range(3)]
    pages += [("http://h.org/", (page % (n, n)).format("short.", "much longer than the story " * 9)) for n in names]
    assert texts_of(spark, pages, max_voted=max_voted) == [STORY.strip()] * 90 + ["short."] * 30


def test_pages_with_clashing_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "http://h.org/", "<p>a</p>", "x", "y", 1, "p"), (None, None, None, None, None, None, None)],
                               "page_id long, url string, html string, host string, path string, votes long, best string")
    for n in (H.MAX_VOTED, 0):
        assert sorted((r.page_id is None, r.text) for r in H.extract_pages(df, max_voted=n).collect()) == [(False, "a"), (True, "")]


def test_hosts(spark):
    urls = {"https://A.b/c": "a.b", "http://u:p@x.org:8080/": "x.org", "//y.z?q": "y.z", "mailto:a": "", "": "", None: ""}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0]: r[1] for r in df.select("url", H.host_of(df.url)).collect()} == urls


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.collect()
    out = {r["page_id"]: r["text"] for r in H.extract_pages(pages).collect()}
    assert len(out) == len(rows)
    for r in rows:
        body = r["html"].partition("<article>")[2].partition("</article>")[0]
        body = re.sub(r"<[^>]*$", "", body)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x.replace("<b>", ""))).split()) for x in re.split("</?p>|</?h1>", body)]
        assert out[r["page_id"]] == "\n\n".join(p for p in parts if p)


def test_empty_pages(spark):
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def items():
    r = np.random.default_rng(9)
    return [(i, " ".join(f"b{x}" for x in r.integers(0, 3000, int(r.integers(12, 60))))) for i in range(30)] + [
        (30, "tiny item"), (31, ""), (32, None), (33, "five words of an item"), (34, "b1 b1 b1 b1 b1 b1 b1 b1 b1 b1")]


def planted(found):
    r = np.random.default_rng(8)
    noise = lambda n: " ".join(f"n{x}" for x in r.integers(0, 900, n))
    docs = [(0, None), (1, ""), (2, noise(50)), (3, "It is a Tiny, item."), (3, "It is a Tiny, item.")]
    for i, text in found:
        w = (text or "").split()
        docs.append((100 + i, noise(40) + " " + " ".join(w).upper() + "! " + noise(15)))      # whole
        if len(w) > 30:
            x = list(w)
            x[len(x) // 2] = "changed"
            docs.append((200 + i, noise(10) + " " + ", ".join(x)))                            # one word differs
            docs.append((300 + i, " ".join(w[2:])))                                           # shorter than the item
            docs.append((400 + i, noise(30) + " " + " ".join(w[:len(w) // 2]) + " " + noise(30)))  # half of it
    return docs


def test_leaks_against_brute_force(spark):
    found, docs = items(), planted(items())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(found, "item_id long, text string")
    want = brute.leaks(docs, found)
    got = D.find_leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want)
    assert all(r["similarity"] == pytest.approx(want[(r["doc_id"], r["item_id"])]) for r in got)
    assert len(got) == len(want) + 1       # the repeated row
    small_blocks = D.find_leaks(df, bench, block_items=4).collect()
    assert sorted(map(tuple, small_blocks)) == sorted(map(tuple, got))
    clean = D.without_leaks(df, bench, block_items=11)
    assert clean.columns == df.columns
    assert sorted(r[0] for r in clean.collect()) == sorted(d for d, _t in docs if d not in {k[0] for k in want})


def test_leaks_in_the_tables(spark, small_docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = lambda df: [(r[0], r[1]) for r in df.collect()]
    want = brute.leaks(rows(small_docs.select("doc_id", "text")), rows(bench))
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(small_docs, bench).collect()} == set(want)


def test_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    assert D.find_leaks(no_docs, bench).count() == 0
    assert D.find_leaks(odd_docs, bench.limit(0)).count() == 0
    clean = D.without_leaks(odd_docs, bench)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()


def test_multi_index_misses_nothing():
    r = np.random.default_rng(6)
    a = r.integers(0, 256, (300, 16)).astype(np.uint8)
    b = a.copy()
    for row in b:
        for bit in r.choice(128, int(r.integers(0, 60)), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    distance = D._POPCOUNT[a ^ b].sum(axis=1)
    candidate = (D._POPCOUNT[a ^ b] <= D.RADIUS // D.BLOCKS).any(axis=1)
    assert candidate[distance <= D.RADIUS].all()


def hard_leaks():
    """Items with masked runs, repeated shingles and windows at similarity 0.75 to 0.8, and documents that hold them."""
    r = np.random.default_rng(5)
    found, docs = [], []
    for i in range(9):
        n = int(r.integers(9, 150))
        w = [f"c{x}" for x in r.integers(0, 5000, n)]
        if i % 3 == 1:
            w[n // 2:n // 2 + n // 4] = [w[0]] * (n // 4)                        # a run of one word
        if i % 3 == 2:
            w = (w[:7] * n)[:n]                                                  # the same seven words over and over
        found.append((i, " ".join(w)))
        noise = [f"n{x}" for x in r.integers(0, 900, 40)]
        docs.append((10 * i, " ".join(noise + w[:n - n // 7] + ["mask"] * (n // 7) + noise)))
        for j in range(1, 7):
            x = list(w)
            for at in r.choice(n, max(1, n * j // 120), replace=False):
                x[at] = "other"
            docs.append((10 * i + j, " ".join(noise[:j] + x + noise)))
        docs.append((10 * i + 7, " ".join(w[:n - n // 7])))
    for i, (n, masked) in enumerate(((74, 10), (144, 20))):
        w = [f"m{i}x{x}" for x in range(n)]
        docs.append((1000 + i, " ".join(w[:n - masked] + ["mask"] * masked)))
        found.append((100 + i, " ".join(w[:n - masked] + ["mask"] * masked)))
        found.append((200 + i, " ".join(w)))
    return found, docs


@pytest.mark.parametrize("threshold", [0.75, 0.5])
def test_leaks_at_the_threshold_and_with_repeated_shingles(spark, threshold):
    """Every pair that reaches the threshold is found, however many bits its fingerprints differ in."""
    found, docs = hard_leaks()
    want = brute.leaks(docs, found, threshold)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(found, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in D.find_leaks(df, bench, threshold).collect()}
    assert set(got) == set(want)
    assert all(got[k]["similarity"] == pytest.approx(want[k]) for k in want)
    assert any(r["distance"] > D.RADIUS for r in got.values())
    clean = {r["doc_id"] for r in D.without_leaks(df, bench, threshold).collect()}
    assert clean == {d for d, _t in docs} - {d for d, _i in want}
