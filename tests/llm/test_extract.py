import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from corpusloom.llm.extract import N_EDGE, extract_pages, features, labelled_page, main_text, marginals, parse, tokens, train


@pytest.fixture(scope="module")
def weights():
    return train()


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    parent, kind = [-1, 0, 0, 1, 1, 2], np.array([0, 1, 2, 1, 3, 2])
    node, edge = rng.normal(size=6), rng.normal(size=(N_EDGE, 2, 2))
    total, on = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        p = np.exp(sum(node[i] * y[i] for i in range(6)) + sum(edge[kind[i], y[parent[i]], y[i]] for i in range(1, 6)))
        total += p
        on += p * np.array(y)
    got = 1 / (1 + np.exp(-marginals(parent, node, edge, kind)[0]))
    assert np.allclose(got, on / total)


def test_held_out_accuracy(weights):
    rng, right, total = random.Random(12345), 0, 0
    for _ in range(80):
        t = labelled_page(rng)
        x, kind = features(t)
        belief = marginals(t.parent, x @ weights[0], weights[1], kind)[0]
        for i, tag in enumerate(t.tag):
            if tag == "#text":
                total += 1
                right += (belief[i] > 0) == bool(t.label[i])
    assert right / total > 0.99


def plain_truth(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = extract_pages(pages).collect()
    assert len(rows) == pages.count()
    assert all(r["text"] == plain_truth(r["html"]) for r in rows)


def test_furniture(weights):
    page = """<body><header><h2>Site</h2></header><nav><ul><li><a href=/a>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</div>
    <main><h1>A title of some kind</h1><p>First &amp; foremost&nbsp;text, with a <a href=x>link</a> inside it.<p>Second paragraph that goes on for a while.
    <div class="ad"><p>Buy now</p></div><ul><li>one thing that counts<li>another thing</ul><script>var p = "</p>";</script></main>
    <section class="comments"><p>Nice article, thanks for it.</p></section><form><label>Mail</label><button>Go</button></form><footer>&copy; us</footer>"""
    assert main_text(page, weights).split("\n\n") == ["A title of some kind", "First & foremost text, with a link inside it.", "Second paragraph that goes on for a while.", "one thing that counts", "another thing"]


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!--", "<script>x", "</b></p>", "&am", "<a b='", "plain", "<div>" * 3000, "<p>" * 3000])
def test_odd_pages(page, weights):
    main_text(page, weights)


ARTICLE = "<h1>Title of this page</h1><p>Long first paragraph with some text in it.</p><p>Second paragraph of text follows here.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a href=x>Home</a></nav><article>{ARTICLE}</article><ul class='commentlist'><li>Great post, thank you so much for it<li>I do not agree with this at all</ul><footer>us</footer>",
        f"<div class='cookiebar'>We use cookies to make this site better for you. <a href=x>Accept</a></div><article>{ARTICLE}</article>",
        f"<article>{ARTICLE}</article><div id='sidebar'><div class='content'><p>About the author and other matters of this site</p></div></div>",
        f"<header><h2>The Site</h2></header><article>{ARTICLE.replace('<h1>', '<header><h1>').replace('</h1>', '</h1></header>')}</article>",
        f"<main><article>{ARTICLE}<footer>Posted in things</footer></article></main><section id=commentsList><h3>2 comments</h3><div class=comment><p>I do not agree with this at all</p></div></section>",
        f"<div id=mainMenu><ul><li><a href=x>Home</a></ul></div><div class=post>{ARTICLE}<div class=adbox><p>Buy two of these today</p></div></div><div class='sidebar-left'><p>More of our pages that you may like to read</p></div>",
    ],
)
def test_ordinary_pages(page, weights):
    assert main_text(f"<body>{page}</body>", weights).split("\n\n") == ["Title of this page", "Long first paragraph with some text in it.", "Second paragraph of text follows here."]


@pytest.mark.parametrize("part", ["<a b='", "<a b=\"x' ", "<", "<a b='x'", "<!--", "<p", "<a b=\"'>"])
def test_a_megabyte_of_broken_markup_takes_no_second(part, weights):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    list(tokens(page))
    assert time.process_time() - began < 1.5


def test_deep_and_unmatched_elements(weights):
    for page in ("<div>" * 20_000 + "</section>" * 20_000, "<b>" + "<x>" * 30_000 + "</b>" * 30_000):
        began = time.process_time()
        parse(page)
        assert time.process_time() - began < 3
    assert "inner text" in "".join(parse("<div>" * 3_000 + "inner text").text)


def test_parse_ends():
    t = parse("<p><b>x<p>y</p></div>z")
    assert [(t.tag[i], t.tag[t.parent[i]]) for i in range(1, len(t.tag))] == [("p", "#root"), ("b", "p"), ("#text", "b"), ("p", "#root"), ("#text", "p"), ("#text", "#root")]


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, None, "t"), (1, "", "t"), (None, "<article><p>" + "word " * 50_000, "t")], "page_id long, html string, text string")
    got = extract_pages(df, out_col="main").collect()
    assert [r["text"] for r in got] == ["t"] * 3 and got[0]["main"] == "" and len(got[2]["main"]) == 249_999
    assert extract_pages(df.limit(0)).count() == 0
