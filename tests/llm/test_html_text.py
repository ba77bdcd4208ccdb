import random
import re
import time
from collections import Counter
from html import unescape

import pyarrow.parquet as pq
import pytest

from tidemark.llm.html_text import LABELLED, deciding, extract, features, main_text, op8_html_text, tree

ART = "<article><h1>The title</h1><p>One &amp; <b>two</b>\n three.<p>Four&nbsp;five<br>six</article>"
WANT = "The title One & two three. Four five six"


def test_the_tree_learns_its_table():
    assert sum(tree().says(features(r[:-1])) != r[-1] for r in LABELLED) == 0


@pytest.mark.parametrize("page", [
    ART,
    f"<nav><a href=/>Home</a></nav>{ART}<footer>c 2020 all rights</footer>",
    f"<header><h1>Site name and its long slogan of many words</h1></header>{ART}<aside><p>{'side ' * 60}</p></aside>",
    f"<form><p>{'please sign up now ' * 9}<input></p></form>{ART}<div class='comments'><article class=comment><p>{'I think so too. ' * 20}</article></div>",
    f"<div id=cookie-notice>{'We use cookies. ' * 20}</div><div class='ad'>Buy this</div>{ART}",
    f"<div class=\"page has-sidebar\">{ART}</div><ul class=menu><li>a<li>b</ul>",
    f"<script>var t='<p>';if(a<b)x();</script><style>p>a{{}}</style>{ART}<!-- <p>no --><noscript>Turn it on</noscript>",
    f"<nav><ul><li>unclosed{ART}",
    f"<ARTICLE CLASS='x'>{ART[9:]}<FOOTER>no</FOOTER>",
    f"<body class=sidebar>{ART.replace('<p>', '<p title=\"a > b\">')}</body>",
    ART.replace("</article>", "<aside>Read more</aside><div class='share-buttons'>Share</div><section id=comments><p>Great article, " + "thanks " * 30 + "</section></article>"),
    ART.replace("<h1>The title</h1>", "<div class='post-header'><h1>The title</h1></div>"),
    ART.replace("<h1>The title</h1>", "<header><h1>The title</h1></header>").replace("</article>", "<div class=responses>First!</div></article>"),
    f"<div class='site-header'>Our site has the best news of all</div><div class=rail><ins class=adsbygoogle>Buy</ins>{'more news ' * 40}</div>{ART}",
    f"<main><div class=notice>Site closed</div>{ART}</main>",
    f"<div style='display: none'>{'hidden ' * 50}</div>{ART}<div hidden>more</div>",
])
def test_pages(page):
    assert main_text(page) == WANT


def test_pages_without_markup_for_the_main_part():
    long = "word " * 40
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><h2>A heading of five words</h2><p>{long}</p><p>{long}</p><div><a href=3>Next page</a></div>"
    assert main_text(page) == f"A heading of five words {long}{long}".strip()


def test_odd_pages(spark):
    odd = [None, "", "   ", "<", "a < b & c", "<p", "<article>x <y", "<script>never closed <p>x", "<!-- open", "</p></div>", "&#0;&#xZ;", "<article>" + "<b " * 20_000, "<article>" + "<p>é" * 50_000]
    for t in odd:
        assert isinstance(main_text(t), str)
    pages = spark.createDataFrame([(k, None if k % 2 else "u", t, k) for k, t in enumerate(odd)] + [(None, "u", ART, 1), (None, "u", ART, 1)], "page_id long, url string, html string, text int")
    got = extract(pages).collect()
    assert len(got) == len(odd) + 2 and sum(r.text == WANT for r in got) == 2 and all(r.n_chars == len(r.text) for r in got)
    assert extract(pages.where("false")).collect() == []


def test_whole_table_against_the_articles(spark):
    """In the driver's pages the main text is what stands in <article>."""
    sf = "/root/testdata/sf0.1"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op8_html_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", lambda m: "" if re.match(r"</?(b|i|a|em|strong|span)\b", m[0]) else " ", article)).split())
        assert r.text == want and r.n_chars == len(want)


def test_pages_whose_names_mislead():
    long, more = "word " * 60, "other " * 45
    for name in ("legal-analysis", "emergency-response", "share-prices", "side-effects"):
        assert main_text(f"<article><h1>Title</h1><p>{long}</p><div class={name}><p>{more}</p><p>{more}</p></div></article>").split() == f"Title {long}{more}{more}".split()
    assert main_text(f"<div class=content><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div><p>{long}</p>") == long.strip()
    assert main_text(f"<div class=content><h1>Title of it</h1><p>{long}</p><p>{more}</p></div><div class=content><p>Buy two and get one of them free today</p></div>") == f"Title of it {long}{more}".strip()


def test_layouts_without_names():
    """Pages put together at random from a menu, a slogan, a text and a closing line, in elements that say nothing."""
    pick = random.Random(4)
    words = lambda mark, n: " ".join(f"{mark}{pick.randrange(99)}" for _ in range(n))
    right = wrong = 0
    for _ in range(300):
        item = pick.choice(["<li>{}</li>", "<div>{}</div>", "<td>{}</td>"])
        menu = "".join(item.format(f"<a href=x>{words('m', pick.randrange(1, 4))}</a>") for _ in range(pick.randrange(3, 9)))
        body = [words("t", pick.choice([pick.randrange(20, 60), pick.randrange(60, 250), pick.randrange(12, 40)])) for _ in range(pick.randrange(3, 9))]
        page = f"<div>{menu}</div><div>{words('m', pick.randrange(3, 9))}</div><div><h1>{words('t', pick.randrange(3, 11))}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><div>{words('m', pick.randrange(2, 7))}<a href=y>{words('m', 2)}</a></div>"
        want = Counter(w for w in re.sub("<[^>]*>", " ", page).split() if w[0] == "t")
        got = Counter(main_text(page).split())
        right += sum((want & got).values())
        wrong += sum((want - got).values()) + sum((got - want).values())
    assert wrong < 0.01 * right


def test_driver_pages_without_their_names(spark):
    """The driver's pages with article, nav, footer and class turned into plain div: words, density and kind still tell."""
    extra = missing = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", r.html).replace(' class="ad"', "")
        want, got = Counter(main_text(r.html).split()), Counter(main_text(plain).split())
        total, missing, extra = total + sum(want.values()), missing + sum((want - got).values()), extra + sum((got - want).values())
    assert missing < 0.01 * total and extra < 0.03 * total


def test_text_features_decide():
    said = Counter()
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        said += deciding(r["html"])
    assert all(said[f] > said["blocks"] / 4 for f in ("words", "density", "words before", "density after", "kind"))


@pytest.mark.parametrize("page", [
    "<div>" * 120_000 + "</p>" * 120_000, "<" + "a" * 1_000_000, "<" + "aaaa " * 200_000, '<a b="x>x"' * 100_000, "<script>" + "</script " * 110_000, "<div " + "a" * 1_000_000 + ">x",
    "<p><div>" * 100_000 + "</p>" * 100_000, "<!-- " * 200_000, "</" * 500_000, "<div class='" + "a-" * 500_000 + "'>x", "<li>" * 250_000,
])
def test_long_odd_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 2
