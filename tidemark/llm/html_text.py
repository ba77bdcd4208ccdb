"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat row of text blocks in page order. A block has its number of words, its link density, both of the
blocks before and after it, the kind of element it stands in, and three numbers for what the markup around it hints at: how
far names and elements put it beside the main text, how far they put it within, and how large the part it belongs to is
beside the page's largest. A decision tree tells text from boilerplate. It is grown here from a small labelled table: the
blocks of the pages in PAGES, which are written out below with their main text marked.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, tidy

# Element and class names of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split())
CLOSES_SAME = frozenset("p li dt dd tr td th option".split())
SIDE_TAGS = frozenset("nav form button select menu search fieldset".split())
DEEP_TAGS = frozenset("aside footer noscript template svg dialog".split())
SIDE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle adslot adbox banner sponsor sponsored promo promotion sidebar side sidenav rail menu nav navbar topnav subnav navigation breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices disclaimer announcement alert popup modal overlay newsletter subscribe subscription signup login search share sharing social widget pagination pager copyright legal".split())
DEEP_NAMES = frozenset("comment comments disqus respond response responses reply replies discussion reactions related recommended recommendations".split())
PLAIN_NAMES = frozenset("area bar block box button buttons container form left links list main page post posts right section site thread top widget wrap wrapper".split())
MAIN_NAMES = frozenset("article post entry story content main text".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
KINDS = {**dict.fromkeys("li dt dd option".split(), 1), **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 2), **dict.fromkeys("p blockquote pre figcaption".split(), 3)}  # other elements: 0

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)\b")

# The labelled pages. {+n}: n words of main text; {n}: n words beside it; with @, the words are a link.
PAGES = [
    # a site with HTML 5 elements
    "<header><h1>{3}</h1><nav><ul><li>{@1}<li>{@1}<li>{@2}<li>{@1}</ul></nav></header><article><h1>{+8}</h1><p>{+60}<p>{+35}<p>{+2}<p>{+110}</article><footer><p>{12}<p>{@2} {@1} {@2}</footer>",
    "<nav><ul><li>{@1}<li>{@1}<li>{@1}<li>{@1}</ul></nav><div class=ad>{9}</div><article><h1>{+11}</h1><p>{+1}<p>{+180}<p>{+4}</article><footer>{11}</footer>",
    "<nav>{@1} {@1} {@2}</nav><main><h1>{+5}</h1><p>{+25}<ul><li>{+4}<li>{+9}<li>{+@3} {+2}</ul><p>{+14}</main><aside><h2>{2}</h2><p>{40}<p>{70}</aside><footer>{8}</footer>",
    "<article><h1>{+3}</h1><p>{+9}<ul><li>{+@4}<li>{+@3}<li>{+@5}</ul><h2>{+2}</h2><p>{+45}</article><aside><ul><li>{@3}<li>{@4}</ul></aside><footer>{@2} {@2} {3}</footer>",
    "<form><p>{30}<p>{5}</form><article><h1>{+2}</h1><p>{+3}<p>{+3}</article><section class=comments><article class=comment><p>{80}</article><article class=comment><p>{25}</article></section>",
    "<article><header><h1>{+4}</h1><p>{+6}</header><p>{+50}<aside>{30}</aside><p>{+70}<div class=share-buttons>{2}</div><section id=comments><h3>{1}</h3><p>{35}<p>{6}</section></article>",
    "<div id=cookie-notice>{45}</div><div class=banner>{4}</div><main><div class=notice>{6}</div><article><h1>{+6}</h1><p>{+30}<p>{+8}<table><tr><td>{+1}<td>{+2}<tr><td>{+3}<td>{+1}</table></article></main>",
    "<div style='display:none'>{60}</div><article><p>{+20}<p>{+5}</article><div hidden>{3}</div><div class=newsletter><p>{18}<p>{2}</div>",
    "<article><h1>{+2}</h1><div class=legal-analysis><p>{+40}<p>{+30}</div><div class=emergency-response><p>{+55}<p>{+22}</div><div class=legal><p>{28}</div></article><footer><p>{16}</footer>",
    "<article><h1>{+6}</h1><div class=nav-theory><p>{+33}</div><p>{+12}<div class=side-effects><p>{+60}<p>{+17}</div><div class=comments-policy>{3}</div><div class=ad-slot>{5}</div><div class=related><h3>{2}</h3><ul><li>{@5}<li>{@6}</ul></div></article>",
    "<article><h2>{+1}</h2>{+30}<p>{+1}<blockquote>{+15}</blockquote>{+2}</article><div class=widget><p>{20}</div>",
    "<header><p>{24}</header><article><div class=post-header><h1>{+7}</h1></div><p>{+44}<div class=responses><p>{14}<p>{3}</div></article><div class=rail><p>{55}<ins>{1}</ins></div>",
    # parts with class names, menus within them and adverts that call themselves content
    "<div class=top>{@1} {@1} {@1}</div><div class=content><h1>{+5}</h1><p>{+65}<p>{+40}<p>{+3}<p>{+90}</div><div class=sidebar><p>{30}<ul><li>{@2}<li>{@3}</ul></div><div class=footer>{9}</div>",
    "<div class=content>{@1} {@1} {@1}</div><p>{+120}<p>{+80}",
    "<div class=content><ul><li>{@1}<li>{@1}<li>{@1}</ul></div><h1>{+4}</h1><p>{+75}<p>{+60}<div>{@2}</div>",
    "<div class=content><h1>{+4}</h1><p>{+90}<p>{+45}<p>{+30}</div><div class=content><p>{11}</div><div>{7}</div>",
    "<div class=content><p>{9}<p>{5}</div><div class=content><h2>{+6}</h2><p>{+55}<p>{+70}<ul><li>{+8}<li>{+6}</ul></div>",
    "<div class=story><h1>{+9}</h1><p>{+28}<p>{+7}<p>{+33}<p>{@2} {@2}</div><div class=links>{@3} {@2} {@4}</div><div>{10}</div>",
    "<div id=main><div class=entry><h2>{+7}</h2><p>{+50}<pre>{+20}</pre><p>{+16}</div><div class=tags>{@1} {@1} {@1}</div></div><div id=legal>{50}</div>",
    "<table><tr><td class=menu>{@1} {@2} {@1}<td class=text><p>{+48}<p>{+52}<p>{+4}<td>{@3}</table><p>{6}",
    # no names at all
    "<div>{@1} {@1}</div><h2>{+5}</h2><p>{+40}<p>{+40}<div>{@2}</div>",
    "<ul><li>{@1}<li>{@1}<li>{@2}</ul><h1>{+6}</h1><p>{+70}<p>{+25}<p>{+110}<p>{+9}<p>{+35}<hr><div>{7}</div><div>{@1} {@1}</div>",
    "<div><div>{3}</div><div>{@1} {@1} {@1} {@1}</div></div><div><h1>{+7}</h1><p>{+45}<p>{+2}<p>{+60}<p>{+1}<p>{+38}</div><div>{10}</div>",
    "<div>{8}</div><div><h1>{+10}</h1><p>{+150}<p>{+1}<p>{+12}<p>{+6}<p>{+90}</div><div>{12}</div>",
    "<ul><li>{@1}<li>{@1}<li>{@1}<li>{@1}<li>{@1}</ul><div>{9}</div><div><h1>{+9}</h1><p>{+1}<p>{+35}<p>{+3}<p>{+210}</div><div>{13}</div>",
    "<ul><li>{@1}<li>{@1}<li>{@1}</ul><div>{6}</div><div><h1>{+12}</h1><p>{+20}<p>{+14}<p>{+2}</div><div>{9}</div>",
    "<table><tr><td>{@1}<td>{@1}<td>{@1}</table><table><tr><td>{+90}<tr><td>{+60}</table><table><tr><td>{5}<td>{@2}</table>",
    "<div>{4}</div><div>{@2} {@1}</div><div>{+80}</div><div>{+45}</div><div>{+120}</div><div>{6}</div>",
    "<center>{@2} {@2} {@2}</center><h1>{+3}</h1><p>{+22}<p>{+31}<blockquote>{+18}</blockquote><p>{+27}<center>{5}</center><center>{@1} {@1}</center>",
    "<ul><li>{@2}<li>{@3}<li>{@2}</ul><h2>{+4}</h2><p>{+60}<ul><li>{+7}<li>{+12}<li>{+5}</ul><p>{+40}<h3>{2}</h3><ul><li>{@6}<li>{@7}<li>{@5}</ul>",
    "<p>{@1} {@1} {@1}<p>{+55}<p>{+35} {+@3}<p>{+20} {+@2} {+30}<p>{@2} {@2}<div>{4}</div>",
    "<h1>{+5}</h1><p>{+30}<p>{+6}<p>{+48}<h2>{+3}</h2><p>{+26}<h3>{3}</h3><ul><li>{@4}<li>{@8}</ul>",
    "<div>{@1}</div><div>{@1}</div><div>{@2}</div><p>{+18}<p>{+100}<p>{+5}<p>{+64}<div>{3} {@1}</div>",
    "<p>{+34}", "<h1>{+4}</h1><p>{+11}", "<div>{+40}</div>", "{+12}", "<p>{+3}", "<div>{@2} {@2}</div>", "<ul><li>{@1}<li>{@2}</ul>", "<article>{+1}</article>", "<article><p>{+@2}</article>",
]


def written_out(page: str) -> str:
    """A page of PAGES with its words: `text` is main text, `side` is beside it."""

    def words(m: re.Match) -> str:
        said = " ".join(["text" if m[1] else "side"] * int(m[3]))
        return f"<a href=x>{said}</a>" if m[2] else said

    return re.sub(r"\{(\+?)(@?)(\d+)\}", words, page)


class Node:
    def __init__(self, value: int, feature: int = -1, at: float = 0.0, low: Node | None = None, high: Node | None = None):
        self.value, self.feature, self.at, self.low, self.high = value, feature, at, low, high

    def path(self, row: tuple) -> list[Node]:
        """The nodes that the row meets; the last is a leaf."""
        met = [self]
        while met[-1].low is not None:
            met.append(met[-1].low if row[met[-1].feature] <= met[-1].at else met[-1].high)
        return met

    def says(self, row: tuple) -> int:
        node = self
        while node.low is not None:
            node = node.low if row[node.feature] <= node.at else node.high
        return node.value


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Node:
    """Splits with the least weighted impurity, at the middle between two values; ties go to the first feature."""
    value = int(2 * y.sum() >= len(y))
    if depth == 0 or y.min() == y.max():
        return Node(value)
    best = (np.inf, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= at
            cost = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if cost < best[0] - 1e-12:
                best = (cost, f, float(at))
    if best[1] < 0:
        return Node(value)
    low = x[:, best[1]] <= best[2]
    return Node(value, best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "kind", "beside", "within", "share")


def features(row: tuple) -> tuple:
    """A block's numbers as the tree takes them, in the order of FEATURES: counts of words beyond 400 are alike."""
    return (min(row[0], 400), row[1], min(row[2], 400), row[3], min(row[4], 400), *row[5:])


class Element:
    """An open element. beside: 0, 0.5 (some of a name says so), 1 (an element or a whole name), 2 (nothing within counts
    as main again); within: 0, 1 (a name), 2 (an element); group: the main part it belongs to, 0 for the rest of the page."""

    __slots__ = ("tag", "kind", "beside", "within", "group")

    def __init__(self, tag: str = "", kind: int = 0, beside: float = 0, within: int = 0, group: int = 0):
        self.tag, self.kind, self.beside, self.within, self.group = tag, kind, beside, within, group


def named_beside(word: str, within: int) -> float:
    """How far one class name or id puts an element beside the main text."""
    parts = {p for p in re.split(r"[-_:]+", word) if p}
    if within and "header" in parts:
        parts.discard("header")  # the head of an article holds its title
    if {"has", "with", "no", "without"} & parts:
        return 0
    told = parts & (SIDE_NAMES | DEEP_NAMES)
    if not told:
        return 0
    if parts - told - PLAIN_NAMES:
        return 0.5
    return 2 if parts & DEEP_NAMES else 1


def element(tag: str, attributes: str, around: Element, groups: int) -> Element:
    """The element within what is around it; a new main part gets the number `groups`."""
    kind = KINDS.get(tag, around.kind if around.kind >= 2 and tag not in ("div", "section", "td", "table", "ul", "ol") else 0)
    beside, role, main_name = 0.0, "", False
    if attributes:
        for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if hidden or name.lower() == "style" and re.search(r"display\s*:\s*none", value):
                return Element(tag, kind, 2, around.within, around.group)
            if name.lower() in ("class", "id") and tag not in ("html", "body", "main"):
                for word in value.split():
                    beside = max(beside, named_beside(word, around.within))
                    main_name = main_name or bool(MAIN_NAMES & set(re.split(r"[-_:]+", word)))
            elif name.lower() == "role":
                role = value
    if around.beside == 2 or tag in DEEP_TAGS or (beside == 2 and tag != "main" and role != "main"):
        return Element(tag, kind, 2, around.within, around.group)
    if tag == "main" or role == "main" or (tag == "article" and beside < 1):
        return Element(tag, kind, 0, 2, around.group if around.within and around.beside < 1 else groups)
    if tag in SIDE_TAGS or role in SIDE_ROLES or tag == "article" or (tag == "header" and not around.within):
        beside = 1
    beside = max(beside, around.beside)
    if main_name and beside < 0.5 and tag in ("div", "section", "td"):
        return Element(tag, kind, 0, max(1, around.within), around.group if around.within else groups)
    return Element(tag, kind, beside, around.within, around.group)


def blocks(page: str) -> list[tuple[str, int, float, Element]]:
    """(text, words, link density, element) of each block with words, in page order. Time grows with the page's length."""
    out: list[tuple[str, int, float, Element]] = []
    stack = [Element()]
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked: list[str] = []
    links = groups = 0

    def end() -> None:
        nonlocal links
        if held:
            words = "".join(held).split()
            if words:
                in_links = len("".join(linked).split())
                out.append((" ".join(words), len(words), min(1.0, in_links / len(words)), stack[-1]))
            held.clear()
            linked.clear()
        links = 0

    def text(raw: str) -> None:
        t = entities.unescape(raw) if "&" in raw else raw
        held.append(t)
        if links:
            linked.append(t)

    at, n = 0, len(page)
    quoted = True  # until a tag does not end outside quotes
    while at < n:
        k = page.find("<", at)
        if k < 0:
            text(page[at:])
            break
        after = page[k + 1 : k + 2]
        name = page[k + 2 : k + 3] if after == "/" else after
        if after not in ("!", "?", "/") and not (name.isascii() and name.isalpha()):
            text(page[at : k + 1])  # a sign in the text
            at = k + 1
            continue
        if k > at:
            text(page[at:k])
        if not (name.isascii() and name.isalpha()):
            if page.startswith("<!--", k):
                m = COMMENT_END.search(page, k + 4)
                at = m.end() if m else n
            else:
                close = page.find("]]>", k) + 2 if page.startswith("<![CDATA[", k) else page.find(">", k)
                at = close + 1 if close > 1 else n
            continue
        m = TAG.match(page, k) if quoted else None
        if m:
            at, closing, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
        else:
            quoted = False
            close = page.find(">", k)
            if close < 0:
                break
            at, closing = close + 1, after == "/"
            inside = page[k + 1 + bool(closing) : close]
            tag = re.match(r"[^\s/]*", inside)[0].lower()
            attributes = inside[len(tag) :]
        if closing:
            if tag == "a":
                links = max(0, links - 1)
                if linked:
                    linked.append(" ")
            elif tag in BLOCK:
                end()
                if opened[tag]:  # an end tag that ends nothing is not looked for
                    while (gone := stack.pop()).tag != tag:
                        opened[gone.tag] -= 1
                    opened[tag] -= 1
            continue
        if tag in RAW:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if tag != "title" or not (stack[-1].within and stack[-1].beside < 1):
                held.append(" ")
            close = page.find(">", m.end()) if m else -1
            at = close + 1 if close >= 0 else n
        elif tag == "br":
            held.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK:
            end()
            if stack[-1].tag == "p":
                opened[stack.pop().tag] -= 1
            if stack[-1].tag == tag and tag in CLOSES_SAME:
                opened[stack.pop().tag] -= 1
            if tag not in VOID:
                new = element(tag, attributes, stack[-1], groups + 1)
                groups = max(groups, new.group)
                stack.append(new)
                opened[tag] += 1
    end()
    return out


def rows_of(found: list[tuple[str, int, float, Element]]) -> list[tuple]:
    """The numbers of each block of a page, in the order of FEATURES."""
    plain: Counter[int] = Counter()
    for _, n, density, e in found:
        if e.beside < 1:
            plain[e.group] += n - round(n * density)
    largest = max(plain.values(), default=0)
    none = (0, 0.0)
    numbers = [(n, d) for _, n, d, _ in found]
    return [(*numbers[k], *(numbers[k - 1] if k else none), *(numbers[k + 1] if k + 1 < len(found) else none), e.kind, e.beside, e.within, plain[e.group] / largest if largest else 1.0) for k, (_, _, _, e) in enumerate(found)]


@lru_cache(maxsize=1)
def labelled() -> list[tuple]:
    """The labelled table: the numbers of each block of PAGES, then 1 for text, 0 for boilerplate."""
    out = []
    for page in PAGES:
        found = blocks(written_out(page))
        out += [(*row, int("text" in block[0])) for row, block in zip(rows_of(found), found, strict=True)]
    return out


LABELLED = labelled()


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(np.array([features(r[:-1]) for r in LABELLED], dtype=float), np.array([r[-1] for r in LABELLED], dtype=float))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, says = blocks(page), tree().says
    return " ".join(block[0] for block, row in zip(found, rows_of(found), strict=True) if says(features(row)))


def deciding(page: str) -> Counter[str]:
    """How many blocks of the page each feature has a say in: those on the block's way through the tree."""
    out: Counter[str] = Counter()
    for row in rows_of(blocks(page)):
        out.update({FEATURES[node.feature] for node in tree().path(features(row))[:-1]})
        out["blocks"] += 1
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, each on its own: no shuffle. Null and empty html give an empty text."""
    arrow_limits(pages.sparkSession)

    def run(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch:
            texts = [main_text(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
