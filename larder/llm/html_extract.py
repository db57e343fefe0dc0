"""Main text of HTML pages by tree scoring.

The page is parsed into a tree of containers.  Each paragraph (a run of text
between block boundaries) earns points for length and commas and passes them to
its ancestors, halved from the second one on; a container's points are
discounted by its link density.  The best container is kept, or all of the
article it is in, with what lies beside it (in ``main``, if there is one, else
under the same parent) and is not mostly links, whatever its length; the blocks
are returned in page order.  Menus, ads and the like are never read.

Nulls and oddities: null, empty or text-free html gives the empty string and 0
characters.  Unclosed elements, stray end tags and pages cut off in the middle
of a tag are read as far as they go.  Rows are independent: repeated rows give
repeated results, other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from larder.llm.common import prepare, table

NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
NAMED = re.compile(r"(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg object canvas title select annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var img wbr "
                   "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover "
                   "mmultiscripts mprescripts mspace mtable mtr mlabeledtr mtd maction semantics".split())
DROPPED = frozenset("nav header footer aside form button menu dialog head fieldset".split())
PARAGRAPHS = frozenset("p pre td th li blockquote h1 h2 h3 h4 h5 h6 dd dt figcaption".split())
# Parts of a page that are no article, as words of a class, id or role.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices "
    "popup modal overlay newsletter subscribe subscription signup login sidebar side rail widget widgets nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies discussion respond share sharing social "
    "related recommended recommendations pagination pager toolbar search complementary contentinfo alert gdpr tracking outbrain taboola "
    "teaser trending popular tags toc legal copyright".split())
# Those that also stand inside articles, where a word of the second set beside them excuses them.
WEAK = frozenset("header side share tags legal notice notices story copyright related toc popular trending alert".split())
LIKELY = frozenset("article body content entry main post story text".split())
WORDS = re.compile(r"[A-Za-z]+")
LINKS = 0.5  # what lies beside the article and has more than this share of link text is navigation
# An open element that a start tag of these kinds ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol "
                   "p pre section table ul".split())


class Node:
    __slots__ = ("tag", "parent", "score", "chars", "linked", "bad", "order", "block", "owner")

    def __init__(self, tag, parent, bad, order):
        self.tag, self.parent, self.bad, self.order = tag, parent, bad, order
        self.score = 0.0
        self.chars = self.linked = 0
        self.block = parent.block if parent is not None and tag in INLINE else self  # the container its text belongs to


class Marks:
    """The page's tags, comments and declarations.  The end of a tag depends only on the
    first stop (a quote or ``>``) after its name, so it is worked out once for every
    stop: a page of open tags or open quotes takes no longer than any other."""

    def __init__(self, page: str):
        self.page = page
        self.stops = [m.start() for m in STOP.finditer(page)]
        self.ends: dict[int, tuple[int, int] | None] = {}
        self.open: dict[str, int] = {}  # quote: a place from which it does not occur any more

    def quote(self, mark: str, at: int) -> int:
        if at >= self.open.get(mark, at + 1):
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.open[mark] = at
        return found

    def end(self, at: int) -> tuple[int, int] | None:
        """(end of the attributes, end of the tag) for attributes from ``at``; None where a
        quote stays open.  Without a ``>`` the tag goes on to the end of the page."""
        path, got = [], (len(self.page), len(self.page))
        while (k := bisect_left(self.stops, at)) < len(self.stops):
            stop = self.stops[k]
            if stop in self.ends:
                got = self.ends[stop]
                break
            path.append(stop)
            mark = self.page[stop]
            close = stop if mark == ">" else self.quote(mark, stop + 1)
            if mark == ">" or close < 0:
                got = (stop, stop + 1) if mark == ">" else None
                break
            at = close + 1
        for stop in path:
            self.ends[stop] = got
        return got

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether an end tag, tag or None, attributes) of the first mark from ``at``."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            for begin, close in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
                if page.startswith(begin, at):
                    end = page.find(close, at + len(begin))
                    return at, end + len(close) if end >= 0 else len(page), False, None, ""
            m = NAME.match(page, at)
            end = m and self.end(m.end())
            if end:
                return at, end[1], bool(m[1]), m[2].lower(), page[m.end():end[0]]
            at += 1
        return None


def _unlikely(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    found = {w.lower() for _, v in NAMED.findall(attrs) for w in WORDS.findall(v)}
    return bool(found & UNLIKELY - WEAK) or bool(found & UNLIKELY) and not found & LIKELY


def blocks_of(page: str) -> tuple[list[tuple[Node, str, bool, int]], list[Node]]:
    """Blocks (container, text, in a paragraph element, link characters) in page
    order, and all containers, parents first, with the characters and link
    characters counted along the tree."""
    root = Node("#root", None, False, 0)
    stack, nodes, blocks, buffer = [root], [root], [], []
    at, n, count, links = 0, len(page), 0, 0
    linked = 0
    opened: Counter = Counter()  # open elements by tag
    marks = Marks(page)

    def flush():
        nonlocal linked
        if buffer:
            text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                node = stack[-1].block
                share = min(linked, len(text))
                blocks.append((node, text, node.tag in PARAGRAPHS, share))
                node.chars += len(text)
                node.linked += share
            linked = 0

    def pop_to(index: int):
        nonlocal links
        for x in stack[index:]:
            links -= x.tag == "a"
            opened[x.tag] -= 1
        del stack[index:]

    def close(tags) -> None:
        """End the innermost open element of ``tags`` if only inline elements are in it."""
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    pop_to(i)
                    break
                if stack[i].tag not in INLINE:
                    break

    while at < n:
        m = marks.next(at)
        end = m[0] if m else n
        if end > at and not stack[-1].bad:
            # a cut-off start such as "<di" at the very end is markup, not text
            text = page[at:end]
            buffer.append(text)
            linked += len(text) if links else 0
        if not m:
            break
        _, at, ends_tag, tag, attrs = m
        if tag is None:
            continue
        if ends_tag:
            if tag not in INLINE:
                flush()
            if opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i)
                        break
                    if tag in INLINE and stack[i].tag not in INLINE:
                        break
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = found.end() if found else n
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS_P:
                close(("p",))
            if tag in CLOSES:
                close(CLOSES[tag])
        if tag in VOID:
            if tag in ("br", "hr"):
                buffer.append(" ")
            continue
        if attrs.endswith("/") and tag not in ("p", "div"):
            continue
        count += 1
        parent = stack[-1]
        stack.append(Node(tag, parent, parent.bad or _unlikely(tag, attrs), count))
        nodes.append(stack[-1])
        opened[tag] += 1
        links += tag == "a"
    flush()
    for x in reversed(nodes[1:]):  # children come after their parents
        x.parent.chars += x.chars
        x.parent.linked += x.linked
    return blocks, nodes


def main_text(page: str | None) -> str:
    """The article's blocks, white space collapsed, joined by newlines."""
    if not page:
        return ""
    blocks, nodes = blocks_of(page)
    if not blocks:
        return ""
    scored: dict[int, Node] = {}
    for node, text, paragraph, _ in blocks:
        points = 1 + text.count(",") + min(len(text) / 100.0, 3) if len(text) >= 25 else 0.25
        up = node.parent if paragraph and node.parent is not None else node
        share = 1.0
        while up is not None and share > 0.05:
            up.score += points * share
            scored[id(up)] = up
            up, share = up.parent, share / 2
    for x in scored.values():
        x.score *= 1 - x.linked / x.chars if x.chars else 0
        if x.tag in ("article", "main"):
            x.score *= 1.5
    best = max(scored.values(), key=lambda x: (x.score, -x.order))
    # All of the outermost article around the best container; what is beside it up to the outermost main.
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    top = max((i for i, x in enumerate(above) if x.tag == "article"), default=0)
    main = max((i for i, x in enumerate(above) if x.tag == "main"), default=None)
    last = top + 1 if main is None else max(main, top)
    around = {id(x) for x in above[top + 1:last + 1]}
    for x in nodes:  # the part beside the article, or the article, that a container lies in
        x.owner = x if x is above[top] or x.parent is None or id(x.parent) in around else x.parent.owner
    out = []
    for node, text, _, linked in blocks:
        if id(node) in around:
            if linked <= LINKS * len(text):
                out.append(text)
            continue
        x = node.owner
        if x is above[top] or x.parent is not None and x.linked <= LINKS * x.chars:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, ident: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text of every row: (id, url, text, n_chars)."""
    def run(frames):
        for f in frames:
            texts = [main_text(x) for x in f["html"]]
            yield pd.DataFrame({"id": f["id"].tolist(), "url": f["url"].tolist(), "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema[ident].dataType.simpleString()
    return (
        # The id travels as text: pandas would turn a column with nulls into floats.
        pages.selectExpr(f"CAST(`{ident}` AS STRING) AS id", f"`{url}` AS url", f"`{page}` AS html")
        .mapInPandas(run, "id string, url string, text string, n_chars bigint")
        .selectExpr(f"CAST(id AS {kind}) AS `{ident}`", "url", "text", "n_chars")
    )


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return extract(table(spark, sf_dir, "pages"))
