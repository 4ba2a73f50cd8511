"""Main-text extraction with a consensus of each host's pages.

Every page scores its containers by the running text they hold; the best one gives way to
an ancestor that holds more of the article (sibling sections, an introduction, a heading).
A page votes for the generalised tag-class path of what it has found, votes are counted per
host in Spark, and every page is extracted again from all containers at its host's winning
path.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Winning paths are broadcast up to so many hosts; beyond, they are joined by shuffle.
BROADCAST_HOSTS = 100_000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=/>][^\s=/>]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_SPLIT = re.compile(r"[\s_\-]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An open element (value) that the start of another one (key) ends.
_ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("ul ol dl table select menu".split())
_BOUNDS = frozenset("body article main section div td th li table ul ol".split())
_DIGITS = re.compile(r"\d+")
#: Elements that hold no part of the article.
SKIP_TAGS = frozenset("head nav footer aside form script style noscript template iframe button select textarea svg canvas object menu dialog search title".split())
#: A class or id marks such a part if it is one of these words, or made of them and of words that only tell where or how.
SKIP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus replies cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup share sharing social related recommended popup modal overlay login search widget toolbar pagination pager copyright legal".split()
)
PLAIN_NAMES = frozenset(
    "a and area articles bar block body bottom box btn button buttons container content count desktop entry form global group header headline icon icons image images inner item items js left link links list main mobile module more outer page panel policy post posts primary reader right row secondary section site slot sticky stories thread title top unit us user wrap wrapper".split()
)
#: Elements deeper than this become siblings, as in browsers; it bounds every search up the tree.
DEEPEST = 256
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


#: Elements that hold others, and those that hold running text.
CONTAINERS = ("div", "section", "article", "main", "body")
PARAGRAPHS = ("p", "pre", "blockquote", "li", "td")
#: A paragraph of so many unlinked characters is prose; siblings are of one article if their prose is so large a part of the best one's text.
PROSE, JOINED = 80, 0.2


class Element:
    __slots__ = ("tag", "names", "parent", "children", "skip", "text", "linked", "depth", "step", "key")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Element | str] = []
        self.names = attributes.get("class", "").lower().split()
        marks = self.names + attributes.get("id", "").lower().split()
        style = attributes.get("style", "").replace(" ", "").lower()
        self.skip = (
            tag in SKIP_TAGS
            or attributes.get("role", "").lower() in SKIP_ROLES
            or "hidden" in attributes
            or attributes.get("aria-hidden") == "true"
            or "display:none" in style
            or tag not in ("html", "body", "main", "article") and any(map(_marks_boilerplate, marks))
        )

        self.step = ".".join([tag, *sorted({_DIGITS.sub("#", n) for n in self.names})])
        #: Equal for elements of one page at equal paths.
        self.key: int = hash((parent.key, self.step)) if parent else 0

    @property
    def path(self) -> str:
        """Tags from the root down, with classes; runs of digits become #."""
        out, e = [], self
        while e.parent is not None:
            out.append(e.step)
            e = e.parent
        return "/".join(reversed(out))


def key_of(path: str | None) -> int:
    """The ``key`` of elements at a path."""
    key = 0
    for step in (path or "").split("/"):
        key = hash((key, step))
    return key


def _marks_boilerplate(name: str) -> bool:
    parts = [p for p in _SPLIT.split(_DIGITS.sub("", name)) if p]
    return not SKIP_NAMES.isdisjoint(parts) and all(p in SKIP_NAMES or p in PLAIN_NAMES for p in parts)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """The attributes of a tag from ``at`` on, where it ends, and whether it closes itself.

    A quoted value that holds a > and is followed by anything but the end of an attribute
    was never closed; it, and one without a second quote, goes on to white space or the next >.
    Every step moves on, so a page is read in linear time whatever it holds.
    """
    out: dict[str, str] = {}
    n = len(page)
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m is None:  # only white space and slashes are left before the tag's or the page's end
            end = page.find(">", at)
            return out, n if end < 0 else end + 1, "/" in page[at : n if end < 0 else end]
        at, value = m.end(), ""
        if m[2]:
            quote = page[at : at + 1]
            close = page.find(quote, at + 1) if quote in ("'", '"') else -1
            if close >= 0 and page.find(">", at, close) >= 0 and not page[close + 1 : close + 2].strip(" \t\n\r\f/>") == "":
                close = -1
            if close >= 0:
                value, at = page[at + 1 : close], close + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        out.setdefault(m[1].lower(), value)


def parse(page: str) -> Element:
    """A tree of the page; end tags may be missing, and markup may break off anywhere."""
    root = here = Element("", {}, None)
    open_: Counter[str] = Counter()
    at, text, n = 0, 0, len(page)

    def leave(e: Element, to: Element) -> Element:
        while e is not to:
            open_[e.tag] -= 1
            e = e.parent
        return to

    while at < n:
        start = page.find("<", at)
        if start < 0:
            break
        nxt = page[start + 1 : start + 2]
        closing = nxt == "/"
        name = _NAME.match(page, start + 2 if closing else start + 1)
        if name is None and nxt not in ("!", "?") and not closing:
            at = start + 1  # a mere sign
            continue
        if start > text:
            here.children.append(page[text:start])
        if name is None:
            end = page.find("-->", start + 4) + 2 if page.startswith("<!--", start) else page.find(">", start)
            at = text = end + 1 if end > start else n
            continue
        tag = name[0].lower()
        attributes, at, alone = _attributes(page, name.end())
        text = at
        if closing:
            if open_[tag] <= 0:
                continue
            e = here
            while e.parent is not None and e.tag != tag:
                if e.tag in _BOUNDS and tag not in BLOCK:
                    e = root  # an inline end tag doesn't reach out of its block
                    break
                e = e.parent
            if e.parent is not None:
                here = leave(here, e.parent)
            continue
        if tag in BLOCK and open_["p"] > 0:
            here = leave(here, _close(here, {"p"}, _SCOPE | _BOUNDS | {"blockquote"}))
        if tag in _ITEMS and any(open_[t] > 0 for t in _ITEMS[tag]):
            here = leave(here, _close(here, _ITEMS[tag], _SCOPE))
        element = Element(tag, attributes, here)
        here.children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = text = end.end() if end else n
        elif tag not in VOID and not alone and element.depth < DEEPEST:
            here = element
            open_[tag] += 1
    if text < n:
        here.children.append(page[text:])
    return root


def _close(here: Element, tags: set[str], scope: frozenset[str]) -> Element:
    e = here
    while e.parent is not None and e.tag not in scope - tags:
        if e.tag in tags:
            return e.parent
        e = e.parent
    return here


def blocks(root: Element) -> Iterator[str]:
    """Texts of the blocks under ``root`` in page order, skipped parts left out; none is empty."""
    run: list[str] = []
    stack: list[Element | str | None] = [root]
    while stack:
        e = stack.pop()
        if isinstance(e, str):
            run.append(e)
        elif e is None or e.tag in BLOCK and e is not root:
            if text := " ".join(entities.unescape("".join(run)).split()):
                yield text
            run = []
            if e is not None and not e.skip:
                stack.append(None)
                stack.extend(reversed(e.children))
        elif e.tag == "br":
            run.append(" ")
        elif e is root or not e.skip:
            stack.extend(reversed(e.children))
    if text := " ".join(entities.unescape("".join(run)).split()):
        yield text


def containers(root: Element) -> list[tuple[float, Element]]:
    """Containers with their scores: the text of their own paragraphs and half of their grandchildren's, less the linked share."""
    order: list[Element] = []
    stack = [root]
    while stack:
        e = stack.pop()
        order.append(e)
        e.text, e.linked = 0, 0
        stack.extend(c for c in e.children if isinstance(c, Element) and not c.skip)
    for e in reversed(order):
        own = sum(len(c.strip()) for c in e.children if isinstance(c, str))
        e.text += own
        e.linked = e.text if e.tag == "a" else e.linked
        if e.parent is not None:
            e.parent.text += e.text
            e.parent.linked += e.linked
    score: dict[int, float] = {}
    for e in order:
        if e.tag in ("p", "pre", "blockquote", "li", "td", "h1", "h2", "h3") or e.tag in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and c.strip() for c in e.children):
            worth = (e.text if e.tag not in ("div", "section", "article", "main", "body") else sum(len(c.strip()) for c in e.children if isinstance(c, str))) - e.linked
            up = e if e.tag in ("div", "section", "article", "main", "body") else e.parent
            share = 1.0
            while up is not None and share > 0.2:
                score[id(up)] = score.get(id(up), 0.0) + share * max(0, worth)
                up, share = up.parent, share / 2
    found = [(score[id(e)] * (1 - e.linked / max(1, e.text)), k, e) for k, e in enumerate(order) if score.get(id(e), 0) > 0 and e.tag in ("div", "section", "article", "main", "body", "td")]
    return [(s, e) for s, _, e in sorted(found, key=lambda x: (-x[0], x[1]))]


def unskipped(root: Element, but: Element | None = None) -> Iterator[Element]:
    """``root`` and the elements under it in page order, without skipped ones and without ``but``."""
    stack = [root]
    while stack:
        e = stack.pop()
        yield e
        stack.extend(c for c in reversed(e.children) if isinstance(c, Element) and not c.skip and c is not but)


def article(root: Element) -> Element | None:
    """The best container, or the ancestor that holds the article of which it is a part.

    That is the article or main element around it if what this has besides is mostly not
    linked, else the outermost container that adds prose: a paragraph of its own, or
    siblings with JOINED of the text found so far.
    """
    ranked = containers(root)
    if not ranked:
        return None
    best = up = inner = ranked[0][1]
    while up.tag not in ("article", "main") and up.parent is not None:
        up, inner = up.parent, up
        more, linked = up.text - best.text, up.linked - best.linked
        if up.tag not in CONTAINERS or more <= 0 or 2 * linked > more:
            continue
        if up.tag in ("article", "main"):
            best = up
            continue
        long = [(e.text - e.linked, e.parent is up) for e in unskipped(up, inner) if e.tag in PARAGRAPHS and e.text - e.linked >= PROSE and 4 * e.linked <= e.text]
        long += [(n, e is up) for e in unskipped(up, inner) if e.tag in CONTAINERS and (n := sum(len(c.strip()) for c in e.children if isinstance(c, str))) >= PROSE]
        if any(own for _, own in long) or long and sum(n for n, _ in long) >= JOINED * best.text:
            best = up
    return best


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def text_at(page: str, path: str | None) -> str:
    """The text of all containers at ``path`` in page order, of the page's own article if it has none there, or of the whole body."""
    root = parse(page)
    best, key = article(root), key_of(path)
    own = [e for e in unskipped(root) if e.tag in (*CONTAINERS, "td") and e.text > e.linked and e.key == key] if best else []
    return "\n".join(text for e in own or [best or root] for text in blocks(e))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): how many pages of a host have their article at a path."""

    def run(batches):
        for b in batches:
            rows = []
            for url, page in zip(b["url"], b["html"]):
                best = article(parse(page or ""))
                if best:
                    rows.append((host_of(url), best.path))
            yield pd.DataFrame(rows, columns=["host", "path"])

    return pages.select("url", "html").mapInPandas(run, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("votes"))


def extract(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars, host, path (the host's winner).

    A null or empty page, or one without text, gives the empty text. Ties between paths go
    to the first in alphabetical order. A page without a host is of the host "". Repeated
    rows are extracted alike; an empty table gives an empty result; other columns are
    ignored.
    """
    from .common import materialise

    best = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    won = materialise(votes(pages).withColumn("r", F.row_number().over(best)).where("r = 1").select("host", "path"), "paths")
    host = F.udf(host_of, "string", useArrow=True)
    placed = pages.select("page_id", "url", "html", host("url").alias("host"))
    joined = placed.join(F.broadcast(won) if won.count() <= broadcast_hosts else won, "host", "left")

    @F.pandas_udf("string")
    def text(page: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([text_at(p or "", q) for p, q in zip(page, path)], dtype=object)

    return joined.select("page_id", "url", text("html", "path").alias("text"), "host", "path").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host", "path")
