"""Main text of HTML pages by tree scoring.

The page becomes a tree. Blocks of text pass points for length and commas up to their ancestors, discounted by link
density; the best container is kept with those of its siblings that score enough or read like text. Parts that by
tag are navigation, notices, forms or the like, and reader comments, never score and are left out of the text. A part that
only its name marks so is left out, too, unless it holds most of the page's own words (`_settle`). Parsing takes time in
proportion to the page, however broken it is.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
DROPPED = frozenset(
    "script style template noscript iframe object embed applet svg math canvas audio video map head title textarea "
    "nav header footer aside form button select option input label fieldset dialog menu xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that close an open element of these names when it is within reach.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
          "option": {"option"}, "body": {"head"}}
REACH = frozenset("table ul ol dl select html body div article section main td th".split())
#: Words in class, id and role that mark what is not the article, and what keeps a part all the same.
COMMENTS = re.compile(r"(^|[\s_-])(comments?|commentlist|disqus|reply|replies|respond|shoutbox)($|[\s_-])", re.I)
BOILERPLATE = re.compile(
    r"(^|[\s_-])(ads?|adverts?|advertisements?|adsense|banners?|breadcrumbs?|captcha|consent|cookies?|copyright|"
    r"dialog|disclaimer|foot|footer|gdpr|header|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notices?|notification|"
    r"overlay|pager|pagination|popup|privacy|promo|promos|related|share|sharing|sidebars?|signup|skyscraper|"
    r"social|sponsor(ed)?|sponsors|subscribe|subscription|tags|toolbar|topbar|widgets?|alert|complementary|contentinfo|search)($|[\s_-])", re.I)
ARTICLE = re.compile(r"(^|[\s_-])(article|articlebody|body|content|entry|hentry|main|page|post|story|text)($|[\s_-])", re.I)
#: Names of a layout that mentions a part without being it.
_LAYOUT = re.compile(r"\b(has|with|no|without|show|hide)[-_]\w+", re.I)

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
#: Elements that an inline end tag never crosses, and how many of them a start tag looks through for what it closes.
_STRUCTURE = BLOCKS | {"option", "select", "head"}
_FAR = 256
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 hgroup p pre blockquote ul ol dl table figure".split())
_NAMED = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I | re.S)


class Node:
    """An element: its children are nodes and strings (already decoded)."""

    __slots__ = ("tag", "parent", "children", "dropped", "suspect", "weight", "score", "letters", "linked", "block", "open")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, weight: float = 0.0, suspect: int = 0):
        self.tag, self.parent, self.children, self.suspect = tag, parent, [], suspect
        self.dropped, self.weight, self.score, self.letters, self.linked = dropped, weight, 0.0, 0, 0
        # the nearest structural element, itself included, and the inline elements open right inside it
        self.block, self.open = (self, {}) if parent is None or tag in _STRUCTURE else (parent.block, None)


def _element(tag: str, attributes: str, parent: Node) -> Node:
    dropped, weight, suspect = tag in DROPPED, 0.0, 0
    if "=" in attributes or "hidden" in attributes:
        for name, value in _NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                article = ARTICLE.search(value)
                if article:
                    weight += 25
                if tag not in ("html", "body", "article", "main"):
                    plain = _LAYOUT.sub(" ", value)
                    dropped = dropped or COMMENTS.search(plain) is not None
                    if BOILERPLATE.search(plain):
                        # 1: names of both kinds, 2: of the one kind only
                        weight, suspect = weight - 25, max(suspect, 1 if article else 2)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                dropped = dropped or tag not in ("html", "body")
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                dropped = dropped or tag not in ("html", "body")
    return Node(tag, parent, dropped, weight + (25 if tag in ("article", "main") else 0), 0 if dropped else suspect)


def parse(page: str) -> Node:
    """The tree of a page, however broken: open elements close with the page, stray end tags are skipped. A tag without `>` ends with
    the page; after a quote that never closes, tags end at the next `>`, quoted or not."""
    root = here = Node("html", None)
    at, end, opened, quotes = 0, len(page), {}, True

    def leave(node: Node, to: Node) -> Node:
        while node is not to:
            counts = opened if node.tag in _STRUCTURE else node.block.open
            counts[node.tag] -= 1
            node = node.parent
        return to

    while at < end:
        if here.tag in RAW:
            close = re.compile(rf"</{here.tag}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else end
            here.children.append(html.unescape(page[at:stop]) if here.tag in ("title", "textarea") else page[at:stop])
            gone = page.find(">", stop) if close else end
            at, here = (gone + 1 if gone >= 0 else end), leave(here, here.parent)
            continue
        sign = page.find("<", at)
        while sign >= 0 and not page.startswith(("<!", "<?"), sign) and not (tag_found := _TAG.match(page, sign)):
            sign = page.find("<", sign + 1)
        text = page[at:sign] if sign >= 0 else page[at:]
        if text:
            here.children.append(html.unescape(text) if "&" in text else text)
        if sign < 0:
            break
        if page.startswith(("<!", "<?"), sign):
            first, last = ("<!--", "-->") if page.startswith("<!--", sign) else ("<![CDATA[", "]]>") if page.startswith("<![CDATA[", sign) else ("<!", ">")
            stop = page.find(last, sign + len(first))
            at = stop + len(last) if stop >= 0 else end
            if last == "]]>":
                here.children.append(page[sign + 9:stop if stop >= 0 else end])
            continue
        closing, tag, after = page[sign + 1] == "/", tag_found[1].lower(), tag_found.end()
        stop = -1
        if quotes and not closing:
            stop = _ATTRIBUTES.match(page, after).end()
            quotes = stop == end or page[stop] == ">"
        if closing or not quotes:
            stop = page.find(">", after)
        stop = end if stop < 0 else stop
        at = stop + 1
        if not closing:
            here = leave(here, _make_room(here, tag))
            if tag == "html":
                continue
            node = _element(tag, page[after:stop], here)
            here.children.append(node)
            if tag not in VOID and not (page[stop - 1] == "/" and tag in ("svg", "path", "use")):
                counts = opened if tag in _STRUCTURE else node.block.open
                counts[tag] = counts.get(tag, 0) + 1
                here = node
        # a block stays open when an inline end tag does not match inside it
        elif (opened if tag in _STRUCTURE else here.block.open).get(tag):
            node = here
            while node.tag != tag:
                node = node.parent
            here = leave(here, node.parent)
    return root


def _make_room(here: Node, tag: str) -> Node:
    """The element that a start tag goes into: it closes a paragraph before any block, list items, cells and rows before their like."""
    if tag in BLOCKS and here.block.tag == "p":
        here = here.block.parent
    ends = CLOSES.get(tag)
    if ends:
        node, stops = here.block, REACH | {tag} - ends
        for _ in range(_FAR):
            if node.parent is None or node.tag in stops and node.tag not in ends:
                break
            if node.tag in ends:
                here = node.parent
                if node.tag in REACH and tag != "tr" and tag not in ("thead", "tbody", "tfoot"):
                    break
            node = node.parent.block
    return here


def _blocks(node: Node) -> list[str]:
    """Text of the blocks below a node in page order, white space folded, without what is dropped."""
    out, run = [], []

    def close():
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                out.append(text)

    stack = [("in", node)]
    while stack:
        what, item = stack.pop()
        if what == "end":
            close()
        elif isinstance(item, str):
            run.append(item)
        elif item.dropped and item is not node:
            if item.tag in BLOCKS:
                close()
        elif item.tag in ("br", "wbr"):
            run.append(" " if item.tag == "br" else "")
        else:
            if item.tag in BLOCKS:
                close()
                stack.append(("end", item))
            stack.extend(("in", c) for c in reversed(item.children))
    close()
    return out


def _settle(root: Node) -> None:
    """Decides on parts that only a name marks. One stays if it holds more than half of the page's words outside links, has few
    links and also bears an article's name, or if nothing but such parts has words; a page with an <article> or <main> needs none."""
    order, stack, suspects, clear = [], [(root, False)], [], False
    words = {}
    while stack:
        node, under = stack.pop()
        under = under or node.suspect > 0
        order.append((node, under))
        if node.suspect:
            suspects.append(node)
        clear = clear or not under and node.tag in ("article", "main")
        stack.extend((c, under) for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)
    if not suspects:
        return
    outside = 0
    for node, under in reversed(order):
        mine = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        total, linked = words.get(id(node), (0, 0))
        total += mine
        linked = total if node.tag == "a" else linked
        words[id(node)] = (total, linked)
        outside += 0 if under or node.tag == "a" else mine
        if node.parent is not None:
            above = words.get(id(node.parent), (0, 0))
            words[id(node.parent)] = (above[0] + total, above[1] + linked)
    plain = lambda n: words[id(n)][0] - words[id(n)][1]
    whole = plain(root)
    largest = max(suspects, key=plain)
    for node in suspects:
        most = 2 * plain(node) > whole and node.suspect == 1 or not outside and node is largest
        node.dropped = clear or not plain(node) or not most or 2 * words[id(node)][1] > words[id(node)][0]


def _measure(root: Node) -> list[Node]:
    """Letters and linked letters of every node; returns live nodes, parents first."""
    _settle(root)
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)
    for node in reversed(order):
        node.letters += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.linked = node.letters
        if node.parent is not None:
            node.parent.letters += node.letters
            node.parent.linked += node.linked
    return order


def _link_density(node: Node) -> float:
    return node.linked / node.letters if node.letters else 0.0


def best_container(root: Node) -> tuple[Node, list[Node]]:
    """The best scored container and its siblings of the same standing, in page order."""
    order = _measure(root)
    for node in order:
        if node.tag not in BLOCKS or not node.letters:
            continue
        own = [c if isinstance(c, str) else "".join(_inline(c)) for c in node.children if isinstance(c, str) or c.tag not in BLOCKS and not c.dropped]
        text = " ".join("".join(own).split())
        if not text:
            continue
        points = 1 + min(len(text) / 25, 40) + text.count(",")
        points *= 1 - _link_density(node)
        # a heading or a container's own words count for the container, a paragraph's for those around it
        share, up = 1.0, node if node.tag not in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dd", "dt") else node.parent
        while up is not None and share >= 0.2:
            up.score += points * share
            up, share = up.parent, share / 2
    for node in order:
        if node.score:
            node.score = (node.score + node.weight) * (1 - _link_density(node))
    containers = [n for n in order if n.score > 0 and n.tag in BLOCKS]
    if not containers:
        return root, [root]
    best = max(containers, key=lambda n: n.score)
    # an article that holds the best container is the container
    up = best
    while up is not None:
        if up.tag in ("article", "main") or up.weight >= 25 and up.tag != "body":
            best = up
            if up.tag == "article":
                break
        up = up.parent
    if best.parent is None:
        return best, [best]
    least = max(10.0, best.score * 0.2)
    kept = []
    for node in best.parent.children:
        if isinstance(node, Node) and not node.dropped and (
                node is best or best.tag not in ("article", "main") and (node.score >= least or _prose(node, 80))
                or best.tag == "article" and node.tag == "article" and node.score >= least):
            kept.append(node)
        elif best.weight < 25 and _beside(node):
            kept.append(node)
    if best.weight < 25:
        # nothing names the article: headings and prose around the container belong to it, up to the body
        up = best.parent
        while up.parent is not None and up.tag != "body":
            around = up.parent.children
            at = next(i for i, c in enumerate(around) if c is up)
            kept = [c for c in around[:at] if _beside(c)] + kept + [c for c in around[at + 1:] if _beside(c)]
            up = up.parent
    return best, kept


def _prose(node: Node, more_than: int) -> bool:
    return node.tag == "p" and node.letters > more_than and _link_density(node) < 0.25


def _beside(part: Node | str) -> bool:
    """Whether a neighbour of an unnamed article reads as a part of it: bare or inline text, a heading, prose or a list with few links."""
    if isinstance(part, str):
        return True
    text = part.tag in _TEXT or part.tag not in _STRUCTURE
    return text and not part.dropped and _link_density(part) < 0.25


def _inline(node: Node) -> Iterator[str]:
    stack = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            yield item
        elif item.tag == "br":
            yield " "
        elif not item.dropped and item.tag not in BLOCKS:
            stack.extend(reversed(item.children))


def main_text(page: str | None) -> str:
    """Blocks of the article joined by line ends; '' for a null or empty page or one without text."""
    if not page:
        return ""
    _, kept = best_container(parse(page))
    parts = Node("div", None)
    parts.children = kept
    return "\n".join(_blocks(parts))


def extract_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, text): one row per page row, whole pages; other columns are not read. Repeated rows are repeated."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[main_text(p) for p in batch["html"]])[["id", "url", "text"]]

    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")) \
        .mapInPandas(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string")
