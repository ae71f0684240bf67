"""Main text of web pages by tree scoring.

Each block of text passes points for its length and its commas to its container and, less and
less, to the ancestors; a container's points are discounted by the share of its text
that is link text.  The best container is kept, widened to the article element
around it if there is one, together with those siblings that score in proportion or
carry plain text.  What can be no main text by its element or its class (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) goes before scoring.

Defined results: a null or empty page gives an empty text; broken markup is read to its end
(unclosed elements end with their parents, an unfinished tag at the end is dropped); repeated rows are
judged alike; a null page_id or url is carried; an empty table gives an empty result; all input columns are carried in `doc`.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.llm.common import row_struct

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; none of it is text of the page.
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
DROP = frozenset("nav aside footer form button select option fieldset dialog menu svg math canvas object audio video map head".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                  "h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are paragraphs: their points go to the parent, not to themselves.
PARAGRAPH = frozenset("p pre blockquote li dd dt td th tr figcaption summary caption address".split()) | HEADING
#: Words of class, id or role that mark what is no main text (fixed values).
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments "
    "commentlist disqus respond replies reply share sharing social related recommended newsletter subscribe subscription signup login search "
    "pagination pager toolbar widget copyright disclaimer paywall contentinfo complementary".split())
BESIDE = frozenset("has with no without".split())
CONTENT = frozenset("article body content entry main page post text blog story".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
#: A stray quoted string, or a name and its value if it has one.
_ATTR = re.compile(r"""\"[^"]*"|'[^']*'|([^\s"'<>/=][^\s"'>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: An open element of the key is closed by a start tag of the values, within the boundary.
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
              "option": ("option",)}
_BOUNDARY = frozenset("ul ol dl table html body article section div".split())


def attributes(attrs: str) -> dict[str, str]:
    """Names (lower case) and values of a tag's attributes; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        if m[1]:
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


class Node:
    __slots__ = ("tag", "words", "parent", "children", "hidden", "score", "size", "link_size")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        named = attributes(attrs) if attrs else {}
        found = " ".join(named[k] for k in ("class", "id", "role") if k in named)
        self.words = frozenset(w.lower() for w in _WORDS.findall(found)) if found else frozenset()
        self.hidden = bool(named) and ("hidden" in named or named.get("aria-hidden", "").strip().lower() == "true"
                                       or _NO_DISPLAY.search(named.get("style", "")) is not None)
        self.score = 0.0
        self.size = self.link_size = 0


def parse(page: str) -> Node:
    """The tree of a page; strings among the children are decoded text."""
    root = node = Node("html", "", None)
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            node.children.append(html.unescape(page[at:lt]))
        if lt == end:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page[lt + 1:lt + 2] in ("!", "?"):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[lt:lt + 3]):
                break  # unfinished at the end of the page
            node.children.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            node = _close(node, tag)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end if not close else close.end()
            continue
        if tag == "html":
            continue
        node = _make_room(node, tag)
        child = Node(tag, m[3], node)
        node.children.append(child)
        if tag not in VOID and not m[3].endswith("/"):
            node = child
        elif tag not in VOID and tag in BLOCK:
            node = child  # <div/> is an open element in HTML
    return root


def _close(node: Node, tag: str) -> Node:
    """The node that is open after an end tag; one that closes nothing is passed over."""
    at: Node | None = node
    while at is not None and at.parent is not None:
        if at.tag == tag:
            return at.parent
        if tag not in BLOCK and at.tag in BLOCK:
            return node
        at = at.parent
    return node


def _make_room(node: Node, tag: str) -> Node:
    """Closes what a start tag ends by itself."""
    if tag in BLOCK or tag == "hr":
        at: Node | None = node
        while at is not None and (at.tag not in BLOCK or at.tag == "p"):
            if at.tag == "p" and at.parent is not None:
                node = at.parent
                break
            at = at.parent
    if tag in HEADING and node.tag in HEADING and node.parent is not None:
        node = node.parent
    if tag in _CLOSED_BY:
        at = node
        while at is not None and at.tag not in _BOUNDARY:
            if at.tag in _CLOSED_BY[tag] and at.parent is not None:
                node = at.parent
                if tag != "tr":
                    break
            at = at.parent
    return node


def _inside(node: Node, tags: frozenset[str]) -> Node | None:
    at = node.parent
    while at is not None:
        if at.tag in tags:
            return at
        at = at.parent
    return None


_ARTICLE = frozenset(("article", "main"))


def _prune(root: Node) -> list[Node]:
    """Takes away what is no main text; the remaining nodes, parents first."""
    every = [root]
    for n in every:
        every += [c for c in n.children if isinstance(c, Node)]
    holds: set[int] = set()  # nodes around an article that is no junk itself
    for n in every:
        if n.tag in _ARTICLE and not n.words & JUNK and n.tag != "html":
            at = n.parent
            while at is not None and id(at) not in holds:
                holds.add(id(at))
                at = at.parent
    _measure(every)
    titled: set[int] = set()
    for n in every:
        if n.tag == "h1":
            at = n
            while at is not None and id(at) not in titled:
                titled.add(id(at))
                at = at.parent

    def junk_by_name(n: Node) -> bool:
        """Named as junk, and neither said to merely have it beside (has-sidebar) nor around the page's title and most of its text."""
        if n.tag in ("body", "main", "html") or not n.words & JUNK or n.words & BESIDE or id(n) in holds:
            return False
        return not (id(n) in titled and 2 * n.size > root.size and not n.words & {"comment", "comments", "header"})

    keep = [root]
    for n in keep:
        left = []
        for c in n.children:
            if isinstance(c, Node):
                junk = c.tag in DROP or c.hidden or junk_by_name(c)
                headed = c.tag == "header" and id(c) not in holds or junk and bool(c.words & {"header", "masthead"})
                if headed and _inside(c, _ARTICLE) or headed and c.tag == "header" and n.tag in _ARTICLE:
                    left += _headings(c)  # the article's own title stands in its header
                    continue
                if junk or c.tag == "header" and id(c) not in holds:
                    continue
            left.append(c)
        n.children = left
        keep += [c for c in left if isinstance(c, Node)]
    return keep


def _headings(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.tag in HEADING:
            out.append(n)
        else:
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def blocks(nodes: list[Node]) -> list[tuple[Node, str]]:
    """Text blocks in page order with the block element each lies in; white space is one space."""
    out: list[tuple[Node, str]] = []
    held: list[str] = []
    todo: list[tuple[Node | str, Node | None]] = [(n, n) for n in reversed(nodes)]
    owner: Node | None = None

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((owner, text))

    while todo:
        item, of = todo.pop()
        if isinstance(item, str):
            if owner is not of:
                flush()
                owner = of
            held.append(item)
            continue
        if item.tag in ("br", "hr", "td", "th", "img", "wbr"):
            held.append(" " if item.tag != "wbr" else "")
        # Cells run on within their row; every other block element ends the block before and after it.
        own = item if item.tag in BLOCK and item.tag not in ("td", "th", "hr") else of
        if own is item:
            todo.append(("", None))
        todo += [(c, own) for c in reversed(item.children)]
        if own is item:
            todo.append(("", None))
    flush()
    return out


def _measure(nodes: list[Node]) -> None:
    """Text and link text of every node, children first."""
    for n in reversed(nodes):
        n.size = sum(len(c) if isinstance(c, str) else c.size for c in n.children)
        n.link_size = n.size if n.tag == "a" else sum(c.link_size for c in n.children if isinstance(c, Node))


def _links(node: Node) -> float:
    return node.link_size / node.size if node.size else 0.0


def _menu(node: Node) -> bool:
    """A list or box of links and nothing else."""
    return node.tag in ("ul", "ol", "div", "table", "section") and _links(node) > 0.9 and len(node.children) > 2


def extract(page: str | None) -> str:
    """The main text: blocks joined by newlines; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    nodes = _prune(root)
    _measure(nodes)
    menus = {id(n) for n in nodes if _menu(n) and n.tag in ("ul", "ol")}
    for n in nodes:
        if menus:
            n.children = [c for c in n.children if id(c) not in menus]
    scored: dict[int, Node] = {}
    for owner, text in blocks([root]):
        points = 1 + sum(map(text.count, ",،，、")) + min(3.0, len(text) / 100)
        at = owner.parent if owner.tag in PARAGRAPH and owner.parent is not None else owner
        depth = 0
        while at is not None and depth < 6:
            if id(at) not in scored:
                scored[id(at)] = at
                at.score = {"article": 10.0, "main": 8.0, "section": 3.0, "div": 3.0}.get(at.tag, 0.0) + 10.0 * bool(at.words & CONTENT)
            at.score += points / (1, 2, 6, 9, 12, 15)[depth]
            at, depth = at.parent, depth + 1
    if not scored:
        return ""
    best = max(scored.values(), key=lambda n: n.score * (1 - _links(n)))
    around = best if best.tag == "article" else _inside(best, frozenset(("article",))) or (
        best if best.tag == "main" else _inside(best, frozenset(("main",))))
    if around is not None and _links(around) < 0.5:
        best = around
    return "\n".join(text for _, text in blocks(_with_siblings(best)))


def _with_siblings(best: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    siblings = [n for n in best.parent.children if isinstance(n, Node)] if best.parent is not None else [best]
    least = max(10.0, 0.2 * best.score)
    out = []
    for n in siblings:
        alike = n.tag == best.tag and n.words == best.words and bool(n.words)
        score = n.score * (1 - _links(n)) + (0.2 * best.score if alike else 0.0)
        plain = n.tag == "p" and n.size > 0 and _links(n) < 0.25
        if n is best or n.tag not in ("article",) and (score >= least or plain or n.tag in HEADING) or n.tag == "article" and score >= least:
            out.append(n)
    return out


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """doc (all input columns), text: the main text of each page."""
    rows = pages.select(row_struct(pages))

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([extract(x) for x in b], dtype=object)

    return rows.select("doc", text_of(F.col("doc").getField(column)).alias("text"))
