"""Operator 7: main text of web pages by composite text density.

Each DOM node gets a composite density: characters per tag, adjusted by the share of characters and tags within
links. The node whose children's densities have the largest sum holds the text; the smallest density on
its path from the body is the threshold that every node beside that path has to reach. Page furniture is cut away first, as
its tags, roles and class names say.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewindow.llm.shared import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose content is never text of the article.
CUT_TAGS = frozenset("head title script style noscript template iframe object svg canvas audio video".split())
INPUTS = frozenset("input select textarea".split())
#: Tags, roles, and whole names of a class or id that mark page furniture. What they mark stays if an article, or most of the text, is in it.
SOFT_TAGS = frozenset("nav footer aside form button menu dialog search".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense ad-banner ad-block ad-box ad-container ad-label ad-slot ad-unit ad-wrapper sponsor sponsored sponsored-content sponsored-links "
    "breadcrumb breadcrumbs comment comments commentlist comment-list comments-area comments-list comments-section reader-comments user-comments disqus replies respond reply-form "
    "cookie cookies cookie-banner cookie-bar cookie-box cookie-consent cookie-dialog cookie-message cookie-notice cookie-popup cookies-banner consent gdpr "
    "modal modal-dialog notice notice-bar notice-banner popup popup-overlay overlay newsletter newsletter-box newsletter-form newsletter-signup subscribe subscription "
    "copyright copyright-notice footer site-footer header site-header masthead topbar login login-form "
    "menu menubar main-menu nav navbar navigation site-nav pager pagination toolbar sidebar left-sidebar right-sidebar sidebar-left sidebar-right".split()
)
#: Names of lists of links, which mark furniture only where most is in links or next to nothing is there.
LINK_NAMES = frozenset(
    "banner promo widget related related-articles related-content related-links related-posts related-stories recommended recommended-articles recommended-posts "
    "share sharing share-buttons share-links sharing-buttons skip skip-link skip-to-content social social-icons social-links social-media social-share".split()
)
#: Characters outside of links from which on something under such a name may be text.
LINK_PROSE = 200
#: Elements that ask for input, and those that hold its names; a form is no text if it has fewer than so many characters of other text for each of the former.
CONTROLS, CONTROL_TEXT, CONTROL_PROSE = INPUTS | {"button"}, INPUTS | frozenset("a button label legend option".split()), 100
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What may stand beside the text within the same part of a page.
BESIDE = HEADINGS | frozenset("header p blockquote figure pre ul ol dl table hr br".split())
#: An open tag ends the open tags of its set, up to the nearest of its bounds.
_CLOSES = {
    **{t: (frozenset(["p"]), frozenset(["td", "th", "table", "button", "body"])) for t in BLOCKS - {"html", "head", "body", "title", "option", "optgroup", "tr", "td", "th", "tbody", "thead", "tfoot", "li", "dd", "dt", "caption", "legend"}},
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt", "p"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt", "p"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    **{t: (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "p"]), frozenset(["table"])) for t in ("tbody", "thead", "tfoot")},
    "body": (frozenset(["head", "title"]), frozenset(["html"])),
}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    """An element: its children are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


#: Open elements beyond which a further one stands beside the innermost one instead of in it, as in browsers.
MAX_DEPTH = 512


class _Tree(HTMLParser):
    """Builds the tree of a page, however incomplete its tags are, in time linear in its tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.stack = [self.root]
        self.open: Counter[str] = Counter()

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES and any(self.open[x] for x in _CLOSES[tag][0]):
            closed, bounds = _CLOSES[tag]
            depth, last = len(self.stack) - 1, 0
            while depth and self.stack[depth].tag not in bounds:
                if self.stack[depth].tag in closed:
                    last = depth
                depth -= 1
            if last:
                self._close_to(last)
        node = Node(tag, dict(attrs), self.stack[-1])
        node.parent.children.append(node)
        if tag not in VOID and (len(self.stack) < MAX_DEPTH or tag in CUT_TAGS | INPUTS | SOFT_TAGS):
            self.stack.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.stack[-1].tag == tag:
            self._close_to(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag] or tag in ("body", "html"):  # what follows these ends is still of the body
            return
        depth = len(self.stack) - 1
        while self.stack[depth].tag != tag:
            if tag not in BLOCKS and self.stack[depth].tag in BLOCKS:
                return
            depth -= 1
        self._close_to(depth)

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)

    def parse_starttag(self, i: int) -> int:
        """A tag that the page ends in is no text, nor is what follows it, as in browsers; so no part of a page is looked at for each of many such tags."""
        end = super().parse_starttag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        return super().parse_pi(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment without an end goes up to the end of the page."""
        return super().parse_comment(i, report) if self.rawdata.find("-->", i) >= 0 else len(self.rawdata)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` is a comment up to the next ``>``, as in browsers; without one it is text."""
        return self.rawdata.find(">", i) + 1 or -1


def _is_cut(node: Node) -> bool:
    """Whether an element is never text: by its tag, or as it is hidden."""
    if node.tag in ("html", "body", "#root"):
        return False
    hidden = "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or _HIDDEN.search(node.attrs.get("style") or "")
    return node.tag in CUT_TAGS or bool(hidden) and node.tag not in ("article", "main")


def _names(node: Node) -> set[str]:
    """The class names and the id of an element."""
    return set(f"{node.attrs.get('class') or ''} {node.attrs.get('id') or ''}".lower().replace("_", "-").split())


@dataclass
class _Held:
    """What an element holds: an article, characters outside of links, characters in links, text that is not of controls, and controls; white space is not counted."""

    article: bool = False
    plain: int = 0
    linked: int = 0
    prose: int = 0
    controls: int = 0


def _held(nodes: list[Node]) -> dict[int, _Held]:
    """What each of the nodes, parents before children, holds."""
    out: dict[int, _Held] = {}
    for node in reversed(nodes):
        h = out[id(node)] = _Held()
        chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        h.plain = h.prose = chars
        for c in node.children:
            if isinstance(c, Node):
                own = out[id(c)]
                h.article = h.article or own.article
                h.plain, h.linked, h.prose, h.controls = h.plain + own.plain, h.linked + own.linked, h.prose + own.prose, h.controls + own.controls
        h.article = h.article or node.tag in ("article", "main")
        if node.tag == "a":
            h.plain, h.linked = 0, h.plain + h.linked
        if node.tag in INPUTS:
            h.plain = h.linked = 0
        if node.tag in CONTROL_TEXT:
            h.prose = 0
        h.controls += node.tag in CONTROLS and node.attrs.get("type") != "hidden"
    return out


def _is_furniture(node: Node, held: _Held, inside: bool) -> bool:
    """Whether an element's tag, role or name says that it is page furniture; ``inside``: within an article or main element."""
    if node.tag == "article":
        return not _names(node).isdisjoint(("comment", "comments"))
    if node.tag in ("html", "body", "main", "#root") or node.tag in HEADINGS:
        return False
    if node.tag in ("form", "search") or node.attrs.get("role") in ("form", "search"):
        return held.prose < CONTROL_PROSE * max(1, held.controls)
    if node.tag in SOFT_TAGS or (node.tag == "header" and not inside) or node.attrs.get("role") in CUT_ROLES:
        return True
    names = _names(node)
    if not names.isdisjoint(LINK_NAMES) and (held.plain < LINK_PROSE or held.linked > held.plain):
        return True
    return not names.isdisjoint(CUT_NAMES)


def _prune(root: Node) -> None:
    """Cuts what is never text, then fields and page furniture, the latter where neither an article nor most of the text outside of links would go with it."""
    _prune_by(root, lambda node, inside: _is_cut(node))
    held = _held(_in_order(root))
    total, apart = held[id(root)].plain, held[id(root)].article

    def furniture(node: Node, inside: bool) -> bool:
        own = held[id(node)]
        if node.tag in INPUTS:
            return True
        most = 2 * own.plain > total and (inside or not apart)
        kept = own.article and node.tag != "article" or most
        return not kept and _is_furniture(node, own, inside)

    _prune_by(root, furniture)


def _prune_by(root: Node, cut: Callable[[Node, bool], bool]) -> None:
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not cut(c, inside)]
        stack += [(c, inside) for c in node.children if isinstance(c, Node)]


def _in_order(root: Node) -> list[Node]:
    """Parents before children."""
    out = [root]
    for node in out:
        out += [c for c in node.children if isinstance(c, Node)]
    return out


def _measure(body: Node) -> list[Node]:
    """Counts and composite densities of the nodes under the body, which is returned first."""
    nodes = _in_order(body)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, lc = node.chars, node.link_chars
        if c:
            base = math.log(max(c / max(1, c - lc) * lc + share * c + math.e, math.e))
            ratio = c / max(1, lc) * max(1, node.tags) / max(1, node.link_tags)
            node.density = c / max(1, node.tags) * max(0.0, math.log(max(ratio, 1.0)) / base)
        node.total = sum(x.density for x in node.children if isinstance(x, Node)) or node.density
    return nodes


def _content(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    body = next((n for n in _in_order(root) if n.tag == "body"), root)
    best = max(_measure(body), key=lambda n: n.total)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    node = best
    while node is not body and node.parent is not body and _plain_beside(node):
        node = node.parent
    kept = [node]
    while node is not body:
        beside = [c for c in node.parent.children if isinstance(c, Node)]
        at = next(i for i, c in enumerate(beside) if c is node)
        head = at
        while kept[0] is node and head and beside[head - 1].tag in HEADINGS:
            head -= 1
        before = [c for i, c in enumerate(beside[:at]) if i >= head or _is_text(c, best, threshold)]
        kept = before + kept + [c for c in beside[at + 1 :] if _is_text(c, best, threshold)]
        node = node.parent
    return kept


def _is_text(node: Node, best: Node, threshold: float) -> bool:
    """Whether a node beside the path is text: by its density, or as a further article with no more of it in links than in the densest one."""
    if node.tag == "article" and node.chars and node.link_chars * best.chars <= best.link_chars * node.chars:
        return True
    return node.density >= threshold > 0


def _plain_beside(node: Node) -> bool:
    """Whether all that stands beside a node is headings and text with few links."""
    for c in node.parent.children:
        if isinstance(c, Node) and c is not node and c.chars and (c.tag not in BESIDE or c.link_chars > 0.3 * c.chars):
            return False
    return True


def _blocks(root: Node) -> list[str]:
    """The texts of the blocks of a subtree, in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list[Node | str | None] = [root]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        else:
            block = x.tag in BLOCKS
            if block:
                end()
                stack.append(None)
            stack += reversed(x.children)
    end()
    return out


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by line feeds, or the empty string.

    A further article beside the text stays if it has no larger share of its characters in links, however short it is. A page that ends within a tag or a comment ends before it.
    Where several nodes have the largest sum of densities, the first in level order is taken. A node whose neighbours are all headings and text with few links
    gives way to its parent, up to the children of the body; headings right before it are its title. No markup is an error.
    """
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _prune(tree.root)
    return "\n".join(b for node in _content(tree.root) for b in _blocks(node))


@F.pandas_udf(StringType())
def _main_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(main_text, na_action=None).astype(object)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` under a struct ``page``, with the main ``text`` and ``n_chars``, its code points.

    Character references are decoded, white space within a block becomes one space, blocks are joined by one line feed; a
    line break is white space. Null, empty and textless pages give the empty string. Every row returns, repeated ones too.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.struct("*").alias("page"), F.coalesce(_main_texts(F.coalesce(F.col(html_col).cast("string"), F.lit(""))), F.lit("")).alias("text"))
    return rows.select("page", "text", F.length("text").cast("long").alias("n_chars"))
