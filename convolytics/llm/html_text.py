"""Main text of web pages by tree scoring.

Blocks of text pass points for their length and commas to the elements around them, half as many with each level; an
element's points are discounted by its link density. The best container is taken, widened to the article or main element
that it stands in, and joined by those of its siblings that look like text. Elements that can't be the article (menus,
headers, footers, sidebars, scripts and so on, by name or role) are left out, and so are those whose class or id
speaks against them on balance; if nothing is left without the latter, the page is scored again with them. Controls of
forms are always left out, the text of a form unless it is more than half of the page's: some pages stand in a form.

Broken markup is read leniently: missing end tags are implied, wrong ones ignored. The time is linear in the length of
a page, also where it is nested deeply: open elements are counted by name, scores are summed once from the leaves up.
References are decoded in each piece of text by itself. Null, empty and textless pages give "". Each row is its own
page: repeated rows and ids give repeated results, empty tables empty ones.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.llm.common import byte_blocks, put

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names of HTML and words that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend".split())
IMPLIED = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tr td th", "table")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
DROPPED = frozenset("script style noscript template head title nav footer aside menu iframe svg math canvas object embed applet audio video map select button input textarea label datalist dialog xmp noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
UNLIKELY = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations widget pagination pager skip login paywall disclaimer".split())
KEPT = frozenset("html body article main".split())
ARTICLE_WORDS = frozenset("article content main story post entry body text page hentry blog news column".split())
HEADING_WORDS = frozenset("header banner masthead".split())
STATE_WORDS = frozenset("has with no without is not show hide".split())


#: Where the text of a raw element ends, searched in the page itself: a letter's lower case can be longer than it.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "unlikely", "held", "points", "score", "chars", "link_chars", "enter", "leave")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, unlikely: bool = False):
        self.tag, self.parent, self.children, self.dropped, self.unlikely, self.held = tag, parent, [], dropped, unlikely, 0


def _verdict(token: str) -> int:
    """What one class token says: 1 for the article, -1 against it, 0 nothing."""
    words = [w.lower() for w in _NAME_WORD.findall(token)]
    against = [w for w in words if w in UNLIKELY]
    if not against:
        return int(any(w in ARTICLE_WORDS for w in words))
    if any(w in STATE_WORDS for w in words):
        return 0
    return 0 if all(w in HEADING_WORDS for w in against) and any(w in ARTICLE_WORDS for w in words) else -1


def _judge(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """If the element is left out, and if its class and id speak against it."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True, False
    if not attributes or attributes.isspace() or tag in ("a", "br"):
        return False, False
    balance, against = 0, False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "role" and value.lower() in DROPPED_ROLES:
            return True, False
        if name in ("class", "id") and tag not in KEPT:
            said = [_verdict(token) for token in value.split()]
            balance, against = balance + sum(said), against or -1 in said
    return False, against and balance < 0


class _Open:
    """The open elements, innermost last, and the depths at which each name is open."""

    def __init__(self, root: Node):
        self.stack, self.depths, self.blocks = [root], defaultdict(list), []

    def push(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Close all from this depth on."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.depths[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def deepest(self, tags: frozenset[str]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def end(self, tag: str) -> None:
        depth = self.deepest(frozenset((tag,)))
        if depth and (tag in BLOCK or not self.blocks or self.blocks[-1] < depth):
            self.cut(depth)

    def imply(self, shut: frozenset[str], fence: frozenset[str]) -> None:
        """Close the outermost element of shut inside the innermost one of fence; of paragraphs the innermost one."""
        barrier, found = self.deepest(fence), []
        for t in shut:
            at = self.depths.get(t)
            if at and at[-1] > barrier:
                found.append(at[-1] if t == "p" else at[bisect_right(at, barrier)])
        if found:
            self.cut(min(found))


_P, _P_FENCE = frozenset("p"), frozenset("table td th button".split())


def parse(html: str) -> Node:
    """Tree of the page; text below dropped elements isn't kept. A form is dropped unless it holds most of the text."""
    root = Node("html", None)
    opened = _Open(root)
    forms: list[Node] = []
    at, end = 0, len(html)
    while at < end:
        m = _MARKUP.search(html, at)
        top = opened.stack[-1]
        if (stop := m.start() if m else end) > at and not top.dropped:
            top.children.append(html[at:stop])
            n = len(top.children[-1].strip())
            root.held += n
            if inside := opened.depths.get("form"):
                opened.stack[inside[0]].held += n
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            opened.end(tag)
            continue
        if tag in ("html", "body"):
            continue
        if tag in IMPLIED:
            opened.imply(*IMPLIED[tag])
        elif tag in CLOSES_P:
            opened.imply(_P, _P_FENCE)
        top = opened.stack[-1]
        dropped, unlikely = (True, False) if top.dropped else _judge(tag, attributes, bool(opened.depths.get("article") or opened.depths.get("main")))
        node = Node(tag, top, dropped, unlikely)
        if not dropped:
            top.children.append(node)
            if tag == "form":
                forms.append(node)
        if tag in RAW:
            shut = RAW_END[tag].search(html, at)
            at = shut.start() if shut else end
            at = end if (shut_at := html.find(">", at)) < 0 else shut_at + 1
        elif tag not in VOID and (tag in BLOCK or not attributes.endswith("/")):
            opened.push(node)
    for node in forms:
        node.dropped = 2 * node.held <= root.held
    return root


def blocks(root: Node, strict: bool = True) -> list[tuple[Node, str]]:
    """(block element, text) in page order, without unlikely elements if strict. Sets the nodes' points, score, chars,
    link_chars, and enter and leave: a node stands inside another if it is entered while the other is."""
    out: list[tuple[Node, str]] = []
    buffer: list[str] = []
    clock = 0

    def flush(owner: Node) -> None:
        if buffer:
            if text := " ".join("".join(buffer).split()):
                out.append((owner, text))
                owner.points.append((len(text), text.count(",")))
            buffer.clear()

    def begin(node: Node) -> Node:
        nonlocal clock
        clock += 1
        node.enter, node.points, node.score, node.chars, node.link_chars = clock, [], 0.0, 0, 0
        return node

    stack: list[tuple[Node, Node, Iterator, bool]] = [(begin(root), root, iter(root.children), False)]
    while stack:
        node, owner, children, linked = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if node.tag in BLOCK:
                flush(owner)
            node.leave = clock
            texts = node.points if node.link_chars * 2 <= node.chars else []
            node.points = sum(1 + commas + length / 100 for length, commas in texts)
            node.score += node.points * (node.parent is None)
            if node.parent:
                node.parent.chars += node.chars
                node.parent.link_chars += node.link_chars
                node.parent.score += node.points + node.score / 2
        elif isinstance(child, str):
            piece = unescape(child) if "&" in child else child
            buffer.append(piece)
            n = len(piece.strip())
            node.chars += n
            node.link_chars += n * linked
        elif child.dropped or strict and child.unlikely:
            continue
        else:
            if child.tag in BLOCK:
                flush(owner)
            elif child.tag == "br":
                buffer.append(" ")
            inner = child if child.tag in BLOCK else owner
            stack.append((begin(child), inner, iter(child.children), linked or child.tag == "a"))
    flush(root)
    return out


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _ancestors(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _looks_like_text(node: Node, least: float) -> bool:
    if _density(node) >= 0.33 or not node.chars:
        return False
    return node.score + node.points >= least or node.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") or node.chars > 80


def _best(root: Node) -> Node | None:
    best, most, stack = None, 0.0, [root]
    while stack:
        node = stack.pop()
        value = node.score * (1 - _density(node))
        if value > most or value == most > 0 and node.enter < best.enter:
            best, most = node, value
        stack.extend(x for x in node.children if isinstance(x, Node) and x.enter)
    return best


def _pick(root: Node, strict: bool) -> str:
    _clear(root)
    found = blocks(root, strict)
    best = _best(root) if found else None
    if best is None:
        return ""
    around = [x for x in _ancestors(best) if x.tag in ("article", "main")]
    best = next((x for x in around if x.tag == "article"), around[-1] if around else best)
    kept = [best]
    if best.parent:
        least = max(1.0, 0.2 * best.score)
        alike = (lambda x: x.tag == best.tag) if best.tag in KEPT else (lambda x: True)
        kept += [x for x in best.parent.children if isinstance(x, Node) and x.enter and x is not best and alike(x) and _looks_like_text(x, least)]
    spans = sorted((x.enter, x.leave) for x in kept)
    starts = [a for a, _ in spans]

    def inside(node: Node) -> bool:
        i = bisect_right(starts, node.enter) - 1
        return i >= 0 and node.enter <= spans[i][1]

    return "\n".join(text for owner, text in found if inside(owner))


def _clear(root: Node) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.enter = 0
        stack.extend(x for x in node.children if isinstance(x, Node))


def main_text(html: str | None) -> str:
    root = parse(html or "")
    return _pick(root, True) or _pick(root, False)


def extract(html: Column) -> Column:
    """Column of the main text of each page."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p) for block in byte_blocks(pages.to_pylist(), 1 << 20) for p in block], pa.string())

    return text(html)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points), which replace columns of these names; whole pages of any length."""
    return put(put(pages, text=extract(F.col(html_col))), n_chars=F.length("text").cast("long"))
