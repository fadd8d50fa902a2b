"""One pass over a page's markup: containers, and blocks of text with what is known of them.

A small helper of ``bindery.llm.html_extract``: it reads tags in one pass, keeps a stack of
open elements and repairs what pages commonly leave open. It builds no document tree. Time
and memory are in proportion to the page, whatever is left open in it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5
from html import unescape
from itertools import accumulate, takewhile

# Element names by the role HTML gives them.
RAW = set("iframe script style textarea title".split())  # hold no elements: they go on up to their end tag
HIDDEN = set("noscript object select svg template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article body center div html main section td".split())
OUTSIDE = set("aside button dialog footer form head header input label menu nav".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ROLES = set("alert banner complementary contentinfo dialog navigation search".split())
# Words in class names and ids that pages use for what is not the article.
NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead topbar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations trending comment comments reply "
    "replies respond disqus widget pagination pager toolbar".split()
)
QUALIFIED = {"has", "with", "no", "without"}  # what follows them is not what the element is
NAMED_WEIGHT = 0.25  # of prose inside an element that is called by such a word

LONGEST_PATH = 1000

NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
MARK = re.compile("[>\"']")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
SAME = {tag: re.compile(rf"<(/?){tag}(?![\w:-])", re.I) for tag in HIDDEN}
ATTRIBUTE = re.compile(r"\b(class|id|role|href)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _tag_end(html: str, at: int, last: dict[str, int], astray: set[int]) -> int:
    """Position after the first ``>`` outside quotes, -1 if there is none.

    Quotes from which no such ``>`` is reached are kept in ``astray``, so that no other tag follows them again.
    """
    passed = []
    while at <= last[">"]:
        at = MARK.search(html, at).start()
        if html[at] == ">":
            return at + 1
        passed.append(at)
        if at in astray or at == last[html[at]]:
            break
        at = html.find(html[at], at + 1) + 1
    astray.update(passed)
    return -1


def tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, slash of an end tag, name and attributes of all markup; without a name where it has no text and no role.

    An element that hides what it holds is passed over if its end tag comes before another one of its
    kind; otherwise it was left open, and the caller decides where it ends.
    """
    last = {mark: html.rfind(mark) for mark in "<>\"'"}
    astray: set[int] = set()
    at = html.find("<")
    while at >= 0:
        found, end = NAME.match(html, at), -1
        slash, tag, rest = "", "", ""
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3
            end = end if end > 2 else len(html)
        elif found and at < last[">"]:
            slash, tag = found[1], found[2].lower()
            end = _tag_end(html, found.end(), last, astray)
            if end < 0 or tag in RAW and not slash:
                end, rest = html.find(">", found.end()) + 1, ""
                close = RAW_END[tag].search(html, end) if tag in RAW and not slash else None
                end = close.end() if close else len(html) if tag in RAW and not slash else end
                tag = ""
            else:
                rest = html[found.end() : end - 1]
                if tag in HIDDEN and not slash and (near := SAME[tag].search(html, end)) and near[1]:
                    end = html.find(">", near.end()) + 1 or len(html)
                    tag = ""
        elif html.startswith(("<!", "<?", "</"), at) and at < last[">"]:
            end = html.find(">", at + 2) + 1
        if end > 0:
            yield at, end, slash, tag, rest
        at = html.find("<", max(end, at + 1))


@dataclass
class Page:
    """Elements in page order; ``last`` is the last element inside, so subtrees are ranges.

    ``named``: elements that are called by a word for furniture. To what is around them they are
    not prose; they and what they hold are containers of a lower score, for the host to vote on.
    """

    tags: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    prose: list[int] = field(default_factory=list)
    other: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    named: list[bool] = field(default_factory=list)
    within: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _names_furniture(classes: list[str]) -> bool:
    for name in classes:
        parts = [p.lower() for p in PARTS.findall(name)]
        parts = list(takewhile(lambda part: part not in QUALIFIED, parts))
        if parts and (parts[0] in NAMES or parts[-1] in NAMES):
            return True
    return False


def _step(tag: str, classes: list[str]) -> str:
    """One step of a generalised path: the tag and its classes without numbers."""
    kept = sorted({re.sub(r"\d+", "0", c.lower()) for c in classes})
    return ".".join([tag, *kept])


def _path(parent: str, step: str) -> str:
    """A path one step longer; very long ones by their digest, which is as good to compare."""
    path = f"{parent}/{step}"
    return path if len(path) <= LONGEST_PATH else f"#{md5(path.encode('utf-8', 'replace')).hexdigest()}"


def read_page(html: str) -> Page:
    page = Page()
    stack: list[tuple[int, int, bool]] = []  # element, outside the article (2: no text of the page at all), link
    depths: dict[str, list[int]] = defaultdict(list)  # where in the stack a tag is open
    blocks, holders, hidden = [], [], []  # where in the stack elements of these kinds are open
    buffer: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text and stack:
            here = stack[-1][0]
            page.blocks.append((here, text))
            page.prose[here] += max(len(text) - 2 * linked, 0)
            page.other[here] += min(linked, len(text))
        buffer.clear()
        linked = 0

    def open_element(tag: str, classes: list[str], outside: int, link: bool, named: bool = False) -> None:
        above = stack[-1] if stack else (-1, 0, False)
        parent = page.paths[above[0]] if stack else ""
        shown = tag in BLOCK and tag not in SELF_CLOSING or tag == "td"
        page.tags.append(tag)
        page.paths.append(_path(parent, _step(tag, classes)) if shown else parent)
        page.parents.append(above[0])
        page.last.append(len(page.tags) - 1)
        page.prose.append(0)
        page.other.append(0)
        page.size.append(0)
        page.named.append(named)
        for kind, at_depth in ((BLOCK, blocks), (CONTAINER, holders), (HIDDEN, hidden)):
            if tag in kind:
                at_depth.append(len(stack))
        depths[tag].append(len(stack))
        stack.append((len(page.tags) - 1, max(outside, above[1]), link or above[2]))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()[0]
            page.last[element] = len(page.tags) - 1
            depths[page.tags[element]].pop()
        for at_depth in (blocks, holders, hidden):
            while at_depth and at_depth[-1] >= depth:
                at_depth.pop()

    def text_up_to(end: int) -> None:
        nonlocal linked
        if end <= at:
            return
        piece = html[at:end]
        piece = unescape(piece) if "&" in piece else piece
        if not stack:
            if not piece.strip():
                return
            open_element("body", [], 0, False)
        if stack[-1][1] == 2:
            return
        page.size[stack[-1][0]] += len(piece.strip())
        if stack[-1][1]:
            page.other[stack[-1][0]] += len(piece.strip())
            return
        buffer.append(piece)
        if stack[-1][2]:
            linked += len(piece.strip())

    for start, end, slash, tag, rest in tags(html):
        text_up_to(start)
        at = end
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if slash:
            # A stray end tag closes nothing beyond its block.
            bounds = blocks if tag not in BLOCK else holders if tag in SELF_CLOSING else []
            if depths[tag] and not (bounds and bounds[-1] > depths[tag][-1]):
                pop_to(depths[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            if hidden:
                pop_to(hidden[0])  # left open: it ends where the page goes on
            if blocks and page.tags[stack[blocks[-1]][0]] in (*SELF_CLOSING.get(tag, ()), "p"):
                pop_to(blocks[-1])
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest else {}
        classes = found.get("class", "").split()
        outside = 2 if tag in HIDDEN else int(tag in OUTSIDE or found.get("role", "").lower() in ROLES)
        named = tag not in ("html", "body", "main", "article") and bool(found) and _names_furniture(classes + [found.get("id", "")])
        if tag not in BLOCK:
            outside, named = max(outside, int(named)), False
        if not stack and tag not in ("html", "body", "head"):
            open_element("body", [], 0, False)
        if not rest.endswith("/"):
            open_element(tag, classes, outside, tag == "a" and "href" in found, named)
    text_up_to(len(html))
    flush()
    pop_to(0)
    _spare_articles(page)
    for n in range(len(page.tags) - 1, 0, -1):
        above = page.parents[n]
        if above >= 0:
            page.prose[above] += 0 if page.named[n] else page.prose[n]
            page.other[above] += page.size[n] if page.named[n] else page.other[n]
            page.size[above] += page.size[n]
    for n, above in enumerate(page.parents):
        page.within.append(page.named[n] or above >= 0 and page.within[above])
    return page


def _spare_articles(page: Page) -> None:
    """Elements around an article or main with most of the page's prose are not furniture, whatever they are called."""
    if not any(page.named):
        return
    whole = list(page.prose)
    for n in range(len(whole) - 1, 0, -1):
        if page.parents[n] >= 0:
            whole[page.parents[n]] += whole[n]
    total = sum(w for w, above in zip(whole, page.parents) if above < 0)
    spared: set[int] = set()
    for n, tag in enumerate(page.tags):
        if tag in ("article", "main") and 2 * whole[n] > total:
            while n >= 0 and n not in spared:
                page.named[n] = False
                spared.add(n)
                n = page.parents[n]


def containers(page: Page) -> list[tuple[float, int]]:
    """Score and element of every container with text: its prose less half of what is not."""
    return [
        (page.prose[n] * (NAMED_WEIGHT if page.within[n] else 1) - page.other[n] / 2, n)
        for n, tag in enumerate(page.tags) if tag in CONTAINER and (page.prose[n] or page.other[n])
    ]


def text_below(page: Page, *elements: int) -> str:
    """The blocks inside elements, one line each, without lists that are menus and furniture by name.

    Elements come in page order, none inside another.
    """
    items = list(accumulate((tag == "li" for tag in page.tags), initial=0))
    lines, left = [], []  # ranges of elements that are left out, in order and apart
    for element in elements:
        for n in range(element, page.last[element] + 1):
            if left and n <= left[-1][1]:
                continue
            menu = page.tags[n] in ("ul", "ol") and page.prose[n] * 9 < page.other[n] and items[page.last[n] + 1] - items[n] >= 3
            if menu or n > element and page.named[n]:
                left.append((n, page.last[n]))
    for holder, text in page.blocks:
        around = bisect_right(elements, holder) - 1
        if around >= 0 and holder <= page.last[elements[around]]:
            near = bisect_right(left, (holder, len(page.tags))) - 1
            if near < 0 or holder > left[near][1]:
                lines.append(text)
    return "\n".join(lines)
