"""One HTML page as blocks of text and hashes of its element subtrees."""

from __future__ import annotations

import hashlib
import html
import re
from typing import NamedTuple

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>"
    r"|<[!?][^<>]*>",
    re.S,
)
_CUT_OFF = re.compile(r"<[/!a-zA-Z][^<>]*\Z")
_NAMED = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
_SKIPPED = set("script style noscript template textarea title svg math iframe object select button canvas".split())
# Of these the next one ends an open one.
_CLOSES = {
    name: re.compile(rf"<(/{'?' if name in ('button', 'select') else ''}){name}\b[^<>]*>", re.I) for name in _SKIPPED
}
# Without an end, these run to the end of the page.
_TO_THE_END = set("script style textarea title".split())
_INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption figure".split())
_COUNTED = set("div section nav header footer aside form ul ol dl table center details dialog fieldset".split())
# Elements that say what they are, and words of class, id and role that say so.
_APART = set("nav footer aside dialog".split())
_APART_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo banner cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe signup sidebar menu navbar nav navigation breadcrumb breadcrumbs comment "
    "comments disqus replies reply related share sharing social widget pagination toolbar login search complementary "
    "contentinfo alert".split()
)
# Names of the state of something else, as "has-sidebar" or "comment-open".
_STATE = re.compile(r"(?:has|no|not|with|without)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled)")
# Outside the article also these.
_OUTSIDE_WORDS = set("header footer masthead topbar".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS_ITEMS = set("ul ol dl table tbody thead tfoot article main section div body".split())


class Block(NamedTuple):
    text: str
    owners: list[int]  # hashes of the counted subtrees around it


class Page(NamedTuple):
    blocks: list[Block]
    units: list[int]  # hashes of all counted subtrees of the page
    digest: int  # of all its text


# Whether an element is no main text: surely, or by its name, which wrappers of the whole page have too.
_NOT, _NAMED_APART, _SURELY = range(3)


class _Element:
    __slots__ = ("tag", "above", "parts", "dropped", "main", "article", "inside", "hash", "holds_chosen", "text", "size", "apart")

    def __init__(self, tag: str, above: _Element | None):
        self.tag, self.above, self.parts, self.hash, self.text, self.size = tag, above, [], 0, False, 0
        self.inside = self.holds_chosen = False
        self.apart = _NOT
        self.dropped = above is not None and above.dropped
        self.article = above is not None and above.article
        self.main = above is not None and above.main


def _chosen(elements: list[_Element], title: _Element | None) -> list[_Element]:
    """The articles, else the ``main``, if they hold the story; none if it stands elsewhere.

    Sidebars and readers' comments mark their entries as articles too, so the mark alone says nothing: one of them must
    hold the page's only h1 or, without such, most of the text around.
    """
    around = _around(title)
    area = elements[0].size
    found: list[_Element] = []
    for mark in ("main", "article"):
        # The outermost ones with text that is not dropped; of the articles only those in the main text, if that is known.
        marked = [e for e in elements if e.size and getattr(e, mark) and not getattr(e.above, mark) and (not found or e.main)]
        if any(e in around if around else 2 * e.size > area for e in marked):
            found, area = marked, sum(e.size for e in marked)
    return found


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _set_apart(element: _Element, attributes: str) -> int:
    tag = element.tag
    if tag in _APART or tag == "head":
        return _SURELY
    apart = _NAMED_APART if tag == "form" or (tag == "header" and not element.article) else _NOT
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return apart
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return _SURELY
        if name == "style":
            if re.search(r"display\s*:\s*none", value):
                return _SURELY
            continue
        names = [n for n in value.split() if not _STATE.fullmatch(n)]
        words = set(re.split(r"[^a-z0-9]+", " ".join(names)))
        if words & _APART_WORDS or (not element.article and words & _OUTSIDE_WORDS):
            apart = _NAMED_APART
    return apart


def _measure(elements: list[_Element], found: list[tuple[str, _Element]]) -> None:
    """The characters of each element that are not dropped."""
    for element in elements:
        element.size = 0
    for text, element in found:
        if not element.dropped:
            element.size += len(text)
    for element in reversed(elements[1:]):
        element.above.size += element.size


def _around(element: _Element | None) -> set[_Element]:
    around = set()
    while element is not None:
        around.add(element)
        element = element.above
    return around


def _drop_named(elements: list[_Element], found: list[tuple[str, _Element]]) -> _Element | None:
    """Drop what is set apart by its name, unless it holds most of the page's text or its only heading.

    The only h1 is returned, unless it stands in a part that only its own presence saved.
    """
    _measure(elements, found)
    headings = [e for e in elements if e.tag in _HEADINGS and e.size]
    titles = [e for e in headings if e.tag == "h1"] or headings
    title = titles[0] if len(titles) == 1 else None
    around, half, saved = _around(title), elements[0].size / 2, False
    for element in elements[1:]:
        element.dropped |= element.above.dropped
        if element.apart == _NAMED_APART and not element.dropped and element.size <= half:
            element.dropped = element not in around
            saved |= element in around
    _measure(elements, found)
    return title if title is not None and title.tag == "h1" and not saved else None


def read_page(source: str | None) -> Page:
    """Blocks of the article (of ``main``, or of the whole page, if neither holds the story) in page order."""
    source = source or ""
    root = _Element("body", None)
    stack, found, elements = [root], [], [root]
    line: list[str] = []
    endless: set[str] = set()

    def flush() -> None:
        if not line:
            return
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            top = stack[-1]
            top.parts.append(text.encode("utf-8", "replace"))
            found.append((text, top))

    def close(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            element.hash = _number(b"\0".join([element.tag.encode(), *element.parts]))
            element.text = element.text or bool(element.parts)
            if element.parts:
                stack[-1].parts.append(element.hash.to_bytes(8, "little", signed=True))

    at = 0
    while True:
        match = _TAG.search(source, at)
        text = source[at : match.start()] if match else _CUT_OFF.sub("", source[at:])
        if text:
            line.append(text)
        if not match:
            break
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if tag in _INLINE:
            continue
        if tag == "br":
            line.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if match[1]:
            if tag in _SKIPPED:
                continue
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        if tag in _SKIPPED:
            # Their end is looked for as it stands; without one, only the tag itself is skipped.
            line.append(" ")
            if tag in ("svg", "math") and match[3].endswith("/"):
                continue
            end = None if tag in endless else _CLOSES[tag].search(source, at)
            if end and end[1]:
                at = end.end()
            elif end is None:
                if tag in _TO_THE_END:
                    break
                endless.add(tag)
            continue
        if tag in ("html", "body"):
            flush()
            continue
        flush()
        # Tags that may be left out: a block ends an open paragraph, an item the one before it.
        for depth in range(len(stack) - 1, 0, -1):
            open_tag = stack[depth].tag
            if open_tag == "p" or open_tag in _CLOSED_BY.get(tag, ()) or (open_tag == "head"):
                close(depth)
                break
            if open_tag in _HOLDS_ITEMS:
                break
        element = _Element(tag, stack[-1])
        if tag == "article":
            element.article = True
        elif tag == "main" or re.search(r"\brole\s*=\s*[\"']?main\b", match[3], re.I):
            element.main = True
        element.apart = _set_apart(element, match[3])
        element.dropped = element.dropped or element.apart == _SURELY
        stack.append(element)
        elements.append(element)
    flush()
    close(1)

    chosen = _chosen(elements, _drop_named(elements, found))
    for element in chosen:
        element.inside, above = True, element
        while above is not None and not above.holds_chosen:
            above.holds_chosen, above = True, above.above
    for element in elements[1:]:
        element.inside |= element.above.inside

    def counted(e: _Element) -> bool:
        if e is root or e.holds_chosen or not e.text:
            return False
        return e.tag in _COUNTED or ((e.tag in _PROSE or e.tag == "article") and not e.inside)

    def owners(e: _Element | None) -> list[int]:
        around = []
        while e is not None:
            if counted(e):
                around.append(e.hash)
            e = e.above
        return around[::-1]

    blocks = [Block(text, owners(e)) for text, e in found if not e.dropped and (not chosen or e.inside)]
    digest = _number(b"\0".join(root.parts))
    return Page(blocks, sorted({e.hash for e in elements if counted(e)}), digest)
