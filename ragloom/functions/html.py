"""HTML of one page: tokens, a stack of open elements, and what is folded over it: nodes and Markdown.

These are the small row functions behind ``operators.page_tree`` and
``operators.page_markdown``. A page is read once, from left to right, in time
linear in its length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Comments, tags (quoted values never reach past the next "<"), declarations.
TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/<>]*)(?P<attrs2>[^<>]*)>|<[!?/][^>]*>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no markup: of the first two it isn't text either.
RAW = ("script", "style", "title", "textarea")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
BLOCKS = "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
CELLS = frozenset(("td", "th"))
#: A start tag ends these open elements, unless one of the barriers is in between.
_IN_FLOW = (frozenset(("p",)), frozenset(("td", "th", "table", "caption", "button", "object")))
IMPLIED = {tag: _IN_FLOW for tag in BLOCKS} | {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "tbody": (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot")), frozenset(("table",))),
    "thead": (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("tr", "td", "th", "thead", "tbody", "tfoot")), frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset()),
}
#: End tags of other elements don't reach out of a cell or a table.
_SCOPE = frozenset(("td", "th", "caption", "table"))
_TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption html body".split())


@dataclass(frozen=True)
class Event:
    """An element opens or closes, or a piece of text: from ``start`` to ``stop`` in the page.

    ``tag`` is empty for text; ``attrs`` is set when an element opens. Text in
    scripts and styles is ``raw``.
    """

    kind: str
    start: int
    stop: int
    tag: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""
    raw: bool = False


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def events(page: str) -> Iterator[Event]:
    """What a page opens, says and closes. Every open element closes: by its end tag, by one that implies it, or at the end."""
    stack: list[str] = []
    count: Counter = Counter()  # of open elements, so that most searches need no look at the stack

    def close_from(i: int, start: int, stop: int) -> Iterator[Event]:
        while len(stack) > i:
            tag = stack.pop()
            count[tag] -= 1
            yield Event("close", start, stop if len(stack) == i else start, tag)

    def text(a: int, b: int, raw: bool = False, plain: bool = False) -> Iterator[Event]:
        if b > a:
            yield Event("text", a, b, text=page[a:b] if raw or plain else entities.unescape(page[a:b]), raw=raw)

    at = 0
    while m := TOKEN.search(page, at):
        yield from text(at, m.start())
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if count[tag]:
                i = len(stack) - 1
                while stack[i] != tag and (tag in _TABLE_PARTS or stack[i] not in _SCOPE):
                    i -= 1
                if stack[i] == tag:
                    yield from close_from(i, m.start(), at)
            continue
        closing, barriers = IMPLIED.get(tag, (frozenset(), frozenset()))
        if any(count[t] for t in closing):
            i, outer = len(stack) - 1, None
            while i >= 0 and stack[i] not in barriers:
                if stack[i] in closing:
                    outer = i
                i -= 1
            if outer is not None:
                yield from close_from(outer, m.start(), m.start())
        attrs = attributes(m["attrs"] or m["attrs2"] or "")
        yield Event("open", m.start(), at, tag, attrs)
        if tag in VOID:
            yield Event("close", at, at, tag)
        elif tag in RAW:
            end = _RAW_END[tag].search(page, at)
            upto, after = (end.start(), end.end()) if end else (len(page), len(page))
            yield from text(at, upto, raw=tag in RAW[:2])
            yield Event("close", upto, after, tag)
            at = after
        else:
            stack.append(tag)
            count[tag] += 1
    yield from text(at, len(page))
    yield from close_from(0, len(page), len(page))


NODE = "pre int, end int, parent int, depth int, tag string, class string, ident string, role string, text string, linked boolean, start int, stop int"


def nodes(page: str) -> list[tuple]:
    """Elements and texts in order of their start; ``end`` is the last node inside, ``start`` and ``stop`` are places in the page.

    Texts have the tag ``#text``; those of scripts and styles are left out.
    ``linked`` texts stand in a link.
    """
    rows: list[list] = []
    open_: list[int] = []
    links = 0
    for e in events(page):
        parent = open_[-1] + 1 if open_ else 0
        if e.kind == "open":
            links += e.tag == "a"
            a = e.attrs
            rows.append([len(rows) + 1, 0, parent, len(open_) + 1, e.tag, a.get("class", ""), a.get("id", ""), a.get("role", ""), "", False, e.start, 0])
            open_.append(len(rows) - 1)
        elif e.kind == "text":
            if not e.raw:
                rows.append([len(rows) + 1, len(rows) + 1, parent, len(open_) + 1, "#text", "", "", "", e.text, links > 0, e.start, e.stop])
        else:
            row = rows[open_.pop()]
            links -= e.tag == "a"
            row[1], row[-1] = len(rows), e.stop
    return [tuple(r) for r in rows]


# Marks with a meaning in Markdown, words of header cells and of links that turn pages.
ESCAPED = "\\`*_{}[]()#+-!|"
LINK_ESCAPED = "\\[]"
HEADER_WORDS = (
    "nome", "name", "title", "titolo", "indirizzo", "address", "addr", "telefono", "phone", "tel", "cellulare", "email", "mail", "e-mail",
    "descrizione", "description", "desc", "servizio", "service", "ufficio", "office", "categoria", "category", "cat",
)
TURNING = ("precedente", "successivo", "previous", "next")
BLANK = " \t\n\r\0\x0b"
#: Elements that are skipped where a sibling has the version for large screens; named ones never are.
NAMED = frozenset("a strong b em i h1 h2 h3 h4 h5 h6 p br li ul ol blockquote code pre table tr td th".split())
_ESCAPES = str.maketrans({c: "\\" + c for c in ESCAPED})
_LINK_ESCAPES = str.maketrans({c: "\\" + c for c in LINK_ESCAPED})
_STOP = re.compile(r"\.(?!\d)")
_RUN = re.compile(r"[ \t\n\r\f\v]+")
_ORIGIN = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]+)([^?#]*)")


def escaped(text: str) -> str:
    return _STOP.sub(r"\\.", text.translate(_ESCAPES))


def absolute(href: str, base: str) -> str:
    """An address as seen from the page ``base``: itself, below the host or below the page's folder; https where the page is."""
    page = _ORIGIN.match(base or "")
    whole = _ORIGIN.match(href)
    if whole:
        same = page and page[1] == "https" and whole[1] == "http" and page[2] == whole[2]
        return "https" + href[4:] if same else href
    if not page or re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", href):
        return href
    if href.startswith("//"):
        return f"{page[1]}:{href}"
    if href.startswith("/"):
        return f"{page[1]}://{page[2]}{href}"
    return f"{page[1]}://{page[2]}{page[3].rpartition('/')[0]}/{href}"


def _falsy(text: str) -> bool:
    """Empty, or a lone zero: both count as nothing in cells and links."""
    return text in ("", "0")


class _Frame:
    """An open element: its Markdown so far, and where its plain text begins."""

    __slots__ = ("tag", "attrs", "parts", "plain", "cells", "rows", "desktop")

    def __init__(self, tag: str, attrs: dict[str, str], plain: int):
        self.tag, self.attrs, self.plain = tag, attrs, plain
        self.parts: list = []
        self.cells: list[tuple[str, str]] = []
        self.rows: list[tuple[str, int]] = []
        self.desktop = 0  # children for large screens

    def inner(self) -> str:
        """Parts joined; those for small screens only where no sibling is for large ones."""
        return "".join(p if isinstance(p, str) else p[0] for p in self.parts if isinstance(p, str) or self.desktop <= p[1])


def _link(frame: _Frame, text: str, base: str) -> str:
    href, title = frame.attrs.get("href", ""), frame.attrs.get("title", "")
    label = text.translate(_LINK_ESCAPES)
    if _falsy(href):
        return label
    if href.startswith("javascript:"):
        if _falsy(text):
            return ""
        return f"**{label}**" if re.fullmatch(r"[0-9]+", text) or text.lower() in TURNING else label
    to = absolute(href, base)
    label = to if _falsy(text) else label
    return f'[{label}]({to} "{title.translate(_LINK_ESCAPES)}")' if not _falsy(title) else f"[{label}]({to})"


def _cells(cells: list[tuple[str, str]]) -> list[str]:
    """The cells of a row: for large screens if it tells screens apart, else all; empty ones are a dash."""
    if any("hidden-xs" in c or "visible-xs" in c for _, c in cells):
        cells = [x for x in cells if "hidden-xs" in x[1]] or [x for x in cells if "visible-xs" not in x[1]]
    texts = (_RUN.sub(" ", text.strip(BLANK)) for text, _ in cells)
    return ["-" if _falsy(t) else t for t in texts]


def is_header(cells: list[str]) -> bool:
    """At least half of the cells hold a word of headers."""
    plain = [re.sub(r"<[^>]*>", "", c).strip(BLANK).lower() for c in cells]
    return sum(any(w in c for w in HEADER_WORDS) for c in plain) * 2 >= len(cells) > 0


def _separator(n: int) -> str:
    return "| " + " | ".join(["---"] * n) + " |"


def _row(cells: list[str]) -> str:
    return f"| {' | '.join(cells)} |"


def _closed(frame: _Frame, plain: list[str], tables: list[_Frame], base: str) -> str:
    """The Markdown of an element whose children are done."""
    tag, inner = frame.tag, frame.inner()
    if tag == "a":
        return _link(frame, "".join(plain[frame.plain :]).strip(BLANK), base)
    if tag in ("strong", "b"):
        return f"**{inner}**"
    if tag in ("em", "i"):
        return f"*{inner}*"
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return f"\n\n{'#' * int(tag[1])} {inner}\n\n"
    if tag == "p":
        return f"\n\n{inner}\n\n"
    if tag == "br":
        return "  \n"
    if tag == "li":
        return f"\n- {inner}"
    if tag in ("ul", "ol"):
        return f"\n{inner}\n"
    if tag == "blockquote":
        return "\n\n" + "\n".join("> " + x for x in inner.strip(BLANK).split("\n")) + "\n\n"
    if tag == "code":
        return f"`{''.join(plain[frame.plain :])}`"
    if tag == "pre":
        return f"\n\n```\n{''.join(plain[frame.plain :])}\n```\n\n"
    if tag == "table":
        rows = frame.rows
        return "\n\n" + "\n".join([rows[0][0], _separator(rows[0][1]), *(r for r, _ in rows[1:])]) + "\n\n" if rows else ""
    if tag == "tr":
        cells = _cells(frame.cells)
        if not cells:
            return ""
        if tables:
            tables[-1].rows.append((_row(cells), len(cells)))
        return "\n" + _row(cells) + ("\n" + _separator(len(cells)) if is_header(cells) else "")
    return inner


def to_markdown(page: str | None, base: str = "") -> str | None:
    """The body of a page (all of it, if it has none) as Markdown; null stays null.

    One fold over the open elements: each closes into a piece of its parent.
    """
    if page is None:
        return None
    stack, plain, tables, body = [_Frame("", {}, 0)], [], [], None
    for e in events(page):
        if e.kind == "text":
            plain.append(e.text)
            if not e.raw:
                stack[-1].parts.append(escaped(e.text))
        elif e.kind == "open":
            stack.append(_Frame(e.tag, e.attrs, len(plain)))
            if e.tag == "table":
                tables.append(stack[-1])
        else:
            frame = stack.pop()
            if tables and tables[-1] is frame:
                tables.pop()
            text, parent, css = _closed(frame, plain, tables, base), stack[-1], frame.attrs.get("class", "")
            large = "hidden-xs" in css
            parent.desktop += large
            if frame.tag in CELLS:
                parent.cells.append((text, css))
            if frame.tag == "body" and body is None:
                body = text
            # a duplicate for small screens is told from its siblings, which may still follow
            parent.parts.append((text, int(large)) if "visible-xs" in css and frame.tag not in NAMED else text)
    return stack[0].inner() if body is None else body
