"""A recovering HTML tree: tags, attributes, order and intervals of every element of a page."""

from __future__ import annotations

import html as _html
import re

from ..functions.markup import INLINE, VOID, collapse_ws, trim_ws

_NAME = r"[A-Za-z][^\s/>]*"
_TOKEN = re.compile(
    rf"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|(?P<skip><[!?][^>]*(?:>|\Z))|</(?P<close>{_NAME})[^>]*(?:>|\Z)"
    rf"|<(?P<open>{_NAME})(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_ATTR = re.compile(r"([^\s/=>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW_TEXT = ("script", "style")
#: Elements that end an open paragraph.
BLOCK = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: For an element: what it ends, and the elements that keep an outer one from being ended.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}


class Decoded(str):
    """Text whose character references are decoded, with its source."""

    __slots__ = ("source",)

    def __new__(cls, source: str):
        self = super().__new__(cls, _html.unescape(source))
        self.source = source
        return self


class Element:
    __slots__ = ("attributes", "children", "end", "height", "id", "level", "parent", "position", "tag")

    def __init__(self, id_, tag, attributes, parent, position):
        self.id, self.tag, self.attributes, self.parent, self.position = id_, tag, attributes, parent, position
        self.children: list = []  # elements, text (str) and comments (tuple of one)
        self.end, self.height, self.level = id_, 0, 0 if parent is None else parent.level + 1


def parse(parts: list[str]) -> list[Element]:
    """All elements of the markups in preorder; ids run on from one markup to the next, each has roots of its own.

    Void elements don't nest. An end tag closes up to the nearest open element of its name and is ignored
    without one. A block's start tag ends an open paragraph that only inline elements separate from it;
    list items, table rows and cells, and options end their like. What is open at the end is closed there.
    Null and empty markups have no elements. Names are lower-cased, an attribute without value is empty,
    of repeated attributes the first counts.
    """
    out: list[Element] = []
    for markup in parts:
        _one(markup or "", out)
    for e in reversed(out):
        if e.parent is not None:
            up = e.parent
            up.end, up.height = max(up.end, e.end), max(up.height, e.height + 1)
    return out


def _one(markup: str, out: list[Element]) -> None:
    stack: list[Element] = []
    counts: list[int] = []  # child elements so far of each open element
    at, size, match = 0, len(markup), _TOKEN.match
    while at < size:
        m = match(markup, at)
        at, kind = m.end(), m.lastgroup
        if kind == "text" or kind == "cdata":
            if stack:
                stack[-1].children.append(Decoded(m[0]) if kind == "text" and "&" in m[0] else m[kind])
        elif kind == "close":
            name = m["close"].lower()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == name:
                    del stack[k:], counts[k:]
                    break
        elif kind == "attrs" or kind == "open":
            name = m["open"].lower()
            if stack:
                _end_implied(name, stack, counts)
            attributes: dict[str, str] = {}
            raw = m["attrs"]
            if raw:
                for a in _ATTR.finditer(raw):
                    value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""
                    attributes.setdefault(a[1].lower(), _html.unescape(value) if "&" in value else value)
            parent = stack[-1] if stack else None
            if parent is not None:
                counts[-1] += 1
            e = Element(len(out), name, attributes, parent, counts[-1] if parent is not None else 1)
            out.append(e)
            if parent is not None:
                parent.children.append(e)
            if name in RAW_TEXT:
                stop = re.compile(rf"</{name}\s*>", re.I).search(markup, at)
                if body := markup[at : stop.start() if stop else size]:
                    e.children.append(body)
                at = stop.end() if stop else size
            elif name not in VOID and not (raw or "").rstrip().endswith("/"):
                stack.append(e)
                counts.append(0)
        elif kind == "comment" and stack:
            stack[-1].children.append((m["comment"],))


def _end_implied(name: str, stack: list[Element], counts: list[int]) -> None:
    if name in BLOCK:
        k = len(stack) - 1
        while k >= 0 and stack[k].tag in INLINE:
            k -= 1
        if k >= 0 and stack[k].tag == "p":
            del stack[k:], counts[k:]
    if name in ENDS:
        ended, bounds = ENDS[name]
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in bounds:
                break
            if stack[k].tag in ended:
                del stack[k:], counts[k:]
                break


def _walk(e: Element):
    """Pieces of e's content in order: (kind, value), kind text, comment, open or close. No recursion: trees may be deep."""
    todo = [iter(e.children)]
    opened = [e]
    while todo:
        for c in todo[-1]:
            if isinstance(c, str):
                yield "text", c, opened[-1]
            elif isinstance(c, tuple):
                yield "comment", c[0], opened[-1]
            else:
                yield "open", c, opened[-1]
                todo.append(iter(c.children))
                opened.append(c)
                break
        else:
            todo.pop()
            done = opened.pop()
            if todo:
                yield "close", done, opened[-1]


def text(e: Element) -> str:
    return "".join(v for kind, v, _ in _walk(e) if kind == "text")


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def inner_html(e: Element, plain=escape) -> str:
    """The content, normalised: double-quoted attributes, no end tags of void elements, entities encoded again (or text as ``plain`` has it)."""
    out = []
    for kind, v, up in _walk(e):
        if kind == "text":
            out.append(v if up.tag in RAW_TEXT else plain(v))
        elif kind == "comment":
            out.append(f"<!--{v}-->")
        elif kind == "open":
            out.append(f"<{v.tag}" + "".join(f' {k}="{_html.escape(x, quote=False).replace(chr(34), "&quot;")}"' for k, x in v.attributes.items()) + ">")
        elif v.tag not in VOID:
            out.append(f"</{v.tag}>")
    return "".join(out)


def _as_written(s: str) -> str:
    """References to the characters of markup, and unknown ones, stay as in the source; all others are decoded."""
    if isinstance(s, Decoded):
        s = _REFERENCE.sub(lambda m: m[0] if (x := _html.unescape(m[0]))[0] in "&<>\"" else x, s.source)
    return s.replace("<", "")


def written_html(e: Element) -> str:
    """As inner_html, but for words: what the source writes as &quot; or &am isn't encoded anew, a "<" that begins no tag is left out."""
    return inner_html(e, _as_written)


def direct_text(e: Element, strict: bool = False) -> str:
    """As the scanner of that name finds it in inner_html, without writing that first."""
    out, closed = [], 0
    for kind, v, up in _walk(e):
        if kind == "text":
            if not closed:
                out.append(v if up.tag in RAW_TEXT else escape(v))
        elif kind != "comment" and v.tag not in VOID and (strict or v.tag not in INLINE):
            closed += 1 if kind == "open" else -1
    return "".join(out)


def flat_text(e: Element) -> str:
    return collapse_ws(direct_text(e, strict=True)) or collapse_ws(direct_text(e))


def grid(e: Element) -> list[list[str]]:
    """A table's rows of trimmed cell texts: each row found from the table, not inside another; its cells likewise."""

    def found(top: Element, names: tuple) -> list[Element]:
        out, todo = [], [c for c in reversed(top.children) if isinstance(c, Element)]
        while todo:
            c = todo.pop()
            if c.tag in names:
                out.append(c)
            else:
                todo += [x for x in reversed(c.children) if isinstance(x, Element)]
        return out

    rows = ([trim_ws(text(c)) for c in found(r, ("td", "th"))] for r in found(e, ("tr",)))
    return [r for r in rows if r]
