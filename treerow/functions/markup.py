"""Scanners over serialised markup. Pure functions of strings, with Spark wrappers in ``register``."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

# Elements without content, and elements that text flows through.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em i kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr".split())
# Elements whose white space is kept.
PRESERVE = frozenset("pre code textarea script style".split())

SPACE = " \t\n\v\f\r"
_RUN = re.compile(f"[{SPACE}]+")
#: A comment, a tag (quoted ">" don't end it), or text. An unterminated comment or tag runs to the end.
_PART = re.compile(r"(?P<comment><!--.*?(?:-->|\Z))|(?P<tag><(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)|(?P<broken><.*\Z)|(?P<text>[^<]+)", re.S)
_NAME = re.compile(r"</?\s*([A-Za-z0-9_:-]+)")


def _parts(html: str, only: int | None = None):
    """(kind, piece, name): kind is comment, text, broken, open, close, single (void or self-closed) or other; ``only`` the piece at a place."""
    for m in _PART.finditer(html) if only is None else [_PART.match(html, only)]:
        kind, piece = m.lastgroup, m[0]
        if kind != "tag":
            yield kind, piece, ""
            continue
        named = _NAME.match(piece)
        name = named[1].lower() if named else ""
        if piece.startswith("</"):
            yield "close", piece, name
        elif not name:
            yield "other", piece, name
        else:
            yield ("single" if piece.endswith("/>") or name in VOID else "open"), piece, name


def direct_text(html: str, strict: bool = False) -> str:
    """Text outside nested elements; unless strict, inline elements are transparent. Entities stay encoded."""
    depth, out = 0, []
    for kind, piece, name in _parts(html):
        if kind == "broken":
            break
        if kind == "text" and depth == 0:
            out.append(piece)
        elif kind in ("open", "close") and (strict or name not in INLINE):
            depth = max(0, depth + (1 if kind == "open" else -1))
    return "".join(out)


def limit_html(html: str, depth: int) -> str:
    """Markup down to ``depth`` levels of elements; text stays at any level, deeper tags and comments go."""
    at, out = 0, []
    for kind, piece, _ in _parts(html):
        if kind == "open":
            at += 1
            keep = at <= depth
        elif kind == "close":
            keep = at <= depth
            at = max(0, at - 1)
        elif kind == "single":
            keep = at + 1 <= depth
        else:
            keep = kind in ("text", "broken") or at <= depth
        if keep:
            out.append(piece)
    return "".join(out)


def minify_html(html: str) -> str:
    """White space in text collapses to one space; text of white space beside a tag or comment goes; preserved elements stay."""
    out, after_tag, at = [], False, 0
    while at < len(html):
        ((kind, piece, name),) = _parts(html, at)
        at += len(piece)
        if kind == "text":
            short = _RUN.sub(" ", piece)
            if short == " " and (after_tag or at < len(html)):
                continue
            out.append(short)
            after_tag = False
            continue
        out.append(piece)
        after_tag = True
        if kind == "open" and name in PRESERVE:  # what looks like a tag inside is none: only the end tag of this name counts
            end = re.compile(rf"</\s*{name}(?![A-Za-z0-9_:-])", re.I).search(html, at)
            stop = end.start() if end else len(html)
            out.append(html[at:stop])
            at = stop
    return "".join(out)


def trim_ws(s: str) -> str:
    return s.strip(SPACE)


def collapse_ws(s: str) -> str:
    return _RUN.sub(" ", s).strip(" ")


def flat_text(html: str) -> str:
    """The value FLATTEN takes from an element: its own text, else that with inline elements transparent."""
    return collapse_ws(direct_text(html, strict=True)) or collapse_ws(direct_text(html))


#: What TFIDF removes before it splits words: comments, script, style and noscript (any name that begins so, up to the exact end tag) with content, all tags.
MARKUP = r"(?is)<!--.*?(-->|\z)|<script.*?(</script>|\z)|<style.*?(</style>|\z)|<noscript.*?(</noscript>|\z)|<[^>]*(>|\z)"


def register(spark) -> None:
    """The scanners as SQL functions, in Arrow batches: direct_text, direct_text_strict, limit_html, minify_html, flat_text."""
    def one(fn):
        def apply(s: pd.Series) -> pd.Series:
            return s.map(fn, na_action="ignore")

        return F.pandas_udf(apply, "string")

    def limited(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else limit_html(x, int(k)) for x, k in zip(s, d, strict=True)], dtype=object)

    for name, fn in (("direct_text", direct_text), ("direct_text_strict", lambda s: direct_text(s, strict=True)), ("minify_html", minify_html), ("flat_text", flat_text)):
        spark.udf.register(name, one(fn))
    spark.udf.register("limit_html", F.pandas_udf(limited, "string"))
