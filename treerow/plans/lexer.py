"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import ParseError

#: Words that are never identifiers.
KEYWORDS = frozenset(
    "SELECT FROM WHERE AND OR IN EXISTS DOCUMENT LIMIT EXCLUDE ORDER BY ASC DESC AS TO LIST COUNT TABLE CSV PARQUET RAW FRAGMENTS "
    "CONTAINS HAS_DIRECT_TEXT ALL ANY IS NOT NULL SHOW DESCRIBE INPUT INPUTS FUNCTIONS AXES OPERATORS".split()
)
_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<string>'[^']*(?:'|\Z)|\"[^\"]*(?:\"|\Z))|(?P<number>[0-9]+)|(?P<word>[A-Za-z_][A-Za-z0-9_-]*)|(?P<sign><>|!=|[=~*,.();])"
)


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, id, string, number, sign, end
    text: str  # upper case for keywords; without quotes for strings
    at: int


def tokenize(sql: str) -> list[Token]:
    """Strings take either quote, have no escapes, and may lack the closing quote at the end of the statement."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected character {sql[at]!r}", at)
        kind, text = m.lastgroup, m[0]
        if kind == "string":
            out.append(Token("string", text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:], at))
        elif kind == "word":
            upper = text.upper()
            out.append(Token("keyword", upper, at) if upper in KEYWORDS else Token("id", text, at))
        elif kind != "space":
            out.append(Token(kind, "<>" if text == "!=" else text, at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]
