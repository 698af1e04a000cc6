"""What a statement says, as immutable values."""

from __future__ import annotations

from dataclasses import dataclass

AXES = ("self", "parent", "child", "ancestor", "descendant")
INT_FIELDS = ("node_id", "parent_id", "sibling_pos", "max_depth", "doc_order")


@dataclass(frozen=True)
class Operand:
    """A field of the nodes on an axis: an INT_FIELDS name, tag, text, attributes (the map), or attribute (one, by name)."""

    field: str
    name: str = ""
    axis: str = "self"
    qualifier: str | None = None


@dataclass(frozen=True)
class Compare:
    operand: Operand
    op: str  # = <> in ~ contains contains_all contains_any is_null is_not_null
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class DirectText:
    tag: str
    value: str


@dataclass(frozen=True)
class Exists:
    axis: str
    where: Expr | None


@dataclass(frozen=True)
class Logic:
    op: str  # and, or
    left: Expr
    right: Expr


Expr = Compare | DirectText | Exists | Logic


@dataclass(frozen=True)
class Item:
    """kind: tag, field, text, inner_html, raw_inner_html, flatten, count, summarize, tfidf."""

    kind: str
    tag: str = ""
    field: str = ""
    depth: int | None = None
    trim: bool = False
    names: tuple[str, ...] = ()  # aliases of flatten, tags of tfidf
    options: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Source:
    kind: str  # document, name, location, raw, fragments
    value: str = ""
    alias: str | None = None
    query: Query | None = None


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Sink:
    kind: str  # list, table, csv, parquet
    path: str | None = None
    header: bool = True


@dataclass(frozen=True)
class Query:
    kind: str = "select"  # select, or a meta statement such as "show functions"
    items: tuple[Item, ...] = ()
    exclude: tuple[str, ...] = ()
    source: Source = Source("document")
    where: Expr | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    sink: Sink | None = None
