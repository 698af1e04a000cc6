"""From a checked statement to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import limit_html, minify_html
from ..functions.text import lower_literal, trim_ws
from ..operators import aggregates
from ..operators.flatten import candidate_tags, flatten, split_filters
from ..operators.predicates import Predicates, needs_of, uses_axes
from ..sources.nodes import Needs, nodes
from .ast import Item, Order, Query, Sink
from .errors import QueryError
from .meta import meta_table
from .validate import MAX_FRAGMENT_BYTES, MAX_FRAGMENTS, MAX_FRAGMENTS_BYTES

CORE_FIELDS = ("node_id", "tag", "attributes", "parent_id", "sibling_pos", "max_depth", "doc_order", "source_uri")
WILDCARD = ("node_id", "tag", "attributes", "parent_id", "max_depth", "doc_order")


@dataclass(frozen=True)
class Documents:
    """A source: rows (doc_id, source_uri, parts); many if there can be more than one document."""

    rows: DataFrame
    many: bool = False
    uris: tuple[str, ...] = ()


@dataclass
class Result:
    """A lazy result: ``columns`` of df are what the statement asked for, ``keys`` order it by document."""

    df: DataFrame
    columns: list[str]
    kind: str = "rows"  # rows, table (doc_id, node_id, row_idx, cells), meta
    sink: Sink | None = None
    many: bool = False
    ordered: bool = False
    implicit: bool = False
    uris: tuple[str, ...] = field(default=())

    def select(self, with_doc: bool = False) -> DataFrame:
        return self.df.select(*(["doc_id"] if with_doc and "doc_id" in self.df.columns and "doc_id" not in self.columns else []), *(f"`{c}`" for c in self.columns))


class Compiler:
    def __init__(self, spark: SparkSession, documents: Callable[[Query], Documents], active: str = "document", sources: list[str] | None = None):
        self.spark, self.documents, self.active, self.sources = spark, documents, active, sources or []

    def compile(self, q: Query) -> Result:
        if q.kind != "select":
            columns, rows = meta_table(q.kind, self.active, self.sources)
            return Result(self.spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns)), columns, "meta", ordered=True)
        source = self.fragments(q.source.query) if q.source.query is not None else self.documents(q)
        first = q.items[0]
        shape = {"tfidf": self.tfidf, "summarize": self.summarize, "count": self.count}.get(first.kind)
        if shape is None and any(i.kind == "flatten" for i in q.items):
            shape = self.flatten
        if shape is None and q.sink is not None and (q.sink.kind == "table" or q.sink.kind == "csv" and q.items == (Item("tag", "table"),)):
            shape = self.table
        out = (shape or self.project)(q, source)
        out.sink, out.many, out.uris = q.sink, source.many, source.uris
        return out

    # rows

    def tags(self, q: Query) -> set[str] | None:
        names = [n for i in q.items for n in (i.names if i.kind == "tfidf" else (i.tag,))]
        return None if "*" in names else {lower_literal(n) for n in names}

    def scan(self, q: Query, source: Documents, tags: set[str] | None, extra: dict[str, set[str] | None], where=...) -> DataFrame:
        """The statement's rows before ORDER BY: tags and WHERE, with only the columns and tags parsed that these need."""
        where = q.where if where is ... else where
        needs = Needs(tags=tags)
        for column, of in extra.items():
            needs.add(column, of)
        if any(o.field == "text" for o in q.order):
            needs.add("text", tags)
        needs_of(where, tags, needs)
        rows = nodes(source.rows, needs)
        if uses_axes(where):
            rows = rows.repartition("doc_id")  # once; windows and joins inside documents keep it
        rows = Predicates().filter(rows, where)
        return rows if tags is None or needs.tags is not None else rows.filter(F.col("tag").isin(sorted(tags)))

    def limited(self, q: Query, rows: DataFrame, order: tuple[Order, ...] | None = None, always: bool = False) -> DataFrame:
        """ORDER BY and LIMIT; document order breaks ties, ascending either way."""
        order = q.order if order is None else order
        keys: list[Column] = []
        for o in order:
            if o.field == "parent_id":
                keys.append(F.desc_nulls_first("parent_id") if o.descending else F.asc_nulls_last("parent_id"))
            elif o.field in rows.columns and o.field != "sibling_pos":
                keys.append(F.desc(o.field) if o.descending else F.asc(o.field))
        if q.limit is not None:
            return rows.orderBy(*keys, "doc_id", "doc_order").limit(q.limit)
        return rows.orderBy(*keys, "doc_id", "doc_order") if q.order and keys or always else rows

    # shapes

    def project(self, q: Query, source: Documents) -> Result:
        tags = self.tags(q)
        if all(i.kind == "tag" for i in q.items):
            rows = self.limited(q, self.scan(q, source, tags, {}))
            out = {e.lower() for e in q.exclude}
            columns = [c for c in WILDCARD if c not in out]
            if not columns:
                raise QueryError("EXCLUDE removes every column")
            if source.many and "source_uri" not in out:
                columns = ["source_uri", *columns]
            return Result(rows, columns, ordered=bool(q.order) or q.limit is not None, implicit=True)
        extra = {}
        if any(i.kind == "text" for i in q.items):
            extra["direct_text"] = tags
        if any(i.kind in ("inner_html", "raw_inner_html") for i in q.items):
            extra["inner_html"] = tags
        rows = self.limited(q, self.scan(q, source, tags, extra))
        columns, values = [], {}
        for i in q.items:
            name, value = self.value(i)
            columns.append(name)
            values[f"__v_{name}"] = value
        kept = [c for c in ("doc_id", "doc_order") if c not in columns]
        rows = rows.select(*kept, *(v.alias(n) for n, v in values.items()))
        rows = rows.select(*kept, *(F.col(f"`__v_{n}`").alias(n) for n in dict.fromkeys(columns)))
        return Result(rows, list(dict.fromkeys(columns)), ordered=bool(q.order) or q.limit is not None)

    def value(self, i: Item) -> tuple[str, Column]:
        if i.kind == "text":
            name, value = "text", F.col("direct_text")
        elif i.kind in ("inner_html", "raw_inner_html"):
            depth, minify = 1 if i.depth is None else i.depth, i.kind == "inner_html"

            def cut(s: pd.Series) -> pd.Series:
                return s.map(lambda x: minify_html(limit_html(x, depth)) if minify else limit_html(x, depth), na_action="ignore")

            name, value = i.kind, F.pandas_udf(cut, "string")(F.col("inner_html"))
        else:
            low = i.field.lower()
            name = low if low in CORE_FIELDS else i.field
            value = F.col(low) if low in CORE_FIELDS else F.col("attributes")[lower_literal(i.field)]
            if i.trim and low in ("node_id", "parent_id", "max_depth", "doc_order"):
                return name, value  # numbers have no edge white space
        return name, trim_ws(value) if i.trim else value

    def count(self, q: Query, source: Documents) -> Result:
        rows = self.limited(q, self.scan(q, source, self.tags(q), {}))
        return Result(rows.agg(F.count("*").alias("count")), ["count"], ordered=True)

    def summarize(self, q: Query, source: Documents) -> Result:
        rows = self.limited(q, self.scan(q, source, None, {}), tuple(o for o in q.order if o.field == "tag"))
        return Result(aggregates.summarize(rows, list(q.order), q.limit), ["tag", "count"], ordered=True)

    def tfidf(self, q: Query, source: Documents) -> Result:
        tags = self.tags(q)
        rows = self.limited(q, self.scan(q, source, tags, {"written_html": tags}))
        return Result(aggregates.tfidf(rows, dict(q.items[0].options)), ["node_id", "parent_id", "tag", "terms_score"])

    def table(self, q: Query, source: Documents) -> Result:
        rows = self.limited(q, self.scan(q, source, {"table"}, {"grid": {"table"}}))
        grid = rows.select("doc_id", "node_id", "doc_order", F.posexplode("grid").alias("row_idx", "cells"))
        return Result(grid.withColumn("row_idx", F.col("row_idx").cast("long")), ["node_id", "row_idx", "cells"], "table")

    def flatten(self, q: Query, source: Documents) -> Result:
        item = next(i for i in q.items if i.kind == "flatten")
        where, filters = split_filters(q.where)
        alias = item.tag == q.source.alias
        tags = None if alias or item.tag == "*" else {lower_literal(item.tag)}
        base = self.limited(q, self.scan(q, source, tags, {}, where))
        chosen = candidate_tags(filters)
        found = nodes(source.rows, Needs({"flat_text": chosen}, chosen))
        rows = flatten(base, found, filters, item.depth, item.names)
        columns, values = [], []
        for i in q.items:
            if i.kind == "flatten":
                columns += i.names
                values += [F.col(f"`{n}`") for n in i.names]
            else:
                name, value = self.value(i)
                columns.append(name)
                values.append(value.alias(name))
        kept = [c for c in ("doc_id", "doc_order") if c not in columns]
        return Result(rows.select(*kept, *values), columns)

    def fragments(self, q: Query) -> Documents:
        """The subquery's strings of each document as one document, under the limits of one.

        Of a single document, they pass through the driver, and all limits are checked before the statement
        runs. Of a table of documents, none does: a document without fragments is left out, and one over a
        limit is an error when it is reached.
        """
        inner = self.compile(q)
        if len(inner.columns) != 1 or inner.kind != "rows":
            raise QueryError("FRAGMENTS() expects a single HTML string column")
        keys = [c for c in ("doc_id", "doc_order") if c in inner.df.columns]
        rows = inner.df if inner.ordered else inner.df.orderBy(*keys)
        value = F.col(f"`{inner.columns[0]}`").cast("string")
        if inner.many:
            place = F.monotonically_increasing_id() if inner.ordered else F.col("doc_order")
            return self._fragments_of_each(inner.df.select("doc_id", place.alias("at"), value.alias("v")))
        kept = rows.select(value.alias("v")).filter(F.col("v").isNotNull() & (trim_ws(F.col("v")) != ""))
        parts = [r["v"] for r in kept.limit(MAX_FRAGMENTS + 1).collect()]
        sizes = [len(p.encode()) for p in parts]
        if not parts:
            raise QueryError("FRAGMENTS() produced no HTML fragments")
        if len(parts) > MAX_FRAGMENTS:
            raise QueryError("FRAGMENTS() exceeds maximum fragment count")
        if any("<" not in p or ">" not in p for p in parts):
            raise QueryError("FRAGMENTS() expects HTML strings")
        if max(sizes) > MAX_FRAGMENT_BYTES or sum(sizes) > MAX_FRAGMENTS_BYTES:
            raise QueryError("FRAGMENTS() exceeds maximum HTML size")
        return Documents(single(self.spark, parts, "fragment"), uris=("fragment",))


    @staticmethod
    def _fragments_of_each(values: DataFrame) -> Documents:
        values = values.filter(F.col("v").isNotNull() & (trim_ws(F.col("v")) != ""))
        size = F.octet_length("v")
        each = values.groupBy("doc_id").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("parts"),
            F.count("*").alias("n"), F.max(size).alias("most"), F.sum(size).alias("bytes"), F.bool_and(F.col("v").contains("<") & F.col("v").contains(">")).alias("markup"),
        )
        checked = (
            F.when(F.col("n") > MAX_FRAGMENTS, F.raise_error(F.lit("FRAGMENTS() exceeds maximum fragment count")))
            .when(~F.col("markup"), F.raise_error(F.lit("FRAGMENTS() expects HTML strings")))
            .when((F.col("most") > MAX_FRAGMENT_BYTES) | (F.col("bytes") > MAX_FRAGMENTS_BYTES), F.raise_error(F.lit("FRAGMENTS() exceeds maximum HTML size")))
            .otherwise(F.col("parts"))
        )
        return Documents(each.select("doc_id", F.lit("fragment").alias("source_uri"), checked.alias("parts")), many=True, uris=("fragment",))


def single(spark: SparkSession, parts: list[str], uri: str) -> DataFrame:
    return spark.createDataFrame([(0, uri, parts)], "doc_id long, source_uri string, parts array<string>")
