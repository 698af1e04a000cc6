"""Element rows of documents: the scan that every query starts from."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import direct_text, flat_text, grid, inner_html, parse, text, written_html

#: Optional columns that a scan computes only for the tags that need them (None: for all).
COMPUTED = ("text", "inner_html", "written_html", "direct_text", "flat_text", "grid")
_CORE = [
    T.StructField("source_uri", T.StringType()),
    T.StructField("node_id", T.LongType(), False),
    T.StructField("parent_id", T.LongType()),
    T.StructField("tag", T.StringType(), False),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("sibling_pos", T.LongType(), False),
    T.StructField("max_depth", T.LongType(), False),
    T.StructField("doc_order", T.LongType(), False),
    T.StructField("subtree_end", T.LongType(), False),
    T.StructField("level", T.LongType(), False),
]


@dataclass
class Needs:
    """What a query asks of the scan: computed columns by tag, and the only tags it reads (None: all)."""

    columns: dict[str, set[str] | None] = field(default_factory=dict)
    tags: set[str] | None = None

    def add(self, column: str, tags: Iterable[str] | None) -> None:
        have = self.columns.get(column, set())
        self.columns[column] = None if tags is None or have is None else have | set(tags)


def nodes(docs: DataFrame, needs: Needs | None = None) -> DataFrame:
    """One row per element of docs(doc_id, source_uri, parts: array<string>), in a map without a shuffle.

    Computed columns and tags that the query doesn't need never leave the parser. Ids are preorder numbers,
    subtree_end is the last id inside an element, so "inside" is an interval test. Null markup has no rows.
    """
    needs = needs or Needs()
    wanted = [c for c in COMPUTED if c in needs.columns]
    of = {c: needs.columns[c] for c in wanted}
    only = needs.tags
    rows = docs.select("doc_id", "source_uri", "parts")
    string = T.StringType()
    kinds = {"grid": T.ArrayType(T.ArrayType(string))}
    schema = T.StructType([rows.schema["doc_id"], *_CORE, *(T.StructField(c, kinds.get(c, string)) for c in wanted)])

    def scan(batches):
        import pyarrow as pa

        make = {"text": text, "inner_html": inner_html, "written_html": written_html, "direct_text": direct_text, "flat_text": flat_text, "grid": grid}
        arrow = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), *[pa.int64()] * 5]
        arrow += [pa.list_(pa.list_(pa.string())) if c == "grid" else pa.string() for c in wanted]

        def batch(docs_, cols):
            return pa.RecordBatch.from_arrays([docs_, *(pa.array(c, k) for c, k in zip(cols, arrow, strict=True))], names=schema.names)

        for b in batches:
            index, cols = [], [[] for _ in arrow]
            for i, (uri, parts) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for e in parse(parts or []):
                    if only is not None and e.tag not in only:
                        continue
                    index.append(i)
                    row = [uri, e.id, None if e.parent is None else e.parent.id, e.tag, list(e.attributes.items()), e.position, e.height, e.id, e.end, e.level]
                    row += [make[c](e) if of[c] is None or e.tag in of[c] else None for c in wanted]
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                if len(index) >= 20_000:
                    yield batch(b.column(0).take(pa.array(index, pa.int64())), cols)
                    index, cols = [], [[] for _ in arrow]
            if index:
                yield batch(b.column(0).take(pa.array(index, pa.int64())), cols)

    return rows.mapInArrow(scan, schema)


def documents(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", uri_col: str | None = "url") -> DataFrame:
    """(doc_id, source_uri, parts) of a table of pages; the id names a document, so it should be unique."""
    uri = F.col(uri_col) if uri_col else F.lit(None).cast("string")
    return pages.select(F.col(id_col).alias("doc_id"), uri.alias("source_uri"), F.array(F.col(html_col)).alias("parts"))
