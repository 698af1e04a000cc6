"""The engine: sources by name, statements in, results out; and a facade of plain Python values."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions import markup, numerals
from .operators import aggregates
from .plans.ast import Query
from .plans.compiler import Compiler, Documents, Result, single
from .plans.errors import QueryError
from .plans.parser import parse
from .plans.validate import validate
from .sources import sinks
from .sources.html import parse as parse_html
from .sources.loaders import MAX_BYTES, MAX_NODES, FetchPolicy, SourceError, decode, fetch, is_url, read_files, read_path
from .sources.nodes import Needs, documents, nodes

#: Rows that the Python facade returns at most.
MAX_RESULTS = 10_000


class Engine:
    """Runs statements over registered documents. ``document`` is the active source, other names are aliases."""

    def __init__(self, spark: SparkSession, policy: FetchPolicy | None = None):
        self.spark, self.policy = spark, policy or FetchPolicy()
        # joins inside documents reuse the one exchange by document; batches stay small for long pages
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        self.named: dict[str, Documents] = {}
        self.active: Documents | None = None
        self.active_uri, self.last_uris = "document", []

    # sources

    def use(self, source: Documents, alias: str | None = None, uri: str = "document") -> Engine:
        if alias:
            self.named[alias] = source
        if alias is None or self.active is None:
            self.active, self.active_uri = source, uri
        return self

    def pages(self, table: DataFrame, id_col: str = "page_id", html_col: str = "html", uri_col: str | None = "url", alias: str | None = None) -> Engine:
        """A table of pages, one document per row; its id should be unique."""
        return self.use(Documents(documents(table, id_col, html_col, uri_col), many=True), alias, "pages")

    def files(self, path: str, alias: str | None = None) -> Engine:
        """HTML files under a path or glob that Spark reads."""
        return self.use(Documents(read_files(self.spark, path), many=True), alias, path)

    def html(self, text: str, alias: str | None = None, uri: str = "document") -> Engine:
        return self.use(Documents(single(self.spark, [text], uri), uris=(uri,)), alias, uri)

    def load(self, location: str, alias: str | None = None) -> Engine:
        """A path or URL, under the engine's policy."""
        return self.html(self._read(location), alias, location)

    def _read(self, location: str) -> str:
        return fetch(location, self.policy) if is_url(location) else read_path(location, self.policy)

    def _documents(self, q: Query) -> Documents:
        s = q.source
        if s.kind == "raw":
            return Documents(single(self.spark, [s.value], "raw"), uris=("raw",))
        if s.kind == "fragments":
            return Documents(single(self.spark, [s.value], "fragment"), uris=("fragment",))
        if s.kind == "location":
            return Documents(single(self.spark, [self._read(s.value)], s.value), uris=(s.value,))
        source = self.named.get(s.value, self.active) if s.kind == "name" else self.active
        if source is None:
            raise QueryError("no document is loaded")
        return source

    # statements

    def query(self, sql: str) -> Result:
        """The statement's lazy result. Files that it names are written by ``run`` or ``sinks.export``."""
        result = Compiler(self.spark, self._documents, self.active_uri, self.last_uris).compile(validate(parse(sql)))
        if result.kind != "meta":
            self.last_uris = list(result.uris) or [self.active_uri]
        return result

    def sql(self, sql: str, with_doc: bool | None = None) -> DataFrame:
        """The statement as a DataFrame, with doc_id in front if there can be many documents."""
        result = self.query(sql)
        return result.select(result.many if with_doc is None else with_doc)

    def run(self, sql: str) -> Result:
        result = self.query(sql)
        sinks.export(result)
        return result

    def nodes(self, alias: str | None = None, columns: dict | None = None) -> DataFrame:
        """The element rows themselves, for use beside the language; persist them to parse only once."""
        source = self.named[alias] if alias else self.active
        if source is None:
            raise QueryError("no document is loaded")
        return nodes(source.rows, Needs(dict(columns or {})))

    def register_functions(self) -> Engine:
        """The scalar functions for Spark SQL."""
        markup.register(self.spark)
        numerals.register(self.spark)
        return self


# the facade of plain values


@dataclass(frozen=True)
class Document:
    html: str
    source: str = "document"


@dataclass(frozen=True)
class TableResult:
    node_id: int
    rows: list[list[str]]


@dataclass(frozen=True)
class ExportSink:
    kind: str
    path: str


@dataclass(frozen=True)
class QueryResult:
    columns: list[str]
    rows: list[dict]
    tables: list[TableResult] = field(default_factory=list)
    to_list: bool = False
    to_table: bool = False
    export_sink: ExportSink | None = None


_last: Document | None = None


def load(source, base_dir: str | Path | None = None, allow_network: bool = False, allow_private: bool = False, max_bytes: int = MAX_BYTES, max_nodes: int = MAX_NODES) -> Document:
    """A document from bytes, a path, a URL or a string of HTML, within limits; ``execute`` uses the last one."""
    global _last
    policy = FetchPolicy(allow_network, allow_private, None if base_dir is None else Path(base_dir), max_bytes)
    uri = "document"
    if isinstance(source, bytes):
        text = decode(source)
    elif isinstance(source, Path):
        text, uri = read_path(str(source), policy), str(source)
    elif is_url(source):
        text, uri = fetch(source, policy), source
    elif "<" in source:
        text = source
    else:
        text, uri = read_path(source, policy), source
    if len(text.encode()) > max_bytes:
        raise SourceError("the document exceeds the maximum size")
    if text.count("<") > max_nodes and len(parse_html([text])) > max_nodes:
        raise SourceError("the document exceeds the maximum number of nodes")
    _last = Document(text, uri)
    return _last


def execute(query: str, source: Document | str | None = None, params=None, max_results: int = MAX_RESULTS, spark: SparkSession | None = None) -> QueryResult:
    """Run a statement on a document (an explicit one, else the last loaded). Export files are reported, not written."""
    if params:
        raise ValueError("params are not supported")
    doc = source if isinstance(source, Document) else load(source) if source is not None else _last
    if doc is None:
        raise ValueError("no document is loaded")
    spark = spark or SparkSession.builder.getOrCreate()
    result = Engine(spark).html(doc.html, uri=doc.source).query(query)
    sink = result.sink
    shared = {"to_list": sink is not None and sink.kind == "list", "to_table": result.kind == "table", "export_sink": ExportSink(sink.kind if sink.kind != "table" else "csv", sink.path) if sink is not None and sink.path else None}
    if result.kind == "table":
        return QueryResult(result.columns, [], [TableResult(n, g) for _, n, g in sinks.tables(result)], **shared)
    found = [tuple(r) for r in sinks.ordered(result).select(*(f"`{c}`" for c in result.columns)).limit(max_results + 1).collect()]
    if len(found) > max_results:
        raise ValueError("the result exceeds max_results")
    return QueryResult(result.columns, [dict(zip(result.columns, r, strict=True)) for r in found], **shared)


def summarize(doc: Document | None = None, max_nodes_preview: int = 50, spark: SparkSession | None = None) -> dict:
    """{total_nodes, tag_counts, attribute_keys} of a document."""
    doc = doc or _last
    if doc is None:
        raise ValueError("no document is loaded")
    spark = spark or SparkSession.builder.getOrCreate()
    return aggregates.overview(Engine(spark).html(doc.html).nodes(), max_nodes_preview)
