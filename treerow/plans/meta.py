"""SHOW and DESCRIBE: fixed descriptions of the language as small tables."""

from __future__ import annotations

# The texts of the meta statements.
FUNCTIONS = [
    ("text(tag)", "string", "Text content of a tag"),
    ("inner_html(tag[, depth])", "string", "Minified HTML inside a tag"),
    ("raw_inner_html(tag[, depth])", "string", "Raw inner HTML without minification"),
    ("flatten_text(tag[, depth])", "string[]", "Flatten descendant text at depth into columns"),
    ("flatten(tag[, depth])", "string[]", "Alias of flatten_text"),
    ("trim(inner_html(...))", "string", "Trim whitespace in inner_html"),
    ("count(tag|*)", "int64", "Aggregate node count"),
    ("summarize(*)", "table<tag,count>", "Tag counts summary"),
    ("tfidf(tag|*)", "map<string,double>", "TF-IDF term scores"),
]
AXES = [("parent", "Parent node"), ("child", "Direct child nodes"), ("ancestor", "Any ancestor node"), ("descendant", "Any descendant node")]
OPERATORS = [
    ("=", "Equality"), ("<>", "Not equal"), ("IN (...)", "Membership"), ("CONTAINS", "Substring or list contains"),
    ("CONTAINS ALL", "Contains all values"), ("CONTAINS ANY", "Contains any value"), ("IS NULL", "Null check"),
    ("IS NOT NULL", "Not-null check"), ("HAS_DIRECT_TEXT", "Direct text predicate"), ("~", "Regex match"), ("AND", "Logical AND"), ("OR", "Logical OR"),
]
DOCUMENT = [
    ("node_id", "int64", "false", "Stable node identifier"),
    ("tag", "string", "false", "Lowercase tag name"),
    ("attributes", "map<string,string>", "false", "HTML attributes"),
    ("parent_id", "int64", "true", "Null for root"),
    ("max_depth", "int64", "false", "Max element depth under node"),
    ("doc_order", "int64", "false", "Preorder document index"),
    ("sibling_pos", "int64", "false", "1-based among siblings"),
    ("source_uri", "string", "true", "Empty for RAW/STDIN"),
]
_CLAUSES = [
    ("clause", "SELECT", "SELECT <tag|*>[, ...]", "Tag list or *"),
    ("clause", "FROM", "FROM <source>", "Defaults to document in REPL"),
    ("clause", "WHERE", "WHERE <expr>", "Predicate expression"),
    ("clause", "ORDER BY", "ORDER BY <field> [ASC|DESC]", "node_id, tag, text, parent_id, sibling_pos, max_depth, doc_order; SUMMARIZE uses tag/count"),
    ("clause", "LIMIT", "LIMIT <n>", "n >= 0, max enforced"),
    ("clause", "EXCLUDE", "EXCLUDE <field>[, ...]", "Only with SELECT *"),
    ("output", "TO LIST", "TO LIST()", "Requires one projected column"),
    ("output", "TO TABLE", "TO TABLE([HEADER|NOHEADER][, EXPORT='file.csv'])", "Select table tags only"),
    ("output", "TO CSV", "TO CSV('file.csv')", "Export result"),
    ("output", "TO PARQUET", "TO PARQUET('file.parquet')", "Export result"),
    ("source", "document", "FROM document", "Active input in REPL"),
    ("source", "alias", "FROM doc", "Alias for document"),
    ("source", "path", "FROM 'file.html'", "Local file"),
    ("source", "url", "FROM 'https://example.com'", "Requires libcurl"),
    ("source", "raw", "FROM RAW('<html>')", "Inline HTML"),
    ("source", "fragments", "FROM FRAGMENTS(<raw|subquery>)", "Concatenate HTML fragments"),
    ("source", "fragments_raw", "FRAGMENTS(RAW('<ul>...</ul>'))", "Raw fragment input"),
    ("source", "fragments_query", "FRAGMENTS(SELECT inner_html(...) FROM doc)", "Subquery returns HTML strings"),
    ("field", "node_id", "node_id", "int64"),
    ("field", "tag", "tag", "lowercase"),
    ("field", "attributes", "attributes", "map<string,string>"),
    ("field", "parent_id", "parent_id", "int64 or null"),
    ("field", "sibling_pos", "sibling_pos", "1-based among siblings"),
    ("field", "source_uri", "source_uri", "Hidden unless multi-source"),
    ("function", "text", "text(tag)", "Direct text content; requires WHERE"),
    ("function", "inner_html", "inner_html(tag[, depth])", "Minified inner HTML; requires WHERE"),
    ("function", "raw_inner_html", "raw_inner_html(tag[, depth])", "Raw inner HTML (no minify); requires WHERE"),
    ("function", "trim", "trim(text(...)) | trim(inner_html(...))", "Trim whitespace"),
    ("aggregate", "count", "count(tag|*)", "int64"),
    ("aggregate", "summarize", "summarize(*)", "tag counts table"),
    ("aggregate", "tfidf", "tfidf(tag|*)", "map<string,double>"),
    ("axis", "parent", "parent.<field>", "Direct parent"),
    ("axis", "child", "child.<field>", "Direct child"),
    ("axis", "ancestor", "ancestor.<field>", "Any ancestor"),
    ("axis", "descendant", "descendant.<field>", "Any descendant"),
    ("predicate", "exists", "EXISTS(axis [WHERE expr])", "Existential axis predicate"),
    ("operator", "=", "lhs = rhs", "Equality"),
    ("operator", "<>", "lhs <> rhs", "Not equal"),
    ("operator", "IN", "lhs IN ('a','b')", "Membership"),
    ("operator", "CONTAINS", "lhs CONTAINS 'x'", "Substring or list contains"),
    ("operator", "CONTAINS ALL", "lhs CONTAINS ALL ('a','b')", "All values"),
    ("operator", "CONTAINS ANY", "lhs CONTAINS ANY ('a','b')", "Any value"),
    ("operator", "IS NULL", "lhs IS NULL", "Null check"),
    ("operator", "IS NOT NULL", "lhs IS NOT NULL", "Not-null check"),
    ("operator", "HAS_DIRECT_TEXT", "HAS_DIRECT_TEXT", "Predicate on direct text"),
    ("operator", "~", "lhs ~ 're'", "Regex match"),
    ("operator", "AND", "expr AND expr", "Logical AND"),
    ("operator", "OR", "expr OR expr", "Logical OR"),
    ("meta", "SHOW INPUT", "SHOW INPUT", "Active source"),
    ("meta", "SHOW INPUTS", "SHOW INPUTS", "Last result sources or active"),
    ("meta", "SHOW FUNCTIONS", "SHOW FUNCTIONS", "Function list"),
    ("meta", "SHOW AXES", "SHOW AXES", "Axis list"),
    ("meta", "SHOW OPERATORS", "SHOW OPERATORS", "Operator list"),
    ("meta", "DESCRIBE doc", "DESCRIBE doc", "Document schema"),
    ("meta", "DESCRIBE language", "DESCRIBE language", "Language spec"),
]


def meta_table(kind: str, active: str, sources: list[str]) -> tuple[list[str], list[tuple]]:
    """(columns, rows) of a meta statement; ``active`` and ``sources`` are the current input and the last result's."""
    return {
        "show input": (["key", "value"], [("source_uri", active)]),
        "show inputs": (["source_uri"], [(s,) for s in sources or [active]]),
        "show functions": (["function", "returns", "description"], FUNCTIONS),
        "show axes": (["axis", "description"], AXES),
        "show operators": (["operator", "description"], OPERATORS),
        "describe doc": (["column_name", "type", "nullable", "notes"], DOCUMENT),
        "describe language": (["category", "name", "syntax", "notes"], _CLAUSES),
    }[kind]
