"""One query per operator over the table of pages (or a small literal page), with the SQL it is compared with."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .functions import numerals
from .operators import aggregates
from .sources import sinks

#: The element tree of the pages in plain SQL: tokens by pattern, levels by a running sum, parents by level.
#: The first step closes the paragraphs that these pages leave open.
TREE = r"""WITH norm AS (SELECT page_id, regexp_replace(html, '<br>(<p>|</article>)', '<br></b></p>\1', 'g') AS h FROM pages),
tok AS (SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (SELECT page_id, regexp_extract_all(h,
  '(?s)<!--.*?-->|<(?:script|style)[^>]*>.*?</(?:script|style)>|</?[a-zA-Z][^>]*>|[^<]+') AS t FROM norm)),
cls AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9:_-]*)', 1)) AS tag,
  CASE WHEN tok LIKE '</%' THEN -1 WHEN regexp_matches(tok, '^<[a-zA-Z]') AND NOT regexp_matches(lower(tok),
  '^<(area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr|script|style)[\s/>]') THEN 1 ELSE 0 END AS d,
  regexp_matches(tok, '^<[a-zA-Z]') AS is_open FROM tok),
dep AS (SELECT *, sum(d) OVER (PARTITION BY page_id ORDER BY pos) AS s FROM cls),
opens AS (SELECT page_id, pos, tag, tok, CASE WHEN d = 1 THEN s ELSE s + 1 END AS lvl, d,
  row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS node_id FROM dep WHERE is_open),
par AS (SELECT o.page_id, o.node_id, o.lvl, o.pos, o.tag, o.tok, max(p.node_id) AS parent_id
  FROM opens o LEFT JOIN opens p ON p.page_id = o.page_id AND p.d = 1 AND p.lvl = o.lvl - 1 AND p.pos < o.pos GROUP BY ALL),
lastn AS (SELECT page_id, max(node_id) AS last_id FROM par GROUP BY page_id),
ends AS (SELECT a.page_id, a.node_id, coalesce(min(b.node_id) - 1, any_value(l.last_id)) AS subtree_end
  FROM par a JOIN lastn l USING (page_id) LEFT JOIN par b ON b.page_id = a.page_id AND b.node_id > a.node_id AND b.lvl <= a.lvl GROUP BY a.page_id, a.node_id),
high AS (SELECT a.page_id, a.node_id, e.subtree_end, max(b.lvl) - a.lvl AS max_depth
  FROM par a JOIN ends e USING (page_id, node_id) JOIN par b ON b.page_id = a.page_id AND b.node_id BETWEEN a.node_id AND e.subtree_end
  GROUP BY a.page_id, a.node_id, a.lvl, e.subtree_end),
own AS (SELECT o.page_id, o.node_id, string_agg(t.tok, '' ORDER BY t.pos) AS own_text FROM
  (SELECT t.page_id, t.pos, t.tok, max(o.node_id) AS node_id FROM dep t JOIN opens o ON o.page_id = t.page_id AND o.d = 1 AND o.lvl = t.s AND o.pos < t.pos
   WHERE t.tok NOT LIKE '<%' GROUP BY ALL) t JOIN par o ON o.page_id = t.page_id AND o.node_id = t.node_id GROUP BY ALL),
n AS (SELECT p.page_id AS doc_id, p.node_id::BIGINT AS node_id, p.parent_id::BIGINT AS parent_id, p.tag, p.lvl, h.subtree_end::BIGINT AS subtree_end, h.max_depth::BIGINT AS max_depth,
  CASE WHEN p.parent_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY p.page_id, p.parent_id ORDER BY p.node_id) END::BIGINT AS sibling_pos, p.node_id::BIGINT AS doc_order,
  CASE WHEN p.tok LIKE '% href="%' THEN replace(regexp_extract(p.tok, ' href="([^"]*)"', 1), '&amp;', '&') END AS href,
  CASE WHEN p.tok LIKE '% class="%' THEN regexp_extract(p.tok, ' class="([^"]*)"', 1) END AS class,
  CASE WHEN p.tok LIKE '% lang="%' THEN regexp_extract(p.tok, ' lang="([^"]*)"', 1) END AS lang,
  CASE WHEN p.tok LIKE '% charset="%' THEN regexp_extract(p.tok, ' charset="([^"]*)"', 1) END AS charset,
  coalesce(own_text, '') AS own_text
  FROM par p JOIN high h USING (page_id, node_id) LEFT JOIN own USING (page_id, node_id)) """

_WIDE = "doc_id, node_id, tag, parent_id, max_depth, doc_order"
_STAR = "* EXCLUDE (attributes, source_uri)"


def _pages(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).sql(statement)

    return run


def _flat(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    """As _pages, without the map of attributes and the address of the page."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pages(statement)(spark, sf_dir).drop("attributes", "source_uri")

    return run


def _literal(statement: str, html: str = "") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).html(html).sql(statement)

    return run


def _cells(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir).withColumn("cells", F.array_join("cells", "|"))


def _tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pages("SELECT TFIDF(h1, footer, TOP_TERMS=5) FROM document")(spark, sf_dir)
    return df.select("doc_id", "node_id", F.explode("terms_score").alias("term", "score")).withColumn("score", F.round("score", 6))


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summarize_content(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", max_tokens=50)


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages("SELECT * FROM document WHERE attributes IS NOT NULL")(spark, sf_dir)
    text = F.array_join(F.transform(F.sort_array(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("doc_id", "node_id", "tag", text.alias("attributes"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    Engine(spark).register_functions()
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("number"))
    return keys.selectExpr("number", "khmer_words(number) AS words", "khmer_numerals(number) AS numerals").selectExpr("*", "khmer_parse(words) AS parsed")


def _cards(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str, n: int = 2000) -> DataFrame:
        cards = "".join(f"  <div class='card'>\n    <h2> Title {i} </h2>\n    <p>   Summary line   {i}   with spaces   </p>\n  </div>\n" for i in range(n))
        return Engine(spark).html(f"<html><body>\n{cards}</body></html>").sql(f"SELECT {kind}(div) FROM document WHERE attributes.class = 'card'")

    return run


def _values(columns: str, *rows: tuple) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    names = [c.strip() for c in columns.split(",")]
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if all(isinstance(r[i], int | None) for r in rows) else c for i, c in enumerate(names))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({columns})"


def _meta(statement: str) -> tuple[Callable, str]:
    from .plans.meta import meta_table
    from .plans.parser import parse

    columns, rows = meta_table(parse(statement).kind, "document", [])
    return _literal(statement), _values(", ".join(f'"{c}"' for c in columns), *rows)


def _axis(column: str, condition: str, inner: str) -> str:
    return f"{TREE} SELECT {column} FROM n WHERE EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND {inner} AND {condition})"


_PARENT, _CHILD = "m.node_id = n.parent_id", "m.parent_id = n.node_id"
_ANCESTOR, _DESCENDANT = "m.node_id < n.node_id AND n.node_id <= m.subtree_end", "n.node_id < m.node_id AND m.node_id <= n.subtree_end"
_KEYS = "doc_id, node_id"
_TABLES = "<table id='t'><tr><th>H1</th><th>H2</th></tr><tr><td> A <b>x</b></td><td>B<table><tr><td>in</td></tr></table></td></tr><tr></tr></table>"
_LIST = "<div class='a b'><ul><li>1</li><li>2 &amp; 3</li></ul></div><div class='c'></div>"
_CARD = "<div id='root'><span><b>Hi</b></span>  <em>There</em><pre>\n a  b</pre></div>"
_DIVS = "<div><p>One</p><span>Two <b>x</b></span></div><div><p>Three</p><p> </p></div><div></div>"

#: name: (statement as a callable, equivalent SQL or nothing)
CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    # projections
    "tag_select": (_flat("SELECT a FROM document"), f"{TREE} SELECT {_WIDE} FROM n WHERE tag = 'a'"),
    "multi_tag": (_flat("SELECT h1, footer, P FROM document"), f"{TREE} SELECT {_WIDE} FROM n WHERE tag IN ('h1', 'footer', 'p')"),
    "wildcard": (_flat("SELECT * FROM document"), f"{TREE} SELECT {_WIDE} FROM n"),
    "exclude": (_pages(f"SELECT {_STAR} FROM document"), f"{TREE} SELECT {_WIDE} FROM n"),
    "attributes_map": (_attributes, f"{TREE} SELECT doc_id, node_id, tag, concat_ws(',', 'charset=' || charset, 'class=' || class, 'href=' || href, 'lang=' || lang) AS attributes FROM n WHERE coalesce(charset, class, href, lang) IS NOT NULL"),
    "attr_project": (_pages("SELECT a.href, a.title FROM document WHERE href IS NOT NULL"), f"{TREE} SELECT doc_id, href, NULL::VARCHAR AS title FROM n WHERE tag = 'a' AND href IS NOT NULL"),
    "field_list": (_pages("SELECT li(node_id, tag, parent_id, sibling_pos, max_depth, doc_order) FROM document"), f"{TREE} SELECT doc_id, node_id, tag, parent_id, sibling_pos, max_depth, doc_order FROM n WHERE tag = 'li'"),
    "source_uri": (_pages("SELECT html(node_id, source_uri) FROM document"), f"{TREE} SELECT doc_id, node_id, url AS source_uri FROM n JOIN pages ON page_id = doc_id WHERE tag = 'html'"),
    "text_fn": (_pages("SELECT a.node_id, TEXT(a) FROM document WHERE attributes.href IS NOT NULL"), f"{TREE} SELECT doc_id, node_id, own_text AS text FROM n WHERE tag = 'a' AND href IS NOT NULL"),
    "text_footer": (_pages("SELECT TEXT(footer) FROM document WHERE parent_id IS NOT NULL"), f"{TREE} SELECT doc_id, replace(replace(own_text, '&copy;', '©'), '&middot;', '·') AS text FROM n WHERE tag = 'footer'"),
    "inner_html_d1": (_literal("SELECT inner_html(div) FROM document WHERE id = 'root'", _CARD), _values("inner_html", ("<span>Hi</span><em>There</em><pre>\n a  b</pre>",))),
    "inner_html_d0": (_literal("SELECT inner_html(div, 0) FROM document WHERE id = 'root'", _CARD), _values("inner_html", ("Hi There a b",))),
    "raw_inner_html": (_literal("SELECT raw_inner_html(div, 2) FROM document WHERE id = 'root'", _CARD), _values("raw_inner_html", ("<span><b>Hi</b></span>  <em>There</em><pre>\n a  b</pre>",))),
    "trim_fn": (_literal("SELECT trim(raw_inner_html(p, 0)) FROM document WHERE sibling_pos = 1", "<p>\n\t x y  </p>"), _values("raw_inner_html", ("x y",))),
    "trim_attr": (_pages("SELECT trim(a.href) FROM document WHERE href IS NOT NULL"), f"{TREE} SELECT doc_id, trim(href) AS href FROM n WHERE tag = 'a' AND href IS NOT NULL"),
    # predicates
    "eq_attr": (_pages("SELECT a.node_id FROM document WHERE attributes.href = '/the'"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'a' AND href = '/the'"),
    "neq_attr": (_pages("SELECT a.node_id FROM document WHERE href <> '/the'"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'a' AND href <> '/the'"),
    "in_attr": (_pages("SELECT a.node_id FROM document WHERE href IN ('/the', '/and', '/of')"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'a' AND href IN ('/the', '/and', '/of')"),
    "in_num": (_pages("SELECT li.node_id FROM document WHERE sibling_pos IN (1, 3) OR max_depth <> 1 OR node_id = '+12'"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'li' AND (sibling_pos IN (1, 3) OR max_depth <> 1 OR node_id = 12)"),
    "num_not_integer": (_pages("SELECT li.node_id FROM document WHERE node_id = 'x' OR sibling_pos IN ('x', 2)"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'li' AND sibling_pos = 2"),
    "is_null_attr": (_pages("SELECT a.node_id FROM document WHERE class IS NULL OR id IS NOT NULL"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'a' AND class IS NULL"),
    "attrs_null": (_flat("SELECT * FROM document WHERE attributes IS NULL"), f"{TREE} SELECT {_WIDE} FROM n WHERE coalesce(href, class, lang, charset) IS NULL"),
    "parent_null": (_flat("SELECT * FROM document WHERE parent_id IS NULL"), f"{TREE} SELECT {_WIDE} FROM n WHERE parent_id IS NULL"),
    "regex_attr": (_pages("SELECT a.href FROM document WHERE href ~ '^/[A-Z].*[a-z]$'"), f"{TREE} SELECT doc_id, href FROM n WHERE tag = 'a' AND regexp_matches(href, '^/[A-Z].*[a-z]$')"),
    "regex_invalid": (_pages("SELECT a.href FROM document WHERE href ~ '('"), f"{TREE} SELECT doc_id, href FROM n WHERE false"),
    "contains": (_pages("SELECT a.href FROM document WHERE href CONTAINS 'TH'"), f"{TREE} SELECT doc_id, href FROM n WHERE tag = 'a' AND contains(lower(href), 'th')"),
    "contains_all": (_pages("SELECT a.href FROM document WHERE href CONTAINS ALL ('th', 'E')"), f"{TREE} SELECT doc_id, href FROM n WHERE tag = 'a' AND contains(lower(href), 'th') AND contains(lower(href), 'e')"),
    "contains_any": (_pages("SELECT a.href FROM document WHERE href CONTAINS ANY ('on', 'the')"), f"{TREE} SELECT doc_id, href FROM n WHERE tag = 'a' AND (contains(lower(href), 'on') OR contains(lower(href), 'the'))"),
    "class_token": (_literal("SELECT div.node_id FROM document WHERE class = 'b' OR class IN ('x', 'c')", _LIST), _values("node_id", (0,), (4,))),
    "class_not": (_literal("SELECT div.node_id FROM document WHERE class <> 'b'", _LIST), _values("node_id", (4,))),
    "has_direct_text": (_pages("SELECT a.node_id FROM document WHERE a HAS_DIRECT_TEXT 'TH'"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'a' AND contains(lower(own_text), 'th')"),
    "text_eq": (_pages("SELECT a.node_id FROM document WHERE text = 'the' OR text IN ('and', 'of')"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'a' AND own_text IN ('the', 'and', 'of')"),
    "tag_eq": (_flat("SELECT * FROM document WHERE tag = 'LI' OR tag ~ '^h[0-9]'"), f"{TREE} SELECT {_WIDE} FROM n WHERE tag = 'li' OR regexp_matches(tag, '^h[0-9]')"),
    "logic": (_pages("SELECT li.node_id FROM document WHERE sibling_pos = 1 OR sibling_pos = 2 AND (max_depth = 1 OR node_id = 5)"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'li' AND (sibling_pos = 1 OR sibling_pos = 2 AND (max_depth = 1 OR node_id = 5))"),
    # axes
    "axis_parent": (_pages("SELECT p.node_id FROM document WHERE parent.tag = 'article'"), _axis(_KEYS, "m.tag = 'article' AND n.tag = 'p'", _PARENT)),
    "axis_child": (_pages("SELECT li.node_id FROM document WHERE child.attributes.href CONTAINS 'th'"), _axis(_KEYS, "contains(lower(m.href), 'th') AND n.tag = 'li'", _CHILD)),
    "axis_ancestor": (_pages("SELECT a.node_id FROM document WHERE ancestor.tag = 'nav'"), _axis(_KEYS, "m.tag = 'nav' AND n.tag = 'a'", _ANCESTOR)),
    "axis_descendant": (_flat("SELECT * FROM document WHERE descendant.attributes.href IS NOT NULL"), _axis(_WIDE, "m.href IS NOT NULL", _DESCENDANT)),
    "axis_is_null": (_flat("SELECT * FROM document WHERE child.attributes.href IS NULL"), f"{TREE} SELECT {_WIDE} FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND {_CHILD} AND m.href IS NOT NULL)"),
    "axis_int": (_pages("SELECT a.node_id FROM document WHERE parent.sibling_pos = 2 AND ancestor.max_depth IN (2, 3)"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'a' AND EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND {_PARENT} AND m.sibling_pos = 2) AND EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND {_ANCESTOR} AND m.max_depth IN (2, 3))"),
    "exists_child": (_flat("SELECT * FROM document WHERE EXISTS(child)"), f"{TREE} SELECT {_WIDE} FROM n WHERE subtree_end > node_id"),
    "exists_child_where": (_flat("SELECT * FROM document WHERE EXISTS(child WHERE tag = 'li' AND sibling_pos = 2)"), _axis(_WIDE, "m.tag = 'li' AND m.sibling_pos = 2", _CHILD)),
    "exists_nested": (_flat("SELECT * FROM document WHERE EXISTS(descendant WHERE tag = 'ul' AND EXISTS(child WHERE child.attributes.href = '/the'))"), f"{TREE} SELECT {_WIDE} FROM n WHERE EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND {_DESCENDANT} AND m.tag = 'ul' AND EXISTS (SELECT 1 FROM n a JOIN n b ON b.doc_id = a.doc_id AND b.parent_id = a.node_id WHERE a.doc_id = m.doc_id AND a.parent_id = m.node_id AND b.href = '/the'))"),
    "axis_or_attr": (_flat("SELECT * FROM document WHERE parent.tag = 'nav' OR class = 'ad' OR descendant.tag = 'h1'"), f"{TREE} SELECT {_WIDE} FROM n WHERE class = 'ad' OR EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND {_PARENT} AND m.tag = 'nav') OR EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND {_DESCENDANT} AND m.tag = 'h1')"),
    # aggregates
    "count_tag": (_pages("SELECT COUNT(a) FROM document WHERE href CONTAINS 'th'"), f"{TREE} SELECT count(*) AS count FROM n WHERE tag = 'a' AND contains(lower(href), 'th')"),
    "count_star": (_pages("SELECT COUNT(*) FROM document"), f"{TREE} SELECT count(*) AS count FROM n"),
    "count_limit": (_pages("SELECT COUNT(a) FROM document LIMIT 7"), f"{TREE} SELECT count(*) AS count FROM (SELECT * FROM n WHERE tag = 'a' ORDER BY doc_id, node_id LIMIT 7)"),
    "summarize": (_pages("SELECT SUMMARIZE(*) FROM document"), f"{TREE} SELECT tag, count(*) AS count FROM n GROUP BY tag"),
    "summarize_order": (_pages("SELECT SUMMARIZE(*) FROM document ORDER BY tag DESC LIMIT 40"), f"{TREE} SELECT tag, count(*) AS count FROM (SELECT * FROM n ORDER BY tag DESC, doc_id, node_id LIMIT 40) GROUP BY tag ORDER BY tag DESC LIMIT 40"),
    "summarize_limit": (_pages("SELECT SUMMARIZE(*) FROM document LIMIT 5"), f"{TREE} SELECT tag, count(*) AS count FROM (SELECT * FROM n ORDER BY doc_id, node_id LIMIT 5) GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 5"),
    "tfidf_long": (
        _tfidf,
        TREE
        + r""", w AS (SELECT doc_id, node_id, unnest(regexp_extract_all(replace(replace(own_text, '&copy;', '©'), '&middot;', '·'), '[A-Za-z0-9_]+')) AS t FROM n WHERE tag IN ('h1', 'footer')),
        c AS (SELECT doc_id, node_id, lower(t) AS term, count(*) AS k FROM w WHERE lower(t) NOT IN ('a','an','and','are','as','at','be','but','by','for','from','has','have','he','her','his','i','in','is','it','its','of','on','or','she','that','the','their','they','to','was','were','with','you') GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
        s AS (SELECT doc_id, node_id, term, k / sum(k) OVER (PARTITION BY doc_id, node_id) * (ln(((SELECT count(*) FROM n WHERE tag IN ('h1', 'footer')) + 1) / (df + 1)) + 1) AS score FROM c JOIN f USING (term))
        SELECT doc_id, node_id, term, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, node_id ORDER BY score DESC, term) AS r FROM s) WHERE r <= 5""",
    ),
    "summarize_content": (
        _content,
        r"""SELECT token, count(*) AS count, count(*)::DOUBLE AS score FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS token FROM documents)
        WHERE token NOT IN ('a','an','and','are','as','at','be','but','by','for','from','has','have','he','her','his','i','in','is','it','its','of','on','or','she','that','the','their','they','to','was','were','with','you')
        GROUP BY token ORDER BY count(*) DESC, token LIMIT 50""",
    ),
    # order and limit
    "orderby_multi": (_pages("SELECT li(node_id, sibling_pos, tag) FROM document ORDER BY tag DESC, max_depth, node_id DESC LIMIT 60"), f"{TREE} SELECT doc_id, node_id, sibling_pos, tag FROM n WHERE tag = 'li' ORDER BY tag DESC, max_depth, node_id DESC, doc_id LIMIT 60"),
    "orderby_parent_desc_nulls": (_flat("SELECT * FROM document ORDER BY parent_id DESC LIMIT 300"), f"{TREE} SELECT {_WIDE} FROM n ORDER BY parent_id DESC NULLS FIRST, doc_id, node_id LIMIT 300"),
    "orderby_sibling_noop": (_flat("SELECT * FROM document ORDER BY sibling_pos DESC LIMIT 50"), f"{TREE} SELECT {_WIDE} FROM n ORDER BY doc_id, node_id LIMIT 50"),
    "orderby_text": (_pages("SELECT a.node_id FROM document ORDER BY text LIMIT 80"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'a' ORDER BY own_text, doc_id, node_id LIMIT 80"),
    "limit_topk": (_flat("SELECT * FROM document LIMIT 100"), f"{TREE} SELECT {_WIDE} FROM n ORDER BY doc_id, node_id LIMIT 100"),
    # flatten, tables, sources
    "flatten_default": (_literal("SELECT div.node_id, FLATTEN_TEXT(div) AS (c1, c2, c3) FROM document WHERE descendant.tag IN ('p', 'span')", _DIVS), _values("node_id, c1, c2, c3", (0, "One", "Two", None), (4, "Three", None, None), (7, None, None, None))),
    "flatten_depth": (_literal("SELECT FLATTEN(div, 2) AS (c1, c2) FROM document", _DIVS), _values("c1, c2", ("x", None), (None, None), (None, None))),
    "flatten_pages": (
        _pages("SELECT FLATTEN(ul) AS (first, second, third) FROM document WHERE descendant.tag = 'a' AND ancestor.tag = 'nav'"),
        TREE + ", v AS (SELECT u.doc_id, u.node_id, trim(a.own_text) AS t, row_number() OVER (PARTITION BY u.doc_id, u.node_id ORDER BY a.node_id) AS r FROM n u JOIN n a ON a.doc_id = u.doc_id AND a.tag = 'a' AND a.node_id > u.node_id AND a.node_id <= u.subtree_end WHERE u.tag = 'ul' AND trim(a.own_text) <> '') SELECT doc_id, max(t) FILTER (r = 1) AS first, max(t) FILTER (r = 2) AS second, max(t) FILTER (r = 3) AS third FROM v GROUP BY doc_id, node_id",
    ),
    "to_table": (_cells(_literal("SELECT table FROM document TO TABLE()", _TABLES)), _values("node_id, row_idx, cells", (0, 0, "H1|H2"), (0, 1, "A x|Bin"), (8, 0, "in"))),
    "to_list": (_pages("SELECT a.href FROM document WHERE ancestor.tag = 'nav' TO LIST()"), _axis("doc_id, href", "m.tag = 'nav' AND n.tag = 'a'", _ANCESTOR)),
    "raw_source": (_literal("SELECT li(node_id, parent_id) FROM RAW('<ul><li>1</li><li>2</li></ul>')"), _values("node_id, parent_id", (1, 0), (2, 0))),
    "fragments_raw": (_literal("SELECT li(node_id) FROM FRAGMENTS(RAW('<ul><li>1</li><li>2</li></ul>')) AS frag"), _values("node_id", (1,), (2,))),
    "fragments_subquery": (_literal("SELECT li.node_id, TEXT(li) FROM FRAGMENTS(SELECT inner_html(div, 2) FROM document WHERE class IS NOT NULL) AS frag WHERE parent.tag = 'ul'", _LIST), _values("node_id, text", (1, "1"), (2, "2 &amp; 3"))),
    # descriptions
    "meta_describe_doc": _meta("DESCRIBE doc"),
    "show_functions": _meta("SHOW FUNCTIONS"),
    "show_axes": _meta("SHOW AXES"),
    "show_operators": _meta("SHOW OPERATORS"),
    "show_input": _meta("SHOW INPUT"),
    "show_inputs": _meta("SHOW INPUTS"),
    "describe_language": _meta("DESCRIBE language"),
    # a page of many cards
    "bench_cards_minified": (_cards("INNER_HTML"), "SELECT '<h2> Title ' || i || ' </h2><p> Summary line ' || i || ' with spaces </p>' AS inner_html FROM range(2000) t(i)"),
    "bench_cards_raw": (_cards("RAW_INNER_HTML"), "SELECT chr(10) || '    <h2> Title ' || i || ' </h2>' || chr(10) || '    <p>   Summary line   ' || i || '   with spaces   </p>' || chr(10) || '  ' AS raw_inner_html FROM range(2000) t(i)"),
}
CATALOGUE["fragments_pages"] = (
    _flat("SELECT li FROM FRAGMENTS(SELECT inner_html(nav, 9) FROM document WHERE child.tag = 'ul') AS f"),
    TREE + ", f AS (SELECT doc_id, node_id, subtree_end, coalesce(sum(subtree_end - node_id) OVER (PARTITION BY doc_id ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n WHERE tag = 'nav') SELECT n.doc_id, (base + n.node_id - f.node_id - 1)::BIGINT AS node_id, n.tag, (base + n.parent_id - f.node_id - 1)::BIGINT AS parent_id, n.max_depth, (base + n.node_id - f.node_id - 1)::BIGINT AS doc_order FROM n JOIN f ON n.doc_id = f.doc_id AND n.node_id > f.node_id AND n.node_id <= f.subtree_end WHERE n.tag = 'li'",
)

FLAGSHIP = "SELECT a.node_id, a.href, TEXT(a) FROM document WHERE ancestor.tag = 'nav' AND href IS NOT NULL"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages' navigation, with their texts."""
    return _pages(FLAGSHIP)(spark, sf_dir)


CATALOGUE["flagship"] = (flagship, _axis("doc_id, node_id, href, own_text AS text", "m.tag = 'nav' AND n.tag = 'a' AND n.href IS NOT NULL", _ANCESTOR))


# files and texts that statements write, read back

_SHOP = "<ul id='shop'><li class='in'>Tea, black</li><li>Salt \"fine\"</li><li class='in out'> Rye </li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr><tr><td>b, c</td></tr></table>"


def _written(make: Callable[[Engine, str], list[tuple]], columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """What ``make`` reads back of files in a folder of its own, which goes at once; small literal pages only."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with tempfile.TemporaryDirectory() as folder:
            rows = make(Engine(spark).html(_SHOP), folder)
        return spark.createDataFrame(rows, ", ".join(f"{c.strip()} {'long' if all(isinstance(r[i], int | None) for r in rows) else 'string'}" for i, c in enumerate(columns.split(","))))

    return run


def _csv_lines(statement: str) -> Callable[[Engine, str], list[tuple]]:
    def make(engine: Engine, folder: str) -> list[tuple]:
        engine.run(statement.format(f"{folder}/out"))
        return list(enumerate(Path(folder, "out").read_text(encoding="utf-8").splitlines()))

    return make


def _parquet_rows(engine: Engine, folder: str) -> list[tuple]:
    import pyarrow.parquet as pq

    engine.run(f"SELECT li(node_id, class) FROM document TO PARQUET('{folder}/out')")
    return [(r["node_id"], r["class"]) for r in pq.read_table(f"{folder}/out").to_pylist()]


def _shown(statement: str, show: Callable) -> Callable[[Engine, str], list[tuple]]:
    return lambda engine, folder: list(enumerate(show(engine.query(statement)).split("\n")))


def _from_files(engine: Engine, folder: str) -> list[tuple]:
    for i in range(3):
        Path(folder, f"p{i}.html").write_text(f"<p><b>{i}</b></p>" * (i + 1), encoding="utf-8")
    df = engine.files(f"{folder}/*.html", alias="files").sql("SELECT b(node_id, source_uri) FROM files")
    return sorted((r["source_uri"].rsplit("/", 1)[-1], r["node_id"]) for r in df.collect())


def _from_path(engine: Engine, folder: str) -> list[tuple]:
    Path(folder, "p.html").write_text("<i>x</i><p><i>y</i></p>", encoding="utf-8")
    from .cli import quote_path

    return [tuple(r) for r in engine.sql(quote_path(f"SELECT i(node_id, parent_id) FROM {folder}/p.html")).collect()]


def _facade(engine: Engine, folder: str) -> list[tuple]:
    from . import api

    Path(folder, "p.html").write_text(_SHOP, encoding="utf-8")
    doc = api.load(Path(folder, "p.html"), base_dir=folder)
    rows = api.execute("SELECT li(node_id, class) FROM document WHERE class IS NOT NULL", source=doc, spark=engine.spark).rows
    counts = api.summarize(doc, spark=engine.spark)
    return [("rows", r["class"], r["node_id"]) for r in rows] + [("tags", k, n) for k, n in counts["tag_counts"].items()] + [("keys", k, n) for k, n in counts["attribute_keys"].items()] + [("total", "nodes", counts["total_nodes"])]


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return Engine(spark).html("<a href='/the'></a>").pages(pages, alias="web").sql("SELECT a.node_id FROM web WHERE web.href = '/the'")


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tempfile.mkdtemp(prefix="dataset-")
    result = Engine(spark).pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).query("SELECT a(node_id, href) FROM document WHERE href CONTAINS 'th'")
    sinks.write_dataset(result, f"file://{folder}/out")
    return spark.read.parquet(f"file://{folder}/out")


def _khmer_sql() -> str:
    """Words of numbers below ten million in plain SQL: digit by digit of the decimal places."""
    digit = "['" + "','".join(numerals.DIGITS[1:]) + "'][{}]"
    place = lambda p: f"CASE WHEN n // {10**p} % 10 > 0 THEN {digit.format(f'n // {10**p} % 10')} || '-' || '{numerals.SCALES[p]}' END"
    tens = "['" + "','".join([numerals.SCALES[1], *numerals.TENS.values()]) + "'][n // 10 % 10]"
    parts = [*(place(p) for p in (6, 5, 4, 3, 2)), f"CASE WHEN n // 10 % 10 > 0 THEN {tens} END", f"CASE WHEN n % 10 > 0 THEN {digit.format('n % 10')} END"]
    return f"SELECT n::VARCHAR AS number, CASE WHEN n = 0 THEN '{numerals.DIGITS[0]}' ELSE concat_ws('-', {', '.join(parts)}) END AS words, translate(n::VARCHAR, '0123456789', '{numerals.NUMERALS}') AS numerals, n::VARCHAR AS parsed FROM (SELECT o_orderkey AS n FROM orders)"


CATALOGUE["khmer_numbers"] = (_numbers, _khmer_sql())
CATALOGUE |= {
    "alias_source": (_pages("SELECT a.node_id FROM doc WHERE a.href = '/of'"), f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'a' AND href = '/of'"),
    "named_source": (_named, f"{TREE} SELECT {_KEYS} FROM n WHERE tag = 'a' AND href = '/the'"),
    "uri_column": (lambda spark, sf_dir: _pages("SELECT h1 FROM document")(spark, sf_dir).drop("attributes"), f"{TREE} SELECT {_WIDE}, url AS source_uri FROM n JOIN pages ON page_id = doc_id WHERE tag = 'h1'"),
    "field_is_null": (_flat("SELECT * FROM document WHERE parent.max_depth IS NULL OR child.tag IS NOT NULL AND sibling_pos IS NOT NULL"), f"{TREE} SELECT {_WIDE} FROM n WHERE parent_id IS NULL OR subtree_end > node_id"),
    "field_not_null_axis": (_pages("SELECT li.node_id FROM document WHERE ancestor.parent_id IS NOT NULL AND tag IS NOT NULL"), _axis(_KEYS, "m.parent_id IS NOT NULL AND n.tag = 'li'", _ANCESTOR)),
    "axis_parent_child_both": (_flat("SELECT * FROM document WHERE EXISTS(parent WHERE tag = 'ul' AND sibling_pos = 1) OR EXISTS(child WHERE tag = 'h1' OR tag = 'ul')"), f"{TREE} SELECT {_WIDE} FROM n WHERE EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND {_PARENT} AND m.tag = 'ul' AND m.sibling_pos = 1) OR EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND {_CHILD} AND m.tag IN ('h1', 'ul'))"),
    "minify_script": (_literal("SELECT inner_html(div, 3) FROM document WHERE id = 'm'", "<div id='m'><style>a  { b : c }</style><p>  x   y </p></div>"), _values("inner_html", ("<style>a  { b : c }</style><p> x y </p>",))),
    "files_source": (_written(_from_files, "name, node_id"), _values("name, node_id", ("p0.html", 1), ("p1.html", 1), ("p1.html", 3), ("p2.html", 1), ("p2.html", 3), ("p2.html", 5))),
    "path_source": (_written(_from_path, "node_id, parent_id"), _values("node_id, parent_id", (0, None), (2, 1))),
    "csv_sink": (_written(_csv_lines("SELECT li(node_id, class), li.title FROM document TO CSV('{}')"), "line, text"), _values("line, text", (0, "node_id,class,title"), (1, "1,in,"), (2, "2,,"), (3, "3,in out,"))),
    "csv_table_sink": (_written(_csv_lines("SELECT table FROM document TO TABLE(EXPORT='{}')"), "line, text"), _values("line, text", (0, "k,v"), (1, "a,1"), (2, '"b, c"'))),
    "parquet_sink": (_written(_parquet_rows, "node_id, class"), "SELECT * FROM (VALUES ('1', 'in'), ('2', NULL), ('3', 'in out')) AS v(node_id, class)"),
    "json_sink": (_written(_shown("SELECT li(node_id, class) FROM document WHERE class = 'out'", sinks.to_json), "line, text"), _values("line, text", (0, "["), (1, "  {"), (2, '    "node_id": 3,'), (3, '    "class": "in out"'), (4, "  }"), (5, "]"))),
    "json_list_sink": (_written(_shown("SELECT li.class FROM document TO LIST()", lambda r: sinks.to_json(r, None)), "line, text"), _values("line, text", (0, '["in", null, "in out"]'))),
    "box_sink": (_written(_shown("SELECT li(node_id, class) FROM document WHERE node_id IN (1, 2)", sinks.to_box), "line, text"), _values("line, text", (0, "┌─────────┬───────┐"), (1, "│ node_id │ class │"), (2, "├─────────┼───────┤"), (3, "│       1 │ in    │"), (4, "│       2 │ NULL  │"), (5, "└─────────┴───────┘"))),
    "dataset_sink": (_dataset, f"{TREE} SELECT doc_id, node_id, href FROM n WHERE tag = 'a' AND contains(lower(href), 'th')"),
    "facade": (
        _written(_facade, "kind, name, n"),
        _values("kind, name, n", ("rows", "in", 1), ("rows", "in out", 3), ("tags", "ul", 1), ("tags", "li", 3), ("tags", "table", 1), ("tags", "tr", 3), ("tags", "th", 2), ("tags", "td", 3), ("keys", "id", 1), ("keys", "class", 2), ("total", "nodes", 13)),
    ),
}
