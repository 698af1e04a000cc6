"""Statements on small pages, exact rows."""

import json
import random

import pytest

from treerow import api
from treerow.api import Engine
from treerow.plans.errors import QueryError
from treerow.sources import html as tree
from treerow.sources import sinks


def rows(spark, page, sql):
    return list(sinks.rows(Engine(spark).html(page).query(sql)))


STALL = "<div class='stall'><span data-part='q1'>4 kg</span><div><b>plums from Oakfield</b></div><span data-part='w'>7 coins</span><em> </em></div>"
CASES = [
    ("<ul id='rivers'><li>Elbe</li></ul>", "SELECT ul.node_id FROM document WHERE attributes.id = 'rivers'", [(0,)]),
    ('<div class="wide  ripe"></div><div class="green"></div>', "SELECT div.node_id FROM doc WHERE attributes.class IN ('ripe')", [(0,)]),
    ("<div id='t1'><table></table></div><div id='t2'><table></table></div>", "SELECT table.node_id FROM doc WHERE parent.attributes.id = 't1'", [(1,)]),
    ("<h1></h1><h2></h2><p></p>", "SELECT h1,h2 FROM doc", [(0, "h1", {}, None, 0, 0), (1, "h2", {}, None, 0, 1)]),
    ("<div id='root'><a href='x'><span></span></a></div>", "SELECT span.node_id FROM doc WHERE ancestor.attributes.id='root'", [(2,)]),
    ("<div id='root'><a href='x'><span></span></a></div>", "SELECT div.node_id FROM doc WHERE descendant.attributes.href='x'", [(0,)]),
    ("<div><a></a></div><div></div>", "SELECT div.node_id FROM doc WHERE child.tag = 'span'", []),
    ("<div></div><div id='x'></div>", "SELECT div.node_id FROM doc WHERE attributes IS NULL", [(0,)]),
    ("<a href='x'></a><a href='y'></a><a></a>", "SELECT a.node_id FROM doc WHERE attributes.href <> 'x'", [(1,)]),
    ("<a href='/map.svg'></a><a href='/svg/map'></a>", "SELECT a.node_id FROM doc WHERE attributes.href ~ '[.]svg$'", [(0,)]),
    ("<a href='ftp://Orchard.test'></a><a href='https://x'></a>", "SELECT a.node_id FROM doc WHERE href CONTAINS 'ORCHARd'", [(0,)]),
    ("<a href='https://x/a.html'></a><a href='mailto:x'></a>", "SELECT a.node_id FROM doc WHERE href CONTAINS ANY ('https', 'mailto')", [(0,), (1,)]),
    ("<a HREF='x'></a>", "SELECT a.node_id FROM doc WHERE HREF = 'x'", []),
    ("<ul><li>One</li><li>Two</li></ul>", "SELECT li(node_id, sibling_pos) FROM doc WHERE sibling_pos = ' 2'", [(2, 2)]),
    ("<div><span class='price'></span><h2></h2></div><div><span></span><h2 class='price'></h2></div>", "SELECT div.node_id FROM doc WHERE EXISTS(child WHERE tag='span' AND attributes.class='price')", [(0,)]),
    ("<div><span class='price'></span><h2></h2></div><div><span></span><h2 class='price'></h2></div>", "SELECT div.node_id FROM doc WHERE child.tag='span' AND child.attributes.class='price'", [(0,), (3,)]),
    ("<div><p></p></div>", "SELECT * EXCLUDE (attributes, doc_order) FROM doc WHERE child.attributes.id IS NULL", [(0, "div", None, 1), (1, "p", 0, 0)]),
    ("<div id='root'><span><b>Hi</b></span><em>There</em></div>", "SELECT inner_html(div, 1) FROM doc WHERE id = 'root'", [("<span>Hi</span><em>There</em>",)]),
    ("<span id=x>   hi   there  </span>", "SELECT raw_inner_html(span) FROM doc WHERE id = 'x'", [("   hi   there  ",)]),
    ("<span id=x>   hi   there  </span>", "SELECT inner_html(span) FROM doc WHERE id = 'x'", [(" hi there ",)]),
    ("<a href=' x '></a><a></a>", "SELECT trim(a.href) FROM doc", [("x",), (None,)]),
    ("<div></div><div></div><span></span>", "SELECT COUNT(div) FROM doc LIMIT 1", [(1,)]),
    ("<div></div><div></div><span></span>", "SELECT SUMMARIZE(*) FROM doc", [("div", 2), ("span", 1)]),
    ("<div></div><div></div><a></a>", "SELECT SUMMARIZE(*) FROM doc ORDER BY tag LIMIT 1", [("a", 1)]),
    ("<p>apple apple banana</p><p>banana banana carrot</p><p></p>", "SELECT TFIDF(p, TOP_TERMS=1, STOPWORDS=NONE) FROM doc", None),
    ("<div><p>One</p><span>Two</span></div><div><p>Three</p></div>", "SELECT FLATTEN_TEXT(div) AS (a, b) FROM doc WHERE descendant.tag IN ('p','span')", [("One", "Two"), ("Three", None)]),
    ("<div><section> Alpha <p>One</p></section></div>", "SELECT FLATTEN_TEXT(div, 1) AS (a) FROM doc", [("Alpha",)]),
    (STALL, "SELECT div.class, FLATTEN(div) AS (a, b, c) FROM doc WHERE class = 'stall'", [("stall", "4 kg", "plums from Oakfield", "plums from Oakfield")]),
    (STALL, "SELECT FLATTEN(doc) AS (a, b) FROM doc WHERE class = 'stall' AND descendant.attributes.data-part CONTAINS ANY ('Q1', 'w')", [("4 kg", "7 coins")]),
    ("<p>x</p>", "SELECT li.node_id FROM RAW('<ul><li>1</li></ul>') AS r WHERE r.node_id = 1", [(1,)]),
    ("<p>b</p><p>a</p>", "SELECT p.node_id FROM doc ORDER BY text", [(1,), (0,)]),
    ("<ul><li></li></ul><p></p>", "SELECT * EXCLUDE (attributes, max_depth, doc_order, tag) FROM doc ORDER BY parent_id DESC, node_id DESC", [(2, None), (0, None), (1, 0)]),
]


@pytest.mark.parametrize(("page", "sql", "want"), CASES, ids=[str(i) for i in range(len(CASES))])
def test_statement(spark, page, sql, want):
    got = rows(spark, page, sql)
    if want is None:
        assert [(r[0], list(r[3])) for r in got] == [(0, ["apple"]), (1, ["banana"]), (2, [])]
    else:
        assert got == want


def test_stall_values_do_not_repeat_with_strict_candidates(spark):
    assert rows(spark, STALL, "SELECT FLATTEN(div) AS (a, b, c) FROM doc WHERE class = 'stall' AND descendant.tag IN ('span', 'b')") == [("4 kg", "plums from Oakfield", "7 coins")]


def test_fragments(spark):
    page = "<div class=x><ul><li>1</li></ul></div><div class=x> </div><div class=x><ul><li>2</li></ul></div>"
    assert rows(spark, page, "SELECT li(node_id, parent_id) FROM FRAGMENTS(SELECT inner_html(div, 2) FROM doc WHERE class = 'x') AS f") == [(1, 0), (3, 2)]
    for sql, message in (
        ("SELECT li FROM FRAGMENTS(SELECT div.class FROM doc)", "HTML strings"),
        ("SELECT li FROM FRAGMENTS(SELECT div.none FROM doc)", "no HTML fragments"),
        ("SELECT li FROM FRAGMENTS(SELECT div(tag, class) FROM doc)", "single HTML string"),
    ):
        with pytest.raises(QueryError, match=message):
            rows(spark, page, sql)
    with pytest.raises(QueryError, match="fragment count"):
        rows(spark, "<p class=x>a<b>c</b></p>" * 1001, "SELECT b FROM FRAGMENTS(SELECT inner_html(p) FROM doc WHERE class = 'x')")


def test_many_documents_stay_apart(spark):
    table = spark.createDataFrame([(1, "u1", "<div><a></a></div>"), (2, "u2", "<a></a><div></div>"), (3, "u3", None), (4, None, "")], "page_id long, url string, html string")
    engine = Engine(spark).pages(table)
    assert sorted(map(tuple, engine.sql("SELECT a(node_id) FROM document WHERE ancestor.tag = 'div' OR parent.tag = 'div'").collect())) == [(1, 1)]
    assert engine.query("SELECT a FROM document").columns[0] == "source_uri"
    assert engine.sql("SELECT COUNT(*) FROM document").first()[0] == 4
    assert [tuple(r) for r in engine.sql("SELECT a.node_id FROM document ORDER BY node_id DESC LIMIT 2").collect()] == [(1, 1), (2, 0)]


# a plain interpreter, against which random statements are compared


def axis(e, name, all_):
    if name == "self":
        return [e]
    if name == "parent":
        return [e.parent] if e.parent is not None else []
    if name == "child":
        return [x for x in all_ if x.parent is e]
    return [x for x in all_ if (x.id < e.id <= x.end if name == "ancestor" else e.id < x.id <= e.end)]


def holds(p, e, all_):
    kind = p[0]
    if kind in ("and", "or"):
        return (all if kind == "and" else any)([holds(x, e, all_) for x in p[1:]])
    if kind == "exists":
        return any(p[2] is None or holds(p[2], x, all_) for x in axis(e, p[1], all_))
    if kind == "tag":
        return any(x.tag == p[2] for x in axis(e, p[1], all_))
    if kind == "null":
        return not any("k" in x.attributes for x in axis(e, p[1], all_))
    return any(x.attributes.get("k") == p[2] for x in axis(e, p[1], all_))


def words(p):
    kind = p[0]
    if kind in ("and", "or"):
        return f"({words(p[1])} {kind.upper()} {words(p[2])})"
    if kind == "exists":
        return f"EXISTS({p[1]}" + (f" WHERE {words(p[2])})" if p[2] else ")")
    at = "" if p[1] == "self" else p[1] + "."
    return f"{at}tag = '{p[2]}'" if kind == "tag" else f"{at}attributes.k IS NULL" if kind == "null" else f"{at}attributes.k = '{p[2]}'"


def predicate(rng, depth):
    names = ("self", "parent", "child", "ancestor", "descendant")
    kind = rng.choice(["and", "or", "exists", "tag", "null", "k"] if depth else ["tag", "null", "k"])
    if kind in ("and", "or"):
        return (kind, predicate(rng, depth - 1), predicate(rng, depth - 1))
    if kind == "exists":
        return (kind, rng.choice(names), predicate(rng, depth - 1) if rng.random() < 0.8 else None)
    return (kind, rng.choice(names), rng.choice("ab") if kind == "tag" else rng.choice("xy"))


def test_random_predicates(spark):
    rng = random.Random(11)
    pages = []
    for i in range(12):
        pages.append((i, "".join(rng.choice(["<a>", "<b>", "<a k=x>", "<b k=y>", "</a>", "</b>", "t"]) for _ in range(30))))
    table = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").coalesce(1)
    engine = Engine(spark).pages(table)
    for _ in range(12):
        p = predicate(rng, 3)
        got = sorted(tuple(r) for r in engine.sql(f"SELECT * EXCLUDE (tag, attributes, parent_id, max_depth, doc_order, source_uri) FROM document WHERE {words(p)}").collect())
        want = []
        for i, h in pages:
            all_ = tree.parse([h])
            want += [(i, e.id) for e in all_ if holds(p, e, all_)]
        assert got == sorted(want), words(p)


def test_sinks(spark, tmp_path):
    import pyarrow.parquet as pq

    engine = Engine(spark).html("<a href='x' id=i>Hi, \"you\"</a><a>Skip</a><a href='y'></a>")
    engine.run(f"SELECT a.href, TEXT(a) FROM document WHERE href IS NOT NULL TO CSV('{tmp_path}/a.csv')")
    assert (tmp_path / "a.csv").read_text() == 'href,text\nx,"Hi, ""you"""\ny,\n'
    engine.run(f"SELECT a FROM document TO PARQUET('{tmp_path}/a.parquet')")
    table = pq.read_table(tmp_path / "a.parquet")
    assert table.column("attributes").to_pylist() == ["{href=x,id=i}", "{}", "{href=y}"] and str(table.schema.field("node_id").type) == "string"
    page = Engine(spark).html("<table><tr><th>H1</th><th>H2</th></tr><tr><td>A</td><td>B</td></tr></table>")
    page.run(f"SELECT table FROM document TO TABLE(EXPORT='{tmp_path}/t.csv')")
    page.run(f"SELECT table FROM document TO TABLE(HEADER=OFF, EXPORT='{tmp_path}/n.csv')")
    assert (tmp_path / "t.csv").read_text() == "H1,H2\nA,B\n"
    assert (tmp_path / "n.csv").read_text() == "col1,col2\nH1,H2\nA,B\n"
    page.run(f"SELECT table FROM document TO CSV('{tmp_path}/d.csv')")
    assert (tmp_path / "d.csv").read_text() == "H1,H2\nA,B\n"
    assert json.loads(sinks.to_json(page.query("SELECT table FROM document TO TABLE()"))) == [["H1", "H2"], ["A", "B"]]
    assert json.loads(sinks.to_json(engine.query("SELECT a.href FROM document TO LIST()"))) == ["x", None, "y"]
    assert "H1" in sinks.to_box(page.query("SELECT table FROM document TO TABLE()"))
    sinks.write_dataset(engine.query("SELECT a FROM document"), f"{tmp_path}/set")
    assert spark.read.parquet(f"{tmp_path}/set").count() == 3
    with pytest.raises(ValueError, match="single table"):
        Engine(spark).html("<p></p>").run(f"SELECT table FROM document TO TABLE(EXPORT='{tmp_path}/x.csv')")


def test_box():
    assert sinks.box(["node_id", "tag"], [(1, "div")]) == "┌─────────┬──────┐\n│ node_id │ tag  │\n├─────────┼──────┤\n│       1 │ div  │\n└─────────┴──────┘"
    assert "│ beta  │   3.5 │" in sinks.box(["name", "value"], [("alpha", "12"), ("beta", "3.5")])
    assert "│ NULL      │ div  │" in sinks.box(["parent_id", "tag"], [(None, "div")])
    cut = sinks.box(["node_id", "text"], [(1, "a very long piece of text")], max_width=30)
    assert "…" in cut and "a very long piece of text" not in cut
    assert "trun" in sinks.box(["node_id"], [(1,), (2,)], total=3)


def test_descriptions(spark):
    engine = Engine(spark).html("<p></p>")
    assert engine.query("DESCRIBE doc").columns == ["column_name", "type", "nullable", "notes"]
    assert [engine.sql(s).count() for s in ("SHOW FUNCTIONS", "SHOW AXES", "SHOW OPERATORS", "DESCRIBE doc", "DESCRIBE language;", "SHOW INPUT", "SHOW INPUTS")] == [9, 4, 12, 8, 55, 1, 1]


def test_facade(spark, tmp_path):
    (tmp_path / "p.html").write_text("<div><p id=a>x</p><p>y</p></div>")
    doc = api.load("p.html", base_dir=tmp_path)
    out = api.execute("SELECT p FROM document ORDER BY node_id DESC", spark=spark)
    assert [r["node_id"] for r in out.rows] == [2, 1] and out.rows[0]["max_depth"] == 0
    assert api.summarize(doc, spark=spark) == {"total_nodes": 3, "tag_counts": {"p": 2, "div": 1}, "attribute_keys": {"id": 1}}
    assert api.execute("SELECT a FROM document TO CSV('x.csv')", source="<a></a>", spark=spark).export_sink == api.ExportSink("csv", "x.csv")
    assert api.load(b"<p>caf\xe9 charset=latin-1</p>").html.startswith("<p>caf\xe9")
    for call in (
        lambda: api.load("../../etc/passwd", base_dir=tmp_path), lambda: api.load("http://example.com"), lambda: api.load("http://127.0.0.1/", allow_network=True),
        lambda: api.load("<div></div>" * 100_001), lambda: api.load("<" + "a" * 5_000_001), lambda: api.execute("SELECT a FROM document", params={"x": 1}),
        lambda: api.execute("SELECT a FROM document", source="<a></a><a></a>", max_results=1, spark=spark), lambda: api.load("missing.html"),
    ):
        with pytest.raises(ValueError):
            call()


def test_files_and_shell(spark, tmp_path):
    from treerow.cli import Shell, quote_path

    for i in range(3):
        (tmp_path / f"{i}.html").write_text(f"<p>{i}</p>")
    assert Engine(spark).files(f"{tmp_path}/*.html").sql("SELECT COUNT(p) FROM document").first()[0] == 3
    assert quote_path("SELECT a FROM ./x.html LIMIT 1") == "SELECT a FROM './x.html' LIMIT 1"
    shell = Shell(Engine(spark))
    shell.answer(f".load {tmp_path}/1.html --alias one")
    assert "│ p    │" in shell.answer(f"SELECT p.tag FROM {tmp_path}/2.html")
    assert "p" in shell.answer(".summarize one") and shell.answer(".number_to_khmer 10") == "ដប់" and shell.answer(".khmer_to_number ដប់") == "10"
    assert shell.answer(".mode json") and json.loads(shell.answer("SELECT TEXT(p) FROM one WHERE node_id = 0")) == [{"text": "1"}]
    assert shell.answer(".summarize_content one --max_tokens 3")


def test_tokenizers_and_functions(spark):
    from pyspark.sql import functions as F

    from treerow.functions.text import register_tokenizer
    from treerow.operators.aggregates import summarize_content

    texts = spark.createDataFrame([("<p>to be or not to be</p><p>Word WORD</p>",)], "t string")
    assert [tuple(r) for r in summarize_content(texts, "t").collect()] == [("beword", 1, 1.0), ("not", 1, 1.0), ("word", 1, 1.0)]
    register_tokenizer("chars", lambda s: [c for c in s if c.isupper()])
    assert [tuple(r) for r in summarize_content(texts, "t", "chars", 2).collect()] == [("W", 2, 2.0), ("D", 1, 1.0)]
    Engine(spark).register_functions()
    assert tuple(texts.select(F.expr("minify_html(' a  b ')"), F.expr("limit_html('<b>x</b>', 0)"), F.expr("direct_text('a<p>b</p>')"), F.expr("khmer_words('10')")).first()) == (" a b ", "x", "a", "ដប់")


def test_stream_of_pages(spark, tmp_path):
    from treerow.streaming.pages import page_stream, stream_nodes, write_nodes

    spark.createDataFrame([(1, "u", "<p><b></b></p>"), (2, "u", "<i></i>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/in")
    write_nodes(stream_nodes(page_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert sorted((r.doc_id, r.tag) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "b"), (1, "p"), (2, "i")]


def test_plans_scan_only_what_they_need(spark, capsys):
    table = spark.createDataFrame([(1, "u", "<a></a>")], "page_id long, url string, html string")
    Engine(spark).pages(table).sql("SELECT a.href FROM document WHERE href = 'x'").explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "inner_html" not in plan


def test_tfidf_counts_references_as_its_sql_does(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from treerow.catalogue import CATALOGUE

    titles = ["token = &quot;abc&quot; &amp; xy", "plum&amp;&am", "plum&amp;&amp", "pear &quo", "&quot;&quot;", "fig > fig", "Elbe &lt;b&gt;"]
    html = [f"<html><body><h1>{t}</h1><footer>&copy; orchard &middot; row {i}</footer></body></html>" for i, t in enumerate(titles)]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").selectExpr("page_id", "'x' AS url", "html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    run, sql = CATALOGUE["tfidf_long"]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = sorted(map(tuple, run(spark, str(tmp_path)).collect()))
    assert found == sorted(db.execute(sql).fetchall())
    assert ["quot"] == [term for doc, node, term, _ in found if (doc, node) == (4, 2)]
