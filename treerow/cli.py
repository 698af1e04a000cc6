"""Command line: one statement, or an interactive shell.

python -m treerow.cli --query "SELECT a.href FROM document" --input page.html --mode json
"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import SparkSession

from .api import Engine
from .functions import numerals
from .operators import aggregates
from .plans.errors import QueryError
from .plans.parser import parse
from .sources import sinks
from .sources.loaders import FetchPolicy, SourceError
from .sources.nodes import Needs

_PATH = re.compile(r"(\bFROM\s+)((?:\.{1,2}/|/|~/)[^\s;'\"]+|[^\s;'\"()]+\.html?)(?=[\s;]|\Z)", re.I)
HELP = """.load <path or URL> [--alias name]   read a document
.mode duckbox|json|plain            how results are shown
.display_mode more|less             whether long JSON is shortened
.max_rows <n|inf>                   rows of a box
.summarize [alias]                  tag counts
.summarize_content [alias] [--lang l] [--max_tokens n]
.number_to_khmer <n> [--khmer-digits] | .khmer_to_number <words>
.help | .quit"""


def quote_path(sql: str) -> str:
    """FROM ./page.html, unquoted, as FROM './page.html'."""
    return _PATH.sub(lambda m: f"{m[1]}'{m[2]}'", sql)


class Shell:
    def __init__(self, engine: Engine, mode: str = "duckbox", max_rows: int = 40, less: bool = False, colour: bool = False):
        self.engine, self.mode, self.max_rows, self.less, self.colour = engine, mode, max_rows, less, colour

    def answer(self, line: str) -> str:
        """The text that a statement or command shows."""
        line = line.strip()
        if line.startswith("."):
            word, *args = line.split()
            command = getattr(self, "do_" + word[1:], None)
            if command is None:
                raise QueryError(f"unknown command {word}")
            return command(args, line[len(word) :].strip())
        return self.statement(line)

    def statement(self, sql: str) -> str:
        result = self.engine.query(quote_path(sql))
        if sinks.export(result):
            return f"Wrote {result.sink.path}"
        if self.mode == "duckbox" and not (result.sink is not None and result.sink.kind == "list"):
            return sinks.to_box(result, self.max_rows, bold=self.colour)
        text = sinks.to_json(result)
        text = sinks.shortened(text) if self.less else text
        return sinks.coloured(text) if self.colour and self.mode == "json" else text

    def do_help(self, args: list[str], rest: str) -> str:
        return HELP

    def do_load(self, args: list[str], rest: str) -> str:
        alias = args[args.index("--alias") + 1] if "--alias" in args else None
        if not args:
            raise QueryError(".load needs a path or URL")
        self.engine.load(args[0], alias)
        return f"Loaded {args[0]}" + (f" as {alias}" if alias else "")

    def do_mode(self, args: list[str], rest: str) -> str:
        if args not in (["duckbox"], ["json"], ["plain"]):
            raise QueryError(".mode needs duckbox, json or plain")
        self.mode = args[0]
        return f"Mode {self.mode}"

    def do_display_mode(self, args: list[str], rest: str) -> str:
        if args not in (["more"], ["less"]):
            raise QueryError(".display_mode needs more or less")
        self.less = args == ["less"]
        return f"Display mode {args[0]}"

    def do_max_rows(self, args: list[str], rest: str) -> str:
        if len(args) != 1 or not (args[0].isdigit() or args[0] == "inf"):
            raise QueryError(".max_rows needs a number or inf")
        self.max_rows = 0 if args[0] == "inf" else int(args[0])
        return f"Max rows {args[0]}"

    def do_summarize(self, args: list[str], rest: str) -> str:
        return self.statement(f"SELECT SUMMARIZE(*) FROM {args[0] if args else 'document'}")

    def do_summarize_content(self, args: list[str], rest: str) -> str:
        option = lambda name, default: args[args.index(name) + 1] if name in args else default
        alias = args[0] if args and not args[0].startswith("--") else None
        nodes = self.engine.nodes(alias, Needs({"inner_html": None}).columns).filter("parent_id IS NULL")
        found = aggregates.summarize_content(nodes, "inner_html", option("--lang", None), int(option("--max_tokens", 20)))
        return sinks.box(found.columns, [tuple(r) for r in found.collect()])

    def do_number_to_khmer(self, args: list[str], rest: str) -> str:
        number = next((a for a in args if not a.startswith("--")), "")
        if "--khmer-digits" in args:
            return numerals.to_numerals(number)
        words = numerals.to_words(number)
        return words.replace(numerals.JOIN, "") if "--compact" in args else words

    def do_khmer_to_number(self, args: list[str], rest: str) -> str:
        return numerals.from_words(rest)

    def loop(self) -> None:
        while True:
            try:
                line = input("treerow> ")
            except EOFError:
                return
            if line.strip() in (".quit", ".q", ".exit"):
                return
            if line.strip():
                try:
                    print(self.answer(line))
                except (ValueError, IndexError, OSError) as e:
                    print(f"Error: {e}")


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="treerow", description="Query HTML with SQL-like statements on Spark.")
    args.add_argument("--query", "-q")
    args.add_argument("--query-file")
    args.add_argument("--input", "-i", help="path, glob or URL; standard input if left out")
    args.add_argument("--mode", choices=("duckbox", "json", "plain"), default="duckbox")
    args.add_argument("--max-rows", type=int, default=40)
    args.add_argument("--display-mode", choices=("more", "less"), default="more")
    args.add_argument("--interactive", action="store_true")
    args.add_argument("--allow-network", action="store_true")
    args.add_argument("--colour", action="store_true")
    given = args.parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, FetchPolicy(allow_network=given.allow_network))
    shell = Shell(engine, given.mode, given.max_rows, given.display_mode == "less", given.colour)
    sql = given.query
    if given.query_file:
        with open(given.query_file, encoding="utf-8") as f:
            sql = f.read()
    try:
        if given.input:
            engine.files(given.input) if any(c in given.input for c in "*?[") else engine.load(given.input)
        elif sql and not given.interactive and _reads_input(sql):
            engine.html(sys.stdin.read())
        if sql:
            print(shell.answer(sql))
        if given.interactive or not sql:
            shell.loop()
    except (ValueError, OSError, SourceError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


def _reads_input(sql: str) -> bool:
    q = parse(quote_path(sql))
    source = q.source
    while source.query is not None:
        source = source.query.source
    return q.kind == "select" and source.kind in ("document", "name")


if __name__ == "__main__":
    sys.exit(main())
