"""Results as JSON, CSV, Parquet and terminal tables."""

from __future__ import annotations

import csv
import io
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Result

#: Rows of a row group in exported Parquet files.
ROW_GROUP = 1024


def cell(v) -> str | None:
    """A value as text: maps as {k=v,...} by key, null as nothing."""
    if v is None:
        return None
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}={_number(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, list | tuple):
        return "[" + ",".join("" if x is None else str(x) for x in v) + "]"
    return _number(v)


def _number(v) -> str:
    return f"{v:g}" if isinstance(v, float) else str(v)


def ordered(result: Result) -> DataFrame:
    """The result in document order, unless it has an order already."""
    keys = [c for c in ("doc_id", "doc_order") if c in result.df.columns]
    keys += ["row_idx"] if result.kind == "table" else []
    return result.df if result.ordered or not keys else result.df.orderBy(*keys)


def rows(result: Result) -> Iterator[tuple]:
    """The result's rows one by one, a partition at a time on the driver."""
    wanted = ordered(result).select(*(F.col(f"`{c}`") for c in result.columns))
    for r in wanted.toLocalIterator():
        yield tuple(r)


def tables(result: Result) -> list[tuple[object, int, list[list[str]]]]:
    """(document, table node, grid) of a table result."""
    out: list = []
    for r in ordered(result).select("doc_id", "node_id", "cells").toLocalIterator():
        if not out or out[-1][:2] != (r["doc_id"], r["node_id"]):
            out.append((r["doc_id"], r["node_id"], []))
        out[-1][2].append(list(r["cells"]))
    return out


def _csv_line(cells: Iterable[str | None]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(["" if c is None else c for c in cells])
    return out.getvalue()


def grid_header(grid: list[list[str]], header: bool) -> tuple[list[str], list[list[str]]]:
    """Column names and data rows: the first row, or col1, col2, ... without a header."""
    width = max(map(len, grid), default=0)
    if not header:
        return [f"col{i + 1}" for i in range(width)], grid
    names, seen = [], {}
    for i in range(width):
        name = grid[0][i].strip() if grid and i < len(grid[0]) and grid[0][i].strip() else f"col{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return names, grid[1:]


def _one_table(result: Result) -> list[list[str]]:
    found = tables(result)
    if len(found) != 1:
        raise ValueError(f"Export requires a single table result; found {len(found)}")
    return found[0][2]


def write_csv(result: Result, path: str) -> None:
    """One CSV file, quoted where needed, null as an empty cell; a table result's grid as it is."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        if result.kind == "table":
            grid = _one_table(result)
            if result.sink is not None and not result.sink.header:
                f.write(_csv_line(grid_header(grid, False)[0]))
            f.writelines(_csv_line(r) for r in grid)
            return
        f.write(_csv_line(result.columns))
        f.writelines(_csv_line(map(cell, r)) for r in rows(result))


def write_parquet(result: Result, path: str) -> None:
    """One Parquet file of nullable strings in row groups of ROW_GROUP; a table's columns are col1, col2, ..."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    if result.kind == "table":
        grid = _one_table(result)
        names, source = grid_header(grid, False)[0], iter([[*r, *[None] * (max(map(len, grid)) - len(r))] for r in grid])
    else:
        names, source = result.columns, ([cell(x) for x in r] for r in rows(result))
    schema = pa.schema([(n, pa.string()) for n in names])
    with pq.ParquetWriter(path, schema) as out:
        group: list = []
        for r in source:
            group.append(r)
            if len(group) == ROW_GROUP:
                out.write_table(pa.table([list(c) for c in zip(*group, strict=True)], schema=schema))
                group = []
        if group:
            out.write_table(pa.table([list(c) for c in zip(*group, strict=True)], schema=schema))


def write_dataset(result: Result, path: str, format: str = "parquet", stringify: bool = False) -> None:
    """The result as a folder that the executors write in parallel, typed unless ``stringify``."""
    df = result.select(with_doc=result.many)
    if stringify or format == "csv":
        df = df.select(*(F.to_json(c).alias(c) if t.startswith(("map", "array")) else F.col(f"`{c}`").cast("string").alias(c) for c, t in df.dtypes))
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)


def export(result: Result) -> bool:
    """Write the file that the statement names, if it names one."""
    sink = result.sink
    if sink is None or not sink.path:
        return False
    (write_parquet if sink.kind == "parquet" else write_csv)(result, sink.path)
    return True


def to_list(result: Result) -> list:
    """TO LIST(): the one column's values."""
    return [r[0] for r in rows(result)]


def to_json(result: Result, indent: int | None = 2) -> str:
    """An array of objects; of values for TO LIST(); a grid, or {node_id, rows} for each of several tables."""
    if result.kind == "table":
        found = tables(result)
        value: object = found[0][2] if len(found) == 1 else [{"node_id": n, "rows": g} for _, n, g in found]
    elif result.sink is not None and result.sink.kind == "list":
        value = to_list(result)
    else:
        value = [dict(zip(result.columns, r, strict=True)) for r in rows(result)]
    return json.dumps(value, ensure_ascii=False, indent=indent, default=str)


def shortened(text: str, lines: int = 10) -> str:
    """The first and last lines of a long JSON text."""
    all_ = text.split("\n")
    return text if len(all_) <= 2 * lines else "\n".join([*all_[:lines], f"... {len(all_) - 2 * lines} lines ...", *all_[-lines:]])


_JSON = re.compile(r'("(?:[^"\\]|\\.)*")(\s*:)?|\b(true|false|null)\b|(-?\d+(?:\.\d+)?)')


def coloured(text: str) -> str:
    """JSON with ANSI colours for keys, strings, numbers and words."""

    def paint(m: re.Match) -> str:
        if m[1]:
            return f"\033[{36 if m[2] else 32}m{m[1]}\033[0m{m[2] or ''}"
        return f"\033[{35 if m[3] else 33}m{m[0]}\033[0m"

    return _JSON.sub(paint, text)


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _fit(s: str, width: int) -> str:
    if _width(s) <= width:
        return s
    out = ""
    for c in s:
        if _width(out + c) > width - 1:
            break
        out += c
    return out + "…"


def box(columns: list[str], data: list[tuple], total: int | None = None, max_width: int = 80, bold: bool = False) -> str:
    """A table drawn with box characters; numbers to the right, the widest columns shrunk until it fits."""
    text = [["NULL" if x is None else re.sub(r"[\r\n\t]", " ", cell(x)) for x in r] for r in data]
    widths = [max([4, _width(c), *(_width(r[i]) for r in text)]) for i, c in enumerate(columns)]
    while sum(w + 3 for w in widths) + 1 > max(20, max_width) and max(widths) > 4:
        widths[widths.index(max(widths))] -= 1
    rule = lambda a, b, c: a + b.join("─" * (w + 2) for w in widths) + c

    def line(cells: list[str], head: bool = False) -> str:
        out = []
        for s, w in zip(cells, widths, strict=True):
            short = _fit(s, w)
            space = " " * (w - _width(short))
            right = not head and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s)
            padded = space + short if right else short + space
            out.append(f"\033[1m{padded}\033[0m" if head and bold else padded)
        return "│ " + " │ ".join(out) + " │"

    lines = [rule("┌", "┬", "┐"), line(columns, True), rule("├", "┼", "┤"), *map(line, text)]
    if total is not None and total > len(data):
        inner = sum(w + 3 for w in widths) - 3
        note = _fit(f"… truncated, showing first {len(data)} of {total} rows …", inner)
        lines.append("│ " + note + " " * (inner - _width(note)) + " │")
    return "\n".join([*lines, rule("└", "┴", "┘")])


def to_box(result: Result, max_rows: int = 40, max_width: int = 80, bold: bool = False) -> str:
    """The result, or each of its tables, as a box; max_rows 0 shows all."""
    if result.kind == "table":
        out = []
        for _, _, grid in tables(result):
            names, data = grid_header(grid, result.sink.header if result.sink else True)
            shown = data[:max_rows] if max_rows else data
            out.append(box(names, [tuple([*r, *[""] * (len(names) - len(r))]) for r in shown], len(data), max_width, bold))
        return "\n".join(out)
    wanted = ordered(result).select(*(F.col(f"`{c}`") for c in result.columns))
    shown = [tuple(r) for r in (wanted.limit(max_rows + 1) if max_rows else wanted).collect()]
    total = wanted.count() if max_rows and len(shown) > max_rows else len(shown)
    return box(result.columns, shown[:max_rows] if max_rows else shown, total, max_width, bold)
