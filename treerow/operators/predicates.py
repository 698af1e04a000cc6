"""WHERE: predicates as columns, axes as windows inside a document."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_ci, lower_literal, split_ws
from ..plans.ast import INT_FIELDS, Compare, DirectText, Exists, Expr, Logic
from ..plans.validate import leaves
from ..sources.nodes import Needs


def literal_int(v: str) -> int | None:
    """A 64-bit integer with optional leading spaces and sign, else nothing."""
    if not re.fullmatch(r"[ \t\n\v\f\r]*[+-]?[0-9]+", v):
        return None
    n = int(v)
    return n if -(1 << 63) <= n < 1 << 63 else None


def java_regex(pattern: str) -> str | None:
    """The pattern for the JVM, or nothing if it isn't valid. A final $ is the very end, not a last line break."""
    from pyspark.sql import SparkSession

    if pattern.endswith("$") and (len(pattern) - len(pattern[:-1].rstrip("\\")) - 1) % 2 == 0:
        pattern = pattern[:-1] + r"\z"
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return None
    return pattern


def needs_of(e: Expr | None, tags: set[str] | None, needs: Needs) -> None:
    """Adds what the predicates read: text and direct text, for the tags they can apply to; whole documents for axes."""
    for x in leaves(e):
        if isinstance(x, DirectText):
            needs.add("direct_text", [lower_literal(x.tag)])
        elif isinstance(x, Compare) and x.operand.field == "text":
            inside = any(isinstance(y, Exists) and x in leaves(y.where) for y in leaves(e))
            needs.add("text", None if x.operand.axis != "self" or inside else tags)
    if uses_axes(e):
        needs.tags = None


def uses_axes(e: Expr | None) -> bool:
    """Whether a predicate looks at other rows of the document."""
    return any(isinstance(x, Compare) and x.operand.axis != "self" or isinstance(x, Exists) and x.where is not None for x in leaves(e))


def own(c: Compare) -> Column:
    """A comparison on the row itself; null counts as false."""
    return F.coalesce(_own(c), F.lit(False))


def _own(c: Compare) -> Column:
    field, op, values = c.operand.field, c.op, list(c.values)
    if field == "attributes":
        return (F.size("attributes") == 0) if op == "is_null" else (F.size("attributes") > 0)
    if op in ("is_null", "is_not_null"):
        if field == "attribute":
            there = F.map_contains_key("attributes", F.lit(c.operand.name))
        elif field == "parent_id":
            there = F.col("parent_id").isNotNull()
        else:
            there = F.lit(True)
        return ~there if op == "is_null" else there
    if field in INT_FIELDS:
        return _numeric(field, op, values)
    if field == "attribute":
        at = F.col("attributes")[c.operand.name]
        if c.operand.name == "class" and op in ("=", "<>", "in"):
            hit = F.arrays_overlap(split_ws(at), F.array(*map(F.lit, values)))
            return at.isNotNull() & ~F.coalesce(hit, F.lit(False)) if op == "<>" else hit
    else:
        at = F.col(field)
        if field == "tag" and op != "~":
            values = [lower_literal(v) for v in values]
    if op == "=":
        return at == values[0]
    if op == "<>":
        return at != values[0]
    if op == "in":
        return at.isin(values)
    if op == "~":
        pattern = java_regex(values[0])
        return F.lit(False) if pattern is None else at.rlike(pattern)
    found = [contains_ci(at, v) for v in values]
    out = found[0]
    for x in found[1:]:
        out = out & x if op == "contains_all" else out | x
    return out


def _numeric(field: str, op: str, values: list[str]) -> Column:
    numbers = [literal_int(v) for v in values]
    if op not in ("=", "<>", "in") or numbers[0] is None and (op != "in" or field != "sibling_pos"):
        return F.lit(False)
    if op == "in":
        return F.col(field).isin([n for n in numbers if n is not None])
    return F.col(field) == numbers[0] if op == "=" else F.col(field) != numbers[0]


class Predicates:
    """Compiles an expression over rows of whole documents. Flags of other rows become columns of these rows.

    Ancestors and descendants: the intervals of elements nest, so a matching ancestor exists if the largest
    subtree_end of the matching rows before this one reaches it, and a matching descendant if the next
    matching row is still inside this one. Both are one pass over a document, whatever its depth. Parents
    and children are such passes too: in preorder, a row's parent is the last row before it that is one
    level up, and the next matching row one level down is a child if it is still inside. For these, each row
    stands once for itself and once, at the other level, for what others look for. So a document is parsed
    and dealt once for all axes of a statement, and rows never multiply, even if documents share an id.
    """

    def __init__(self):
        self.flags = 0

    def filter(self, df: DataFrame, e: Expr | None) -> DataFrame:
        if e is None:
            return df
        columns = df.columns
        df, where = self.compile(e, df)
        return df.filter(where).select(*columns)

    def compile(self, e: Expr, df: DataFrame) -> tuple[DataFrame, Column]:
        if isinstance(e, Logic):
            df, a = self.compile(e.left, df)
            df, b = self.compile(e.right, df)
            return df, (a & b if e.op == "and" else a | b)
        if isinstance(e, DirectText):
            return df, F.coalesce((F.col("tag") == lower_literal(e.tag)) & contains_ci(F.col("direct_text"), e.value), F.lit(False))
        if isinstance(e, Exists):
            if e.where is None:
                return df, {"self": F.lit(True), "parent": F.col("parent_id").isNotNull(), "ancestor": F.col("parent_id").isNotNull()}.get(e.axis, F.col("subtree_end") > F.col("node_id"))
            df, inner = self.compile(e.where, df)
            return self.lift(df, inner, e.axis)
        axis = e.operand.axis
        if axis == "self":
            return df, own(e)
        here = replace(e, operand=replace(e.operand, axis="self"))
        if e.op == "is_null":  # no node of the axis has it
            df, has = self.lift(df, own(replace(here, op="is_not_null")), axis)
            return df, ~has
        return self.lift(df, own(here), axis)

    def _named(self) -> str:
        self.flags += 1
        return f"__flag{self.flags}"

    def lift(self, df: DataFrame, flag: Column, axis: str) -> tuple[DataFrame, Column]:
        """Whether some row on the axis of this one has the flag."""
        if axis == "self":
            return df, flag
        name = self._named()
        df = df.withColumn(name, flag)
        out = self._named()
        if axis == "ancestor":
            before = W.partitionBy("doc_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)
            return df.withColumn(out, F.coalesce(F.max(F.when(F.col(name), F.col("subtree_end"))).over(before) >= F.col("node_id"), F.lit(False))), F.col(out)
        if axis == "descendant":
            after = W.partitionBy("doc_id").orderBy(F.desc("node_id")).rowsBetween(W.unboundedPreceding, -1)
            return df.withColumn(out, F.coalesce(F.min(F.when(F.col(name), F.col("node_id"))).over(after) <= F.col("subtree_end"), F.lit(False))), F.col(out)
        at, other = f"{out}at", F.col("level") + (1 if axis == "parent" else -1)
        roles = F.array(F.struct(F.col("level").alias("level"), F.lit(True).alias("self")), F.struct(other.alias("level"), F.lit(False).alias("self")))
        both = df.select("*", F.explode(roles).alias(at))
        itself, level = F.col(f"{at}.self"), F.col(f"{at}.level")
        if axis == "parent":
            before = W.partitionBy("doc_id", level).orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)
            found = F.last(F.when(~itself, F.col(name)), ignorenulls=True).over(before)
        else:
            after = W.partitionBy("doc_id", level).orderBy(F.desc("node_id")).rowsBetween(W.unboundedPreceding, -1)
            found = F.min(F.when(~itself & F.col(name), F.col("node_id"))).over(after) <= F.col("subtree_end")
        return both.withColumn(out, F.coalesce(found, F.lit(False))).filter(itself).drop(at), F.col(out)
