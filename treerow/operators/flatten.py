"""FLATTEN: the texts of an element's descendants, left to right, as columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Compare, Expr, Logic, Operand
from ..plans.validate import is_descendant_filter, leaves
from .predicates import own


def split_filters(e: Expr | None) -> tuple[Expr | None, list[Compare]]:
    """The expression without comparisons on descendants, which choose candidates instead, and those comparisons."""
    chosen = [x for x in leaves(e, False) if is_descendant_filter(x)]
    return _without(e), chosen


def _without(e: Expr | None) -> Expr | None:
    if isinstance(e, Logic):
        left, right = _without(e.left), _without(e.right)
        if left is None or right is None:
            return left or right
        return Logic(e.op, left, right)
    return None if e is not None and is_descendant_filter(e) else e


def candidate(filters: list[Compare]):
    out = F.lit(True)
    for f in filters:
        if f.op == "=":  # one value counts, for classes too
            f = replace(f, values=f.values[:1])
        out = out & own(replace(f, operand=Operand(f.operand.field, f.operand.name)))
    return out


def candidate_tags(filters: list[Compare]) -> set[str] | None:
    """Tags that candidates are limited to, if a filter names them."""
    for f in filters:
        if f.operand.field == "tag":
            return {v.lower() for v in (f.values[:1] if f.op == "=" else f.values)}
    return None


def flatten(base: DataFrame, nodes: DataFrame, filters: list[Compare], depth: int | None, names: tuple[str, ...]) -> DataFrame:
    """base's rows with the columns ``names``: values of their candidates in document order, null where there are too few.

    Candidates lie inside the row's interval in the same document, or exactly ``depth`` levels below it;
    without a depth, empty values don't count. Rows without values stay.
    """
    found = nodes.filter(candidate(filters)).select(F.col("doc_id").alias("__doc"), F.col("node_id").alias("__node"), F.col("level").alias("__level"), "flat_text")
    same = F.col("__doc") == F.col("doc_id")
    if depth is None:
        found = found.filter("flat_text <> ''")
        inside = same & (F.col("__node") > F.col("node_id")) & (F.col("__node") <= F.col("subtree_end"))
    else:
        inside = same & F.col("__node").between(F.col("node_id"), F.col("subtree_end")) & (F.col("__level") == F.col("level") + depth)
    pairs = base.select("doc_id", "node_id", "subtree_end", "level").join(found, inside)
    values = pairs.groupBy("doc_id", "node_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("__node", "flat_text"))), 1, len(names)), lambda x: x["flat_text"]).alias("__values"))
    out = base.join(values, ["doc_id", "node_id"], "left")
    return out.select(*base.columns, *(F.get("__values", F.lit(i)).alias(n) for i, n in enumerate(names)))
