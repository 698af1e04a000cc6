"""Chat formatting by prefix-target expansion, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template: <s>role[INST]text</s> per turn.
OPEN, BODY, CLOSE = "<s>", "[INST]", "</s>"


def escape(c: Column) -> Column:
    """No control string is left: backslashes double, and one goes after the first character of each control string."""
    c = F.regexp_replace(c, r"\\", r"\\\\")
    c = F.regexp_replace(c, r"<(/?s>)", r"<\\$1")
    return F.regexp_replace(c, r"\[(/?INST\])", r"[\\$1")


def unescape(c: Column) -> Column:
    """Inverse of escape: a pair of backslashes is one, a single one goes."""
    return F.regexp_replace(c, r"\\(\\)?", "$1")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per training example: conv_id, example, target_turn, formatted, loss_start, loss_chars, is_last.

    Every assistant turn becomes an example of its own: all preceding turns are its context and only its
    reply, ``loss_chars`` code points from ``loss_start`` of ``formatted``, is trainable. What follows the
    last assistant turn, or a conversation without one, gives a final example without a target
    (loss_chars 0, target_turn null), so no turn is lost. is_last marks a conversation's longest example.

    Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have one order. Null
    role or text is empty; rows with a null conversation form one conversation. Extra columns are not read.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    piece = F.struct(
        F.col("turn"), F.col("role"), F.col("text"),
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("t"))
    convs = convs.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("whole"),
        F.transform("t", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), F.length(x["head"]).alias("h"), F.length(x["body"]).alias("b"))).alias("t"),
    )
    # ends of turns by a running sum over each conversation's own short list
    ends = F.expr(
        "transform(t, (x, i) -> named_struct('turn', x.turn, 'role', x.role, 'b', x.b, "
        f"'end', aggregate(slice(t, 1, i + 1), 0L, (a, y) -> a + y.h + y.b + {len(CLOSE)})))"
    )
    convs = convs.withColumn("t", ends)
    cut = F.filter("t", lambda x: x["role"] == "assistant")
    convs = convs.select("conv_id", "whole", F.element_at("t", -1)["end"].alias("all"), cut.alias("cut"))
    targets = F.transform("cut", lambda x: F.struct(x["turn"].alias("target_turn"), x["end"].alias("end"), (x["end"] - len(CLOSE) - x["b"]).alias("loss_start"), x["b"].cast("long").alias("loss_chars")))
    rest = F.array(F.struct(F.lit(None).cast(rows.schema["turn"].dataType).alias("target_turn"), F.col("all").alias("end"), F.col("all").alias("loss_start"), F.lit(0).cast("long").alias("loss_chars")))
    done = F.coalesce(F.element_at(F.col("cut"), F.when(F.size("cut") > 0, F.lit(-1)).otherwise(F.lit(None)))["end"] == F.col("all"), F.lit(False))
    examples = convs.select("conv_id", "whole", "all", F.posexplode(F.when(done, targets).otherwise(F.concat(targets, rest))).alias("example", "x"))
    return examples.select(
        "conv_id", F.col("example").cast("long").alias("example"), "x.target_turn",
        F.expr("substring(whole, 1, cast(x.end as int))").alias("formatted"),
        "x.loss_start", "x.loss_chars", (F.col("x.end") == F.col("all")).alias("is_last"), F.col("x.end").alias("formatted_chars"),
    )


def read_chats(formatted: Column) -> Column:
    """The (role, text) turns of a formatted example, unescaped."""
    parts = F.split(formatted, CLOSE, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), BODY, 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)^.*?\[INST\]", "")).alias("text"),
        ),
    )
