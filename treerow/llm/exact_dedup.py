"""Exact dedup: tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: What entries of equal texts agree in.
DIGEST = ("text_sha256", "n", "x")
#: Runs of white space that normalisation replaces by one space.
SPACE = r"[\x20\x09-\x0D]+"


def _merged(entries: DataFrame) -> DataFrame:
    """Runs merged: entries dealt by run and slice, sorted, and equal neighbours made one, smallest id kept.

    The sort is the merge of the runs that meet; the aggregate streams over it, as both its distribution
    and its order are those of the sort, so no further exchange or hash table is needed.
    """
    dealt = entries.repartition("run", "slice").sortWithinPartitions("run", "slice", *DIGEST)
    return dealt.groupBy("run", "slice", *DIGEST).agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = 3) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    Every input partition makes a run of (digest, smallest id, count), sorted by digest. In each round
    the runs meet as in ``levels`` levels of a binomial tree at once: those of 2^levels neighbours merge,
    until one run is left. A run is cut into slices of digests, as many as there are leaves, so that no
    task holds a whole run, the last one included. A digest is SHA-256 with the text's length and a second
    hash beside it: an entry is merged only with entries that agree in all three, which is the
    verification at every level. Copies collapse before the first exchange and at each level, so a hot
    text costs a row per run and round.

    Null text counts as empty. Of equal texts the row with the smallest id stays, null ids last; where
    ids tie, one of the rows stays. Only the id and text columns are read, so others may clash. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    # written once: the row number must not change when a task is run again
    leaves = scratch.write(
        docs.select(F.col(id_col).alias("doc_id"), norm.alias("t")).select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").alias("n"), F.xxhash64("t").alias("x"), F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("run")),
        "leaves",
    )
    key = list(DIGEST)
    left = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    # the leading bits of the digest, so that slices are in the order of digests
    cut = F.floor(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long") * left / (1 << 32)).cast("int")
    first = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id"), F.col("rid"))
    runs = leaves.withColumn("slice", cut).groupBy("run", "slice", *key).agg(F.min(first).alias("best"), F.count("*").alias("size"))
    while left > 1:
        left = -(-left >> levels)
        runs = _merged(runs.withColumn("run", F.shiftright("run", levels)))
    copies = runs.filter("size > 1").select(*key, F.col("best.doc_id").alias("keep"), F.col("best.rid").alias("keep_rid"), "size")
    return leaves.join(copies, key, "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        "text_sha256",
    )
