"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

#: (kind, pattern, characters of its value at least). The value is the last group of assign, else the match.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    # the least lengths of these two stand in the pattern: a run's matches that are long enough stay the same
    ("access", r"AKIA[A-Z0-9]{14,}", 18),
    ("hex", r"[0-9a-f]{16,}", 16),
)
#: Values with one of these are placeholders of documentation, whatever their owner.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567890?abcdef"


def _elements(text: Column, kind: str, pattern: str) -> Column:
    """(n, m, v) of each match: code points from the last match's end to its own, the match, its value."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?{pattern}"), F.lit(0))
    whole = lambda e: F.regexp_extract(e, rf"(?s){pattern}$" if kind != "assign" else pattern, 0)
    value = (lambda e: F.regexp_extract(e, pattern, 1)) if kind == "assign" else whole
    out = F.transform(found, lambda e: F.struct(F.length(e).alias("n"), whole(e).alias("m"), value(e).alias("v")))
    # a cheap exact test first: most texts have no match at all
    maybe = {"assign": F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), "access": F.contains(text, F.lit("AKIA")), "hex": F.rlike(text, F.lit("[0-9a-f]{16}"))}[kind]
    return F.when(maybe, out)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = 3, live_repos: int = 3) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_shared.

    Base spans are the leftmost non-overlapping matches of KINDS, per kind, without those whose value is
    too short; positions are code points, end exclusive. Over the whole corpus each value's hash then gets
    its number of distinct repositories and owners: a value with ``example_owners`` owners or more is a
    widely copied example; one of a single owner, in at most ``live_repos`` repositories, that has letters
    and digits and no placeholder word is owner-specific and looks live; all else is shared. The span of
    each live value is added as kind ``live``; base spans stay.

    Only matches, never texts, are shuffled; hashes are counted by (hash, owner, repository) before they
    meet, so a value copied into a third of all rows is a few rows per task. Null text is empty, a null
    owner or repository counts as one of its own; repeated rows each get their row. Extra columns are not
    read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "owner", "repo", F.monotonically_increasing_id().alias("rid"), *(_elements(F.col("t"), k, p).alias(k) for k, p, _ in KINDS))
    rows = scratch.write(rows, "matches")  # matches only; fixes the row numbers

    spans = None
    for order, (kind, _, least) in enumerate(KINDS):
        x = rows.filter(F.size(kind) > 0).select("rid", "owner", "repo", F.posexplode(kind).alias("pos", "e"))
        x = x.withColumn("end", F.sum("e.n").over(W.partitionBy("rid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
        x = x.filter(F.length("e.v") >= least).select(
            "rid", "owner", "repo", F.lit(order).alias("order"), F.lit(kind).alias("kind"),
            (F.col("end") - F.length("e.m")).alias("start"), "end", (F.col("end") - F.length("e.v")).alias("vstart"),
            F.sha2("e.v", 256).alias("hash"), _looks_live(F.col("e.v")).alias("looks"),
        )
        spans = x if spans is None else spans.unionByName(x)
    spans = scratch.write(spans, "spans")

    owners = spans.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    # a table of its own, so that the join deals both sides anew and can split the spans of a very common value
    freq = scratch.write(owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")), "frequencies")
    ranked = spans.join(freq, "hash").withColumn(
        "class",
        F.when(F.col("owners") >= example_owners, "example").when((F.col("owners") == 1) & (F.col("repos") <= live_repos) & F.col("looks"), "live").otherwise("shared"),
    )
    text = lambda kind, start: F.concat_ws(":", kind, F.col(start).cast("string"), F.col("end").cast("string"))
    entry = F.struct("start", "order", "end", text(F.col("kind"), "start").alias("s"))
    live = F.struct(F.col("vstart").alias("start"), F.lit(len(KINDS)).alias("order"), "end", text(F.lit("live"), "vstart").alias("s"))
    per_row = ranked.groupBy("rid").agg(
        F.sort_array(F.collect_list(entry)).alias("base"),
        F.sort_array(F.collect_set(F.when(F.col("class") == "live", live))).alias("added"),
        *(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k, _, _ in KINDS),
        *(F.sum((F.col("class") == c).cast("long")).alias(f"n_{c}") for c in ("live", "example", "shared")),
    )
    joined = lambda c: F.array_join(F.transform(c, lambda e: e["s"]), ",")
    counts = [f"n_{k}" for k, _, _ in KINDS]
    return rows.select("rid", "doc_id").join(per_row, "rid", "left").select(
        "doc_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.sha2(F.coalesce(joined(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined(F.sort_array(F.concat("base", "added"))), F.lit("")).alias("spans"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "n_shared")),
    )


def _looks_live(v: Column) -> Column:
    return F.rlike(v, F.lit("[A-Za-z]")) & F.rlike(v, F.lit("[0-9]")) & ~F.rlike(v, F.lit(PLACEHOLDER))
