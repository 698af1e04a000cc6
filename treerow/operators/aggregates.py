"""COUNT, SUMMARIZE, TFIDF and the summaries of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, strip_html, tokenize, tokens_of


def summarize(rows: DataFrame, order: list, limit: int | None) -> DataFrame:
    """(tag, count), most frequent first unless ordered otherwise."""
    counts = rows.groupBy("tag").agg(F.count("*").alias("count"))
    keys = [F.desc(o.field) if o.descending else F.asc(o.field) for o in order] or [F.desc("count")]
    counts = counts.orderBy(*keys, "tag")
    return counts if limit is None else counts.limit(limit)


def term_scores(rows: DataFrame, key: list[str], kept: list[str], top_terms: int = 30, min_df: int = 1, max_df: int = 0, stopwords: bool = True) -> DataFrame:
    """(key..., kept..., term, score): the best terms of each row's written_html, the rows being the corpus; no term for a row without any.

    score = share of the row's kept words x (ln((rows + 1) / (rows with the term + 1)) + 1); terms in fewer
    than min_df or more than max_df rows (0: no bound) go; ties go to the smaller term. Words are counted
    with partial sums; lengths and the best terms are windows over a row's distinct terms. Only the number
    of rows with each term, and of rows, are tables beside that.
    """
    total = rows.agg(F.count("*").alias("rows"))
    words = tokenize(strip_html(F.col("written_html")))
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(*STOPWORDS))
    counts = rows.select(*key, *kept, F.explode_outer(words).alias("term")).groupBy(*key, *kept, "term").agg(F.count("term").alias("n"))
    df = counts.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    if max_df:
        df = df.filter(F.col("df") <= max_df)
    idf = df.crossJoin(F.broadcast(total)).select("term", (F.log((F.col("rows") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # total is one row
    of_row = W.partitionBy(*key)
    share = F.col("n") / F.sum("n").over(of_row)
    scored = counts.withColumn("share", F.when(F.col("n") > 0, share)).join(idf, "term", "left").withColumn("score", F.col("share") * F.col("idf"))
    best = F.row_number().over(of_row.orderBy(F.desc_nulls_last("score"), "term"))
    scored = scored.withColumn("__r", best).filter(F.col("__r") <= top_terms)
    return scored.select(*key, *kept, F.when(F.col("score").isNotNull(), F.col("term")).alias("term"), "score")


def tfidf(rows: DataFrame, options: dict[str, str]) -> DataFrame:
    """(doc_id, node_id, parent_id, tag, terms_score): a map of the best terms per row, empty for a row without words."""
    key = ["doc_id", "node_id"]
    kept = ["parent_id", "tag", "doc_order"]
    scores = term_scores(rows, key, kept, int(options.get("TOP_TERMS", 30)), int(options.get("MIN_DF", 1)), int(options.get("MAX_DF", 0)), options.get("STOPWORDS", "ENGLISH") in ("ENGLISH", "DEFAULT"))
    entry = F.when(F.col("term").isNotNull(), F.struct("term", "score"))
    return scores.groupBy(*key, *kept).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("terms_score"))


def summarize_content(texts: DataFrame, text_col: str, language: str | None = None, max_tokens: int = 20) -> DataFrame:
    """(token, count, score) of the most frequent words of one text set; score equals the count."""
    words = texts.select(F.explode(tokens_of(strip_html(F.col(text_col)), language)).alias("token")).filter(~F.col("token").isin(*STOPWORDS))
    counts = words.groupBy("token").agg(F.count("*").alias("count"))
    return counts.select("token", "count", F.col("count").cast("double").alias("score")).orderBy(F.desc("count"), "token").limit(max_tokens)


def overview(nodes: DataFrame, top: int = 50) -> dict:
    """{total_nodes, tag_counts, attribute_keys}: the ``top`` most frequent of each, ties in order of appearance."""
    first = F.min(F.struct("doc_id", "doc_order"))
    tags = nodes.groupBy("tag").agg(F.count("*").alias("n"), first.alias("first")).orderBy(F.desc("n"), "first").limit(top)
    keys = nodes.select("doc_id", "doc_order", F.posexplode(F.map_keys("attributes")).alias("pos", "key"))
    keys = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "doc_order", "pos")).alias("first")).orderBy(F.desc("n"), "first").limit(top)
    return {"total_nodes": nodes.count(), "tag_counts": {r["tag"]: r["n"] for r in tags.collect()}, "attribute_keys": {r["key"]: r["n"] for r in keys.collect()}}
