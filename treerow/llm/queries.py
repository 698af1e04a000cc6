"""The opN queries over the test tables, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .chat_format import BODY, CLOSE, OPEN, format_chats, read_chats, unescape
from .common import Scratch
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .language import identify
from .line_dedup import dedup_lines
from .packing import pack
from .secrets import scan_secrets
from .simhash import simhash_groups
from .suffix_dedup import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that occur elsewhere."""
    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secret spans, with owner-specific ones marked; owner is the source, repository the document."""
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from WARC files: its payload's size and digest, and which response a revisit refers to."""
    scratch = Scratch(spark, "warc")
    warc.write_captures(_table(spark, sf_dir, "pages"), scratch.path("archive"))
    records = warc.read_records(spark, scratch.path("archive"), with_payload=False)
    # written once, as the joins below read the records several times
    records = scratch.write(records, "records")
    captures = warc.transactions(records)
    captures = warc.resolve_revisits(captures, scratch.write(warc.originals(captures), "originals"))
    page = lambda c: F.col(f"{c}.fields")["page-id"].cast("long")
    return captures.select(
        page("metadata").alias("page_id"),
        F.coalesce("capture.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.warc_type").alias("record_type"),
        page("original.metadata").alias("refers_to"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when near-duplicate lines of the corpus stay once."""
    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_kept").alias("n_kept"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that benchmark windows cover."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("matches")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash and component of every document."""
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation as read back from its formatted examples, conversation -7 among them."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    examples = format_chats(turns)
    read = examples.select(
        "conv_id", "example", "formatted_chars",
        F.when(F.col("is_last"), F.col("formatted")).alias("last"),
        F.when(F.col("loss_chars") > 0, unescape(F.expr("substring(formatted, cast(loss_start as int) + 1, cast(loss_chars as int))"))).otherwise("").alias("loss"),
    )
    convs = read.groupBy("conv_id").agg(F.max("last").alias("last"), F.sum("formatted_chars").alias("formatted_chars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"))
    turn = read_chats(F.col("last"))
    convs = convs.select("conv_id", turn.alias("t"), "loss", "formatted_chars")
    return convs.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal normalised texts stays, for every document."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc": op3_warc,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_chat_format": op9_chat_format,
    "op10_exact_dedup": op10_exact_dedup,
}

_SECRET_KINDS = (
    ("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    ("hex", 2, "[0-9a-f]+", 0, 16),
)


def _secret_sql() -> str:
    parts = []
    for kind, order, pattern, group, least in _SECRET_KINDS:
        parts.append(
            f"""SELECT doc_id, source, '{kind}' AS kind, {order} AS ord, e_end - length(m) AS s, e_end AS e, v FROM (
            SELECT doc_id, source, regexp_extract(el, '{pattern}$', 0) AS m, regexp_extract(el, '{pattern}$', {group}) AS v,
                   sum(length(el)) OVER (PARTITION BY doc_id ORDER BY i) AS e_end
            FROM (SELECT doc_id, source, unnest(a) AS el, generate_subscripts(a, 1) AS i FROM (
                  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '(?s).*?{pattern}', 0) AS a FROM documents)))
            WHERE length(v) >= {least}"""
        )
    return f"""WITH sp AS ({" UNION ALL ".join(parts)}),
    fr AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT (source, doc_id)) AS repos FROM sp GROUP BY v),
    cl AS (SELECT sp.*, CASE WHEN owners >= 3 THEN 'example' WHEN owners = 1 AND repos <= 3 AND regexp_matches(sp.v, '[A-Za-z]') AND regexp_matches(sp.v, '[0-9]')
             AND NOT regexp_matches(sp.v, '(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567890?abcdef') THEN 'live' ELSE 'shared' END AS class
           FROM sp JOIN fr USING (v)),
    al AS (SELECT doc_id, kind, ord, s, e FROM cl UNION ALL SELECT DISTINCT doc_id, 'live', 3, e - length(v), e FROM cl WHERE class = 'live'),
    js AS (SELECT doc_id, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord) AS spans,
                  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, ord) FILTER (ord < 3) AS base FROM al GROUP BY doc_id),
    ct AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                  count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'example') AS n_example, count(*) FILTER (class = 'shared') AS n_shared FROM cl GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_shared, 0) AS n_shared
    FROM documents d LEFT JOIN js USING (doc_id) LEFT JOIN ct USING (doc_id)"""


def _chat_sql() -> str:
    esc = lambda c: rf"regexp_replace(regexp_replace(replace({c}, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
          sum({len(OPEN) + len(BODY) + len(CLOSE)} + length({esc("role")}) + length({esc("text")})) OVER w AS upto
          FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, max(n)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
    FROM n GROUP BY conv_id"""


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_CONTAMINATION_SQL = f"""WITH b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS win
           FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
    ns AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
    m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id),
    -- longest run of equal words that a window begins: diagonals of item and document positions
    bp AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM b WHERE item_id IN (SELECT item_id FROM m)),
    dp AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM m)),
    di AS (SELECT m.doc_id, m.item_id, dp.i, bp.j, i - row_number() OVER (PARTITION BY m.doc_id, m.item_id, dp.i - bp.j ORDER BY dp.i) AS g
           FROM (SELECT DISTINCT doc_id, item_id FROM m) m JOIN dp USING (doc_id) JOIN bp ON bp.item_id = m.item_id AND bp.x = dp.x),
    rn AS (SELECT doc_id, item_id, count(*) AS n FROM di GROUP BY doc_id, item_id, i - j, g),
    lo AS (SELECT doc_id, max(rn.n) AS longest FROM rn JOIN b USING (item_id) WHERE rn.n >= least(13, len(b.w)) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0) AS longest
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN lo USING (doc_id)"""

ORACLES = {
    "op2_secret_scan": _secret_sql(),
    "op7_decontamination": _CONTAMINATION_SQL,
    "op9_chat_format": _chat_sql(),
    "op10_exact_dedup": r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}
