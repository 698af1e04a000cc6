"""WARC archives: write captures of pages, read the records back, assemble one transaction per capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes at which an archive file is full (one capture may pass them), and archive files of one Arrow batch.
FILE_BYTES, BATCH_FILES = 32 << 20, 4
#: A gzip member of nothing, which may follow any other: the text writer ends each row with it.
NOTHING = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
RECORD = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, warc_date string, payload_digest string, payload_bytes long, intact boolean, fields map<string,string>, payload binary"


def sha1_base32(c: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: every five hex digits are four letters."""
    group = lambda i: F.conv(F.substring(F.sha1(c), 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda v, shift: F.substring(F.lit(ALPHABET), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(letter(group(i), shift) for i in range(8) for shift in (15, 10, 5, 0)))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1")]
    for k, v in headers:
        v = F.lit(v) if isinstance(v, str) else v
        lines.append(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write a request, a response or revisit, and a metadata record per page to WARC 1.1 files under path.

    Each record is a gzip member of its own, so that a reader can begin at any record. A file ends with
    the capture that brings it to ``file_bytes`` bytes, as compressed.

    Of pages whose payloads (the html in UTF-8; null is empty) are equal and of at least ``least`` bytes,
    those with the smallest id are responses and the others revisits of the first of them; null ids come
    last. Request and metadata name the capture in WARC-Concurrent-To. Record ids come from id, url and
    payload, so a task that runs again writes the same records. Only payload digests are grouped; of a
    payload only its repeated digests are joined back. Null urls become urn:page; extra columns are not
    read; an empty table writes no record.
    """
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), "\r", "%0D"), "\n", "%0A")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), uri.alias("uri"), html.alias("html"))
    rows = rows.select("*", sha1_base32(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("n"), F.xxhash64("html").alias("x"))
    first = rows.filter(F.col("n") >= least).groupBy("digest", "n", "x").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "uri")).alias("f"), F.count("*").alias("c")).filter("c > 1").drop("c")
    rows = rows.join(first, ["digest", "n", "x"], "left")
    revisit = F.col("f").isNotNull() & ~F.col("id").eqNullSafe(F.col("f.id"))
    own = _uuid(F.lit("capture"), F.col("id"), F.col("uri"), F.col("digest"))
    payload_digest = F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    capture = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", F.col("own")), ("WARC-Date", date), ("WARC-Target-URI", F.col("uri")),
            ("WARC-Payload-Digest", payload_digest), ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To", F.when(revisit, _uuid(F.lit("capture"), F.col("f.id"), F.col("f.uri"), F.col("digest")))),
            ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("f.uri"))), ("Content-Type", "application/http;msgtype=response"),
        ],
        F.concat(head, F.when(revisit, "").otherwise(F.col("html"))),
    )
    host, rest = F.regexp_extract("uri", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("uri", "^[a-z]+://[^/?#]*([^#]*)", 1)
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _uuid(F.lit("request"), F.col("own"))), ("WARC-Date", date), ("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", F.col("own")), ("Content-Type", "application/http;msgtype=request")],
        F.concat(F.lit("GET "), F.when(rest == "", "/").otherwise(rest), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)),
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _uuid(F.lit("metadata"), F.col("own"))), ("WARC-Date", date), ("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", F.col("own")), ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    rows = rows.withColumn("own", own)
    small_batches(pages.sparkSession)

    def archive(batches):
        import zlib

        import pyarrow as pa

        def member(record):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            return z.compress(record) + z.compress(END.encode()) + z.flush()

        held, size = [], 0
        for b in batches:
            for capture_records in zip(*b.columns, strict=True):
                for r in capture_records:
                    held.append(member(r.as_buffer()))
                    size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], names=["value"])

    files = rows.select(*(c.cast("binary").alias(n) for n, c in (("request", request), ("capture", capture), ("metadata", metadata)))).mapInArrow(archive, "value binary")
    # a row is a file; a cast to string leaves the bytes as they are, and in ISO-8859-1 so are those of NOTHING
    files = files.select(F.col("value").cast("string"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the WARC files (gzip, of one or many members, or plain) under path; RECORD has the columns.

    Files are read by Spark and parsed record by record by Content-Length, so a payload may hold anything.
    payload is the entity after the HTTP header of a response, ``intact`` tells whether its SHA-1 is the
    one the record names; ``fields`` are those of a metadata record.
    """
    small_batches(spark, BATCH_FILES)
    names = [c.split()[0] for c in RECORD.split(", ")]

    def parse(batches):
        import pyarrow as pa

        kinds = [*[pa.string()] * 7, pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for b in batches:
            for content in b.column(0):
                rows = []
                for row in records(content.as_buffer(), with_payload):
                    rows.append(row)
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def records(content, with_payload: bool):
    """Tuples of RECORD's columns, one record in memory at a time."""
    import base64
    import gzip
    import hashlib
    import io

    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16) if bytes(content[:2]) == b"\x1f\x8b" else io.BytesIO(content)

    def fields(lines):
        return [tuple(x.strip() for x in line.decode().split(":", 1)) for line in lines if b":" in line]

    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        lines = []
        while (line := stream.readline().rstrip(b"\r\n")):
            lines.append(line)
        head = {k.lower(): v for k, v in fields(lines)}
        block = stream.read(int(head["content-length"]))
        kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        payload, extra, intact = None, [], None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            intact, digest = own == digest, own
        elif kind == "metadata":
            extra = fields(block.split(b"\r\n"))
        yield (kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, None if payload is None else len(payload), intact, extra, payload if with_payload else None)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (response or revisit), request, metadata.

    Request and metadata records are joined to the capture that their WARC-Concurrent-To names. Those
    sides have one row per capture, so a capture never multiplies; one without them keeps nulls.
    """
    captures = records.filter(F.col("warc_type").isin("response", "revisit"))
    captures = captures.select(F.struct(*(c for c in records.columns if c not in ("concurrent_to", "fields"))).alias("capture"))
    side = lambda kind, *cols: records.filter((F.col("warc_type") == kind) & F.col("concurrent_to").isNotNull()).dropDuplicates(["concurrent_to"]).select(F.col("concurrent_to").alias(f"{kind}_of"), F.struct("record_id", "target_uri", "warc_date", *cols).alias(kind))
    out = captures.join(side("request"), F.col("capture.record_id") == F.col("request_of"), "left").join(side("metadata", "fields"), F.col("capture.record_id") == F.col("metadata_of"), "left")
    return out.drop("request_of", "metadata_of")


def originals(captures: DataFrame) -> DataFrame:
    """(original_id, original): payload_bytes and metadata of each response, once per record id."""
    responses = captures.filter(F.col("capture.warc_type") == "response")
    return responses.select(F.col("capture.record_id").alias("original_id"), F.struct("capture.payload_bytes", "metadata").alias("original")).dropDuplicates(["original_id"])


def resolve_revisits(captures: DataFrame, responses: DataFrame) -> DataFrame:
    """Transactions with ``original``: what originals() has of the response that a revisit refers to.

    Given as a table, both sides of the join are dealt anew, so the many revisits of one response can be
    split. A response looks itself up, so that its missing reference is not a key that all share.
    """
    key = F.coalesce("capture.refers_to", "capture.record_id")
    found = captures.withColumn("__key", key).join(responses, F.col("__key") == F.col("original_id"), "left")
    return found.withColumn("original", F.when(F.col("capture.refers_to").isNotNull(), F.col("original"))).drop("__key", "original_id")
