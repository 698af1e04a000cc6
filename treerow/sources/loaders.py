"""Documents from files, URLs, strings and tables of pages, under limits."""

from __future__ import annotations

import ipaddress
import socket
from dataclasses import dataclass
from pathlib import Path
from urllib.error import URLError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed limits of the interactive facade.
MAX_BYTES, MAX_NODES, MAX_REDIRECTS, TIMEOUT_S = 5_000_000, 100_000, 3, 10
HTML_TYPES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml")


class SourceError(ValueError):
    """A source that can't be read or isn't allowed."""


@dataclass(frozen=True)
class FetchPolicy:
    allow_network: bool = False
    allow_private: bool = False
    base_dir: Path | None = None
    max_bytes: int = MAX_BYTES
    timeout_s: float = TIMEOUT_S


def is_url(s: str) -> bool:
    return s.lower().startswith(("http://", "https://"))


def check_host(url: str, allow_private: bool) -> None:
    """Every address that the host resolves to must be public."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise SourceError("only http and https URLs can be fetched")
    if allow_private:
        return
    try:
        found = {info[4][0] for info in socket.getaddrinfo(parts.hostname, parts.port or 80, type=socket.SOCK_STREAM)}
    except OSError as e:
        raise SourceError(f"cannot resolve {parts.hostname}") from e
    for address in found:
        if not ipaddress.ip_address(address.split("%")[0]).is_global:
            raise SourceError("private network targets are not allowed")


class _NoRedirect(HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def fetch(url: str, policy: FetchPolicy) -> str:
    """The page behind a URL: at most MAX_REDIRECTS hops, each checked again, HTML types only, a bounded size."""
    if not policy.allow_network:
        raise SourceError("network access is off")
    opener = build_opener(_NoRedirect)
    for _ in range(MAX_REDIRECTS + 1):
        check_host(url, policy.allow_private)
        try:
            with opener.open(Request(url, headers={"User-Agent": "treerow"}), timeout=policy.timeout_s) as reply:
                kind = reply.headers.get_content_type() if reply.headers.get("Content-Type") else ""
                if kind and kind not in HTML_TYPES:
                    raise SourceError(f"not HTML: {kind}")
                return decode(_bounded(reply.read(policy.max_bytes + 1), policy))
        except URLError as e:
            code, target = getattr(e, "code", None), getattr(e, "headers", None)
            if code in (301, 302, 303, 307, 308) and target and target.get("Location"):
                url = urljoin(url, target["Location"])
                continue
            raise SourceError(f"cannot fetch {url}: {e}") from e
    raise SourceError("too many redirects")


def _bounded(data: bytes, policy: FetchPolicy) -> bytes:
    if len(data) > policy.max_bytes:
        raise SourceError("the document exceeds the maximum size")
    return data


def decode(data: bytes) -> str:
    """By the charset named in the first 8 KiB, else UTF-8; bytes that don't fit are replaced."""
    import re

    named = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", data[:8192], re.I)
    try:
        return data.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def read_path(path: str, policy: FetchPolicy) -> str:
    p = Path(path)
    if policy.base_dir is not None:
        base = Path(policy.base_dir).resolve()
        p = (base / p).resolve()
        if not p.is_relative_to(base):
            raise SourceError("the path is outside the base directory")
    try:
        data = p.read_bytes()
    except OSError as e:
        raise SourceError(f"Failed to open file: {path}") from e
    return decode(_bounded(data, policy))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source_uri, parts) of the HTML files under a path or glob, read by Spark; the id is the path's hash."""
    files = spark.read.format("binaryFile").load(path)

    def text(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[decode(x)] for x in b.column(2).to_pylist()], pa.list_(pa.string()))], names=["doc_id", "source_uri", "parts"])

    return files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source_uri"), "content").mapInArrow(text, "doc_id long, source_uri string, parts array<string>")
