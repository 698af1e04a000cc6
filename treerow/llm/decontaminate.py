"""Benchmark decontamination by suffix arrays of the training shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_columns, small_batches

#: Consecutive words of an item that count as contamination; a shorter item counts whole.
WINDOW = 13
#: Text bytes of test items that one pass over the documents holds; more are searched in further passes.
BLOCK_BYTES = 32 << 20
#: Bytes of documents that one training shard indexes (a longer document is a shard of its own).
SHARD_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class Words:
    """Word hashes of byte strings: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""

    def __init__(self):
        import numpy as np

        b = np.arange(256)
        self.is_word = (b >= 0x80) | ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        import numpy as np

        if len(self.power) <= n:
            n, one = 2 * n, np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate((one, np.full(n, _BASE, np.uint64))))
                self.inverse = np.cumprod(np.concatenate((one, np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))))

    def split(self, texts: list[bytes]):
        """(hashes, text number, starts, ends, the lower-cased buffer) of all words of the texts, in order."""
        import numpy as np

        buf = b"\n".join(texts).lower() + b"\n"
        raw = np.frombuffer(buf, np.uint8)
        self._grow(len(raw))
        edge = np.diff(np.concatenate(([False], self.is_word[raw])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)])))
            h = (sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        return h, np.searchsorted(bounds, starts, "right"), starts, ends, buf


class TestIndex:
    """Every suffix of the test items, as ranks of their words, ready to be looked up in a training shard."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        import numpy as np

        self.window, self.ids = window, [i for i, _ in items]
        words = Words()
        h, item, starts, ends, buf = words.split([t for _, t in items]) if items else (np.empty(0, np.uint64), np.empty(0, np.int64), [], [], b"")
        self.vocab, first, rank = np.unique(h, return_index=True, return_inverse=True)
        self.spell = [buf[starts[i] : ends[i]] for i in first]
        rank = rank.astype(np.int64) + 1
        count = np.bincount(item, minlength=len(items)) if items else np.empty(0, np.int64)
        begin = np.concatenate(([0], np.cumsum(count)))
        self.words = [rank[begin[i] : begin[i + 1]] for i in range(len(items))]
        inner = item[1:] == item[:-1] if len(item) else np.empty(0, bool)
        self.pairs = np.unique(rank[:-1][inner] * (1 << 32) + rank[1:][inner]) if len(rank) else np.empty(0, np.int64)
        self.suffixes: dict[bytes, list[tuple[int, int]]] = {}
        sizes = {}
        for i, w in enumerate(self.words):
            size = min(window, len(w))
            for at in range(len(w) - size + 1 if size else 0):
                key = w[at : at + size].astype(">u4").tobytes()
                self.suffixes.setdefault(key, []).append((i, at))
                sizes[key] = size
        self.keys = sorted(self.suffixes)
        self.sizes = np.array([sizes[k] for k in self.keys], np.int64)
        self.least = int(self.sizes.min()) if len(self.keys) else 0
        self.low = np.array(self.keys, f"S{4 * window}")
        self.high = np.array([k + b"\xff" * (4 * window - len(k)) for k in self.keys], f"S{4 * window}")

    def search(self, texts: list[bytes], words: Words):
        """For each text: words, hit word intervals, longest matches as (item number, word of it, word of the text, words)."""
        import numpy as np

        n_words = np.zeros(len(texts), np.int64)
        hits: list[list] = [[] for _ in texts]
        matches: list[list] = [[] for _ in texts]
        h, doc, starts, ends, buf = words.split(texts)
        n_words += np.bincount(doc, minlength=len(texts))
        if not len(h) or not self.keys:
            return n_words, hits, matches
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        rank = np.where(self.vocab[at] == h, at + 1, 0)
        # a suffix can match only while its word pairs are pairs of test items
        code = rank[:-1] * (1 << 32) + rank[1:]
        fits = (rank[:-1] > 0) & (rank[1:] > 0) & (doc[:-1] == doc[1:])
        where = np.flatnonzero(fits)
        if len(where) and len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, code[where]), len(self.pairs) - 1)
            fits[where] = self.pairs[place] == code[where]
        else:
            fits[:] = False
        n = len(rank)
        stop = np.minimum.accumulate(np.concatenate((np.where(fits, n, np.arange(n - 1)), [n - 1]))[::-1])[::-1]
        run = np.where(rank > 0, stop - np.arange(n) + 1, 0)
        suffix = np.flatnonzero(run >= self.least)
        if not len(suffix):
            return n_words, hits, matches
        # the shard's suffix array, to the depth of a window: suffixes in the order of their words
        depth = np.arange(self.window)
        table = np.where(depth < run[suffix, None], rank[np.minimum(suffix[:, None] + depth, n - 1)], 0).astype(">u4")
        keys = np.ascontiguousarray(table).view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")
        keys, suffix = keys[order], suffix[order]
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        first = np.searchsorted(doc, np.arange(len(texts)))
        for k in np.flatnonzero(high > low):
            size = int(self.sizes[k])
            spelled = [self.spell[r - 1] for r in np.frombuffer(self.keys[k], ">u4")]
            for p in suffix[low[k] : high[k]].tolist():
                if spelled != [buf[a:b] for a, b in zip(starts[p : p + size].tolist(), ends[p : p + size].tolist(), strict=True)]:
                    continue  # words of equal hash
                d = int(doc[p])
                hits[d].append((p, p + size))
                for i, start in self.suffixes[self.keys[k]]:
                    w = self.words[i]
                    if start and p and rank[p - 1] == w[start - 1] and doc[p - 1] == d:
                        continue  # not the start of a longest match
                    rest = min(len(w) - start, n - p)
                    same = (rank[p : p + rest] == w[start : start + rest]) & (doc[p : p + rest] == d)
                    matches[d].append((i, start, p - int(first[d]), rest if same.all() else int(np.argmin(same))))
        hits = [[(a - int(first[d]), z - int(first[d])) for a, z in x] for d, x in enumerate(hits)]
        return n_words, hits, matches


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("z", T.LongType())]))
_MATCHES = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("item_at", "at", "words"))]))
_FIELDS = [T.StructField("__n_words", T.LongType()), T.StructField("__hits", _SPANS), T.StructField("__matches", _MATCHES)]


def _marker(index: TestIndex):
    def make(texts):
        import pyarrow as pa

        words = Words()
        n_words, spans, found = [], [], []
        k = 0
        while k < len(texts):
            size, z = 0, k
            while z < len(texts) and (z == k or size + len(texts[z] or b"") <= SHARD_BYTES):
                size, z = size + len(texts[z] or b""), z + 1
            n, hits, matches = index.search([t or b"" for t in texts[k:z]], words)
            n_words += n.tolist()
            spans += [[{"a": a, "z": b} for a, b in merged(x)] for x in hits]
            found += [[{"item": index.ids[i], "item_at": s, "at": p, "words": m} for i, s, p, m in x] for x in matches]
            k = z
        span = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
        match = pa.list_(pa.struct([("item", pa.string()), *((c, pa.int64()) for c in ("item_at", "at", "words"))]))
        return [pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(found, match)]

    return make


def _mark(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text: str, window: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with __n_words, __hits (disjoint word intervals) and __matches.

    Items of more than BLOCK_BYTES are searched block by block: what one block finds is written before the
    next is read, so the driver and each worker hold one block's index at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tests = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("t"))
    size = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))

    def index(n: int) -> TestIndex:
        block = tests.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n).collect()
        return TestIndex(sorted((r["i"], bytes(r["t"])) for r in block), window)

    if blocks == 1:
        out = append_columns(docs, text_col, _marker(index(0)), _FIELDS, keep)
    else:
        scratch = Scratch(spark, "decontaminate")
        kept = list(dict.fromkeys([*keep, text_col]))
        # written with their numbers, so that no later step can number them anew
        rows = scratch.write(docs.select(*(f"`{c}`" for c in kept), F.monotonically_increasing_id().alias("__rid")), "rows")
        found = []
        for n in range(blocks):
            marked = append_columns(rows, text_col, _marker(index(n)), _FIELDS, ["__rid"])
            found.append(scratch.write(marked if n == 0 else marked.filter(F.size("__hits") > 0), f"block{n}"))
        of = found[0].select("__rid", "__n_words")
        for part in found[1:]:
            found[0] = found[0].unionByName(part)
        hits = found[0].groupBy("__rid").agg(F.array_sort(F.flatten(F.collect_list("__hits"))).alias("__hits"), F.flatten(F.collect_list("__matches")).alias("__matches"))
        out = rows.select(*(f"`{c}`" for c in keep), "__rid").join(of, "__rid").join(hits, "__rid").drop("__rid")
    return out.withColumn(
        "__n_hit",  # intervals of several blocks may overlap
        F.expr("aggregate(__hits, named_struct('n', 0L, 'z', 0L), (s, h) -> named_struct('n', s.n + greatest(0L, h.z - greatest(h.a, s.z)), 'z', greatest(s.z, h.z)), s -> s.n)"),
    ).withColumn("__items", F.array_sort(F.array_distinct(F.transform("__matches", lambda m: m["item"]))))


def _contaminated():
    return (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, longest, matches.

    Each task cuts its documents into shards, builds the suffix array of a shard's words (only suffixes
    whose word pairs occur in some item, as no other can match) and looks up every test suffix by binary
    search; a matched window's words are hit. ``matches`` are the longest verbatim matches that hold a
    window: item, word of the item and of the document where it starts, number of words; ``longest`` is the
    most words of one. A document of which a twentieth is hit is contaminated. No document is shuffled while
    the items fit one block of BLOCK_BYTES; more blocks are searched one after the other. Null or empty texts have no words and no hits; repeated
    rows each get a row; no items mean no hits; extra columns are not read.
    """
    rows = _mark(docs.withColumnRenamed(id_col, "doc_id"), items, text_col, item_col, item_text, window, ["doc_id"])
    return rows.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"), F.coalesce(F.array_max(F.transform("__matches", lambda m: m["words"])), F.lit(0)).cast("long").alias("longest"), F.col("__matches").alias("matches"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    rows = _mark(docs, items, text_col, item_col, item_text, window, docs.columns)
    return rows.filter(~_contaminated()).select(*(f"`{c}`" for c in docs.columns))
