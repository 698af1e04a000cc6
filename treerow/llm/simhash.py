"""SimHash near-dedup: fingerprints sharded by their Hamming distance to vantage points, linked exactly."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, append_columns, connected_components, small_batches

BITS = 64
#: Rows that are compared as one matrix; larger sets are split at a vantage point first.
LEAF = 512
#: Width of a shard's ring of distances; at least twice the largest radius, so a ring meets only its neighbours.
RING = 8
_SPLIT_SEED = 0x9E3779B97F4A7C15


def _spread():
    import numpy as np

    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def make_fingerprints(width: int):
    """A function of texts (UTF-8 bytes or None) that gives their SimHash as one signed 64-bit array."""

    def make(texts):
        import numpy as np
        import pyarrow as pa
        import xxhash

        spread, digest = _spread(), xxhash.xxh64_intdigest
        out = np.zeros(len(texts), np.uint64)
        for i, t in enumerate(texts):
            words = (t or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
            if not words:
                continue
            norm = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            n = max(1, len(words) - width + 1)
            last = ends[width - 1 :] if len(words) >= width else ends[-1:]
            h = np.fromiter((digest(norm[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
            counts = np.zeros(BITS, np.int64)
            for k in range(0, n, 255 * 256):  # 255 rows fit a byte-wide counter
                lanes = spread[h[k : k + 255 * 256].view(np.uint8).reshape(-1, 8)]
                sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
                counts += sums.view(np.uint8).reshape(len(sums), BITS).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]
        return [pa.array(out.view(np.int64))]

    return make


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id by default) and __fp, the SimHash of word shingles, as a signed long."""
    return append_columns(docs, text_col, make_fingerprints(width), [T.StructField("__fp", T.LongType())], keep or [id_col])


def _balls(fps, radius: int):
    """Sets that hold every linked pair, from radius + 1 blocks of the bits that vary; none if one of them is over half of fps.

    The distance within a block never exceeds the whole distance, and a linked pair's is zero in one block
    at least, so it lies in one ball of distance zero around a vantage value of that block.
    """
    import numpy as np

    vary = int(np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps))
    bits = [b for b in range(BITS) if vary >> b & 1]
    if len(bits) <= radius:
        return []
    out, n = [], radius + 1
    for k in range(n):
        block = bits[len(bits) * k // n : len(bits) * (k + 1) // n]
        value = fps & np.uint64(sum(1 << b for b in block))
        order = np.argsort(value, kind="stable")
        cut = np.flatnonzero(np.diff(value[order])) + 1
        parts = np.split(fps[order], cut)
        if max(map(len, parts)) > len(fps) // 2:
            return []
        out += [p for p in parts if len(p) > 1]
    return out


def linked_pairs(fps, radius: int, depth: int = 0):
    """Edges that join the distinct fingerprints ``fps`` (uint64) as all pairs within radius do.

    A set of up to LEAF is compared at once. A larger one is split by distance to a vantage point: both
    of a pair are at most at the median, or else both are above the median less the radius (triangle
    bound), so two overlapping halves hold every pair. Random fingerprints are all about as far apart, so
    that the halves overlap almost whole; those go to balls of distance zero in single blocks of bits
    (``_balls``). Where these don't shrink the set either (a dense cluster), a search from fingerprint to
    fingerprint looks only at rings within the radius of it and drops what is already joined, so a cluster
    costs one pass per member over what is left.
    """
    import numpy as np

    m = len(fps)
    if m < 2:
        return []
    if m <= LEAF:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        if near.sum() == m:
            return []
        label, was = np.arange(m), None
        while was is None or (label != was).any():
            was, label = label, np.where(near, label[None, :], m).min(axis=1)
            label = label[label]
        moved = np.flatnonzero(label != np.arange(m))
        return [(fps[moved], fps[label[moved]])]
    vantage = fps[(depth * 7919) % m]
    d = np.bitwise_count(fps ^ vantage).astype(np.int64)
    middle = int(np.median(d))
    low, high = fps[d <= middle], fps[d > middle - radius]
    if max(len(low), len(high)) <= 0.6 * m:
        return linked_pairs(low, radius, depth + 1) + linked_pairs(high, radius, depth + 1)
    groups = _balls(fps, radius)
    if groups:
        return [e for g in groups for e in linked_pairs(g, radius, depth + 1)]
    rings = [fps[d == k] for k in range(BITS + 1)]
    edges = []
    for k in range(BITS + 1):
        while len(rings[k]):
            root, rings[k] = rings[k][0], rings[k][1:]
            todo = [(root, k)]
            while todo:
                x, at = todo.pop()
                for r in range(max(0, at - radius), min(BITS, at + radius) + 1):
                    if len(rings[r]) and (hit := np.bitwise_count(rings[r] ^ x) <= radius).any():
                        found, rings[r] = rings[r][hit], rings[r][~hit]
                        edges.append((found, np.full(len(found), x)))
                        todo += [(y, r) for y in found]
    return edges


def blocks_for(n: int, radius: int) -> int:
    """The least number of blocks whose shared ones have bits enough for n fingerprints in shards of about LEAF."""
    blocks = radius + 1
    while BITS * (blocks - radius) // blocks < (max(n, 1) // LEAF).bit_length() and comb(blocks + 1, radius) <= 500:
        blocks += 1
    return blocks


def near_components(marked: DataFrame, scratch: Scratch, radius: int = 4) -> DataFrame:
    """(fp, root) of each distinct __fp that has another within ``radius`` bits, or a chain of such.

    Shards: the bits are cut into blocks, of which two linked fingerprints share all but ``radius`` at
    least; each choice of so many blocks is a ball of distance zero around a vantage value. The more
    fingerprints there are, the more blocks (``blocks_for``), so a shard's expected size has a bound. Within
    a value, a shard is a ring of RING distances to the choice's vantage point; a fingerprint within the
    radius of the next ring goes there as well.
    """
    distinct = scratch.write(marked.select(F.col("__fp").alias("fp")).distinct(), "distinct", free=False)
    blocks = blocks_for(distinct.count(), radius)
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    shards = []
    for b, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in chosen)
        value = F.xxhash64(F.lit(b), F.col("fp").bitwiseAND(mask - (1 << BITS) * (mask >> (BITS - 1))))
        vantage = (_SPLIT_SEED * (2 * b + 1)) % (1 << BITS)
        vantage -= (1 << BITS) * (vantage >> (BITS - 1))
        away = F.bit_count(F.col("fp").bitwiseXOR(F.lit(vantage)))
        ring, over = F.floor(away / RING), away % RING >= RING - radius
        # values that share a hash share a shard, which only makes it larger
        shards.append(F.xxhash64(value, ring))
        shards.append(F.when(over, F.xxhash64(value, ring + 1)))
    placed = distinct.select("fp", F.explode(F.array(*shards)).alias("shard")).filter("shard IS NOT NULL")

    def link(batches):
        import numpy as np
        import pyarrow as pa

        def edges(shard, fp, last):
            """Edges of all shards but an unfinished last one; that one's rows."""
            cut = np.flatnonzero(np.diff(shard)) + 1
            bounds = [0, *cut.tolist(), len(shard)]
            end = len(bounds) - 1 if last else len(bounds) - 2
            out = []
            for a, z in zip(bounds[:end], bounds[1 : end + 1], strict=True):
                if z - a > 1:
                    out += linked_pairs(fp[a:z], radius)
            return out, bounds[end]

        shard, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            shard = np.concatenate((shard, b.column(1).to_numpy()))
            fp = np.concatenate((fp, b.column(0).to_numpy().view(np.uint64)))
            out, rest = edges(shard, fp, False) if len(shard) else ([], 0)
            shard, fp = shard[rest:], fp[rest:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).view(np.int64)) for k in (0, 1)], names=["u", "v"])
        if len(shard):
            out, _ = edges(shard, fp, True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).view(np.int64)) for k in (0, 1)], names=["u", "v"])

    pairs = placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(link, "u long, v long")
    return connected_components(pairs, scratch, "links").select(F.col("node").alias("fp"), F.col("root"))


def _with_roots(marked: DataFrame, scratch: Scratch, radius: int) -> tuple[DataFrame, DataFrame]:
    marked = scratch.write(marked, "fingerprints")
    return marked, scratch.write(near_components(marked, scratch, radius), "roots")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Rows link where their fingerprints differ in at most ``radius`` bits. Null or empty text has
    fingerprint zero, which links like any other; a text of fewer words than a shingle is one shingle.
    Equal fingerprints are one node, whatever their number. Null ids are larger than all others; repeated
    rows each get a row. Only the id and text columns are read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")
    marked, roots = _with_roots(fingerprints(docs.withColumnRenamed(id_col, "doc_id"), "doc_id", text_col, width), scratch, radius)
    least = marked.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("least")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = scratch.write(least, "least")
    # a table of its own, so that the join deals both sides and can split a very large component
    component = scratch.write(least.groupBy("root").agg(F.min("least").alias("component_id")), "component")
    of = least.join(component, "root").select(F.col("fp").alias("__fp"), "component_id")
    return marked.join(of, "__fp").select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs, all columns, that have the smallest id of their component; one row where ids tie."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "simhash")
    rows = docs.withColumn("__rid", F.monotonically_increasing_id())
    # whole rows are written once, with their numbers, so that no later step can number them anew
    marked = scratch.write(fingerprints(rows, id_col, text_col, width, rows.columns), "rows")
    roots = scratch.write(near_components(marked, scratch, radius), "roots")
    order = F.struct(F.isnull(id_col).alias("none"), F.col(f"`{id_col}`").alias("id"), F.col("__rid").alias("rid"))
    least = marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(order).alias("first")).join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    keep = least.select(F.col("first.rid").alias("__rid"))
    return marked.join(keep, "__rid", "left_semi").select(*(f"`{c}`" for c in docs.columns))
