"""Repeated-passage dedup: LCP intervals of sparse suffix arrays, sharded so that equal passages meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Bytes of a passage whose repetition counts, and of the grams that anchor it.
SPAN, GRAM = 200, 32
#: Bytes of text that one task indexes at a time; a longer text is cut into overlapping slices.
CHUNK = 1 << 20
#: Occurrences from which an anchor's passages are dealt out one by one instead of to one suffix array.
HEAVY = 20_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Anchors:
    """Cuts texts into strips: runs of SPAN-byte windows that share an anchor, the window's least gram hash.

    The anchor depends on a window's bytes only, so equal windows get anchors of equal hash at equal
    places: comparing the strips of one anchor hash with each other finds every repeated window.
    """

    def __init__(self, span: int = SPAN, gram: int = GRAM):
        import numpy as np

        self.span, self.gram, n = span, gram, CHUNK + span + 1
        one = np.ones(1, np.uint64)
        self.power = [np.cumprod(np.concatenate((one, np.full(n, b, np.uint64)))) for b in _BASES]
        self.inverse = [np.cumprod(np.concatenate((one, np.full(n, pow(b, -1, 1 << 64), np.uint64)))) for b in _BASES]

    @staticmethod
    def mix(x):
        import numpy as np

        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def strips(self, texts: list[bytes]):
        """(text number, first byte, windows, anchor's place in the strip, anchor hash, strip hash), as arrays per chunk."""
        held, size = [], 0
        for i, t in enumerate(texts):
            for at in range(0, max(0, len(t) - self.span + 1), CHUNK):
                piece = t[at : at + CHUNK + self.span - 1]
                if size + len(piece) > CHUNK + self.span and held:
                    yield self._strips(held)
                    held, size = [], 0
                held.append((i, at, piece))
                size += len(piece)
        if held:
            yield self._strips(held)

    def _strips(self, held):
        import numpy as np

        span, gram = self.span, self.gram
        raw = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        n = len(raw)
        sums = []
        for power in self.power:
            s = np.zeros(n + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=s[1:])
            sums.append(s)
        h = self.mix((sums[0][gram:] - sums[0][: n - gram + 1]) * self.inverse[0][: n - gram + 1])
        bits = np.uint64(22)
        low = np.uint64((1 << 22) - 1)
        least = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
        width, want = 1, span - gram + 1
        while 2 * width <= want:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < want:
            least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
        anchor = (least & low).astype(np.int64)  # of the window that starts here
        lengths = np.array([len(p) for _, _, p in held])
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        piece = np.repeat(np.arange(len(held)), lengths)[: len(anchor)]
        start = np.arange(len(anchor))
        valid = start + span <= (begin + lengths)[piece]
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        windows = np.bincount(run[valid], minlength=len(first))
        end = first + windows + span - 1
        place = anchor[first] - first
        own = (sums[1][end] - sums[1][first]) * self.inverse[1][first]
        own = self.mix(own + windows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + place.astype(np.uint64))
        which = piece[first]
        text = np.array([i for i, _, _ in held])[which]
        at = first - begin[which] + np.array([a for _, a, _ in held])[which]
        return text, at, windows, place, h[anchor[first]].view(np.int64), own.view(np.int64)


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    import numpy as np

    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def lcp_intervals(lcp: list[int]):
    """(value, first, last) of each interval of the array's common-prefix tree, by a scan with a stack.

    lcp[k] is the common prefix of entries k - 1 and k; children come before parents.
    """
    stack = [(0, 0)]
    for k in range(1, len(lcp) + 1):
        now = lcp[k] if k < len(lcp) else -1
        left = k - 1
        while stack and stack[-1][0] > now:
            value, left = stack.pop()
            if k - 1 > left:
                yield value, left, k - 1
        if k < len(lcp) and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def maximal_repeats(strips: list[tuple[bytes, int]], least: int = SPAN):
    """(before, after, members) of the maximal repeats around the strips' common anchor, least bytes or longer.

    Strips are (bytes, place of the anchor). The suffixes from the anchors are sorted (a sparse suffix
    array); each LCP interval is a set of all strips that agree on ``after`` bytes from the anchor and no
    more. Where the bytes to the left differ, the interval splits: its members are sorted by what precedes
    the anchor, and a member's reach is its longest agreement with a neighbour there. ``members`` gives
    (strip, before) of all occurrences that reach back far enough.
    """
    right = [s[a:] for s, a in strips]
    left = [s[:a][::-1] for s, a in strips]
    order = sorted(range(len(strips)), key=right.__getitem__)
    lcp = [0] + [common(right[order[k - 1]], right[order[k]]) for k in range(1, len(order))]
    rank = {i: r for r, i in enumerate(sorted(range(len(strips)), key=left.__getitem__))}
    furthest = max(map(len, left))
    for after, a, z in lcp_intervals(lcp):
        if after + furthest < least:
            continue
        inside = sorted(order[a : z + 1], key=rank.__getitem__)
        shared = [common(left[i], left[j]) for i, j in zip(inside, inside[1:], strict=False)]
        reach = [max(p, q) for p, q in zip([-1, *shared], [*shared, -1], strict=True)]
        members = [(i, r) for i, r in zip(inside, reach, strict=True) if r + after >= least]
        if members:
            yield after, members


def covered(strips: list[tuple[bytes, int]], least: int = SPAN) -> list[list[tuple[int, int]]]:
    """For each strip the disjoint intervals, within it, of the maximal repeats that cover it."""
    found: list[list] = [[] for _ in strips]
    for after, members in maximal_repeats(strips, least):
        for i, before in members:
            found[i].append((strips[i][1] - before, strips[i][1] + after))
    return [_merged(x) for x in found]


def _merged(spans):
    out: list = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def repeated_spans(docs: DataFrame, scratch: Scratch, span: int = SPAN, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, h, spans): byte intervals of each text that lie in passages repeated in some text of docs(doc_id, h, t).

    h is the text's hash; (doc_id, h) names a text, so rows that repeat a text share their spans.

    1. Each text is cut into strips (Anchors), about 1.2 per 100 bytes, written as hashes only.
    2. Anchor hashes that occur once can't repeat and go. The rest are grouped with partial sums.
    3. Strips that are equal as a whole become one, with their number: that alone settles copies, and
       keeps hot texts from meeting in one task. An anchor with one strip needs no comparison.
    4. One occurrence of each strip left is read from its text, and each anchor's strips get a suffix
       array, whose LCP intervals give the maximal repeats. An anchor of ``heavy`` occurrences or more,
       as around a passage that very many different texts share, is dealt out window by window instead.
    5. Spans go back to all occurrences.
    """
    def cut(batches):
        import numpy as np
        import pyarrow as pa

        anchors = Anchors(span, gram)
        names = ["doc_id", "h", "at", "windows", "place", "anchor", "strip"]
        for b in batches:
            texts = b.column(2).to_pylist()
            for text, at, windows, place, anchor, strip in anchors.strips(texts):
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at), pa.array(windows.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(anchor), pa.array(strip)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    strips = scratch.write(docs.select("doc_id", "h", F.col("t").cast("binary").alias("t")).mapInArrow(cut, f"doc_id {kind}, h long, at long, windows int, place int, anchor long, strip long"), "strips")
    often = strips.groupBy("anchor").agg(F.count("*").alias("n"), F.min("strip").alias("lo"), F.max("strip").alias("hi")).filter("n > 1")
    # a table of its own, so that the join below deals both sides and can split a hot anchor's strips
    often = scratch.write(often.select("anchor", "n", (F.col("lo") != F.col("hi")).alias("mixed")), "often")
    again = scratch.write(strips.join(often, "anchor"), "again")
    scratch.drop("strips", "often")

    mixed = again.filter("mixed")
    one = mixed.groupBy("anchor", "strip").agg(F.count("*").alias("copies"), F.max("n").alias("n"), F.min(F.struct("doc_id", "h", "at", "windows", "place")).alias("o"))
    wanted = one.select("o.doc_id", "o.h", F.struct("anchor", "strip", "copies", "n", "o.at", "o.windows", "o.place").alias("s")).groupBy("doc_id", "h").agg(F.collect_list("s").alias("s"))
    wanted = wanted.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), "s")
    read = wanted.join(docs, docs["doc_id"].eqNullSafe(wanted["__d"]) & (docs["h"] == wanted["__h"])).select("s", F.col("t").cast("binary").alias("t"))

    def fetch(batches):
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for wants, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s in wants:
                    row = (s["anchor"], s["strip"], s["copies"], s["n"], s["place"], t[s["at"] : s["at"] + s["windows"] + span - 1])
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "strip", "copies", "n", "place", "bytes"])

    # a row that repeats a text gives the same strips again; the group below sees each once
    members = read.mapInArrow(fetch, "anchor long, strip long, copies long, n long, place int, bytes binary")
    members = scratch.write(members, "members")

    def compare(batches):
        import pyarrow as pa

        key, held = None, []
        out: list = []

        def close():
            if len(held) > 1:
                for (strip, copies, *_), spans in zip(held, covered([(x[3], x[2]) for x in held], span), strict=True):
                    if copies == 1 and spans:
                        out.append((key, strip, [{"a": a, "z": z} for a, z in spans]))

        def batch():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))], names=["anchor", "strip", "s"])

        for b in batches:
            for anchor, strip, copies, place, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if anchor != key:
                    close()
                    key, held = anchor, []
                if not held or held[-1][0] != strip:
                    held.append((strip, copies, place, data))
            if out:
                yield batch()
                out = []
        close()
        if out:
            yield batch()

    spans_type = "array<struct<a:long,z:long>>"
    light = members.filter(F.col("n") < heavy).select("anchor", "strip", "copies", "place", "bytes").repartition("anchor").sortWithinPartitions("anchor", "strip")
    found = light.mapInArrow(compare, f"anchor long, strip long, s {spans_type}")
    # heavy anchors: each window of a distinct strip by itself, counted with partial sums
    alone = members.filter(F.col("n") >= heavy).dropDuplicates(["anchor", "strip"])
    windows = alone.select("anchor", "strip", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - span)).alias("a")).select("anchor", "strip", "a", F.expr(f"sha2(substring(bytes, a + 1, {span}), 256)").alias("w"))
    twice = windows.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w")
    dealt = windows.join(twice, "w").groupBy("anchor", "strip").agg(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), (F.col("a") + span).cast("long").alias("z"))).alias("s"))
    found = scratch.write(found.unionByName(dealt.select("anchor", "strip", F.col("s").cast(spans_type).alias("s"))), "found")

    length = F.col("windows") + (span - 1)
    copies = one.filter("copies > 1").select("anchor", "strip", F.lit(None).cast(spans_type).alias("s"))
    part = mixed.join(found.unionByName(copies), ["anchor", "strip"])
    whole = F.array(F.struct(F.col("at").cast("long").alias("a"), (F.col("at") + length).cast("long").alias("z")))
    moved = F.transform("s", lambda x: F.struct((x["a"] + F.col("at")).alias("a"), (x["z"] + F.col("at")).alias("z")))
    spans = again.filter("not mixed").select("doc_id", "h", whole.alias("s")).unionByName(part.select("doc_id", "h", F.coalesce(moved, whole).alias("s")))
    spans = spans.groupBy("doc_id", "h").agg(F.flatten(F.collect_set("s")).alias("spans"))
    return scratch.write(spans, "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), spans.

    A byte goes if a ``span``-byte string that covers it starts anywhere else in the table too, the same
    text included; strings are judged on the input. ``spans`` are the maximal removed runs as byte
    offsets, ``kept`` is the rest. Null text is empty; texts shorter than the span stay whole; rows that
    repeat an id or a whole row count as texts of their own, so they repeat each other. Only the id and
    text columns are read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "suffix")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    spans = repeated_spans(rows, scratch, span, gram, heavy)
    named = spans.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), "spans")
    joined = rows.join(named, rows["doc_id"].eqNullSafe(named["__d"]) & (rows["h"] == named["__h"]), "left").select("doc_id", F.col("t").cast("binary").alias("t"), "spans")

    def cut(batches):
        import hashlib

        import pyarrow as pa

        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        pair = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
        for b in batches:
            out: list[list] = [[] for _ in names[1:]]
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                runs = _merged((s["a"], s["z"]) for s in found or ())
                at, kept = 0, []
                for a, z in runs:
                    kept.append(t[at:a])
                    at = z
                kept = b"".join([*kept, t[at:]])
                for c, x in zip(out, (len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"a": a, "z": z} for a, z in runs]), strict=True):
                    c.append(x)
            kinds = [*[pa.int64()] * 3, pa.string(), pa.binary(), pair]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<a:long,z:long>>")
