"""Harmonic packing: pieces in reciprocal-capacity classes, a fixed number of a class in each bin."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

CAPACITY = 2048
END = 1
#: Neighbouring input partitions whose incomplete bins are completed together.
MERGE = 8
#: Public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs that make one piece of so many characters: the fast merges would take the square of their length, or give up.
_LONG = re.compile(r"\s{4096}|\S{4096}")
_SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


class Encoder:
    """Ids of a byte-level BPE vocabulary (the text of its tokenizers JSON), add_special_tokens=False.

    The merges run in tiktoken, which gives the same ids several times faster; a text that holds a
    special token's string, which tokenizers maps to its own id, or a very long run without a break, is
    encoded by tokenizers.
    """

    def __init__(self, source: str):
        import tiktoken
        from tokenizers import Tokenizer

        made = json.loads(source)
        special = {t["content"] for t in made.get("added_tokens", ())}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in made["model"]["vocab"].items() if token not in special}
        self.special = sorted(special)
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_str(source)

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or len(text) >= 4096 and _LONG.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n ids: whole bins, then slots of capacity // class.

    What is left after the whole bins goes to the smallest slot that holds it if that wastes at most a
    sixty-fourth of the slot; else the largest slot that it fills is cut off first.
    """
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if (slot - rest) * 64 <= slot:
            out.append((rest, k))
            break
        k += 1
        while capacity // k > rest:
            k += 1
        out.append((capacity // k, k))
        rest -= capacity // k
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids.

    A document's ids (UTF-8 text, then END) are cut into ``cuts``. Each task fills bins of its own: class
    k's bins take exactly k pieces, so no task asks another. The bins that a task leaves incomplete, less
    than one per class, are completed together with those of MERGE - 1 neighbours: by class first; what is
    left then is laid end to end and cut at the capacity. So only one sequence per MERGE partitions is
    not full. A sequence is padded to the capacity unless its length is a power of two.

    ``tokenizer`` is the path of a byte-level BPE tokenizers JSON, read once by the driver. Null text is
    empty (END alone); repeated rows are documents of their own; null ids stay null; extra columns are not
    read; an empty table gives an empty result. A document's ids are in memory once, in one task.
    """
    import zlib

    small_batches(docs.sparkSession, 128)
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = _SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]

    def batch(out, like):
        import pyarrow as pa

        kinds = [like, *[pa.int64()] * 7, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def fill(batches):
        import numpy as np
        from pyspark import TaskContext

        encode, part = Encoder(source), TaskContext.get().partitionId()
        made, waiting, like = 0, {}, None
        for b in batches:
            like, out = b.schema.field(0).type, []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), END], "<u4").tobytes()
                n, at = len(ids) // 4, 0
                for length, k in cuts(n, capacity):
                    piece = ids[4 * at : 4 * (at + length)]
                    bin_ = waiting.setdefault(k, [])
                    bin_.append((doc, at, length, zlib.crc32(piece), n, piece))
                    at += length
                    if len(bin_) == k:
                        out += placed(bin_, (part << 32) + made, part)
                        made, waiting[k] = made + 1, []
            if out:
                yield batch(out, like)
        if rest := [(*x[:5], None, k, part, x[5]) for k, bin_ in waiting.items() for x in bin_]:
            yield batch(rest, like)

    def placed(bin_, sequence, part):
        at, out = 0, []
        for doc, start, length, crc, n, piece in bin_:
            out.append((doc, start, length, crc, n, sequence, at, part, piece if with_ids else None))
            at += length
        return out

    def complete(batches):
        """Incomplete bins of some partitions (offset holds the class until a piece is placed), one group per block."""
        block, held = None, []
        for b in batches:
            like = b.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[7] // MERGE != block:
                    if held:
                        yield batch(finish(block, held), like)
                    block, held = row[7] // MERGE, []
                held.append(row)
        if held:
            yield batch(finish(block, held), like)

    def finish(block, held):
        made, out, rest, base = 0, [], [], (1 << 62) + (block << 32)
        by_class: dict[int, list] = {}
        for row in sorted(held, key=lambda r: (r[6], r[7], r[0] is None, "" if r[0] is None else r[0], r[1])):
            by_class.setdefault(row[6], []).append((*row[:5], row[8]))
        for k, pieces in by_class.items():
            whole = len(pieces) // k * k
            for i in range(0, whole, k):
                out += placed(pieces[i : i + k], base + made, block)
                made += 1
            rest += pieces[whole:]
        at, bin_ = 0, []
        for doc, start, length, _, n, piece in rest:
            while length:
                take = min(length, capacity - at)
                part = piece[: 4 * take]
                bin_.append((doc, start, take, zlib.crc32(part), n, part))
                piece, start, length, at = piece[4 * take :], start + take, length - take, at + take
                if at == capacity:
                    out += placed(bin_, base + made, block)
                    made, at, bin_ = made + 1, 0, []
        if bin_:
            out += placed(bin_, base + made, block)
        return out

    first = Scratch(docs.sparkSession, "packing").write(rows.mapInArrow(fill, schema), "pieces")
    left = first.filter("sequence_id IS NULL").withColumn("block", F.floor(F.col("part") / MERGE)).repartition("block").sortWithinPartitions("block", "part").drop("block")
    out = first.filter("sequence_id IS NOT NULL").unionByName(left.mapInArrow(complete, schema)).drop("part")
    return out if with_ids else out.drop("ids")
