"""Fuzzy line dedup by MinHash over character shingles, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: Characters (UTF-16 units) of a shingle, and the Jaccard similarity, as a fraction, from which lines are near duplicates.
SHINGLE, SIMILAR = 8, (4, 5)
#: Min-hashes, and the triples of them that make a band, each hash in two: lines at the threshold share a band with probability 0.98.
HASHES = 12
BANDS = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10, 11), (0, 3, 6), (1, 4, 9), (2, 7, 10), (5, 8, 11))
#: Bits of each min-hash in a line's sketch, and the min-hashes that must agree where many lines of a bucket are apart (0.98 do at the threshold).
SLOT, AGREE = 5, 7
#: Sets of slots (three; the name is older), one of which at least is among any AGREE slots: of seven, three are in one third.
#: Each band has one slot in each third, so that lines that meet by a band don't share a set for that alone.
QUADS = tuple(q for third in ((0, 4, 7, 11), (1, 3, 8, 10), (2, 5, 6, 9)) for q in combinations(third, 3))
#: Lines of a bucket, still apart, up to which they are compared with each other; in larger ones only those that share a rare shingle are.
SMALL = 32
#: Lines of a large bucket that share a set of QUADS up to which they are held against each other: 960 comparisons for a line.
CROWD = 80
#: Shared shingles of a large bucket up to which each of its lines meets them as one array; those of a larger one are joined shingle by shingle.
LISTED = 1 << 15
#: Words of 64 bits, each the parities of a line's shingles that fall on it: those in which two lines' words differ bound their shingles apart.
#: As many have the bits that any shingle falls on, which needs no distinct shingles and bounds them likewise.
WORDS = 16
#: Words of 64 bits of the bitmap that keeps rows that nothing meets from being dealt; a full one keeps fewer back, and loses nothing.
FILTER = 1 << 18
#: Shingles of a line, a power of two, whose least hashes are found before the aggregate looks up the line, once for all of them.
TOGETHER = 8
_STEP = 4096


def _signed(x: int) -> int:
    x %= 1 << 64
    return x - (1 << 64) if x >> 63 else x


_MASKS = [_signed(0x9E3779B97F4A7C15 * (2 * k + 1)) for k in range(HASHES)]


@contextmanager
def _one_level_maps(spark):
    """Aggregates of many keys, none of which repeats for long, skip the small map in front of the hash map."""
    name = "spark.sql.codegen.aggregate.map.twolevel.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _id(h1: str, h2: str) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def _grams(line: str) -> str:
    """SQL: hashes of a line's shingles. The lambdas bind the bytes, so that a line is encoded once."""
    return f"transform(array(encode({line}, 'UTF-16BE')), p -> transform(sequence(1, greatest(octet_length(p) - {2 * SHINGLE - 1}, 1), 2), i -> xxhash64(substring(p, i, {2 * SHINGLE}))))[0]"


def _near_pairs(pairs: DataFrame) -> DataFrame:
    """(u, v, alike) of the rows (u, v, su, sv) whose lines su and sv are near; alike is their similarity.

    The distinct shingles are columns, so that compiled code meets them: within a lambda, sets are made of boxed objects.
    The numbers come from a generator, as a filter on a projection's columns would compute them once for each mention.
    """
    grams = pairs.select("u", "v", F.expr(f"array_distinct({_grams('su')})").alias("gu"), F.expr(f"array_distinct({_grams('sv')})").alias("gv"))
    counts = grams.select("u", "v", F.inline(F.array(F.struct(F.size("gu").alias("n"), F.size("gv").alias("n_b"), F.size(F.array_except("gu", "gv")).alias("only")))))
    near = counts.select("u", "v", F.expr("n - only").alias("both"), F.expr("n_b + only").alias("any")).filter(f"both * {SIMILAR[1]} >= any * {SIMILAR[0]}")
    return near.select("u", "v", F.expr("both / any").alias("alike"))


def _may_be_near() -> Column:
    """False only where the lines of words w0, ... and w0_b, ..., of n and n_b shingles with repeats, can't be near.

    A bit that only one line's words have stands for a shingle, at least, that the other lacks. Near lines differ by
    a ninth of their distinct shingles at most, of which n and n_b are upper bounds, so no near pair is lost.
    """
    apart = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"w{j}").bitwiseXOR(F.col(f"w{j}_b"))) for j in range(WORDS)))
    return apart * (SIMILAR[0] + SIMILAR[1]) <= (F.col("n") + F.col("n_b")) * (SIMILAR[1] - SIMILAR[0])


def _agree(a: str, b: str) -> Column:
    """Whether AGREE slots of two sketches are equal at least; equal min-hashes always are."""
    x = F.col(a).bitwiseXOR(F.col(b))
    # the lowest bit of each slot is set if any of the slot is: few operations, so that the join's code stays short enough to be compiled
    folded = reduce(lambda p, k: p.bitwiseOR(F.shiftrightunsigned(x, k)), range(1, SLOT), x)
    return F.bit_count(folded.bitwiseAND(F.lit(sum(1 << SLOT * k for k in range(HASHES))))) <= HASHES - AGREE


def _hashed(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, g0, g1, ...): of lines s of n + 1 shingles, the hashes of TOGETHER shingles a row."""
    points = lines.select(*keys, F.encode("s", "UTF-16BE").alias("p"))
    points = points.select(*keys, "p", F.greatest(F.expr("cast(octet_length(p) / 2 as int)") - SHINGLE, F.lit(0)).alias("n"))
    steps = points.select(*keys, "p", "n", F.explode(F.sequence(F.lit(0), F.col("n"), F.lit(_STEP))).alias("j"))
    places = steps.select(*keys, "p", "n", F.explode(F.sequence(F.col("j"), F.least(F.col("j") + (_STEP - 1), F.col("n")), F.lit(TOGETHER))).alias("i"))
    # past the end the last shingle again, which changes no minimum and no set; on bits, as sums and products are checked for overflow
    return places.select(*keys, "n", *(F.expr(f"xxhash64(substring(p, shiftleft(least(i | {k}, n), 1) | 1, {2 * SHINGLE}))").alias(f"g{k}") for k in range(TOGETHER)))


def _words(texts: DataFrame) -> DataFrame:
    """(x, n, w0, w1, ...): the number of shingles, with repeats, and the bits of WORDS words on which a shingle of the line x falls."""
    of = lambda k: [F.shiftrightunsigned(f"g{k}", 6).bitwiseAND(WORDS - 1).alias(f"j{k}"), F.expr(f"shiftleft(1L, cast(g{k} & 63 as int))").alias(f"b{k}")]
    bits = _hashed(texts, "x").select("x", (F.col("n") + 1).alias("n"), *(c for k in range(TOGETHER) for c in of(k)))
    word = lambda j: reduce(lambda p, q: p.bitwiseOR(q), (F.when(F.col(f"j{k}") == j, F.col(f"b{k}")).otherwise(0) for k in range(TOGETHER)))
    return bits.groupBy("x", "n").agg(*(F.bit_or(word(j)).alias(f"w{j}") for j in range(WORDS)))


def _signatures(lines: DataFrame) -> DataFrame:
    """(h1, h2, sketch, b0, b1, ...) of each distinct line: hashes of its bands, and SLOT bits of each min-hash."""
    hashes = _hashed(lines, "h1", "h2")
    # the min-hash of permutation k is the least hash after an exclusive or with a constant
    least = [F.least(*(F.col(f"g{k}").bitwiseXOR(F.lit(m)) for k in range(TOGETHER))) for m in _MASKS]
    mins = hashes.groupBy("h1", "h2").agg(*(F.min(g).alias(f"m{k}") for k, g in enumerate(least)))
    sketch = reduce(lambda p, q: p.bitwiseOR(q), (F.shiftleft(F.xxhash64(f"m{k}").bitwiseAND((1 << SLOT) - 1), SLOT * k) for k in range(HASHES)))
    return mins.select("h1", "h2", sketch.alias("sketch"), *(F.xxhash64(F.lit(b), *(f"m{k}" for k in ks)).alias(f"b{b}") for b, ks in enumerate(BANDS)))


def _may_meet(rows: DataFrame, others: DataFrame, by: str) -> DataFrame:
    """rows without those whose hash ``by`` is surely in none of the others, by a bitmap of fixed size; a join has to follow."""
    word, bit = F.shiftrightunsigned(by, 6).bitwiseAND(FILTER - 1), F.expr(f"shiftleft(1L, cast({by} & 63 as int))")
    bitmap = F.broadcast(others.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits")))
    return rows.join(bitmap, (word == F.col("__word")) & (F.col("__bits").bitwiseAND(bit) != 0), "left_semi")


def _sizes_fit() -> Column:
    """Whether the numbers of shingles n and n_b allow the similarity."""
    return SIMILAR[1] * F.least("n", "n_b") >= SIMILAR[0] * F.greatest("n", "n_b")


def _met_in_small(placed: DataFrame, found: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (u, v) of lines in small buckets that may be near; ``words`` is of ``_words``."""
    rows = placed.drop("lines").join(found.select("x", "sketch").join(words, "x"), "x")
    a, b = rows.filter("not near"), rows.select(*(F.col(c).alias(f"{c}_b") for c in rows.columns))
    once = F.col("near_b") | (F.col("x") < F.col("x_b"))
    open_ = once & (F.col("root") != F.col("root_b")) & _agree("sketch", "sketch_b")
    pairs = a.join(b, (F.col("bucket") == F.col("bucket_b")) & F.when(open_, _may_be_near()).otherwise(False))
    return pairs.select(F.least("x", "x_b").alias("u"), F.greatest("x", "x_b").alias("v"))


def _may_pair(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (bucket, x, root, sketch, n, d, near) without the lines that surely have no partner in their bucket.

    Of AGREE equal slots at least one of QUADS is among, so partners share its bits. Where up to CROWD lines of a bucket do,
    they are held against each other by what a pair must fulfil anyway; where more do, all of them stay: a line costs
    a bounded number of comparisons, and no pair is lost. Both tables below are written, so that a line is spelled out once
    and joined with the counts once.
    """
    low, high = SIMILAR
    quads = F.array(*(F.xxhash64(F.lit(i), F.col("sketch").bitwiseAND(F.lit(sum((1 << SLOT) - 1 << SLOT * k for k in q)))) for i, q in enumerate(QUADS)))
    slots = scratch.write(rows.select("bucket", "x", "root", "sketch", "n", "d", "near", F.explode(quads).alias("quad")), "slots")
    heads = slots.groupBy("bucket", "quad").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.count("*").alias("lines"), F.count_if(~F.col("near")).alias("asking"))
    # a table of its own, so that the join can split a quad that very many lines share
    heads = scratch.write(heads.filter("a <> z and asking > 0").select("bucket", "quad", "lines"), "quads")
    slots = scratch.write(slots.join(heads, ["bucket", "quad"]), "meeting")
    crowded = slots.filter(F.col("lines") > CROWD).select("bucket", "x")
    few = slots.filter(F.col("lines") <= CROWD).drop("lines")
    b = few.select(*(F.col(c).alias(f"{c}_b") for c in few.columns))
    by_d = F.abs(F.col("d") - F.col("d_b")) * (low + high) <= (F.col("n") + F.col("n_b")) * (high - low)  # of partners, all but so many of the shingles are shared
    fit = (F.col("root") != F.col("root_b")) & ~(F.col("near") & F.col("near_b")) & _sizes_fit() & by_d & _agree("sketch", "sketch_b")
    met = few.join(b, (F.col("bucket") == F.col("bucket_b")) & (F.col("quad") == F.col("quad_b")) & fit, "left_semi").select("bucket", "x")
    return rows.join(scratch.write(crowded.union(met).distinct(), "partnered"), ["bucket", "x"], "left_semi")


def _met_in_large(placed: DataFrame, known: DataFrame, found: DataFrame, stars: list[DataFrame], grams: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of lines in large buckets that may be near.

    ``stars`` has (bucket, u, near) of further centres u, ``grams`` gives (x, n, g) of lines x. Buckets whose centres
    are of one component are one here, with the one of three centres that most lines are near.
    With D the shingles by which a line differs from the centre and d their number, two lines differ by
    d + d_b - 2 k shingles, k being those in D and D_b. A line that isn't near the centre has p d > q (n + n_c),
    so to be near another it must share with that one more than half, nearly, of D_b. So lines meet only
    by shingles of D: what both have of a passage, or of the text that they are copies of, isn't in it.
    The order of shingles, the same in all of a bucket, begins with those that fewest lines have in D; those that
    no line shares with one that asks take their places in it but meet nothing, so they are never written.
    """
    low, high = SIMILAR
    p, q = low + high, high - low  # near: q (n + n_b) >= p times the shingles by which two lines differ
    placed = placed.join(known.select(F.col("x").alias("bucket"), F.col("root").alias("family")), "bucket", "left").withColumn("family", F.coalesce("family", "bucket"))
    placed = scratch.write(placed, "large")
    kinds = [placed.groupBy("family", "bucket").agg(F.count_if("near").alias("met")).select("family", F.lit(0).alias("kind"), F.col("bucket").alias("u"), "met")]
    of = placed.select("family", "bucket").distinct()
    for i, rows in enumerate(stars, 1):
        kinds.append(of.join(rows, "bucket").groupBy("family", "u").agg(F.count_if("near").alias("met")).select("family", F.lit(i).alias("kind"), "u", "met"))
    centres = reduce(DataFrame.union, kinds).groupBy("family", "kind").agg(F.max(F.struct("met", "u")).alias("m")).select("family", F.col("m.u").alias("u")).distinct()
    centres = scratch.write(centres, "centres")
    marks = scratch.write(centres.join(grams(centres.select(F.col("u").alias("x")).distinct()).select(F.col("x").alias("u"), F.col("n").alias("nc"), F.col("g").alias("c")), "u"), "marks")
    rows = placed.select("family", "x", "root").distinct()
    rows = scratch.write(rows.join(grams(rows.select("x").distinct()), "x").join(found.select("x", "sketch"), "x"), "lines")
    tried = rows.join(marks, "family").groupBy("family", "u").agg(F.count_if(F.expr(f"size(array_intersect(g, c)) * {p} >= (n + nc) * {low}")).alias("met"))
    chosen = tried.groupBy("family").agg(F.max(F.struct("met", "u")).alias("m")).select("family", F.col("m.u").alias("u"))
    chosen = chosen.join(known.select(F.col("x").alias("u"), F.col("root").alias("ru")), "u", "left").withColumn("ru", F.coalesce("ru", "u"))
    rows = rows.join(marks.join(chosen, ["family", "u"]), "family")
    rows = rows.select(F.col("family").alias("bucket"), "x", "root", "u", "ru", "sketch", "n", "nc", F.expr("concat(array_except(g, c), array_except(c, g))").alias("keys"))
    rows = scratch.write(rows.withColumn("d", F.size("keys")).withColumn("near", F.expr(f"(n + nc) * {q} >= d * {p}")), "differing")
    # not all lines have been compared with this centre: those near it are to be of its component
    linked = scratch.write(rows.filter("near and root <> ru").select(F.least("x", "u").alias("u"), F.greatest("x", "u").alias("v")), "linked")
    scratch.drop("large", "centres", "marks", "lines")
    rows = scratch.write(_may_pair(rows, scratch), "paired")
    scratch.drop("differing", "slots", "quads", "meeting", "partnered")
    each = rows.select("bucket", "x", "near", F.explode("keys").alias("key"))
    # a shingle matters if several lines have it and one of them asks
    common = scratch.write(each.groupBy("bucket", "key").agg(F.count("*").alias("m"), F.count_if(~F.col("near")).alias("asked")).filter("m > 1 and asked > 0").drop("asked"), "common")
    # by some shingles most lines differ from the centre: these come last in the order, and a bitmap tells exactly which of them two lines share
    rank = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("m"), "key"))
    usual = common.filter("m > 8").withColumn("r", rank).filter("r <= 64").select("bucket", "key", "r")
    sizes = common.groupBy("bucket").agg((F.count("*") <= LISTED).alias("listed"))
    ranked = scratch.write(common.join(usual, ["bucket", "key"], "left").join(sizes, "bucket"), "ranked")
    place = F.struct(F.coalesce(-F.col("r"), F.lit(-65)).alias("r"), "m", "key")
    # an intersection keeps the order of its first array: a line's shared shingles in the order of the bucket, without a row for each
    lists = ranked.filter("listed").groupBy("bucket").agg(F.sort_array(F.collect_list(place)).alias("l"))
    # a table of its own, so that the join can split a very large bucket
    lists = scratch.write(lists.select("bucket", F.col("l.key").alias("ranks"), F.expr("filter(l, s -> s.r > -65)").alias("top")), "lists")
    bits = F.expr("transform(array(array_intersect(top.key, keys)), had -> aggregate(top, 0L, (b, s) -> if(array_contains(had, s.key), b | shiftleft(1L, -s.r - 1), b)))[0]")
    whole = rows.select("bucket", "x", "keys").join(lists, "bucket").select("bucket", "x", F.array_intersect("ranks", "keys").alias("shared"), bits.alias("bits"))
    single = rows.join(ranked.filter("not listed").select("bucket").distinct(), "bucket").select("bucket", "x", F.explode("keys").alias("key"))
    single = single.join(ranked.filter("not listed"), ["bucket", "key"]).groupBy("bucket", "x").agg(
        F.sort_array(F.collect_list(place)).alias("shared"), F.bit_or(F.when(F.col("r").isNull(), 0).otherwise(F.expr("shiftleft(1L, r - 1)"))).alias("bits")
    )
    single = scratch.write(single.withColumn("shared", F.col("shared.key")), "shared_singly")
    shared = scratch.write(whole.union(single).filter("size(shared) > 0").withColumn("often", F.bit_count("bits")), "shared")
    odd = f"transform(sequence(0, {WORDS - 1}), j -> aggregate(filter(keys, k -> (shiftright(k, 6) & {WORDS - 1}) = j), 0L, (w, k) -> w ^ shiftleft(1L, cast(k & 63 as int))))"
    rows = rows.withColumn("odd", F.expr(odd)).drop("keys", "u", "ru").join(shared, ["bucket", "x"]).withColumn("rare", F.col("d") - F.col("often")).withColumn("alone", F.expr("d - size(shared)"))
    # as the first shingle that two lines share has at least k - 1 others behind it in both
    rows = rows.withColumn("meets", F.expr(f"d - cast(floor((d * {p} + (nc - n) * {q}) / {2 * p}) as int)"))
    # and of near lines, neither has more than n q / low shingles that the other lacks
    most = f"cast(floor(n * {q} / {low}) as int) + 1"
    rows = rows.withColumn("meets", F.expr(f"least(meets, {most})")).withColumn("asks", F.expr(f"if(near, 0, least(d, {most}))"))
    rows = rows.filter("greatest(meets, asks) > alone")
    rows = rows.select("bucket", "x", "root", "sketch", "bits", "odd", "n", "d", "rare", "near", "meets", "asks", "alone", F.posexplode(F.expr("slice(shared, 1, greatest(meets, asks) - alone)")).alias("i", "key"))
    keys = scratch.write(rows.withColumn("key", F.xxhash64("bucket", "key")).withColumn("i", F.col("i") + F.col("alone")).drop("bucket", "alone"), "keys")
    scratch.drop("paired", "common", "ranked", "lists", "shared_singly", "shared")
    a, b = keys.filter("i < asks").drop("near", "meets", "asks"), keys.filter("i < meets").drop("meets", "asks")
    b = b.select(*(F.col(c).alias(f"{c}_b") for c in b.columns))
    open_ = (F.col("near_b") | (F.col("x") < F.col("x_b"))) & (F.col("root") != F.col("root_b")) & _sizes_fit()
    k = F.bit_count(F.col("bits").bitwiseAND(F.col("bits_b"))) + F.greatest(F.least(F.col("rare") - F.col("i"), F.col("rare_b") - F.col("i_b")), F.lit(0))
    enough = k * (2 * p) >= (F.col("d") + F.col("d_b")) * p - (F.col("n") + F.col("n_b")) * q
    apart = f"aggregate(sequence(0, {WORDS - 1}), 0, (m, j) -> m + bit_count(odd[j] ^ odd_b[j]))"
    fit = F.when(open_ & enough & _agree("sketch", "sketch_b"), F.expr(f"{apart} * {p} <= (n + n_b) * {q}")).otherwise(False)
    pairs = a.join(b, (F.col("key") == F.col("key_b")) & fit)
    return pairs.select(F.least("x", "x_b").alias("u"), F.greatest("x", "x_b").alias("v")).union(linked)


def near_lines(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2, r1, r2): the component (r1, r2) of each line hash that has near duplicates.

    ``lines`` has h1, h2 and the normalised line s; equal lines are one node throughout. In a band's
    bucket all lines are compared with a centre, the line that meets most others, and those that aren't near
    it with the line most like it, which is nearer to the middle of a family of copies; lines still apart are
    compared with the shortest of them. These links give components. Only buckets that then still
    hold lines of several components are looked at again, for pairs of different components whose sketches
    agree in AGREE min-hashes. Up to SMALL lines, a bucket's lines meet each other. Words of the bits on
    which their shingles fall prove most pairs apart, those with centres too. In a larger bucket lines meet only by shingles that are unusual
    in it, which near lines must share if one isn't near the centre. What is left is compared exactly.
    """
    with _one_level_maps(scratch.spark):
        signed = scratch.write(_signatures(lines), "signatures")
    rows = signed.select("h1", "h2", "sketch", F.explode(F.array(*(f"b{b}" for b in range(len(BANDS))))).alias("bucket"))
    often = scratch.write(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    met = _may_meet(rows, often, "bucket").join(often.hint("shuffle_hash"), "bucket")
    # a line's buckets are few; a line that meets most others is the likeliest original of a group of copies
    found = met.groupBy("h1", "h2").agg(F.first("sketch").alias("sketch"), F.sum("n").alias("w"), F.collect_list("bucket").alias("buckets"))
    found = scratch.write(found.select(_id("h1", "h2").alias("x"), "h1", "h2", "sketch", "w", "buckets"), "found")
    scratch.drop("signatures", "often")
    named = found.select(F.col("x"), "h1", "h2")
    texts = scratch.write(_may_meet(lines, named, "h1").join(named.hint("shuffle_hash"), ["h1", "h2"]).select("x", "s").dropDuplicates(["x"]), "texts")
    members = found.select(F.explode("buckets").alias("bucket"), "x", "w")

    with _one_level_maps(scratch.spark):
        words = scratch.write(_words(texts), "words")

    def near_pairs(pairs: DataFrame) -> DataFrame:
        """(u, v, alike) of the pairs (u, v) that are near; only those that may be, by their words, meet their texts."""
        two = pairs.join(words.withColumnRenamed("x", "u"), "u").join(words.select(*(F.col(c).alias("v" if c == "x" else f"{c}_b") for c in words.columns)), "v")
        two = two.filter(_may_be_near()).select("u", "v")
        return _near_pairs(two.join(texts.select(F.col("x").alias("v"), F.col("s").alias("sv")), "v").join(texts.select(F.col("x").alias("u"), F.col("s").alias("su")), "u"))

    def star(rows: DataFrame, centres: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Each row's line against its bucket's centre (bucket, u), if there is one: the near pairs, and (bucket, u, x, near, centre, alike)."""
        centres = scratch.write(centres, f"{name}_centres")
        pairs = scratch.write(rows.select("bucket", F.col("x").alias("v")).join(centres, "bucket", "left"), f"{name}_pairs")
        wanted = pairs.filter("u <> v").select("u", "v").distinct()
        links = scratch.write(near_pairs(wanted), name)
        out = pairs.join(links, ["u", "v"], "left")
        centre = F.coalesce(F.col("u") == F.col("v"), F.lit(False))
        out = out.select("bucket", "u", F.col("v").alias("x"), (F.col("alike").isNotNull() | centre).alias("near"), centre.alias("centre"), "alike")
        return links.select("u", "v"), scratch.write(out, f"{name}_rows")

    def best(rows: DataFrame, by: str) -> DataFrame:
        return rows.groupBy("bucket").agg(F.max(F.struct(by, "x")).alias("c")).select("bucket", F.col("c.x").alias("u"))

    first, first_rows = star(members, best(members, "w"), "first")
    # buckets with one centre are of one family, mostly: from here on they are one bucket, named by the centre
    first_rows = scratch.write(first_rows.filter("not centre").select(F.col("u").alias("bucket"), "x", "near", "alike").distinct(), "families")
    second, second_rows = star(first_rows.filter("not near"), best(first_rows.filter("near"), "alike"), "second")
    apart = second_rows.filter("not near").select("bucket", "x")
    third, third_rows = star(apart, best(apart.join(texts.select("x", (-F.length("s")).alias("short")), "x"), "short"), "third")
    known = connected_components(first.union(second).union(third), scratch, "known")
    known = scratch.write(known.select(F.col("node").alias("x"), "root"), "known")
    # all of a bucket that has several lines apart or a component besides: all lines were compared with the first centre
    placed = first_rows.select("bucket", "x", "near").join(known, "x", "left").select("bucket", "x", "near", F.coalesce("root", "x").alias("root"))
    placed = scratch.write(placed, "roots")
    several = scratch.write(placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.count("*").alias("lines")).filter("a <> z").select("bucket", "lines"), "several")
    placed = scratch.write(placed.join(several, "bucket"), "apart")
    large = F.col("lines") > SMALL

    def grams(wanted: DataFrame) -> DataFrame:
        """(x, n, g): the shingles of the lines x and their number."""
        return texts.join(wanted, "x").select("x", F.expr(f"array_distinct({_grams('s')})").alias("g")).select("x", F.size("g").alias("n"), "g")

    more = scratch.write(_met_in_small(placed.filter(~large), found, words).distinct(), "met_in_small")
    more = more.union(scratch.write(_met_in_large(placed.filter(large), known, found, [second_rows, third_rows], grams, scratch).distinct(), "met_in_large"))
    scratch.drop("linked", "keys")
    more = scratch.write(near_pairs(more.distinct()).select("u", "v"), "more")
    scratch.drop("roots", "several", "apart", "met_in_small", "met_in_large")
    edges = known.filter("x <> root").select(F.col("x").alias("u"), F.col("root").alias("v")).union(more)
    parts = connected_components(edges, scratch, "components")
    roots = parts.join(named.withColumnRenamed("x", "node"), "node").select("h1", "h2", "root")
    return scratch.write(roots.join(named.select(F.col("x").alias("root"), F.col("h1").alias("r1"), F.col("h2").alias("r2")), "root").select("h1", "h2", "r1", "r2"), "near")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text reduced to lines that are kept, and __n_lines, __n_kept.

    Lines, split at line feeds, are compared in lower case without the spaces around them; two are near
    duplicates if their sets of SHINGLE-character shingles (a shorter line is one) have Jaccard similarity
    SIMILAR or more. Of each connected component of the corpus's lines the first, by (id, line number),
    stays, ids of null last. Blank lines always stay. Null text stays null and has no lines. Rows that
    repeat both id and text are one document and keep the same lines. All columns are kept; an empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    text = F.col(f"`{text_col}`")
    h = F.xxhash64(text)
    # lower case is of whole texts, once: of a line, the filter would make it again. A line feed ends a word as an end of text does.
    # outer, as otherwise Spark splits texts again to leave out empty arrays; there are none
    rows = docs.filter(text.isNotNull()).select(F.col(f"`{id_col}`").alias("d"), h.alias("h"), F.posexplode_outer(F.split(F.lower(text), "\n", -1)).alias("line", "s"))
    rows = rows.withColumn("s", F.trim("s")).filter("s <> ''")
    lines = rows.select("d", "h", "line", "s", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), F.col("s")).alias("h2"))
    near = near_lines(lines.select("h1", "h2", "s"), scratch)
    scratch.drop_all_but("near")

    places = scratch.write(lines.drop("s"), "places")
    order = F.struct(F.isnull("d").alias("none"), "d", "h", "line")
    # the first place of each class of several places, by the line hashes that are in it
    own = places.groupBy("h1", "h2").agg(F.min(order).alias("f"), F.count("*").alias("n"))
    own = own.join(near, ["h1", "h2"], "left").filter("n > 1 or r1 is not null")
    own = scratch.write(own.select("h1", "h2", "f", F.coalesce("r1", "h1").alias("c1"), F.coalesce("r2", "h2").alias("c2")), "own")
    # a table of its own, so that the join deals both sides anew and can split a very large component
    least = scratch.write(own.groupBy("c1", "c2").agg(F.min("f").alias("f")), "least", free=False)
    first = scratch.write(own.drop("f").join(least, ["c1", "c2"]).select("h1", "h2", "f"), "firsts")
    # only what goes is dealt by document; the hashes' table is of its own, so that the join can split a very common line
    gone = places.join(first, ["h1", "h2"]).filter(order != F.col("f")).groupBy("d", "h").agg(F.collect_set("line").alias("gone"))
    gone = scratch.write(gone.select(F.col("d").alias("__d"), F.col("h").alias("__h"), F.col("gone").alias("__gone")), "gone")
    scratch.drop("near", "places", "own", "least", "firsts")

    marked = docs.withColumn("__hash", h)
    out = marked.join(gone, marked[f"`{id_col}`"].eqNullSafe(gone["__d"]) & (marked["__hash"] == gone["__h"]), "left")
    split = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))  # numbers are distinct, so the order stays
    kept = F.transform(F.array(split), lambda s: F.transform(left, lambda i: F.get(s, i)))[0]
    out = out.withColumn("__lines", F.when(F.col("__gone").isNull(), split).otherwise(kept)).withColumn("__n_lines", F.size(split))
    columns = [F.when(F.col("__gone").isNull(), F.col(f"`{c}`")).otherwise(F.array_join("__lines", "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, F.when(text.isNull(), 0).otherwise(F.col("__n_lines")).cast("long").alias("__n_lines"), F.when(text.isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("__n_kept"))
