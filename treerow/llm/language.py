"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import append_columns, small_batches
from .decontaminate import Words

#: Buckets of hashed features.
BUCKETS = 1 << 18
#: Labelled documents per language that the model is fitted on at most (chosen by the hash of id and text), and the longest that may be one.
TRAIN_DOCS, TRAIN_CHARS = 250, 20_000
#: Training sequences are spliced from segments of so many words of different documents.
SEGMENT, SPLICE = 30, 12
ROUNDS, RATE, DECAY = 14, 0.6, 1e-6
#: Words of a block of the forward-backward scan; text bytes that are featurised at once.
BLOCK, CHUNK = 32, 1 << 20
UNKNOWN = "und"


class Features:
    """Hashed features of each word: affixes, byte trigrams with word ends, and the word itself (lexicon)."""

    def __init__(self):
        import numpy as np

        self.words = Words()
        b = np.arange(256)
        self.words.is_word = self.letter = (b >= 0x80) | ((b >= 0x61) & (b <= 0x7A))

    def __call__(self, texts: list[bytes]):
        """(text number of each word, features of each word (n, 5), trigrams of all words, first trigram of each word)."""
        import numpy as np

        h, doc, starts, ends, buf = self.words.split(texts)
        raw = np.frombuffer(buf, np.uint8)
        is_letter = self.letter[raw]
        b = np.where(is_letter, raw, 32).astype(np.uint32)
        b = np.concatenate(([32], b, [32, 32])).astype(np.uint32)
        at = np.flatnonzero(is_letter)
        tri = self._bucket((b[at] << 16) | (b[at + 1] << 8) | b[at + 2], 1)
        first = np.concatenate(([0], np.cumsum(ends - starts)[:-1])) if len(starts) else np.empty(0, np.int64)
        s, e = starts + 1, ends + 1  # b has one more in front
        two, three = (b[s] << 8) | b[s + 1], (b[s] << 16) | (b[s + 1] << 8) | b[s + 2]
        low = np.maximum(e - 3, s - 1)
        own = np.stack(
            [
                ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64),
                self._bucket(two, 2), self._bucket(three, 3),
                self._bucket((b[e - 2] << 8) | b[e - 1], 4), self._bucket((b[low] << 16) | (b[e - 2] << 8) | b[e - 1], 5),
            ],
            axis=1,
        )
        return doc, own, tri, first

    @staticmethod
    def _bucket(code, kind: int):
        import numpy as np

        x = (code.astype(np.uint64) + np.uint64(kind << 24)) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(46)).astype(np.int64)


def marginals(emission, lengths, transition):
    """Label probabilities of each word by forward-backward, and expected transitions; sequences lie end to end.

    Sequences are cut into blocks. All blocks' transfer matrices are multiplied out at once, one scan per
    sequence joins them, and the words inside all blocks are then visited at once.
    """
    import numpy as np

    n, labels = emission.shape
    p = np.exp(emission - emission.max(axis=1, keepdims=True))
    t = np.exp(transition - transition.max())
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    inside = np.arange(total) - np.repeat(first, blocks)
    base = np.repeat(begin, blocks) + inside * BLOCK
    size = np.minimum(np.repeat(lengths, blocks) - inside * BLOCK, BLOCK)
    step = np.arange(BLOCK)
    valid = step < size[:, None]
    index = np.where(valid, base[:, None] + step, 0)
    pb = p[index]  # (block, word, label)
    m = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for k in range(BLOCK):
        new = (m.reshape(-1, labels) @ t).reshape(total, labels, labels) * pb[:, k, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        m = np.where(valid[:, k, None, None], new, m)
    order = np.argsort(-blocks, kind="stable")
    into, out = np.full((total, labels), 1 / labels), np.ones((total, labels))
    counts = blocks[order]
    for k in range(1, int(counts[0]) if len(counts) else 0):
        live = first[order[: np.searchsorted(-counts, -k, "left")]] + k
        v = np.einsum("bi,bij->bj", into[live - 1], m[live - 1])
        into[live] = v / v.sum(axis=1, keepdims=True)
    for k in range((int(counts[0]) if len(counts) else 0) - 2, -1, -1):
        live = first[order[: np.searchsorted(-counts, -(k + 1), "left")]] + k
        v = np.einsum("bij,bj->bi", m[live + 1], out[live + 1])
        out[live] = v / v.sum(axis=1, keepdims=True)
    ahead = np.empty((total, BLOCK, labels))
    v = into
    for k in range(BLOCK):
        v = (v @ t) * pb[:, k]
        v = v / v.sum(axis=1, keepdims=True)
        ahead[:, k] = v
    gamma = np.empty((n, labels))
    moves = np.zeros((labels, labels))
    back = out
    for k in range(BLOCK - 1, -1, -1):
        on = valid[:, k]
        g = ahead[:, k] * back
        g /= g.sum(axis=1, keepdims=True)
        gamma[index[on, k]] = g[on]
        before = into if k == 0 else ahead[:, k - 1]
        x = before[:, :, None] * t * (pb[:, k] * back)[:, None, :]
        moves += (x / x.sum(axis=(1, 2), keepdims=True))[on].sum(axis=0)
        new = (pb[:, k] * back) @ t.T
        back = np.where(on[:, None], new / new.sum(axis=1, keepdims=True), back)
    return gamma, moves


@dataclass
class Model:
    labels: list[str]
    weights: object  # (BUCKETS, labels) float32
    transition: object

    def label(self, texts: list):
        """For each text (UTF-8 bytes or None) its words in lower case, in order, as (word, label, probability)."""
        import numpy as np

        feature, out = Features(), []
        for t in texts:
            low = (t or b"").decode("utf-8", "replace").lower().encode()
            _, own, tri, first = feature([low])
            if not len(first) or not self.labels:
                out.append([])
                continue
            gamma, _ = marginals(self.emission(own, tri, first), np.array([len(first)]), self.transition)
            _, _, starts, ends, buf = feature.words.split([low])
            best = gamma.argmax(axis=1)
            chance = gamma.max(axis=1)
            out.append([(buf[a:z].decode("utf-8", "replace"), self.labels[j], float(p)) for a, z, j, p in zip(starts.tolist(), ends.tolist(), best.tolist(), chance.tolist(), strict=True)])
        return out

    def emission(self, own, tri, first):
        import numpy as np

        if not len(first):
            return np.zeros((0, len(self.labels)))
        return self.weights[own].sum(axis=1) + np.add.reduceat(self.weights[tri], first, axis=0)

    def predict(self, texts: list):
        """(label or UNKNOWN, score) of each text (UTF-8 bytes or None): the label of most words, by marginal mass, and its share."""
        import numpy as np

        feature, low = Features(), [(t or b"").decode("utf-8", "replace").lower().encode() for t in texts]
        emissions, lengths, k = [], np.zeros(len(texts), np.int64), 0
        while k < len(low):
            size, z = 0, k
            while z < len(low) and (z == k or size + len(low[z]) <= CHUNK):
                size, z = size + len(low[z]), z + 1
            doc, own, tri, first = feature(low[k:z])
            emissions.append(self.emission(own, tri, first))
            lengths[k:z] = np.bincount(doc, minlength=z - k)
            k = z
        labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = np.flatnonzero(lengths)
        if len(some) and self.labels:
            gamma, _ = marginals(np.concatenate(emissions), lengths[some], self.transition)
            mass = np.add.reduceat(gamma, np.concatenate(([0], np.cumsum(lengths[some])[:-1])), axis=0)
            best = mass.argmax(axis=1)
            for i, j, s in zip(some.tolist(), best.tolist(), (mass.max(axis=1) / mass.sum(axis=1)).tolist(), strict=True):
                if any(97 <= c <= 122 for c in low[i][:64]) or any(c.isalpha() for c in low[i].decode()):
                    labels[i], scores[i] = self.labels[j], min(1.0, s)
        return labels, scores


def train(rows: list[tuple[bytes, str]], rounds: int = ROUNDS) -> Model:
    """Fit on (lower-cased text, language): segments of different documents are spliced, so switches are learned too."""
    import numpy as np

    labels = sorted({x for _, x in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1)))
    doc, own, tri, first = Features()([t for t, _ in rows])
    y = np.array([labels.index(x) for _, x in rows])[doc]
    n, wide = len(y), len(labels)
    weights, transition = np.zeros((BUCKETS, wide), np.float32), np.zeros((wide, wide))
    if not n:
        return Model(labels, weights, transition)
    # splice: the order of words that training sees, and the lengths of its sequences
    place = np.arange(n) - np.searchsorted(doc, doc)
    segment = np.cumsum(np.concatenate(([True], (np.diff(doc) != 0) | (place[1:] % SEGMENT == 0)))) - 1
    rng = np.random.default_rng(7)
    rank = rng.permutation(segment[-1] + 1)
    order = np.argsort(rank[segment], kind="stable")
    lengths = np.bincount(rank[segment] // SPLICE)
    lengths = lengths[lengths > 0]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    seen = np.zeros((wide, wide))
    y_in = y[order]
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    np.add.at(seen, (y_in[at - 1], y_in[at]), 1)
    for j in y_in[starts]:
        seen[:, j] += 1 / wide
    size = np.diff(np.concatenate((first, [len(tri)])))
    square, square_t = np.full((BUCKETS, wide), 1e-8, np.float32), np.full((wide, wide), 1e-8)
    model = Model(labels, weights, transition)
    truth = np.eye(wide)[y]
    for _ in range(rounds):
        gamma, moves = marginals(model.emission(own, tri, first)[order], lengths, model.transition)
        miss = truth.copy()
        miss[order] -= gamma
        for j in range(wide):
            g = np.bincount(tri, np.repeat(miss[:, j], size), BUCKETS)
            for k in range(own.shape[1]):
                g += np.bincount(own[:, k], miss[:, j], BUCKETS)
            g = (g / n - DECAY * weights[:, j]).astype(np.float32)
            square[:, j] += g * g
            weights[:, j] += RATE * g / np.sqrt(square[:, j])
        g = (seen - moves) / n
        square_t += g * g
        transition += RATE * g / np.sqrt(square_t)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = TRAIN_DOCS) -> Model:
    """A model of the labelled documents that aren't held out; per_label of each label at most, chosen by hash.

    Only the label counts and that bounded sample reach the driver: a label's rows are thinned by the hash of
    id and text to about twice per_label, and of these the per_label least hashes stay (a limit that each
    task applies first). A label with fewer documents is sampled whole; documents over TRAIN_CHARS are not
    sampled.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("y")).filter(~held_out(F.col("i")) & F.col("t").isNotNull() & F.col("y").isNotNull() & (F.length("t") <= TRAIN_CHARS))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([])
    share = F.create_map(*(x for y, n in counts.items() for x in (F.lit(y), F.lit(2.0 * per_label / n))))
    chosen = rows.withColumn("h", F.pmod(F.xxhash64("i", "t", F.lit(11)), F.lit(1 << 40))).filter(F.col("h") < share[F.col("y")] * (1 << 40))
    chosen = chosen.withColumn("r", F.row_number().over(W.partitionBy("y").orderBy("h"))).filter(F.col("r") <= per_label)
    return train(sorted((r["t"].lower().encode(), r["y"]) for r in chosen.select("t", "y").collect()))


def _predicted(docs: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    small_batches(docs.sparkSession, 512)

    def make(texts):
        import pyarrow as pa

        labels, scores = model.predict(texts)
        return [pa.array(labels, pa.string()), pa.array(scores, pa.float64())]

    return append_columns(docs, text_col, make, [T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())], keep)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    The field's words are runs of letters; affixes, byte trigrams and a lexicon, all hashed, weigh each
    label, and learned transitions tie neighbours. lang_pred is the label with the most marginal mass over
    the whole text's words, score its share of the mass (0 to 1). Null text, or one without a letter, is
    ``und`` with score 0, and so is any text if no document is labelled. Repeated rows each get a row;
    extra columns are not read.
    """
    docs = docs.withColumnRenamed(id_col, "doc_id")
    model = model or fit(docs, "doc_id", text_col, label_col)
    rows = _predicted(docs, model, text_col, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def label_words(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per document: id, words: an array of (word, lang, score) in order, for code-switched text.

    Each word's label is the likeliest by forward-backward over the whole text, score its probability. A
    text without letters, or null, has no words, nor has any text if no document is labelled.
    """
    docs = docs.withColumnRenamed(id_col, "doc_id")
    model = model or fit(docs, "doc_id", text_col, label_col)
    small_batches(docs.sparkSession, 512)

    def make(texts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))
        return [pa.array([[{"word": w, "lang": x, "score": p} for w, x, p in t] for t in model.label(texts)], kind)]

    words = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    return append_columns(docs, text_col, make, [T.StructField("__words", words)], ["doc_id"]).withColumnRenamed("__words", "words")


def keep_identified(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The documents, all columns, whose language is known and holds at least ``min_score`` of the mass."""
    rows = _predicted(docs, fit(docs, id_col, text_col, label_col), text_col, docs.columns)
    return rows.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= min_score)).select(*(f"`{c}`" for c in docs.columns))
