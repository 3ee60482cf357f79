"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its whole form and its byte n-grams (3 to 5, with marks at both ends), each hashed to a bucket
with an embedding; a misspelt word shares most of its n-grams with the right form. A segment of SEGMENT words is the
average of its words' subword embeddings, a linear softmax on top gives its class. Insults are sparse in long texts, so
a text's probability is that of its most toxic segment; training starts on whole texts and then, epoch by epoch, takes
each text's currently most toxic segment, the one that decides its score. Embeddings and softmax are fitted together
by Adam.

The model is fitted on the driver on at most MAX_TRAIN labelled texts (in the order of a hash of the id), none with
crc32 of the id as text mod 4 = 2; only the text is read, never label, language, source or id of a scored row. Scoring
reads one number per bucket (embedding times softmax weights), for the distinct words of a chunk once.

Defined results: a null or empty text, or one without words, scores the training set's share of toxic texts; rows with the same id are scored each; rows without an id are scored and count as not held
out; a null label is no label; several labels of one id train as the largest; without any labels every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import only, text_or_empty
from folioscope.llm.hashing import ALNUM, U64, Words, mixed, word_chunks

BUCKETS = 1 << 18
DIM = 8
MAX_TRAIN = 8_000
SEGMENT = 12
THRESHOLD = 0.3
GRAMS = (3, 4, 5)


def subwords(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the chosen words' subwords, and where each word's begin (with the end)."""
    start, size = words.start[which], words.end[which] - words.start[which]
    padded = np.concatenate([[0], np.cumsum(size + 2)])
    own = np.repeat(np.arange(len(which)), size + 2)
    place = np.arange(padded[-1]) - padded[own]
    raw = words.data[np.clip(start[own] + place - 1, 0, len(words.data) - 1)].astype(U64) if len(own) else np.zeros(0, U64)
    raw[padded[:-1]] = 1
    raw[padded[1:] - 1] = 2
    ends = padded[1:][own]
    parts, owners = [words.hash[which]], [np.arange(len(which))]
    with np.errstate(over="ignore"):
        for n in GRAMS:
            at = np.flatnonzero(np.arange(len(raw)) + n <= ends)
            h = np.full(len(at), n, U64)
            for k in range(n):
                h = h * U64(0x100000001B3) + raw[at + k]
            parts.append(mixed(h))
            owners.append(own[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(parts)[order] & U64(BUCKETS - 1)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(which) + 1))


class Segments:
    """The segments of a run of texts as bags of distinct words: what training and scoring share."""

    def __init__(self, words: Words):
        n = len(words.hash)
        self.distinct, place, self.word = np.unique(words.hash, return_index=True, return_inverse=True)
        self.buckets, self.bounds = subwords(words, place)
        within = np.arange(n) - np.repeat(words.first[:-1], np.diff(words.first))
        self.first = np.append(np.flatnonzero(within % SEGMENT == 0), n)
        self.text = np.searchsorted(words.first, self.first[:-1], "right") - 1

    def logits(self, table: np.ndarray, bias: float) -> np.ndarray:
        """One for each segment."""
        if not len(self.word):
            return np.zeros(0)
        sums = np.add.reduceat(table[self.buckets], self.bounds[:-1])
        counts = np.diff(self.bounds)
        return np.add.reduceat(sums[self.word], self.first[:-1]) / np.add.reduceat(counts[self.word], self.first[:-1]) + bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    def __init__(self, table: np.ndarray, bias: float, prior: float):
        self.table, self.bias, self.prior = table, bias, prior

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, _, words in word_chunks(column, ALNUM):
            best = np.full(len(words), -np.inf)
            segments = Segments(words)
            np.maximum.at(best, segments.text, segments.logits(self.table, self.bias))
            out.append(np.where(np.isinf(best), self.prior, sigmoid(best)))
        return np.concatenate(out) if out else np.zeros(0)


class Sample:
    """Training texts as word numbers in one vocabulary, so memory is bounded by the words, not their subwords."""

    def __init__(self, texts: list[str]):
        number: dict[int, int] = {}
        buckets, sizes, words, firsts, owner = [], [], [], [], []
        at = 0
        for i, text in enumerate(texts):
            for _, _, found in word_chunks(pa.array([text], pa.string()), ALNUM):
                s = Segments(found)
                known = np.fromiter((number.get(x, -1) for x in s.distinct.tolist()), np.int64, len(s.distinct))
                unseen = np.flatnonzero(known < 0)
                known[unseen] = np.arange(len(number), len(number) + len(unseen))
                number.update(zip(s.distinct[unseen].tolist(), known[unseen].tolist(), strict=True))
                own = np.diff(s.bounds)
                sizes.append(own[unseen])
                is_new = np.zeros(len(own), bool)
                is_new[unseen] = True
                buckets.append(s.buckets[np.repeat(is_new, own)].astype(np.int32))
                if len(s.word):
                    words.append(known[s.word].astype(np.int32))
                    firsts.append(s.first[:-1] + at)
                    owner.append(np.full(len(s.first) - 1, i))
                    at += len(s.word)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.buckets, self.bounds = join(buckets, np.int32), np.concatenate([[0], np.cumsum(join(sizes, np.int64))]).astype(np.int64)
        self.word, self.first, self.owner = join(words, np.int32), np.append(join(firsts, np.int64), at), join(owner, np.int64)

    def random_segments(self, rng) -> dict[int, int]:
        """One segment of each text that has words."""
        return self._first_by(rng.random(len(self.owner)))

    def most_toxic(self, slope: np.ndarray) -> dict[int, int]:
        sums, counts = np.add.reduceat(slope[self.buckets], self.bounds[:-1]), np.diff(self.bounds)
        value = np.add.reduceat(sums[self.word], self.first[:-1]) / np.add.reduceat(counts[self.word], self.first[:-1])
        return self._first_by(-value)

    def _first_by(self, value: np.ndarray) -> dict[int, int]:
        order = np.lexsort((value, self.owner))
        texts, at = np.unique(self.owner[order], return_index=True)
        return dict(zip(texts.tolist(), order[at].tolist(), strict=True))

    def bag(self, segment: int) -> np.ndarray:
        return np.concatenate([self.buckets[self.bounds[w] : self.bounds[w + 1]] for w in self.word[self.first[segment] : self.first[segment + 1]].tolist()])


def train(texts: list[str], labels: list[int], warm: int = 4, epochs: int = 16, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Model:
    """Joint fit of embeddings and softmax weights: warm epochs on random segments, then on the most toxic ones."""
    y = np.array(labels, float)
    sample = Sample(texts)
    if not len(sample.word) or y.max() == y.min():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 30.0 if share == 1 else -30.0, share)
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([1 - y.mean(), y.mean()])).astype(np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (embed, weight, bias)]
    importance = np.where(y == 1, min(4.0, (len(y) - y.sum()) / max(1, y.sum())), 1.0)
    step = 0
    for epoch in range(warm + epochs):
        segment = sample.random_segments(rng) if epoch < warm else sample.most_toxic(embed @ (weight[:, 1] - weight[:, 0]))
        for part in np.array_split(rng.permutation(np.array(list(segment))), max(1, len(segment) // batch)):
            bags = [sample.bag(segment[i]) for i in part.tolist()]
            sizes = np.array([len(b) for b in bags])
            ids, owner = np.concatenate(bags), np.repeat(np.arange(len(part)), sizes)
            shares = (1 / sizes[owner]).astype(np.float32)
            hidden = np.add.reduceat(embed[ids] * shares[:, None], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            score = hidden @ weight + bias
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part].astype(int)] -= 1
            p *= (importance[part] / len(part))[:, None]
            back = (p @ weight.T).astype(np.float32)
            used, place = np.unique(ids, return_inverse=True)
            grad = np.zeros((len(used), DIM), np.float32)
            np.add.at(grad, place, back[owner] * shares[:, None])
            step += 1
            for (m, v), target, g, at in ((moments[0], embed, grad, used), (moments[1], weight, hidden.T @ p, slice(None)), (moments[2], bias, p.sum(axis=0), slice(None))):
                m[at] = 0.9 * m[at] + 0.1 * g
                v[at] = 0.999 * v[at] + 0.001 * g * g
                target[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-6)
    return Model((embed @ (weight[:, 1] - weight[:, 0])).astype(np.float32), float(bias[1] - bias[0]), float(y.mean()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    marks = only(labels, id=doc_id, toxic=toxic).where(F.col("toxic").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(max_train)  # at most max_train rows: safe to broadcast
    rows = only(docs, id=doc_id, text=text).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(max_train).collect()
    return train([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each document."""
    sent = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.prior))
    own = only(docs, doc_id=doc_id, text=text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_or_empty("text").alias("text"))
    schema = own.select("doc_id", "held_out", F.lit(0.0).alias("score")).schema

    def run(batches):
        tool = Model(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tool.score(part.column(2)), pa.float64())], names=["doc_id", "held_out", "score"])

    return own.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_and_score(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    return score(docs, fit(docs, labels, **names), **{k: v for k, v in names.items() if k in ("doc_id", "text")})
