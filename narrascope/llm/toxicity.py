"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed into a table, with
marks at the word's ends), a window of words is the mean of its words, and a linear softmax
over the window's vector gives the probability of the toxic class. Vectors and softmax
are trained jointly in numpy by Adagrad. A misspelling that training never saw shares most of
its n-grams with the word it stands for.

A text is as toxic as its most toxic window (of WINDOW words: one over the whole text found almost no toxic
document of the test tables). In the first round of training the
window is the whole text; after that, each text's currently most toxic window
carries the gradient, so a few words count however long the text is.

Training reads a bounded sample of labelled rows (`per_class` of each class, chosen by
a hash of the id, texts of at most TEXT_BYTES); scoring reads every row and whole texts. Since the softmax is linear in
the mean, a word's part is a number, and workers look words up in a table of scores per n-gram.

Defined cases: null and empty texts get the score of a window without words;
without labelled rows of both classes the score is the share of toxic labels (0 without
labels); null labels are not used; a row that is labelled twice is toxic if one label says so;
rows that repeat an id are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from array import array
from dataclasses import dataclass


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import map_batches, release_memory, small_batches, texts, written

SEED = 7
BUCKETS = 1 << 17
DIMENSIONS = 12
GRAMS = (3, 6)  # shortest and longest n-gram, in characters, end marks included
WINDOW = 3  # words
PER_CLASS = 1500  # labelled rows of each class that training reads
TEXT_BYTES = 1 << 15  # longest text that training reads, so the sample holds at most 2 * PER_CLASS * TEXT_BYTES
VISITS = 24_000  # texts that training visits, repeats counted, however many there are
BATCH = 32
LARGEST_WEIGHT = 2.0  # of a training row
RATE = 0.3
CACHED = 400_000  # words remembered by a worker
EDGES = b".,;:!?\"'()[]{}<>|#*$%&-_=+~/\\"


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().split()


def buckets_of(word: bytes) -> list[int]:
    """Buckets of a word's character n-grams; the whole word is one of them if it is short enough."""
    text = f"<{word.strip(EDGES).decode('utf-8', 'replace')}>"
    grams = {text[a:a + n] for n in range(GRAMS[0], GRAMS[1] + 1) for a in range(len(text) - n + 1)} or {text}
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


@dataclass(frozen=True)
class Model:
    """Vectors per bucket, the softmax's two columns and biases."""

    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def bucket_scores(self) -> np.ndarray:
        """What each n-gram adds to the toxic class against the other."""
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)

    def log_odds(self) -> float:
        return float(self.bias[1] - self.bias[0])


def window_means(scores: np.ndarray) -> np.ndarray:
    """Mean score of every window of WINDOW words; of all words in a shorter text."""
    if len(scores) <= WINDOW:
        return np.array([scores.mean() if len(scores) else 0.0])
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    return (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW


def train(documents: list[list[bytes]], toxic: np.ndarray, visits: int = VISITS, seed: int = SEED) -> Model:
    """Fit vectors and softmax together on lower-case words and 0/1 labels.

    The number of rounds follows from `visits`, so that the training effort is the same for any sample.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    softmax = np.zeros((DIMENSIONS, 2), np.float32)
    softmax[:, 1] = random.uniform(-1, 1, DIMENSIONS)
    share = float(np.clip(toxic.mean(), 1e-4, 1 - 1e-4)) if len(toxic) else 1e-4
    bias = np.array([math.log(1 - share), math.log(share)], np.float32)
    if len(set(toxic.tolist())) < 2:
        softmax[:] = 0
        return Model(vectors, softmax, bias)
    # the rarer class counts more, so that the limit of one half does not favour the frequent one
    weights = np.clip(0.5 / np.array([1 - share, share]), None, LARGEST_WEIGHT).astype(np.float32)
    place: dict[bytes, int] = {}
    rows = [np.array([place.setdefault(w, len(place)) for w in words], np.int32) for words in documents]
    buckets, lengths = array("i"), array("i")
    for word in place:
        own = buckets_of(word)
        buckets.extend(own)
        lengths.append(len(own))
    flat, sizes = np.array(buckets, np.int32), np.array(lengths, np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    squares = [np.full_like(p, 1e-4) for p in (vectors, softmax, bias)]
    for turn in range(1 + visits // len(rows)):
        for chosen in np.array_split(random.permutation(len(rows)), max(1, len(rows) // BATCH)):
            by_bucket = vectors @ (softmax[:, 1] - softmax[:, 0])
            used = np.unique(np.concatenate([rows[i] for i in chosen])) if len(chosen) else np.empty(0, np.int64)
            if not len(used):
                continue
            spans = np.concatenate([np.arange(starts[u], starts[u] + sizes[u]) for u in used])
            cuts = np.concatenate(([0], np.cumsum(sizes[used])[:-1]))
            of_word = np.add.reduceat(by_bucket[flat[spans]], cuts) / sizes[used]
            steps = [np.zeros_like(p) for p in (softmax, bias)]
            touched, amounts = [], []
            for i in chosen:
                if not len(rows[i]):
                    continue
                if turn == 0:
                    words = rows[i]
                else:
                    best = int(np.argmax(window_means(of_word[np.searchsorted(used, rows[i])])))
                    words = rows[i][best:best + WINDOW]
                parts = np.concatenate([flat[starts[w]:starts[w] + sizes[w]] for w in words])
                weight = np.repeat(1 / (len(words) * sizes[words]), sizes[words]).astype(np.float32)
                mean = weight @ vectors[parts]
                logits = mean @ softmax + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[int(toxic[i])] -= 1
                p *= weights[int(toxic[i])]
                steps[0] += np.outer(mean, p)
                steps[1] += p
                touched.append(parts)
                amounts.append(weight[:, None] * (softmax @ p)[None, :])
            if not touched:
                continue
            parts, at = np.unique(np.concatenate(touched), return_inverse=True)
            step = np.zeros((len(parts), DIMENSIONS), np.float32)
            np.add.at(step, at, np.concatenate(amounts))
            squares[0][parts] += step ** 2
            vectors[parts] -= RATE * step / np.sqrt(squares[0][parts])
            for value, change, square in zip((softmax, bias), steps, squares[1:]):
                change = change / len(chosen)
                square += change ** 2
                value -= 0.1 * RATE * change / np.sqrt(square)
    return Model(vectors, softmax, bias)


def sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", per_class: int = PER_CLASS) -> tuple[list[list[bytes]], np.ndarray]:
    """Words and labels of at most `per_class` labelled rows per class, by a hash of the id.

    `usable` is a condition on the id column (named `id`) that keeps held-out rows away.
    """
    known = written(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
                    .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & usable)
                    .groupBy("id").agg(F.max("y").alias("y")), "labels")
    ids = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        ids = part if ids is None else ids.union(part)
    # at most 2 * per_class ids, and as many texts of bounded length on the driver
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TEXT_BYTES)
            .join(F.broadcast(written(ids, "sample")), "id").orderBy(F.xxhash64("id", "text")).limit(2 * per_class).collect())
    return [words_of((r["text"] or "").encode()) for r in rows], np.array([r["y"] for r in rows], np.int64)


class Scorer:
    """Scores of texts from a table of scores per n-gram."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.tolist(), bias
        self.known: dict[bytes, float] = {}

    def word(self, word: bytes) -> float:
        value = self.known.get(word)
        if value is None:
            grams = buckets_of(word)
            value = sum(map(self.table.__getitem__, grams)) / len(grams)
            if len(self.known) >= CACHED:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = value
        return value

    def score(self, text: bytes) -> float:
        words, known = words_of(text), self.known
        try:
            values = [known[w] for w in words]
        except KeyError:
            values = list(map(self.word, words))
        odds = self.bias + float(window_means(np.array(values, np.float64)).max())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; the table of n-gram scores is sent to each worker once (half a megabyte)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bucket_scores(), model.log_odds()))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        scorer = Scorer(*sent.value)

        def step(batch):
            values = [scorer.score(t) for t in texts(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.float64())], ["id", "score"])
        return step

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                       make, f"id {kind}, score double")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, **columns) -> Model:
    return train(*sample(docs, labels, usable, **columns))




def not_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose score lies below the limit, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bucket_scores(), model.log_odds()))
    schema = docs.schema
    names = [f"c{i}" for i in range(len(schema))]
    at = names[docs.columns.index(text_col)]

    def run(batches):
        scorer = Scorer(*sent.value)
        for batch in batches:
            keep = [scorer.score(t) < limit for t in texts(batch, at)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        del scorer
        release_memory()

    renamed = docs.toDF(*names)
    small_batches(docs.sparkSession)
    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)
