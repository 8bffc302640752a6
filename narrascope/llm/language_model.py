"""Interpolated modified Kneser-Ney language model of word bigrams.

The model is counted in three Spark jobs over the whole training text and stored as
sorted arrays in the shared folder, which workers map into memory:

* words: 64-bit hashes in order, with counts. A word's id is its place in this order.
* bigrams: keys `history * (words + 1) + word` in order, with counts. Histories are dealt to
  files by a hash; a frequent one is split over many files by the word that follows.
* histories and continuations: dense slices by id of the sums that discounts need.

Tasks combine counts before they send them, as arrays of keys. A written file is
renamed into place, so a task that runs again replaces it by the same content.
The folder must be a mounted path for mapping; other file systems are refused.

Probability of word v after history u, with count c and the discounts D1, D2, D3+
from the counts of counts:

    p(v|u) = (c - D(c)) / c(u) + (D1 n1(u) + D2 n2(u) + D3 n3(u)) / c(u) * p(v)
    p(v)   = (k - D'(k)) / B + (D1' m1 + D2' m2 + D3' m3) / B / (V + 1)

k is the number of different histories of v, B the number of different bigrams. An
unknown word has c = k = 0; an unknown history leaves p(v). The values sum to 1 over the
V known words and one unknown word.

Defined cases: a null text is empty and scores its end token only; without
training text every probability is 1; rows that repeat are counted as often as they
occur; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.llm.common import release_memory, small_batches, texts, written
from narrascope.session import new_scratch

END = b"\n"  # no word can equal it
SEED = 42
WORDS_PER_FILE = 1 << 20
TOKENS_PER_FILE = 1 << 21
TOKENS_AT_ONCE = 1 << 21  # tokens a task counts before it sends them on
SCORED_AT_ONCE = 1 << 18
DISTINCT_AT_ONCE = 300_000  # different words a task counts before it sends them on
CACHED = 300_000  # words remembered by a worker
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def local_path(folder: str) -> str:
    """The folder as a path that can be mapped."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"the model folder must be mounted to be mapped into memory: {folder}")
    return folder


def save(path: str, array: np.ndarray) -> None:
    """Write an array beside its place and rename it, so that readers never see a part of it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(part, "wb") as file:
        np.save(file, array)
    os.replace(part, path)


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def discounts(of: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things counted once, twice, three and four times."""
    if min(of) <= 0:
        return 0.5, 1.0, 1.5
    n1, n2, n3, n4 = of
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the few numbers that belong to them."""

    folder: str
    tokens: int
    word_bits: int  # leading bits of a hash that name its word file
    word_offsets: tuple[int, ...]
    words: int
    bigram_files: int
    bigrams: int = 0
    high: tuple[float, float, float] = (0.5, 1.0, 1.5)
    low: tuple[float, float, float] = (0.5, 1.0, 1.5)
    low_mass: float = 0.0  # D1' m1 + D2' m2 + D3' m3


class Arrays:
    """The mapped arrays of a model and the words a worker has met."""

    def __init__(self, model: Model):
        self.model = model
        self._open: dict[str, np.ndarray] = {}
        self.known: dict[bytes, int] = {}

    def array(self, name: str) -> np.ndarray:
        if name not in self._open:
            self._open[name] = np.load(f"{self.model.folder}/{name}.npy", mmap_mode="r")
        return self._open[name]

    def _word_ids(self, words: list[bytes]) -> list[int]:
        """Places of words in the vocabulary; -1 if unknown."""
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w, SEED) for w in words], np.uint64)
        file = (hashes >> np.uint64(64 - self.model.word_bits)).astype(np.int64) if self.model.word_bits else np.zeros(len(words), np.int64)
        ids = np.full(len(words), -1, np.int64)
        order = np.lexsort((hashes, file))
        for part in np.split(order, np.flatnonzero(np.diff(file[order])) + 1):
            if len(part):
                stored = self.array(f"words-{file[part[0]]}")
                place = np.searchsorted(stored, hashes[part])
                hit = place < len(stored)
                hit[hit] = stored[place[hit]] == hashes[part][hit]
                ids[part[hit]] = place[hit] + self.model.word_offsets[file[part[0]]]
        return ids.tolist()

    def ids(self, documents: list[list[bytes]]) -> np.ndarray:
        """Ids of all tokens of the documents, one after the other."""
        known = self.known
        new = list({w for words in documents for w in words if w not in known})
        if len(known) + len(new) > CACHED:
            kept = {w: known[w] for words in documents for w in words if w in known}
            known.clear()
            known.update(kept)
        if new:
            known.update(zip(new, self._word_ids(new)))
        return np.fromiter((known[w] for words in documents for w in words), np.int64, sum(map(len, documents)))

    def by_id(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of a dense table, which lies in slices, at the given ids; 0 for unknown words."""
        out = np.zeros(len(ids), np.float64)
        slices = ids >> 20
        for k in range(slices.max(initial=-1) + 1):
            at = np.flatnonzero(slices == k)
            if not len(at):
                continue
            out[at] = self.array(f"{name}-{k}")[ids[at] & (1 << 20) - 1]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of words; 0 for unknown ones and for the start of a text."""
        offsets = np.array(self.model.word_offsets)
        out = np.zeros(len(ids), np.int64)
        ok = (ids >= 0) & (ids < self.model.words)
        file = np.searchsorted(offsets, ids, side="right") - 1
        file[~ok] = -1
        for k in range(len(offsets)):
            at = np.flatnonzero(file == k)
            if not len(at):
                continue
            out[at] = self.array(f"counts-{k}")[ids[at] - offsets[k]]
        return out

    def bigram_file(self, histories: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The file of a bigram: by history, and a frequent history (given its count) by the word as well."""
        parts = 1 + counts // TOKENS_PER_FILE
        start = histories == self.model.words  # the start of a text may be frequent too
        parts[start] = self.model.bigram_files
        mixed = histories.astype(np.uint64) * np.uint64(31) + (words % parts).astype(np.uint64) + np.uint64(1)
        return ((mixed * SPREAD) >> np.uint64(33)).astype(np.int64) % self.model.bigram_files

    def bigram_counts(self, histories: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Training counts of bigrams, given the counts of their histories; 0 for unknown ones."""
        found = np.zeros(len(words), np.int64)
        known = np.flatnonzero((histories >= 0) & (words >= 0))
        keys = histories[known].astype(np.uint64) * np.uint64(self.model.words + 1) + words[known].astype(np.uint64)
        file = self.bigram_file(histories[known], words[known], counts[known])
        order = np.lexsort((keys, file))
        for part in np.split(order, np.flatnonzero(np.diff(file[order])) + 1):
            if not len(part):
                continue
            k = file[part[0]]
            stored, small = self.array(f"bigrams-{k}"), self.array(f"times-{k}")
            place = np.searchsorted(stored, keys[part])
            hit = place < len(stored)
            hit[hit] = stored[place[hit]] == keys[part][hit]
            times = small[place[hit]].astype(np.int64)
            if (many := times == 255).any():
                times[many] = self.array(f"many-{k}")[np.searchsorted(self.array(f"many_at-{k}"), place[hit][many])]
            found[known[part[hit]]] = times
        return found

    def score(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: training count, base log10 probability, model log10 probability."""
        m = self.model
        ids = self.ids(documents)
        # tables are read once per different word of the portion, the start of a text among them
        own, place = np.unique(np.append(ids, m.words), return_inverse=True)
        word, start = place[:-1], place[-1]
        before = np.concatenate(([start], word[:-1]))
        before[np.cumsum([0, *map(len, documents[:-1])])] = start
        counts = self.counts(own)
        base = np.log10((counts + 1.0) / (m.tokens + m.words + 1.0))[word]
        if not m.bigrams:
            return counts[word], base, np.zeros(len(ids))
        kinds = self.by_id("continuations", own)
        low = (kinds - discounted(kinds, m.low) + m.low_mass / (m.words + 1)) / m.bigrams
        total = self.by_id("totals", own)
        safe = np.maximum(total, 1)
        rest = sum(d * self.by_id(f"n{k}", own) for k, d in enumerate(m.high, 1)) / safe
        times = self.bigram_counts(own[before], ids, counts[before]).astype(np.float64)
        value = np.where(total[before] > 0, (times - discounted(times, m.high)) / safe[before] + rest[before] * low[word], low[word])
        return counts[word], base, np.log10(value)


def discounted(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)]


# the arrays of the model that this worker has met last; those of others are let go
_HELD: list[Arrays] = []


def arrays(model: Model) -> Arrays:
    """The arrays of a model. A word's id belongs to the folder, so what counting has met serves scoring too."""
    if not _HELD or _HELD[0].model != model:
        lookup = Arrays(model)
        if _HELD and _HELD[0].model.folder == model.folder:
            lookup.known = _HELD[0].known
        _HELD[:] = [lookup]
    return _HELD[0]


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def portions(batch: pa.RecordBatch, limit: int) -> Iterator[list[list[bytes]]]:
    """The documents of a batch as tokens, in portions of about `limit` tokens."""
    part, size = [], 0
    for text in texts(batch, "text"):
        part.append(tokens(text))
        size += len(part[-1])
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sent() -> pa.RecordBatch:
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w, SEED) for w in counts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], ["hash", "n"])

    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in texts(batch, "text"):
            counts.update(tokens(text))
            if len(counts) >= DISTINCT_AT_ONCE:
                yield sent()
                counts.clear()
    if counts:
        yield sent()
    counts.clear()
    release_memory()


def _fit_words(text: DataFrame, folder: str) -> tuple[int, int, tuple[int, ...], int]:
    counted = written(text.mapInArrow(_count_words, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    words, total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    bits = max(0, -(-2 * words // WORDS_PER_FILE) - 1).bit_length()
    file = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("bigint")

    def store(table: pa.Table) -> pa.Table:
        hashes = table.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        k = table.column("file")[0].as_py()
        save(f"{folder}/words-{k}.npy", hashes[order])
        save(f"{folder}/counts-{k}.npy", table.column("n").to_numpy()[order])
        return pa.table({"file": pa.array([k], pa.int64()), "rows": pa.array([len(order)], pa.int64())})

    stored = dict(map(tuple, counted.withColumn("file", file).groupBy("file").applyInArrow(
        store, "file bigint, rows bigint").collect()))  # one row per file of about a million words
    for k in range(1 << bits):
        if k not in stored:
            save(f"{folder}/words-{k}.npy", np.empty(0, np.uint64))
            save(f"{folder}/counts-{k}.npy", np.empty(0, np.int64))
    sizes = [stored.get(k, 0) for k in range(1 << bits)]
    return total or 0, bits, tuple(np.cumsum([0, *sizes[:-1]]).tolist()), words


def _count_bigrams(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = arrays(model)

        def sent() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(waiting))
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts = np.diff(np.append(first, len(keys))).astype(np.uint32)
            keys = keys[first]
            base = np.uint64(model.words + 1)
            histories = (keys // base).astype(np.int64)
            file = lookup.bigram_file(histories, (keys % base).astype(np.int64), lookup.counts(histories))
            order = np.argsort(file, kind="stable")
            parts = [p for p in np.split(order, np.flatnonzero(np.diff(file[order])) + 1) if len(p)]
            return pa.RecordBatch.from_arrays([
                pa.array([int(file[p[0]]) for p in parts], pa.int64()),
                pa.array([keys[p].tobytes() for p in parts], pa.binary()),
                pa.array([_narrow(counts[p]) for p in parts], pa.binary())], ["file", "keys", "counts"])

        waiting, size = [], 0
        for batch in batches:
            for documents in portions(batch, SCORED_AT_ONCE):
                ids = lookup.ids(documents)
                history = np.concatenate(([model.words], ids[:-1]))
                history[np.cumsum([0, *map(len, documents[:-1])])] = model.words
                waiting.append(history.astype(np.uint64) * np.uint64(model.words + 1) + ids.astype(np.uint64))
                size += len(ids)
                if size >= TOKENS_AT_ONCE:
                    yield sent()
                    waiting, size = [], 0
        if waiting:
            yield sent()
        waiting.clear()
        release_memory()

    return run


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in one byte each if they fit, else in four; the length tells which."""
    return (counts.astype(np.uint8) if counts.max() < 256 else counts.astype("<u4")).tobytes()


def _wide(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == length else "<u4").astype(np.int64)


def _store_bigrams(model: Model):
    """Merge the counts of one file, store them, and send on sums by history and by word."""
    def run(table: pa.Table) -> pa.Table:
        k = table.column("file")[0].as_py()
        keys = [np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()]
        counts = [_wide(b, len(a)) for a, b in zip(keys, table.column("counts").to_pylist())]
        keys, counts = combined(np.concatenate(keys), np.concatenate(counts))
        save(f"{model.folder}/bigrams-{k}.npy", keys)
        save(f"{model.folder}/times-{k}.npy", np.minimum(counts, 255).astype(np.uint8))
        many = np.flatnonzero(counts >= 255)
        save(f"{model.folder}/many_at-{k}.npy", many)
        save(f"{model.folder}/many-{k}.npy", counts[many])
        base = np.uint64(model.words + 1)
        rows = []
        history = (keys // base).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], history[1:] != history[:-1])))
        sums = [np.add.reduceat(v.astype(np.int64), first) for v in
                (counts, counts == 1, counts == 2, counts >= 3)]
        ids, kinds = np.unique((keys % base).astype(np.int64), return_counts=True)
        for kind, owner, values in (("h", history[first], np.stack(sums, 1)), ("w", ids, kinds[:, None])):
            slices = owner >> 20
            for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(slices)) + 1):
                if len(part):
                    rows.append((int(slices[part[0]]), kind, owner[part].astype("<i8").tobytes(),
                                 values[part].astype("<i8").tobytes(), [0] * 5))
        rows.append((-1, "n", b"", b"", [len(keys), *(int((counts == c).sum()) for c in (1, 2, 3, 4))]))
        return pa.table(list(map(pa.array, zip(*rows))), names=["slice", "kind", "ids", "sums", "numbers"])

    return run


def _store_slices(model: Model):
    """Dense tables of one million ids, and how many words have one, two, ... histories."""
    def run(table: pa.Table) -> pa.Table:
        k = table.column("slice")[0].as_py()
        dense = {name: np.zeros(1 << 20, np.int64) for name in ("totals", "n1", "n2", "n3", "continuations")}
        for kind, ids, sums in zip(*(table.column(c).to_pylist() for c in ("kind", "ids", "sums"))):
            at = np.frombuffer(ids, "<i8") & (1 << 20) - 1
            values = np.frombuffer(sums, "<i8").reshape(len(at), -1)
            for name, column in zip(("totals", "n1", "n2", "n3") if kind == "h" else ("continuations",), values.T):
                dense[name][at] += column
        for name, values in dense.items():
            save(f"{model.folder}/{name}-{k}.npy", values if values.max() >= 1 << 32 else values.astype(np.uint32))
        kinds = dense["continuations"]
        numbers = [int((kinds == c).sum()) for c in (1, 2, 3, 4)] + [int((kinds >= 3).sum())]
        return pa.table({"numbers": pa.array([numbers])})

    return run


def _summed(numbers: DataFrame) -> list[int]:
    return [x or 0 for x in numbers.agg(*[F.sum(F.col("numbers")[i]) for i in range(5)]).first()]


def fit(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> Model:
    """Count the training rows and store the model in a fresh folder beside the checkpoints."""
    folder = local_path(new_scratch(spark, "language-model"))
    small_batches(spark)
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    total, bits, offsets, words = _fit_words(text, folder)
    model = Model(folder, total, bits, offsets, words, max(1, -(-total // TOKENS_PER_FILE)))
    sent = text.mapInArrow(_count_bigrams(model), "file bigint, keys binary, counts binary")
    sums = written(sent.groupBy("file").applyInArrow(
        _store_bigrams(model), "slice bigint, kind string, ids binary, sums binary, numbers array<bigint>"), "sums")
    bigrams, *of_bigrams = _summed(sums.filter("kind = 'n'"))
    slices = written(sums.filter("kind <> 'n'").groupBy("slice").applyInArrow(
        _store_slices(model), "numbers array<bigint>"), "slices")
    *of_words, three = _summed(slices)
    low = discounts(of_words)
    return Model(folder, total, bits, offsets, words, model.bigram_files, bigrams, discounts(of_bigrams), low,
                 low[0] * of_words[0] + low[1] * of_words[1] + low[2] * three)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score and score (log10 probabilities of the whole text) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = arrays(model)
        for batch in batches:
            at = 0
            for documents in portions(batch, SCORED_AT_ONCE):
                seen, base, value = lookup.score(documents)
                sizes = [len(d) for d in documents]
                first = np.cumsum([0, *sizes[:-1]])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(at, len(documents)), pa.array(sizes, pa.int64()),
                    pa.array(np.add.reduceat((seen > 0).astype(np.int64), first)),
                    pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(value, first))],
                    ["id", "n_tokens", "n_known", "base_score", "score"])
                at += len(documents)
        release_memory()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def fit_and_score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """Scores of all rows by a model of the rows for which `held` is false."""
    model = fit(docs.sparkSession, docs.filter(~held), text_col)
    return score(docs, model, id_col, text_col), model
