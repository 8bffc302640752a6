"""Quality rules by labelling lines as content or boilerplate.

A text's lines (those with a word) are labelled by a linear-chain conditional random
field with two states. Viterbi decoding finds the best sequence; the share of words that
lie in content lines decides whether the text is kept, unless the base rules reject it first.

The field is trained here, in numpy, by gradient ascent on the likelihood of line
labels. Line labels come from the quality labels of texts: the lines of a good text are
content; a bad text's lines start as boilerplate, and in a second round those that the
first field decodes as content count as content. Training reads a bounded
sample (`per_class` texts of each class, chosen by a hash of the id); every row is decoded
over its whole text.

Defined cases: a null text has no words and fails the base rules; without labelled
texts of both classes a text is kept unless the base rules reject it; a text labelled
twice is good only if every label says so; rows that repeat an id are judged each; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import small_batches, texts, written

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_SHARE = 50  # percent of words in repeated windows beyond which a text fails
WINDOW = 3
CONTENT_SHARE = 0.5
PER_CLASS = 1000  # labelled texts of each class that training reads
TEXT_BYTES = 1 << 15  # longest text that training reads, so the sample holds at most 2 * PER_CLASS * TEXT_BYTES
STEPS = 100
PENALTY = 1e-3
PORTION = 1 << 20  # bytes of texts whose lines are measured at once
FEATURES = ("one", "words", "symbols", "capitals", "digits", "exclamations", "bars", "repeated", "stop", "word_length",
            "few_words", "starts_small", "other_marks")


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SPACE, SYMBOL = _class(b" \t\n\v\f\r"), _class(SYMBOLS)
CAPITAL, SMALL, DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789")
CONTINUED = _class(bytes(range(128, 192)))
MARK = _class(bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in SYMBOLS + b".,!"))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    place: dict[bytes, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
    keys = ids[:n]
    for k in range(1, window):
        if len(place) > 1 << 20:  # keep the combined key in 64 bits
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * len(place) + ids[k:n + k]
        if k < window - 1 and len(place) > 1 << 20:
            keys = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k:n + k] |= twice
    return int(covered.sum())


def measure(portion: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, first line, lines);
    per line with a word its features, and its words."""
    data = np.frombuffer(b"\n".join(portion) + b"\n", np.uint8)
    stops = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], stops[:-1] + 1))
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype=np.int64)

    words = per_line(begins)
    solid = per_line(~space)
    points = per_line(~space & ~CONTINUED[data])
    symbols = per_line(SYMBOL[data])
    capitals, small, digits = per_line(CAPITAL[data]), per_line(SMALL[data]), per_line(DIGIT[data])
    loud, bars, marks = per_line(data == 33), per_line(data == 124), per_line(MARK[data])
    last = np.zeros(len(starts), np.uint8)
    some = solid > 0
    where = np.flatnonzero(~space)
    if len(where):
        last[some] = data[where[np.cumsum(solid)[some] - 1]]
        first_byte = np.zeros(len(starts), np.uint8)
        first_byte[some] = data[where[(np.cumsum(solid) - solid)[some]]]
    else:
        first_byte = last
    repeated = np.zeros(len(starts), bool)
    rows, at = [], 0
    for text in portion:
        lines = text.split(b"\n")
        seen: set[bytes] = set()
        here = words[at:at + len(lines)]
        for k in np.flatnonzero(here).tolist():
            if lines[k] in seen:
                repeated[at + k] = True
            else:
                seen.add(lines[k])
        cut = slice(at, at + len(lines))
        rows.append((int(here.sum()), int(points[cut].sum()), int(symbols[cut].sum()), int(repeated[cut].sum()),
                     repeated_words(text.split()), at, len(lines)))
        at += len(lines)
    size, count = np.maximum(solid, 1), np.maximum(words, 1)
    features = np.stack([
        np.ones(len(starts)), np.minimum(words, 40) / 40, np.minimum(symbols / count, 1), capitals / np.maximum(capitals + small, 1),
        digits / size, np.minimum(loud / count, 1), np.minimum(bars / count, 1), repeated, np.isin(last, list(b".?!")),
        np.minimum(solid / count, 20) / 20, words < 4, SMALL[first_byte], marks / size], 1)
    return np.array(rows, np.int64).reshape(-1, 7), features, words


@dataclass(frozen=True)
class Field:
    """Weights of the features per state, transitions, and start scores; state 1 is content."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    @staticmethod
    def keep_all() -> Field:
        weights = np.zeros((len(FEATURES), 2))
        weights[0, 1] = 1.0
        return Field(weights, np.zeros((2, 2)), np.zeros(2))

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi: the best state of every line, given its scores per state."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        back, first = [], True
        for s0, s1 in scores.tolist():
            if first:
                a, b, first = self.start[0] + s0, self.start[1] + s1, False
                continue
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
        if first:
            return []
        state = int(b >= a)
        path = [state]
        for step in reversed(back):
            state = int(step[state])
            path.append(state)
        return path[::-1]


def train_field(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = STEPS) -> Field:
    """Gradient ascent (Adam) on the mean log-likelihood of the labels per line, over padded sequences."""
    longest = max(map(len, sequences))
    mask = np.zeros((len(sequences), longest), bool)
    x = np.zeros((len(sequences), longest, len(FEATURES)))
    y = np.zeros((len(sequences), longest), np.int64)
    for i, (sequence, states) in enumerate(zip(sequences, labels)):
        mask[i, :len(sequence)], x[i, :len(sequence)], y[i, :len(sequence)] = True, sequence, states
    lines = mask.sum()
    gold = np.eye(2)[y] * mask[..., None]
    both = (mask[:, 1:] & mask[:, :-1])[..., None, None]
    gold_moves = (gold[:, :-1, :, None] * gold[:, 1:, None, :] * both).sum((0, 1))
    values = [np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros(2)]
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]

    def total(a, axis):
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    for step in range(1, steps + 1):
        weights, moves, start = values
        emit = x @ weights
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            grown = total(alpha[:, t - 1, :, None] + moves, 1) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], grown, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            grown = total(moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], grown, 0)
        norm = total(alpha[:, -1], 1)
        single = np.exp(alpha + beta - norm[:, None, None]) * mask[..., None]
        pair = np.exp(np.where(both, alpha[:, :-1, :, None] + moves + (emit + beta)[:, 1:, None, :] - norm[:, None, None, None], -np.inf))
        gradients = [np.einsum("ntf,nts->fs", x, gold - single) / lines - PENALTY * weights,
                     (gold_moves - pair.sum((0, 1))) / lines - PENALTY * moves,
                     (gold[:, 0] - single[:, 0]).sum(0) / lines - PENALTY * start]
        for k, g in enumerate(gradients):
            means[k] = 0.9 * means[k] + 0.1 * g
            squares[k] = 0.99 * squares[k] + 0.01 * g * g
            values[k] = values[k] + 0.1 * (means[k] / (1 - 0.9 ** step)) / (np.sqrt(squares[k] / (1 - 0.99 ** step)) + 1e-8)
    return Field(*values)


CUT = 64  # lines of a training sequence; longer texts are trained in several sequences


def train(documents: list[bytes], good: np.ndarray) -> Field:
    """A field from whole texts and their 0/1 quality labels, in two rounds."""
    if len(set(good.tolist())) < 2:
        return Field.keep_all()
    sequences, owner = [], []
    for text, label in zip(documents, good):
        rows, features, words = measure([text])
        own = features[words > 0]
        for start in range(0, len(own), CUT):
            sequences.append(own[start:start + CUT])
            owner.append(int(label))
    if len(set(owner)) < 2:
        return Field.keep_all()
    labels = [np.full(len(s), y) for s, y in zip(sequences, owner)]
    first = train_field(sequences, labels)
    again = []
    for sequence, states, y in zip(sequences, labels, owner):
        path = np.array(first.decode(sequence @ first.weights))
        again.append(states if y or path.all() else path)
    return train_field(sequences, again)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "quality", per_class: int = PER_CLASS) -> tuple[list[bytes], np.ndarray]:
    """At most `per_class` labelled texts per class, by a hash of the id."""
    known = written(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
                    .filter(F.col("id").isNotNull() & F.col("y").isNotNull())
                    .groupBy("id").agg(F.min("y").alias("y")), "labels")
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TEXT_BYTES)
            .join(F.broadcast(written(parts[0].union(parts[1]), "sample")), "id")
            .orderBy(F.xxhash64("id", "text")).limit(2 * per_class).collect())
    return [(r["text"] or "").encode() for r in rows], np.array([r["y"] for r in rows], np.int64)


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text",
          share: float = CONTENT_SHARE) -> DataFrame:
    """id, the five counts, base_failed, content_share and kept of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def verdicts(portion: list[bytes]) -> tuple[np.ndarray, list[float]]:
        rows, features, words = measure(portion)
        scores = features @ field.weights
        shares = []
        for first, lines in rows[:, 5:].tolist():
            here = words[first:first + lines]
            used = here > 0
            path = np.array(field.decode(scores[first:first + lines][used]), np.int64)
            shares.append(float((here[used] * path).sum() / max(int(here.sum()), 1)))
        return rows, shares

    def run(batches):
        for batch in batches:
            documents, at = list(texts(batch, "text")), 0
            while at < len(documents):
                portion, size = [], 0
                while at + len(portion) < len(documents) and (not portion or size + len(documents[at + len(portion)]) <= PORTION):
                    size += len(documents[at + len(portion)])
                    portion.append(documents[at + len(portion)])
                rows, shares = verdicts(portion)
                failed = (rows[:, 0] < MIN_WORDS) | (100 * rows[:, 4] > REPEAT_SHARE * rows[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(portion)), *[pa.array(rows[:, k]) for k in range(5)], pa.array(failed),
                     pa.array(shares, pa.float64()), pa.array(~failed & (np.array(shares) >= share))],
                    ["id", *names, "base_failed", "content_share", "kept"])
                at += len(portion)

    counts = ", ".join(f"{n} bigint" for n in names)
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, {counts}, base_failed boolean, content_share double, kept boolean")
