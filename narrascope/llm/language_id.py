"""Language identification by cross-parsing against suffix automata.

A language is known by a bounded sample of labelled text. Its suffix automaton tells how long the
longest match of a text's next characters in that sample is; a text is parsed greedily into such
matches. Phrases end at words' ends: a word is parsed with a blank on either side, so that beginnings and
endings count, and a worker parses a word once. The cost of a phrase is the logarithm of the length
of the language's sample, and a character that the sample lacks costs eight bits more, which makes
samples of different lengths comparable. The language with the least cost per character wins.

Training reads at most `per_language` passages of at most `passage` characters a language, chosen by a hash of
the id and starting at a place that follows from it; all languages together hold at most TOTAL characters. Prediction
reads every row and whole texts.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text where no language was
learned; equal costs go to the smaller language name; the score is the winner's lead, as a share of the second cost
(1 with one language); null languages, null and letterless texts teach nothing; rows that repeat an id count as one
sampled text but are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrascope.llm.common import release_memory, small_batches, texts, written

PER_LANGUAGE = 48
PASSAGE = 2048
TOTAL = 4 << 20  # characters of all samples together
LITERAL = 8.0  # bits of a character that a sample lacks, besides its phrase
CACHED = 250_000  # words remembered by a worker
CACHED_BYTES = 4 << 20  # and letters of all of them
WORD_LIMIT = 64  # longer words are not remembered
NONE = "und"


class SuffixAutomaton:
    """All substrings of a text; a state is a dictionary of the states that follow by character."""

    def __init__(self, text: str):
        following: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for char in text:
            new = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and char not in following[at]:
                following[at][char] = new
                at = link[at]
            if at >= 0:
                old = following[at][char]
                if length[old] == length[at] + 1:
                    link[new] = old
                else:
                    clone = len(following)
                    following.append(following[old].copy())
                    length.append(length[at] + 1)
                    link.append(link[old])
                    while at >= 0 and following[at].get(char) == old:
                        following[at][char] = clone
                        at = link[at]
                    link[old] = link[new] = clone
            last = new
        states: list[dict[str, dict]] = [{} for _ in following]
        for state, own in zip(states, following):
            state.update((char, states[to]) for char, to in own.items())
        self.start = states[0]

    def phrases(self, text: str) -> tuple[int, int]:
        """Number of greedy longest matches that make up the text, and how many of them are lacking characters."""
        at = start = self.start
        count = lacking = 0
        for char in text:
            if char in at:
                at = at[char]
                continue
            if at is not start:
                count += 1
            if char in start:
                at = start[char]
            else:  # a phrase of its own
                count += 1
                lacking += 1
                at = start
        return count + (at is not start), lacking


def words_of(text: str) -> Iterator[str]:
    """Words with a letter, in lower case, cut to their first and last letter."""
    for word in text.lower().split():
        if word.isalpha():
            yield word
            continue
        a, b = 0, len(word)
        while a < b and not word[a].isalpha():
            a += 1
        while a < b and not word[b - 1].isalpha():
            b -= 1
        if a < b:
            yield word[a:b]


@dataclass(frozen=True)
class Model:
    """The sample of every language, words joined by blanks, in order of the names."""

    names: tuple[str, ...]
    samples: tuple[str, ...]


def sample(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           per_language: int = PER_LANGUAGE, passage: int = PASSAGE) -> DataFrame:
    """(lang, passage) of the labelled rows to learn from; `usable` is a condition on the id column, named `id`."""
    labelled = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"),
                           F.col(text_col).cast("string").alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & usable)
    sizes = written(labelled.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")), "languages")
    languages = max(1, sizes.count())
    length = max(16, min(passage, TOTAL // languages))
    most = max(1, min(per_language, TOTAL // (length * languages)))
    # four times as many as needed, so that chance leaves enough; the join's small side has a row per language
    share = (F.lit(4.0 * most) / F.greatest("n", F.lit(1))).alias("share")
    place = F.xxhash64(F.lit("language"), "id")
    unit = F.pmod(place, F.lit(1 << 20)) / F.lit(float(1 << 20))
    start = F.pmod(F.xxhash64("id"), F.greatest(F.char_length("text") - length, F.lit(0)) + 1).cast("int") + 1
    chosen = labelled.join(F.broadcast(sizes.select("lang", share)), "lang").filter(unit < F.col("share")).select(
        "lang", place.alias("place"), F.substring("text", start, F.lit(length)).alias("passage"))
    met = chosen.groupBy("lang", "place").agg(F.min("passage").alias("passage"))
    return met.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("place"))).filter(
        F.col("rank") <= most).select("lang", "passage")


def fit(docs: DataFrame, usable: Column, **how) -> Model:
    """Learn from a bounded sample; at most TOTAL characters reach the driver."""
    found: dict[str, list[str]] = {}
    for lang, passage in sorted(map(tuple, sample(docs, usable, **how).collect())):
        found.setdefault(lang, []).extend(words_of(passage))
    taught = {lang: f" {' '.join(words)} " for lang, words in found.items() if words}
    return Model(tuple(sorted(taught)), tuple(taught[lang] for lang in sorted(taught)))


class Parser:
    """Costs of texts in every language; a word's costs are computed once and remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.ways = [(SuffixAutomaton(text).phrases, math.log2(len(text) + 1)) for text in model.samples]
        self.place: dict[str, int] = {}
        self.room = max(1024, min(CACHED, 16 * CACHED_BYTES // (8 * max(1, len(model.names)))))
        self.costs = np.zeros((self.room, len(model.names)))
        self.letters = 0

    def word(self, word: str) -> list[float]:
        text, costs = f" {word} ", []
        for phrases, bits in self.ways:
            count, lacking = phrases(text)
            costs.append(count * bits + lacking * LITERAL)
        return costs

    def text(self, text: str) -> np.ndarray | None:
        """Cost of a text in every language; none if it has no letter."""
        words = list(words_of(text))
        if not words:
            return None
        total = np.zeros(len(self.model.names))
        # in portions, so that a portion's new words always fit
        for start in range(0, len(words), self.room // 4):
            part = words[start:start + self.room // 4]
            new = set(part).difference(self.place)
            if len(self.place) + len(new) > self.room or self.letters > CACHED_BYTES:
                self.place.clear()
                self.letters, new = 0, set(part)
            long = {word: self.word(word) for word in new if len(word) > WORD_LIMIT}
            for word in new:
                if word not in long:
                    self.costs[len(self.place)] = self.word(word)
                    self.place[word] = len(self.place)
                    self.letters += len(word)
            if long:
                for word in part:
                    if word in long:
                        total += long[word]
                part = [word for word in part if word not in long]
            total += self.costs[np.fromiter(map(self.place.__getitem__, part), np.int64, len(part))].sum(0)
        return total

    def best(self, text: str | None) -> tuple[str, float]:
        cost = self.text(text) if text and self.model.names else None
        if cost is None:
            return NONE, 0.0
        order = np.argsort(cost, kind="stable")
        if len(order) == 1:
            return self.model.names[0], 1.0
        first, second = cost[order[0]], cost[order[1]]
        return self.model.names[order[0]], float(min(1.0, max(0.0, (second - first) / second)))


# the parser of the model that a worker has met last
_PARSER: list[tuple[Model, Parser]] = []


def parser(model: Model) -> Parser:
    if not _PARSER or _PARSER[0][0] != model:
        _PARSER[:] = [(model, Parser(model))]
    return _PARSER[0][1]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most TOTAL characters
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(sent.value)
        for batch in batches:
            found = [own.best(text.decode("utf-8", "replace")) for text in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["id", "lang_pred", "score"])
        release_memory()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double")
