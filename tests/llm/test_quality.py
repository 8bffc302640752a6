"""Line quality: counts of whole texts against plain Python, and the field's optimum against enumeration of all paths."""

import collections
import itertools
import pathlib
import re

import numpy as np
import pytest

from narrascope.llm import quality
from narrascope.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")
def test_counts_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op2_line_quality"](spark, FOLDER).collect()
    assert len(found) == len(texts)
    for row in found:
        text = texts[row.doc_id] or ""
        words = WORD.findall(text)
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        seen, lines = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(again))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected, row.doc_id
        assert row.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (row.base_failed and row.kept) and 0 <= row.content_share <= 1
        assert row.kept == (not row.base_failed and row.content_share >= quality.CONTENT_SHARE)


def objective(field, sequences, labels):
    """Mean log-likelihood per line less the penalty, with the normaliser summed over all paths."""
    total = 0.0
    for x, y in zip(sequences, labels):
        emit = x @ field.weights
        value = lambda p: field.start[p[0]] + sum(emit[i, s] for i, s in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        scores = [value(p) for p in itertools.product((0, 1), repeat=len(x))]
        total += value(tuple(y)) - np.logaddexp.reduce(scores)
    lines = sum(map(len, sequences))
    return total / lines - quality.PENALTY / 2 * sum((v ** 2).sum() for v in (field.weights, field.moves, field.start))


def test_the_field_is_at_its_optimum():
    dice = np.random.default_rng(3)
    width = len(quality.FEATURES)
    sequences = [dice.normal(size=(n, width)) for n in (1, 3, 4, 2, 5, 4)]
    labels = [(s[:, 0] + 0.5 * dice.normal(size=len(s)) > 0).astype(int) for s in sequences]
    field = quality.train_field(sequences, labels, steps=4000)
    best = objective(field, sequences, labels)
    assert best > objective(quality.Field.keep_all(), sequences, labels)
    step = 1e-3
    for name in ("weights", "moves", "start"):
        value = getattr(field, name)
        for at in np.ndindex(value.shape):
            values = [dict(weights=field.weights, moves=field.moves, start=field.start) for _ in (0, 1)]
            for sign, changed in zip((-1, 1), values):
                moved = value.copy()
                moved[at] += sign * step
                changed[name] = moved
            low, high = (objective(quality.Field(**v), sequences, labels) for v in values)
            assert abs(high - low) / (2 * step) < 2e-3, (name, at)  # the gradient vanishes
