"""Exact token counts of every prefix of a text, by dynamic programming.

For byte-level BPE the encoding of a prefix is the encoding of a shorter prefix plus
one token: the only vocabulary entry that ends there and whose border to the
shorter prefix's last token no merge would cross. So the count at a position is
the count where that token starts, plus one. The recurrence runs inside the
vocabulary's pre-tokens, once per different chunk (white space and the word after
it), and the counts along a text are the running sum of its chunks' steps. Steps
are stored per character, so truncation and budget questions are answered from
the stored table (`count_at`, `longest_prefix`) without encoding again.

Defined cases: null counts as empty (no tokens, empty table); the special string
of the vocabulary counts as one token, as the library has it by default, and a
prefix that ends inside it counts its characters as ordinary text; a prefix
never ends inside a character; texts of any length are read whole; rows that
repeat an id keep their rows; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import cache
from operator import itemgetter, sub
from sys import byteorder

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import map_batches

# Fixed value: how the byte-level vocabulary splits text before its merges.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CHUNK = regex.compile(r"\s*\S+|\s+")
WORD = regex.compile(r"\s*\S+")
SPACES = regex.compile(r"\s*")
PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%&*|]*)")  # chunks of one or two pre-tokens
SHORT = 64  # longer chunks are not cached
CACHED = 1_500_000  # pieces of text remembered by a worker
STEM, STEMS = 3, 150_000  # bytes between remembered stems, and stems remembered by a worker
BORDERS = 400_000  # borders remembered by a worker
STEP = np.dtype("<i2")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens numbered by the order of their merges: bytes first, then merge 0, 1, ..."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = byte_letters()
        number = {bytes([b]): b for b in range(256)}
        self.left, self.right, self.pairs = list(range(256)), list(range(256)), {}
        for merge in stored["model"]["merges"]:
            first, second = (bytes(map(letters.__getitem__, part)) for part in
                             (merge if isinstance(merge, list) else merge.split(" ")))
            place = len(self.left)
            self.left.append(number[first])
            self.right.append(number[second])
            self.pairs.setdefault((number[first], number[second]), place)
            number.setdefault(first + second, place)
        self.number = number
        # the longest token that ends in given three bytes
        self.reach: dict[bytes, int] = {}
        for token in number:
            if len(token) > 2:
                self.reach[token[-3:]] = max(len(token), self.reach.get(token[-3:], 0))
        self.special = [t["content"] for t in stored["added_tokens"]]
        self.special_split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._holds: dict[tuple[int, int], bool] = {}
        self._stems: dict[bytes, tuple[list[int], list[int]]] = {}
        self._pieces: dict[str, bytes] = {}

    def border_holds(self, a: int, b: int) -> bool:
        """Whether two adjacent tokens stay apart: the merges of both are undone, latest first,
        and no merge across the border may come before one that was undone."""
        known = self._holds.get((a, b))
        if known is None:
            if len(self._holds) >= BORDERS:
                self._holds.clear()
            known = self._holds[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        before = len(self.left)
        while True:
            if self.pairs.get((a, b), before) < before:
                return False
            if a > b:
                if a < 256:
                    return True
                before, a = a, self.right[a]
            else:
                if b < 256:
                    return True
                before, b = b + 1, self.left[b]  # of equal merges the left one comes first

    def _grow(self, word: bytes, last: list[int], count: list[int]) -> None:
        """Carry the recurrence on from the prefix that `last` and `count` cover to the whole word."""
        number, known, reach = self.number, self._holds, self.reach
        for end in range(len(last), len(word) + 1):
            longest = reach.get(word[end - 3:end], 2) if end > 2 else end
            for start in range(end - longest if end > longest else 0, end):
                part = word[start:end]
                if part in number:
                    token = number[part]
                    if start:
                        border = (last[start], token)
                        holds = known[border] if border in known else self.border_holds(*border)
                        if not holds:
                            continue
                    last.append(token)
                    count.append(count[start] + 1)
                    break

    def _stem(self, stem: bytes) -> tuple[list[int], list[int]]:
        """The recurrence over a stem, whose length is a multiple of STEM; words share stems."""
        state = self._stems.get(stem)
        if state is None:
            last, count = map(list, self._stem(stem[:-STEM])) if len(stem) > STEM else ([-1], [0])
            self._grow(stem, last, count)
            if len(self._stems) >= STEMS:
                self._stems.clear()
            state = self._stems[stem] = last, count
        return state

    def counts(self, word: bytes) -> list[int]:
        """Token count of word[:1], word[:2], ... for one pre-token."""
        stem = word[:(len(word) - 1) // STEM * STEM] if len(word) <= SHORT else b""
        last, count = map(list, self._stem(stem)) if stem else ([-1], [0])
        self._grow(word, last, count)
        return count[1:]

    def _piece(self, piece: str) -> list[int]:
        """Counts at the ends of the characters of one pre-token."""
        data = piece.encode()
        if len(piece) == 3 and piece[0] == "'" and piece[1:].isalpha():
            # two letters after the mark only join it once both are there
            return [self.counts(data[:1])[-1], self.counts(data[:1])[-1] + self.counts(data[1:2])[-1], self.counts(data)[-1]]
        counts = self.counts(data)
        return counts if len(data) == len(piece) else [
            c for c, following in zip(counts, [*data[1:], 0]) if following & 0xC0 != 0x80]

    def _chunk_counts(self, chunk: str) -> list[int]:
        spaces = SPACES.match(chunk).end()
        # white space that ends a prefix is one pre-token, whatever follows it in the text
        found = self._piece(chunk[:spaces]) if spaces else []
        at = before = 0
        for piece in SPLIT.findall(chunk):
            counts = self._piece(piece)
            found += [before + c for c in counts[max(0, spaces - at):]]
            at += len(piece)
            before += counts[-1]
        return found[:len(chunk)]

    def _chunk_steps(self, chunk: str) -> bytes:
        plain = PLAIN.fullmatch(chunk)
        if plain:
            counts = self._piece(plain[1])
            if plain[2]:
                counts += [counts[-1] + c for c in self.counts(plain[2].encode())]
        else:
            counts = self._chunk_counts(chunk)
        steps = array("h", map(sub, counts, (0, *counts[:-1])))
        if byteorder == "big":
            steps.byteswap()
        return steps.tobytes()

    def _plain_steps(self, text: str) -> bytes:
        """Steps of a text without special strings: its chunks' steps one after the other.

        In a text whose words are parted by one space or line break each, the chunks are what lies
        between the spaces (a line break stays with the word after it). Other texts are cut by
        the pattern.
        """
        head, *rest = text.replace("\n", " \n").split(" ")
        known = self._pieces
        found = {}
        if not CHUNK.fullmatch(head):
            rest = None
        else:
            for piece in set(rest).difference(known):
                chunk = piece if piece[:1] == "\n" else " " + piece
                if not WORD.fullmatch(chunk):
                    rest = None
                    break
                found[piece] = self._chunk_steps(chunk)
        if rest is None:
            return b"".join(map(self._chunk_steps, CHUNK.findall(text)))
        short = {p: s for p, s in found.items() if len(p) <= SHORT}
        if len(known) + len(short) > CACHED:
            kept = {p: known[p] for p in rest if p in known}
            known.clear()
            known.update(kept)
        known.update(short)
        if len(short) < len(found):
            parts = [known[p] if p in known else found[p] for p in rest]
        else:
            parts = itemgetter(*rest)(known) if len(rest) > 1 else [known[p] for p in rest]
        return self._chunk_steps(head) + b"".join(parts)

    def steps(self, text: str) -> np.ndarray:
        """Per character: how much the token count of the prefix changes with it."""
        if not self.special or "<|" not in text:
            return np.frombuffer(self._plain_steps(text), STEP)
        parts, at = [], 0
        for match in self.special_split.finditer(text):
            section = text[at:match.start()]
            # up to its last character the special string is ordinary text after the section
            open_part = np.frombuffer(self._plain_steps(section + match.group()[:-1]), STEP)
            whole = int(np.frombuffer(self._plain_steps(section), STEP).sum(dtype=np.int64)) + 1
            parts += [open_part, np.array([whole - int(open_part.sum(dtype=np.int64))], STEP)]
            at = match.end()
        return np.concatenate([*parts, np.frombuffer(self._plain_steps(text[at:]), STEP)])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pack(steps: np.ndarray) -> bytes:
    """The stored table: steps in 8 bits where they fit, else 16, compressed."""
    small = steps.astype(np.int8)
    fits = bool((small == steps).all())
    return (b"\1" if fits else b"\2") + zlib.compress((small if fits else steps).tobytes(), 1)


def unpack(table: bytes) -> np.ndarray:
    """Token count of every prefix, the empty one first."""
    steps = np.frombuffer(zlib.decompress(table[1:]), np.int8 if table[:1] == b"\1" else STEP)
    return np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))


def count_at(table: bytes, characters: int) -> int:
    """Tokens of the prefix of so many characters."""
    return int(unpack(table)[characters])


def longest_prefix(table: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens."""
    return int(np.flatnonzero(unpack(table) <= budget)[-1])


def prefix_counts(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text",
                  table: bool = True) -> DataFrame:
    """id, n_bytes, n_tokens, keep_chars (longest prefix within the budget) and the stored table of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        words = vocabulary(path)

        def step(batch):
            rows = []
            for text in batch.column("text").to_pylist():
                steps = words.steps(text or "")
                total = int(steps.sum(dtype=np.int64))
                keep = len(steps)
                if total > budget or keep > budget:  # a text of fewer characters may still pass the budget on its way
                    keep = int(np.flatnonzero(np.concatenate(([0], np.cumsum(steps, dtype=np.int64))) <= budget)[-1])
                rows.append((len((text or "").encode()), total, keep, pack(steps) if table else None))
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())],
                ["id", "n_bytes", "n_tokens", "keep_chars", "prefix_table"])
        return step

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), make,
                       f"id {kind}, n_bytes bigint, n_tokens bigint, keep_chars bigint, prefix_table binary")
