"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's full windows stand alone; what is left of it is cut into pieces of at
most `grain` tokens. The pieces are collected in groups of bounded size, in the order
in which a task reads them. In a group every piece starts as a partial partition
with one filled window; the two partitions with the largest spread are merged again and
again, the fullest window of one with the emptiest of the other, until one partition
with near-equal windows is left. If its fullest window exceeds the capacity, the
number of windows rises and the group is packed again.

No rows are shuffled and no group spans tasks, so work and memory per task are
bounded at any input size; a task computed again reads the same rows and gives
the same sequences, whose ids carry the task's number.

Defined cases: a null text is empty, and an empty document still has its end
token; rows that repeat an id are packed separately; a text longer than a window
is cut; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import parts_of_bytes, release_memory, small_batches, texts

CAPACITY = 2048
GRAIN = 512
GROUP = 512  # pieces that are packed together
SENT = 512  # pieces that a task sends on at once
CACHED = 1_500_000  # words remembered by a worker
WORD_LIMIT = 64  # longer words are not remembered
END = 1  # id after every document


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Positions of the pieces in each window, by multiway differencing.

    A partial partition is the sums of its windows in order, and a node per window. A
    node is a piece, or stands for two nodes that were put into one window.
    """
    n = len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[-1], nodes[-1] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    joined, made = [], n
    for turn in range(n, 2 * n - 1):
        _, _, sums_a, nodes_a = heapq.heappop(heap)
        _, _, sums_b, nodes_b = heapq.heappop(heap)
        sums = sums_a + sums_b[::-1]
        order = sums.argsort(kind="stable")
        sums, first, second = sums[order], nodes_a[order], nodes_b[::-1][order]
        nodes = np.maximum(first, second)
        both = np.flatnonzero((first >= 0) & (second >= 0))
        nodes[both] = made + np.arange(len(both))
        joined.append((made, first[both], second[both]))
        made += len(both)
        heapq.heappush(heap, (int(sums[0] - sums[-1]), turn, sums, nodes))
    window = np.zeros(made, np.int64)
    last = heap[0][3]
    window[last[last >= 0]] = np.flatnonzero(last >= 0)
    for start, first, second in reversed(joined):
        window[first] = window[second] = window[start:start + len(first)]
    found: list[list[int]] = [[] for _ in range(windows)]
    for i, k in enumerate(window[:n].tolist()):
        found[k].append(i)
    return found


def pack_group(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most `capacity`; their number rises until the fullest window fits."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, windows)
        if max(sum(sizes[i] for i in part) for part in found) <= capacity:
            return [part for part in found if part]
        windows += max(1, windows // 100)


class WordIds:
    """Ids of a text by a vocabulary that never joins words across ASCII white space.

    Each word is encoded by the library once and remembered; a text is the chain of
    its words' ids as little-endian 32-bit numbers.
    """

    # a run of Latin letters, then a run of marks: one or two units of the vocabulary's own split
    PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+([.,;:!?#$%&*|]*)")
    UNIT_END = "</w>"

    def __init__(self, path: str, cached: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.UNIT_END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.cached = cached

    def _encode(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words: plain ones in one call, cut where their last unit ends; others one by one."""
        found, plain, units = {}, [], []
        for word in words:
            match = self.PLAIN.fullmatch(word)
            if match:
                plain.append(word)
                units.append(2 if match[1] else 1)
            else:
                found[word] = self._encode(word).tobytes()
        if plain:
            ids = self._encode(b" ".join(plain))
            cuts = np.flatnonzero(self.ends[ids])[np.cumsum(units) - 1] + 1
            data = ids.tobytes()
            cuts = (4 * cuts).tolist()
            found.update((w, data[a:b]) for w, a, b in zip(plain, [0, *cuts], cuts))
        return found

    def encode(self, batch: Iterable[bytes]) -> Iterator[bytes]:
        for part in parts_of_bytes(batch):
            # letters in lower case share an entry; a special string must keep its own case
            split = [(text if b"<|" in text else text.lower()).split() for text in part]
            known = self.known
            extra = self.learn(set(chain.from_iterable(split)).difference(known))
            short = {w: ids for w, ids in extra.items() if len(w) <= WORD_LIMIT}
            if len(known) + len(short) > self.cached:
                rest = {w: known[w] for words in split for w in words if w in known}
                known.clear()
                known.update(rest)
            known.update(short)
            long = {w: ids for w, ids in extra.items() if len(w) > WORD_LIMIT}
            for words in split:
                if long:
                    yield b"".join([known[w] if w in known else long[w] for w in words])
                else:
                    yield b"".join(itemgetter(*words)(known)) if len(words) > 1 else b"".join([known[w] for w in words])


@cache
def word_ids(path: str, cached: int) -> WordIds:
    return WordIds(path, cached)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, grain: int = GRAIN, group: int = GROUP, with_ids: bool = True,
                   cached: int = CACHED) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves
    (`ids`, little-endian 32-bit) on request. `cached` words are remembered by a worker."""
    kind = docs.schema[id_col].dataType
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    types = [None, *[pa.int64()] * 6, *([pa.binary()] if with_ids else [])]
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path, cached)
        sequence = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []

        def rows_of(done: list[tuple], id_type) -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t or id_type) for c, t in zip(columns, types)], names)

        def packed(pieces: list[tuple]) -> Iterator[tuple]:
            nonlocal sequence
            for window in pack_group([p[2] for p in pieces], capacity):
                offset = 0
                for piece in (pieces[i] for i in window):
                    yield (*piece[:5], sequence, offset, *piece[5:])
                    offset += piece[2]
                sequence += 1

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            done: list[tuple] = []
            for doc_id, data in zip(batch.column("id").to_pylist(), encoder.encode(texts(batch, "text"))):
                data += end
                total = len(data) // 4
                full = total // capacity * capacity
                for start in (*range(0, full, capacity), *range(full, total, grain)):
                    stop = start + capacity if start < full else min(start + grain, total)
                    own = data[4 * start:4 * stop]
                    piece = (doc_id, start, stop - start, zlib.crc32(own), total, *((own,) if with_ids else ()))
                    if start < full:
                        done += packed([piece])
                    else:
                        waiting.append(piece)
                while len(waiting) >= group:
                    part, waiting = waiting[:group], waiting[group:]
                    done += packed(part)
                if len(done) >= SENT:
                    yield rows_of(done, id_type)
                    done = []
            if done:
                yield rows_of(done, id_type)
        if waiting:
            yield rows_of(list(packed(waiting)), id_type)
        release_memory()

    ids = ", ids binary" if with_ids else ""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
             f"sequence_id bigint, offset bigint{ids}")
