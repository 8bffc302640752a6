"""Near duplicates by SimHash fingerprints, found through anchors of a covering code.

A fingerprint has 64 bits. Two stretches of 23 bits are covered by the binary
Golay code, which is perfect: every 23-bit word lies within 3 bits of exactly one
of 4,096 code words. The anchors are all pairs of code words (2^24 of them). A
fingerprint's home is its nearest anchor. If two fingerprints differ in at most t
bits, with e1 of them in the first stretch and e2 in the second (e1 + e2 <= t), then
the second fingerprint lies within 3 + e1 and 3 + e2 bits of the home of the first.
So each fingerprint is replicated to all anchors within these bounds (about 61 for
t = 2) and compared there with the fingerprints at home. No pair is lost.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import map_batches, texts, without, written
from narrascope.llm.graph import components

BITS = 64
SEED = 42
SHINGLE = 3
THRESHOLD = 2
HALF = 23  # bits of a stretch
RADIUS = 3  # covering radius of the Golay code
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
STEP = 1 << 16  # shingles whose bits are counted at once


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle; one for a shorter text, none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:1 - width].tolist(), ends[width - 1:].tolist())],
                    np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for no hashes. Signed 64-bit."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), STEP):
        part = hashes[start:start + STEP].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; null texts count as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def step(batch):
            values = [fingerprint(shingle_hashes(t)) for t in texts(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.int64())], ["id", "fp"])
        return step

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
                       make, f"id {kind}, fp bigint")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator."""
    rest = words.copy()
    for bit in range(HALF - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << bit - 11), rest)
    return rest


@cache
def patterns(extra: int) -> tuple[np.ndarray, ...]:
    """Per syndrome, the error patterns of weight <= 3, then of weight 4, ... 3 + extra; -1 fills up."""
    units = 1 << np.arange(HALF)
    levels = []
    for level in range(extra + 1):
        weights = range(RADIUS + 1) if level == 0 else (RADIUS + level,)
        errors = np.array([int(sum(units[list(c)])) for w in weights for c in combinations(range(HALF), w)], np.int64)
        of = syndrome(errors)
        order = np.argsort(of, kind="stable")
        errors, of = errors[order], of[order]
        counts = np.bincount(of, minlength=1 << 11)
        table = np.full((1 << 11, counts.max()), -1, np.int64)
        table[of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)] = errors
        levels.append(table)
    return tuple(levels)


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint, and (row, anchor) of every anchor it is replicated to."""
    sides = []
    for shift in (0, HALF):
        part = fps >> shift & (1 << HALF) - 1
        of = syndrome(part)
        # the 12 high bits tell a code word of this cyclic code from all others
        sides.append([np.where(t[of] < 0, -1, (part[:, None] ^ t[of]) >> 11) for t in patterns(threshold)])
    rows, found = [], []
    for i, first in enumerate(sides[0]):
        for second in sides[1][:threshold - i + 1]:
            pair = np.where((first[:, :, None] < 0) | (second[:, None, :] < 0), -1,
                            first[:, :, None] << 12 | second[:, None, :])
            row, *_ = at = np.nonzero(pair >= 0)
            rows.append(row)
            found.append(pair[at])
    return sides[0][0][:, 0] << 12 | sides[1][0][:, 0], np.concatenate(rows), np.concatenate(found)


def anchor_rows(fps: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(anchor, fp) at home, and (anchor, fp) of all replicas, of a table of distinct fingerprints."""
    def rows_of(home: bool):
        def make():
            def step(batch):
                values = batch.column("fp").to_numpy()
                at, row, anchor = [], [], []
                for start in range(0, len(values), 512):
                    own, r, a = anchors(values[start:start + 512], threshold)
                    at.append(own)
                    row.append(r + start)
                    anchor.append(a)
                if home:
                    return pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(at).astype(np.int32)), pa.array(values)], ["anchor", "fp"])
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(anchor).astype(np.int32)), pa.array(values[np.concatenate(row)])],
                    ["anchor", "fp"])
            return step
        return map_batches(fps.select("fp"), make, "anchor int, fp bigint")

    return rows_of(True), rows_of(False)


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in at most `threshold` bits.

    The planner takes the replicas for as many rows as the fingerprints, about 1/61 of what they are, so it would
    broadcast them for some hundred thousand fingerprints: the hint keeps both sides in shuffles.
    """
    home, replicas = anchor_rows(fps, threshold)
    near = F.bit_count(F.col("h.fp").bitwiseXOR(F.col("r.fp"))) <= threshold
    return home.alias("h").join(
        replicas.alias("r").hint("merge"),
        (F.col("h.anchor") == F.col("r.anchor")) & (F.col("h.fp") < F.col("r.fp")) & near,
    ).select(F.col("h.fp").alias("a"), F.col("r.fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: int = THRESHOLD) -> DataFrame:
    """(id, fp, component): component is the smallest id whose text is reachable over links.

    Rows with equal fingerprints form one node, so copies cost no pairs. Null ids
    keep their row; a component without any id has a null component.
    """
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = components(links(nodes, threshold))
    of = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = of.groupBy("root").agg(F.min("low").alias("component"))
    named = of.join(lowest, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     threshold: int = THRESHOLD) -> DataFrame:
    """One row of every component stays, with all its columns: the smallest id (null ids come last),
    then the smallest text hash."""
    text = F.col(text_col).cast("string")
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("digest")).alias("key"), text.alias("text"))
    found = near_duplicates(keyed, "key", "text", threshold)
    decided = written(found.groupBy(F.col("id").alias("key"), F.col("component")).agg(F.count(F.lit(1)).alias("n")), "decisions")
    flat = decided.select("key.id", "key.digest", "n", (F.col("key") == F.col("component")).alias("stays"))
    return without(docs, {"id": F.col(id_col), "digest": digest}, flat.filter(~F.col("stays")),
                   flat.filter(F.col("stays") & (F.col("n") > 1)))
