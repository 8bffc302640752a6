"""Exact k-means over integer vectors with heap-ordered bounds.

A vector's gap is its distance to the second nearest centroid less that to its own. When
centroids move, the gap of every vector of a cluster shrinks by at most the cluster's own
drift plus the largest drift of another. So each cluster keeps a heap of gaps, each offset by the
drift accumulated when it was measured, and only vectors whose gap is used up are
popped and scanned against all centroids again. Distances are exact integers; gaps carry a
margin for rounding, so the result equals that of a full scan.

Vectors stay in blocks, one row each, as a byte matrix with the block's heaps beside it; a round
reads and writes the blocks and shuffles only sums per centroid and component. Every round is a
written table, so a lost executor costs one round's share; the one before it is removed.

Defined cases: vectors that are null, of another length, or with a null, NaN or infinite component
are left out; components (times the scale) beyond 2**26 count as 2**26, so that distances fit 64 bits;
null ids hash as an empty text; vectors that repeat are judged each and may start as equal centroids, of
which the smaller number wins; fewer vectors than clusters give fewer centroids; sums beyond 64 bits are
null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import written
from narrascope.session import discard, local_table

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
LARGEST = 1 << 26
EXACT = 1 << 22  # below it, products and sums of 64 components are exact in doubles
MARGIN = 1e-9
TYPES = (np.int8, np.int16, np.int32)


@dataclass(frozen=True)
class Centres:
    """Centroids, and per cluster the drift by which gaps have shrunk since the start."""

    points: tuple[tuple[int, ...], ...]
    drift: tuple[float, ...]

    def moved(self, points: list[tuple[int, ...]]) -> Centres:
        steps = [sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5 * (1 + MARGIN) for p, q in zip(self.points, points)]
        rest = [max([0.0, *steps[:k], *steps[k + 1:]]) for k in range(len(steps))]
        return Centres(tuple(points), tuple(d + own + other for d, own, other in zip(self.drift, steps, rest)))

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in self.points]


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(id, point) of the usable vectors, as integers floor(scale * x)."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    inside = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    return rows.filter(vector.isNotNull() & (F.size(vector) == dimensions) & finite).select(
        F.col(id_col).alias("id"), F.transform(vector, lambda x: F.floor(inside(x))).alias("point"))


def starting_centres(vectors: DataFrame, clusters: int, seed: int) -> Centres:
    """The vectors with the smallest hashes of `seed:id`; at most `clusters` rows reach the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.select("point", name.alias("hash")).orderBy("hash", "point").limit(clusters).collect()
    return Centres(tuple(tuple(row["point"]) for row in first), (0.0,) * len(first))


def squared_distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every centre, as 64-bit integers."""
    if max(np.abs(points).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT and centres.shape[1] <= DIMENSIONS:
        p, c = points.astype(np.float64), centres.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    points = points.astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centres.astype(np.int64)], 1)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre (ties: the smaller number) and gap to the second nearest, less the margin."""
    squares = squared_distances(points, centres)
    own = squares.argmin(1)
    if squares.shape[1] == 1:
        return own, np.full(len(own), np.inf)
    two = np.sqrt(np.partition(squares, 1, axis=1)[:, :2].astype(np.float64))
    return own, two[:, 1] - two[:, 0] - MARGIN * (1 + two[:, 0] + two[:, 1])


class Block:
    """Some vectors, their clusters, and a heap of (gap plus drift then, place) per cluster."""

    def __init__(self, points: np.ndarray, clusters: int):
        self.points = points
        self.owner = np.full(len(points), -1, np.int16)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]

    def assign(self, centres: Centres) -> np.ndarray:
        """Rescan the vectors whose gap is used up; per cluster, changes of the component sums and of the count."""
        if (self.owner < 0).any():
            expired = np.arange(len(self.points))
        else:
            popped = []
            for heap, limit in zip(self.heaps, centres.drift):
                while heap and heap[0][0] <= limit:
                    popped.append(heapq.heappop(heap)[1])
            expired = np.array(popped, np.int64)
        changes = np.zeros((len(centres.points), self.points.shape[1] + 1), np.int64)
        if not len(expired):
            return changes
        points = self.points[expired]
        now, gap = nearest(points, np.array(centres.points, np.int64))
        before = self.owner[expired]
        keys = (gap + np.array(centres.drift)[now]).tolist()
        for key, place, cluster in zip(keys, expired.tolist(), now.tolist()):
            heapq.heappush(self.heaps[cluster], (key, place))
        counted = np.concatenate([points.astype(np.int64), np.ones((len(points), 1), np.int64)], 1)
        for at, sign in ((before, -1), (now, 1)):
            moved = (before != now) & (at >= 0)
            np.add.at(changes, at[moved], sign * counted[moved])
        self.owner[expired] = now
        return changes

    def stored(self) -> tuple[bytes, bytes, bytes, bytes, list[int]]:
        entries = [entry for heap in self.heaps for entry in heap]
        return (self.points.tobytes(), self.owner.tobytes(), np.array([k for k, _ in entries], np.float64).tobytes(),
                np.array([i for _, i in entries], np.int32).tobytes(), [len(heap) for heap in self.heaps])

    @classmethod
    def read(cls, points: bytes, owner: bytes, keys: bytes, places: bytes, sizes: list[int], dimensions: int) -> Block:
        owners = np.frombuffer(owner, np.int16).copy()
        kind = next(t for t in TYPES if np.dtype(t).itemsize * len(owners) * dimensions == len(points))
        block = cls(np.frombuffer(points, kind).reshape(len(owners), dimensions), len(sizes))
        block.owner = owners
        entries = list(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(places, np.int32).tolist()))
        ends = np.cumsum(sizes).tolist()
        block.heaps = [entries[end - size:end] for size, end in zip(sizes, ends)]
        return block


def _narrow(points: np.ndarray) -> np.ndarray:
    """The smallest integer type that holds the components."""
    low, high = points.min(initial=0), points.max(initial=0)
    return points.astype(next(t for t in TYPES if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


STATE = "points binary, owner binary, keys binary, places binary, sizes array<int>, changes array<bigint>"


def _row(ids: pa.Array, block: Block, changes: np.ndarray) -> pa.RecordBatch:
    points, owner, keys, places, sizes = block.stored()
    held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays(
        [held, pa.array([points], pa.binary()), pa.array([owner], pa.binary()), pa.array([keys], pa.binary()),
         pa.array([places], pa.binary()), pa.array([sizes], pa.list_(pa.int32())),
         pa.array([changes.ravel().tolist()], pa.list_(pa.int64()))],
        ["ids", "points", "owner", "keys", "places", "sizes", "changes"])


def _blocks_of(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.Array, Block]]:
    """The blocks of a batch of the state table."""
    columns = [batch.column(c).to_pylist() for c in ("points", "owner", "keys", "places", "sizes")]
    for i, parts in enumerate(zip(*columns)):
        yield batch.column("ids").slice(i, 1).flatten(), Block.read(*parts, dimensions)


def _first_round(vectors: DataFrame, centres: Centres, dimensions: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("point").flatten().to_numpy(zero_copy_only=False)
                block = Block(_narrow(flat.reshape(batch.num_rows, dimensions)), len(centres.points))
                yield _row(batch.column("id"), block, block.assign(centres))

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"ids array<{kind}>, {STATE}")


def _next_round(state: DataFrame, centres: Centres, dimensions: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in _blocks_of(batch, dimensions):
                yield _row(ids, block, block.assign(centres))

    return state.mapInArrow(run, state.schema)


def _last_assignment(state: DataFrame, centres: Centres, dimensions: int) -> DataFrame:
    kind = state.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.array(centres.points, np.int64)
        for batch in batches:
            for ids, block in _blocks_of(batch, dimensions):
                block.assign(centres)
                distance = np.zeros(len(ids), np.int64)
                for k in range(len(points)):
                    own = block.owner == k
                    distance[own] = squared_distances(block.points[own], points[k:k + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([ids, pa.array(block.owner.astype(np.int32)), pa.array(distance)],
                                                 ["id", "cluster", "distance"])

    return state.mapInArrow(run, f"id {kind}, cluster int, distance bigint")


@dataclass
class Clustering:
    """(id, cluster, distance) of every kept vector, and the centroids they were measured against."""

    assigned: DataFrame
    centres: Centres


def cluster(rows: DataFrame, id_col: str, vector_col: str, clusters: int = CLUSTERS, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> Clustering:
    """Assign and move centroids `rounds` times, then assign once more."""
    vectors = integer_vectors(rows, id_col, vector_col, dimensions, scale)
    centres = starting_centres(vectors, clusters, seed)
    if not centres.points:
        kind = vectors.schema["id"].dataType.simpleString()
        return Clustering(rows.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance bigint"), centres)
    width = dimensions + 1
    totals = [[0] * width for _ in centres.points]
    state = None
    for _ in range(rounds):
        before = state
        state = written(_first_round(vectors, centres, dimensions) if before is None
                        else _next_round(before, centres, dimensions), "clusters")
        if before is not None:
            discard(before)
        # one row per centroid and component
        summed = state.select(F.posexplode("changes").alias("at", "change")).groupBy("at").agg(F.sum("change").alias("change"))
        for at, change in summed.collect():
            totals[at // width][at % width] += change
        centres = centres.moved([tuple(s // own[-1] for s in own[:-1]) if own[-1] else point
                                 for own, point in zip(totals, centres.points)])
    if state is None:
        state = written(_first_round(vectors, centres, dimensions), "clusters")
    assigned = written(_last_assignment(state, centres, dimensions), "assigned")
    discard(state)
    return Clustering(assigned, replace(centres))


def with_inertia(found: Clustering) -> DataFrame:
    """The assigned vectors with the inertia of their cluster, of all, and the digest of their centroid."""
    spark = found.assigned.sparkSession
    total: Column = F.expr("try_cast(sum(cast(distance as decimal(38,0))) as bigint)")
    of_cluster = dict(map(tuple, found.assigned.groupBy("cluster").agg(total).collect()))  # a row per cluster
    of_all = found.assigned.agg(total).first()[0]
    rows = [(k, of_cluster.get(k), of_all, digest) for k, digest in enumerate(found.centres.digests())]
    names = local_table(spark, rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.assigned.join(F.broadcast(names), "cluster")
