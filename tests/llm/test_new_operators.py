"""Language identification, clustering and conversation repair against brute force, and their defined cases."""

import collections
import hashlib
import heapq
import itertools
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrascope.llm import clustering, conversations, language_id
from narrascope.llm.common import held_out
from narrascope.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")


# --- conversations -----------------------------------------------------------------------------------------------

def visible(text):
    return re.findall(r"[^\x20\x09-\x0D]", text)


def after_damage(rows):
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range(2 if kind == 3 else kind != 0):
            yield conv, turn, role, text


def search(rows):
    """Cheapest edits by Dijkstra over (row, role initials' state), ties by the letters."""
    def step(state, role):
        initial = role[:1]
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        ways = [("I", 2, role, "", at) for role in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                ways += [("K", extra, role, text, at + 1), *[("R", 2 + extra, r, text, at + 1) for r in ("user", "assistant")]]
        for edit, price, role, text, to in ways:
            if step(state, role) is not None:
                heapq.heappush(heap, (cost + price, audit + edit, to, step(state, role), (*out, f"{role}:{text}")))


def expected_repairs(table, damage):
    by = collections.defaultdict(list)
    for row in table:
        by[row[0]]
    for row in after_damage(table) if damage else [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in table]:
        by[row[0]].append(row)
    result = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        seen, marked = set(), []
        for _, _, role, text in rows:
            shown = visible(text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        counts = collections.Counter(fault for *_, fault in marked)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, *_), (b, *_) in itertools.pairwise(marked))
        turns = [t for _, t, *_ in rows if t is not None]
        cost, audit, out = search(marked)
        result[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"],
                        counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return result


SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, place string, kind string"


def made_up(seed, n=120):
    pick = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(pick.choice((0, 1, 2, 5, 9, 14))):
            rows.append((conv, pick.choice((turn, turn + 3, turn)) if pick.random() < 0.95 else None,
                         pick.choice(("user", "assistant", "system", "user", "assistant", "tool", "", None)),
                         pick.choice(("Hello there.", "what", "", " \n", "yes!", None, "long " * 50 + "?", "é?"))))
    # rows of one turn with one role but other texts have no order that the contract fixes
    return list({(c, t, r or " "): (c, t, r, x) for c, t, r, x in rows}.values())


@pytest.mark.parametrize("damage,block", [(True, 256), (True, 3), (False, 2)])
def test_repairs_against_search(spark, damage, block):
    rows = made_up(block)
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    found = conversations.digests(conversations.repair(table, damage=damage, block=block)).collect()
    expected = expected_repairs(rows, damage)
    assert {r[0]: tuple(r[1:]) for r in found} == expected and len(found) == len(expected)


def test_long_conversation_and_empty_table(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"line {i}.") for i in range(5000)] + [(8, 1, "user", "same.")] * 3000
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv: r for r in conversations.digests(conversations.repair(table, block=64)).collect()}
    assert found[7].cost == 0 and found[7].audit == "K" * 5000
    assert found[8].duplicate == 2999 and found[8].cost == 2999 * 3 + 2
    assert found[7].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[:5000]).encode()).hexdigest()
    assert conversations.digests(conversations.repair(table.limit(0))).count() == 0
    kept = conversations.repair(table, block=64).filter("place >= 0 AND conv = 8").collect()
    assert [(r.edit, r.role) for r in kept] == [("K", "user"), ("I", "assistant")]


@tables
def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op13_conversation_repair"](spark, FOLDER).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == expected_repairs(rows, True)


# --- clustering --------------------------------------------------------------------------------------------------

def plain_means(rows, clusters=16, rounds=3):
    kept = [(i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda row: hashlib.sha256(f"1:{'' if row[0] is None else row[0]}".encode()).hexdigest()
    centres = [np.array(v, dtype=object) for _, v in sorted(kept, key=lambda r: (name(r), r[1]))[:clusters]]
    points = np.array([v for _, v in kept], dtype=object).reshape(len(kept), 64)

    def nearest():
        return np.stack([((points - c) ** 2).sum(1) for c in centres], 1)

    for _ in range(rounds):
        own = nearest().argmin(1)
        centres = [np.array([int(s) // int((own == k).sum()) for s in points[own == k].sum(0)], dtype=object) if (own == k).any() else c
                   for k, c in enumerate(centres)]
    squares = nearest()
    own = squares.argmin(1)
    far = squares[np.arange(len(own)), own]
    return [(i, int(k), int(d), int(far[own == k].sum()), int(far.sum()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest())
            for (i, _), k, d in zip(kept, own, far)]


@tables
def test_clustering_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    found = QUERIES["op12_centroid_clustering"](spark, FOLDER).collect()
    assert sorted(map(tuple, found)) == sorted(plain_means(rows))


def test_clustering_cases(spark):
    pick = random.Random(3)
    rows = [(i, [pick.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(64)]) for i in range(300)]
    rows += [(1, rows[0][1])] * 200 + [(None, [0.25] * 64), (301, [1e5] * 64), (302, [-3e4, *[2.0] * 63])]  # repeats, wide components
    bad = [(400, None), (401, [1.0] * 63), (402, [None] * 64), (403, [float("nan")] * 64), (404, [float("inf")] * 64)]
    schema = "vec_id bigint, embedding array<double>, cluster string, distance int, id int, point int"
    table = spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows + bad], schema).repartition(5)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    found = clustering.with_inertia(clustering.cluster(table, "vec_id", "embedding")).select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, found), key=key) == sorted(plain_means(rows), key=key)
    few = clustering.cluster(table.filter("vec_id < 3 AND vec_id <> 1"), "vec_id", "embedding")
    assert len(few.centres.points) == 2 and few.assigned.count() == 2
    assert clustering.with_inertia(clustering.cluster(table.limit(0), "vec_id", "embedding")).count() == 0


def test_bounds_spare_scans():
    """Vectors far from every border are not scanned again, whatever small moves centroids make."""
    pick = np.random.default_rng(5)
    points = np.concatenate([pick.integers(-3, 4, (500, 64)) + 60 * k for k in range(3)]).astype(np.int8)
    centres = clustering.Centres(tuple(tuple(map(int, points[500 * k])) for k in range(3)), (0.0,) * 3)
    block = clustering.Block(points, 3)
    block.assign(centres)
    moved = centres.moved([tuple(x + 1 for x in p) for p in centres.points])
    before = [list(heap) for heap in block.heaps]
    assert not block.assign(moved).any() and [list(heap) for heap in block.heaps] == before
    again = clustering.Block.read(*block.stored(), 64)
    assert (again.owner == block.owner).all() and again.heaps == block.heaps


# --- language identification -------------------------------------------------------------------------------------

def greedy(word, text):
    count = lacking = at = 0
    while at < len(word):
        size = max((n for n in range(1, len(word) - at + 1) if word[at:at + n] in text), default=0)
        count, lacking, at = count + 1, lacking + (size == 0), at + max(1, size)
    return count, lacking


def test_longest_matches():
    pick = random.Random(9)
    for _ in range(50):
        text = "".join(pick.choice("ab né") for _ in range(pick.randrange(0, 60)))
        automaton = language_id.SuffixAutomaton(text)
        for _ in range(20):
            word = "".join(pick.choice("ab néx") for _ in range(pick.randrange(0, 12)))
            assert automaton.phrases(word) == greedy(word, text)


@tables
def test_language_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op11_language_id"](spark, FOLDER).collect()}
    model = language_id.fit(docs, ~held_out(F.col("id"), 5, 0))
    rows = docs.collect()
    assert len(found) == len(rows) and sum(map(len, model.samples)) <= language_id.TOTAL
    known, right = 0, 0
    for n, row in enumerate(rows):
        got = found[row.doc_id]
        assert got.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0) and 0 <= got.score <= 1
        if got.lang_pred == language_id.NONE:
            assert not any(c.isalpha() for c in row.text or "")
            continue
        if got.held_out and row.lang is not None:
            known, right = known + 1, right + (got.lang_pred == row.lang)
        if n % 100 == 0 and len(row.text) < 3000:
            costs = []
            for text in model.samples:
                parts = [greedy(f" {w} ", text) for w in language_id.words_of(row.text)]
                costs.append(sum(c for c, _ in parts) * math.log2(len(text) + 1) + language_id.LITERAL * sum(x for _, x in parts))
            assert got.lang_pred == model.names[int(np.argmin(costs))]
    assert right >= 0.97 * known


def test_language_cases(spark):
    schema = "doc_id bigint, text string, lang string, source string, id string, place string, passage string"
    rows = [(i, ("the cat and the dog", "der hund und die katze")[i % 2], ("en", "de")[i % 2], "s", "x", "y", "z") for i in range(1, 40)]
    rows += [(50, None, "en", None, None, None, None), (51, "", "en", None, None, None, None), (52, "1 2 !", None, None, None, None, None),
             (None, "die katze", "de", None, None, None, None), (53, "the dog " * 40_000, None, None, None, None, None),
             (54, "x" * 100_000, None, None, None, None, None), *[(60, "the cat", "en", None, None, None, None)] * 30]
    table = spark.createDataFrame(rows, schema)
    usable = ~held_out(F.col("id"), 5, 0)
    model = language_id.fit(table, usable)
    assert model.names == ("de", "en")
    found = collections.defaultdict(set)
    for row in language_id.predict(table, model).collect():
        found[row.id].add(row.lang_pred)
    assert found[50] == found[51] == found[52] == {"und"} and found[None] == {"de"} and found[53] == {"en"} and found[60] == {"en"}
    assert len(found[54]) == 1 and language_id.predict(table, model).count() == len(rows)
    nothing = language_id.fit(table.limit(0), usable)
    assert {tuple(r) for r in language_id.predict(table, nothing).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert language_id.predict(table.limit(0), model).count() == 0
    bound = language_id.fit(table, usable, per_language=1, passage=16)
    assert all(len(text) <= 18 for text in bound.samples)
