"""The operators on small hand-made tables, against brute force; edge cases of every operator."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from narrascope.llm import (
    common, exact_dedup, language_model, line_dedup, mixing, packing, prefix_tokens, quality, sharding, simhash, toxicity)
from narrascope.llm.common import key_filter, marked_in, maybe_in
from narrascope.llm.graph import components
from narrascope.llm.queries import BYTE_BPE, WORD_BPE, tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row string, id string"
LONG = "word other " * 30_000
ROWS = [
    (1, "The cat sat on the mat today", "en", "a", 1, "x", "r", "i"), (2, "the CAT sat on the mat today", "en", "a", 1, None, "r", "i"),
    (3, None, "en", None, None, "x", "r", "i"), (4, "", None, "b", 0, "x", None, "i"), (None, "no id here at all", "en", "b", 1, "x", "r", None),
    (5, "É une\nligne\n\nligne", "fr", "b", 1, "x", "r", "i"), (6, "É une\nligné\n\nLigne x", "fr", "c", 1, "x", "r", "i"),
    (7, "same row", "en", "c", 1, "x", "r", "i"), (7, "same row", "en", "c", 1, "x", "r", "i"), (8, "same row", "en", "c", 1, "x", "r", "i"),
    (9, LONG, "en", "c", 1, "x", "r", "i"), (10, "<|endoftext|> a  b\t\n", "en", "c", 1, "x", "r", "i"), (11, " \n ", "en", "c", 1, "x", "r", "i")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (9, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_exact_copies(docs, none):
    got = exact_dedup.mark_copies(docs).collect()
    assert len(got) == len(ROWS)
    groups = collections.defaultdict(list)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for row in ROWS:
        groups[(row[1] or "").translate(fold)].append(row[0])
    rank = lambda i: -1 if i is None else i
    expected = sorted((rank(i), rank(max(ids, key=rank)), len(ids)) for ids in groups.values() for i in ids)
    assert sorted((rank(r.id), rank(r.keep_id), r.group_size) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.mark_copies(none).count() == exact_dedup.drop_copies(none).count() == 0


def test_collisions_do_not_merge(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    weak = lambda text: F.substring(F.md5(text), 1, 0)  # noqa: E731  every text collides
    got = {r.id: (r.keep, r.size) for r in exact_dedup.exact_groups(table, key=weak).collect()}
    same = {r.id: (r.keep, r.size) for r in exact_dedup.exact_groups(table).collect()}
    assert got == same and len(got) == 60


def plain_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert sorted(r.fp & 2 ** 64 - 1 for r in got) == sorted(plain_print(r[1]) for r in ROWS)
    for row in got:
        near = [r.id for r in got if r.fp == row.fp and r.id is not None]
        assert row.component is None or row.component <= min(near, default=row.component)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component for r in got})
    assert simhash.near_duplicates(none).count() == simhash.drop_near_copies(none).count() == 0


def test_anchors_lose_no_link(spark):
    dice = random.Random(3)
    values = {dice.getrandbits(64) for _ in range(300)}
    for value in list(values):
        for flips in (1, 2, 3):
            values.add(value ^ sum({1 << dice.randrange(64) for _ in range(flips)}))
    values = [v - 2 ** 64 if v >= 2 ** 63 else v for v in values]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint")).collect()}
    wanted = {(a, b) for a in values for b in values if a < b and ((a ^ b) & 2 ** 64 - 1).bit_count() <= 2}
    assert got == wanted and len(wanted) > 500


def test_replicas_are_never_broadcast(spark):
    """Of few fingerprints by the planner's estimate, which leaves out that each is replicated about 61 times."""
    stored = common.written(spark.range(2_000).select(F.xxhash64("id").alias("fp")), "prints")
    found = simhash.links(stored)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) > 16 * 2_000
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    dice = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [
        (dice.randrange(200, 300), dice.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_quality_counts_and_verdicts(docs, none, labels):
    for field in (quality.Field.keep_all(), quality.train(*quality.sample(docs, labels))):
        got = quality.judge(docs, field).collect()
        assert len(got) == len(ROWS) and not any(r.kept for r in got if r.n_words < 50)
        nine = next(r for r in got if r.id == 9)
        assert nine.n_words == 60_000 and nine.n_repeat_words == 60_000 and nine.base_failed
    five = next(r for r in got if r.id == 5)
    assert (five.n_words, five.word_chars, five.n_dup_lines) == (4, 14, 1)
    assert quality.judge(none, field).count() == 0


def test_viterbi_is_the_best_path():
    dice = np.random.default_rng(1)
    field = quality.Field(np.zeros((13, 2)), dice.normal(size=(2, 2)), dice.normal(size=2))
    for n in range(1, 8):
        scores = dice.normal(size=(n, 2))
        value = lambda p: field.start[p[0]] + sum(scores[i, s] for i, s in enumerate(p)) + sum(
            field.moves[a, b] for a, b in zip(p, p[1:]))
        paths = [[k >> i & 1 for i in range(n)] for k in range(2 ** n)]
        assert value(field.decode(scores)) == pytest.approx(max(map(value, paths)))


def test_prefix_counts(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(BYTE_BPE))
    count = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    got = prefix_tokens.prefix_counts(docs, tokenizer(BYTE_BPE), 5).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len((r[1] or "").encode()), count(r[1] or "")) for r in ROWS)
    words, dice = prefix_tokens.vocabulary(tokenizer(BYTE_BPE)), random.Random(2)
    letters = [*"ab cde'sltr  \n\t1!.-é中 \x1c ", "'ll", "'re", "<|endoftext|>", "the", "ing"]
    for _ in range(60):
        text = "".join(dice.choice(letters) for _ in range(dice.randrange(25)))
        table = prefix_tokens.pack(words.steps(text))
        counts = [count(text[:i]) for i in range(len(text) + 1)]
        assert prefix_tokens.unpack(table).tolist() == counts
        assert prefix_tokens.longest_prefix(table, 3) == max(i for i, c in enumerate(counts) if c <= 3)
    assert prefix_tokens.prefix_counts(none, tokenizer(BYTE_BPE), 5).count() == 0


def test_shards(spark, docs, none, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 64)
    table = spark.createDataFrame([(i % 300 if i % 3 else None, f"t{i % 50}" if i % 3 else "hot") for i in range(1000)], "doc_id bigint, text string")
    got = sharding.shuffled(table, F.lit(1)).collect()
    assert sorted(str(tuple(r.record)) for r in got) == sorted(map(str, map(tuple, table.collect())))
    slots = collections.defaultdict(list)
    for row in got:
        slots[row.shard].append(row.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(str, got)) == sorted(map(str, sharding.shuffled(table, F.lit(1)).collect()))
    clashing = docs.withColumns({"shard": F.lit("x"), "slot": F.lit(1), "record": F.lit(2), "bucket": F.lit(3), "bytes": F.lit(4)})
    stored = sharding.write_shards(clashing, sharding.record_bytes("text"), f"file://{tmp_path}/shards")
    assert stored.count() == len(ROWS) and stored.select("record.shard").distinct().count() == 1
    assert sorted(map(str, stored.select("record.*").collect())) == sorted(map(str, clashing.collect()))
    assert sharding.shuffled(none, F.lit(1)).count() == 0


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer(WORD_BPE))
    got = packing.pack_documents(docs, tokenizer(WORD_BPE)).collect()
    windows, texts = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        windows[r.sequence_id].append((r.offset, r.length))
        texts[r.id].append((r.start, r.ids))
    for pieces in windows.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY
    for doc_id, text, *_ in ROWS:
        if doc_id != 7:
            ids = np.frombuffer(b"".join(p for _, p in sorted(texts[doc_id])), "<u4").tolist()
            assert ids == library.encode(text or "", add_special_tokens=False).ids + [1]
    assert packing.pack_documents(none, tokenizer(WORD_BPE)).count() == 0


def test_differencing_fills_windows():
    dice = random.Random(4)
    for n in (1, 2, 50, 300):
        sizes = [dice.randrange(1, 513) for _ in range(n)]
        windows = packing.pack_group(sizes)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert max(sum(sizes[i] for i in w) for w in windows) <= packing.CAPACITY
        assert len(windows) <= math.ceil(sum(sizes) / packing.CAPACITY) * 1.05 + 1


def test_toxicity_learns_subwords(spark, docs, none, labels):
    dice = random.Random(6)
    words = ["".join(dice.choice("abeinorst") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(300):
        text = [dice.choice(words) for _ in range(dice.randrange(20, 200))]
        if i % 3 == 0:
            text.insert(dice.randrange(len(text)), dice.choice(["zugblorf", "zugblorfen", "zugblorfisch"]))
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(table, table, F.col("id") % 5 != 0)
    got = {r.id: r.score for r in toxicity.scores(table, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 5 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.9
    scorer = toxicity.Scorer(model.bucket_scores(), model.log_odds())
    assert scorer.score(b"zugblorfenn " + words[0].encode()) > 0.5 > scorer.score(" ".join(words[:40]).encode())
    for known in (labels, labels.limit(0)):
        small = toxicity.fit(docs, known, F.lit(True))
        scored = toxicity.scores(docs, small).collect()
        assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.not_toxic(docs, small).columns == docs.columns
    assert toxicity.scores(none, small).count() == toxicity.not_toxic(none, small).count() == 0


def test_line_dedup(spark, docs, none):
    dice = random.Random(8)
    lines = ["".join(dice.choice("abé ") for _ in range(dice.randrange(1, 9))) for _ in range(150)]
    lines += [line[:k] + c + line[k + 1:] for line in lines[:40] for k, c in ((dice.randrange(len(line)), dice.choice(["", "x"])),)]
    dice.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 5:i * 5 + 5])) for i in range(len(lines) // 5)]
    first = {}
    for i, text in rows:
        for no, line in enumerate(text.split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" "), (i, no))

    def within(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return a == b
        k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k + 1:] == b[k:] or a[k:] == b[k + 1:]
    kept = {at for line, at in first.items() if not any(w < at and within(line, other) for other, w in first.items())}
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: r for r in line_dedup.line_counts(table).collect()}
    assert {i: got[i].n_kept for i in got} == {i: sum(at[0] == i for at in kept) for i, _ in rows}
    texts = {r.doc_id: r.text for r in line_dedup.deduplicated(table).collect()}
    for i, text in rows:
        stay = [line for no, line in enumerate(text.split("\n")) if not line.strip(" ") or (i, no) in kept]
        assert texts[i] == "\n".join(stay)
    counts = line_dedup.line_counts(docs).collect()
    assert len(counts) == len(ROWS) and all(r.n_lines == 0 for r in counts if r.id in (3, 4, 11))
    cut = line_dedup.deduplicated(docs)
    assert cut.columns == docs.columns and cut.filter("doc_id = 3 and text is null").count() == 1
    assert line_dedup.line_counts(none).count() == line_dedup.deduplicated(none).count() == 0
    named = docs.withColumns({name: F.lit(1) for name in ("n_lines", "n_kept", "n_exact", "n_near", "row", "counts", "kept", "hit", "tie")})
    assert line_dedup.deduplicated(named).columns == named.columns
    assert sorted(map(str, line_dedup.deduplicated(named).select("doc_id", "text").collect())) == sorted(map(str, cut.select("doc_id", "text").collect()))
    counted = line_dedup.deduplicated(named, counted=True).select("row.doc_id", "counts.*")
    assert sorted(map(str, map(tuple, counted.collect()))) == sorted(map(str, map(tuple, counts)))


def test_key_filters_lose_no_key(spark, monkeypatch):
    rows = spark.range(5000).select(F.xxhash64("id").alias("k"), "id")
    keys = rows.filter("id % 7 = 0").select("k")
    wanted = {r.id for r in rows.filter("id % 7 = 0").collect()}
    found = key_filter(keys, "k")
    passed = {r.id for r in maybe_in(rows, "k", found).collect()}
    assert passed >= wanted and len(passed) < 1500
    assert {r.id for r in marked_in(rows, "k", found, "m").filter("m").collect()} == passed
    assert marked_in(rows, "k", found, "m").count() == 5000
    monkeypatch.setattr(common, "LARGEST_KEYS", 10)  # the shuffled way beyond the bound
    many = key_filter(keys, "k")
    assert many.bits is None and {r.id for r in maybe_in(rows, "k", many).collect()} == wanted


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.copies <= 2 for r in got)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0
    rows = [(i, "w " * (i % 40), None if i % 9 == 0 else f"s{i % 4}") for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    by = collections.defaultdict(lambda: [0, 0.0])
    for row in mixing.mix(table).collect():
        source = rows[row.id][2]
        by[source][0] += row.copies * row.size
        by[source][1] = row.target
    assert all(abs(taken - target) <= 80 for taken, target in by.values())
    total = sum(i % 40 for i in range(900))
    assert sum(t for _, t in by.values()) == pytest.approx(1.5 * total)
    assert sorted(mixing.mix(table).collect()) == sorted(mixing.mix(table).collect())


def test_language_model(spark, docs, none):
    rows = docs.filter("doc_id is null or doc_id <> 9").collect()
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == 0
    table = docs.filter("doc_id is null or doc_id <> 9")
    scored, model = language_model.fit_and_score(table, held)
    uni, bi = collections.Counter(), collections.Counter()
    for row in rows:
        if (row.doc_id or 0) % 5:
            tokens = language_model.tokens((row.text or "").encode())
            uni.update(tokens)
            bi.update(zip([None, *tokens], tokens))
    assert (model.tokens, model.words, model.bigrams) == (sum(uni.values()), len(uni), len(bi))
    for row in scored.collect():
        assert row.score < 0 and row.n_known <= row.n_tokens and math.isfinite(row.base_score)
    lookup = language_model.arrays(model)
    total = sum(10 ** lookup.score([[w, v]])[2][1] for w in [b"the"] for v in [*uni, b"never seen"])
    assert total == pytest.approx(1)
    assert language_model.score(docs, model).count() == len(ROWS)
    empty, nothing = language_model.fit_and_score(none, F.lit(False))
    assert empty.count() == 0 and nothing.tokens == 0


def test_without_moves_only_rows_that_may_be_decided(spark, monkeypatch):
    seen, write = {}, common.written

    def kept(df, label):
        seen[label] = write(df, label)
        return seen[label]

    monkeypatch.setattr(common, "written", kept)
    rows = [(i if i % 7 else None, f"text {i % 900}") for i in range(2000)] + [(5, "text 5"), (5, "text 5"), (None, "lost")]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    losers = spark.createDataFrame([(11, "text 11"), (None, "lost"), (11, "text 12")], "id bigint, text string")
    repeated = spark.createDataFrame([(5, "text 5")], "id bigint, text string")
    got = common.without(docs, {"a": F.col("id"), "b": F.col("text")}, *[t.toDF("a", "b") for t in (losers, repeated)])
    expected = [r for r in rows if r not in ((11, "text 11"), (None, "lost"), (5, "text 5"))] + [(5, "text 5")]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(expected, key=order)
    assert seen["maybe"].count() < 50  # five rows and the few whose bit is set by chance


def test_words_of_few_texts_are_held_at_a_time(spark):
    """Long texts are cut into words a few at a time, and an Arrow batch of them is closed by its bytes."""
    encoder, taken = packing.word_ids(tokenizer(WORD_BPE), 1000), []
    long = b"some words of a long text " * 20_000

    def values():
        for i in range(8):
            taken.append(i)
            yield long

    first = next(encoder.encode(values()))
    assert len(taken) == -(-common.SPLIT_AT_ONCE // len(long))
    assert first == next(encoder.encode([long]))
    few = [b"x"] * 600 + [long] * 5 + [b""]
    parts = list(common.parts_of_bytes(few, size=2 * len(long)))
    assert [v for part in parts for v in part] == few and [len(p) for p in parts] == [256, 256, 90, 2, 2]
    table = spark.range(40, numPartitions=1).select(F.lit(long.decode()).alias("text"))
    seen = common.map_batches(table, lambda: lambda batch: batch.slice(0, 1), "text string").count()
    assert seen >= 40 * len(long) // (common.BYTES_AT_ONCE + 2 * len(long))
