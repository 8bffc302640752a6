"""Operators against plain Python, with settings that force their skew paths."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from narrascope.operators import duplicates, evaluation, evidence, identity, ordering, quality, skew, splits, tables
from narrascope.operators import reporting as R


@pytest.fixture(scope="module")
def hot_rows(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", rng.randrange(100)) for i in rng.sample(range(5000), 3000)]
    return rows, spark.createDataFrame(rows, "pos long, key string, val int").repartition(7)


@pytest.mark.parametrize("few", [10_000, 0])
def test_grouped_row_number_across_blocks(hot_rows, monkeypatch, few):
    monkeypatch.setattr(ordering, "FEW_BLOCKS", few)
    rows, df = hot_rows
    expected, seen = {}, Counter()
    for pos, key, _ in sorted(rows):
        seen[key] += 1
        expected[pos] = seen[key]
    got = ordering.grouped_row_number(df, ["key"], "pos", "n", width=100).collect()
    assert {r["pos"]: r["n"] for r in got} == expected


def test_grouped_row_number_without_keys(hot_rows):
    rows, df = hot_rows
    got = ordering.grouped_row_number(df, [], "pos", "n", width=64).collect()
    assert {r["pos"]: r["n"] for r in got} == {r[0]: i + 1 for i, r in enumerate(sorted(rows))}


def test_grouped_row_number_with_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (150, None)], "pos long, key string")
    got = {r["pos"]: r["n"] for r in ordering.grouped_row_number(df, ["key"], "pos", "n", width=100).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 150: 3}


def test_grouped_previous_across_blocks(hot_rows):
    rows, df = hot_rows
    last, expected = {}, {}
    for pos, key, val in sorted(rows):
        expected[pos] = last.get(key)
        last[key] = val
    got = ordering.grouped_previous(df, ["key"], "pos", "val", "before").collect()
    assert {r["pos"]: r["before"] for r in got} == expected


def test_previous_keeps_null_values(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "a", "z"), (120, "a", "w")], "pos long, key string, v string")
    got = {r["pos"]: r["b"] for r in ordering.grouped_previous(df, ["key"], "pos", "v", "b").collect()}
    assert got == {1: None, 2: "x", 3: None, 120: "z"}


def test_previous_of_a_hot_key_with_far_apart_numbers(spark):
    rows = [(i * 10**12, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "pos long, key string, v long").repartition(5)
    last, expected = {}, {}
    for pos, key, v in rows:
        expected[pos] = last.get(key)
        last[key] = v
    found = ordering.grouped_previous(df, ["key"], "pos", "v", "b")
    assert {r["pos"]: r["b"] for r in found.collect()} == expected
    assert "hashpartitioning(key" not in found._jdf.queryExecution().executedPlan().toString()  # no key is gathered


def test_dense_blocks_are_not_ranked(spark):
    df = spark.range(5000).select((F.col("id") + 7).alias("pos"), F.lit("x").alias("wide"))
    found = ordering.grouped_row_number(df, [], "pos", "n", width=1000)
    assert found.filter("n <> pos - 6").count() == 0 and found.count() == 5000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]  # the rows themselves are neither shuffled nor sorted


def test_running_totals_over_ranges(spark):
    values = random.Random(2).sample(range(10_000), 800)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v int, w long").repartition(5)
    total, expected = 0, {}
    for v in sorted(values, reverse=True):
        total += v % 7
        expected[v] = total
    got = ordering.running_totals(df, [F.desc("v")], {"t": "w"}).collect()
    assert {r["v"]: r["t"] for r in got} == expected


def test_left_lookup_splits_hot_keys(hot_rows, spark, monkeypatch):
    rows, df = hot_rows
    monkeypatch.setattr(skew, "HOT_FLOOR", 10)
    monkeypatch.setattr(skew, "HOT_KEYS", 10)
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", None)], "key string, value int")
    assert [r["key"] for r in skew.hot_keys(df, ["key"]).collect()] == ["hot"]
    got = skew.left_lookup(df, lookup, ["key"], F.col("pos")).collect()
    known = {"hot": 1, "k1": 2}
    assert {(r["pos"], r["value"]) for r in got} == {(p, known.get(k)) for p, k, _ in rows}
    assert len(got) == len(rows)


def test_left_lookup_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(90)], "pos long, key string")
    lookup = spark.createDataFrame([("a", 5), (None, 9)], "key string, value int")
    got = skew.left_lookup(df, lookup, ["key"], F.col("pos")).collect()
    assert {(r["pos"], r["value"]) for r in got} == {(i, None if i % 3 else 5) for i in range(90)} and len(got) == 90


def test_lookup_join_beyond_the_broadcast_limit(hot_rows, spark):
    rows, df = hot_rows
    lookup = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "key string, value int")
    small = {(r["pos"], r["value"]) for r in skew.lookup_join(df, lookup, ["key"], F.col("pos")).collect()}
    large = {(r["pos"], r["value"]) for r in skew.lookup_join(df, lookup, ["key"], F.col("pos"), limit=5).collect()}
    assert small == large and len(small) == len(rows)


def test_dedupe_and_sequential_ids(spark):
    df = spark.createDataFrame([(0, "s", "5"), (1, "s", "5"), (2, "t", "5"), (3, "s", "6"), (4, "s", "5")], "pos long, ds string, id string")
    got = {r["pos"]: r["out"] for r in identity.dedupe_ids(df, "ds", "id", "pos", "out").collect()}
    assert got == {0: "5", 1: "5_dup1", 2: "5", 3: "6", 4: "5_dup2"}
    blocks = spark.createDataFrame([(1, 7), (0, 9), (1, 2), (0, 1)], "block int, pos long")
    ids = {(r["block"], r["pos"]): r["id"] for r in identity.sequential_ids(blocks, "block", "pos", "id").collect()}
    assert ids == {(0, 1): "OIL-00001", (0, 9): "OIL-00002", (1, 2): "OIL-00003", (1, 7): "OIL-00004"}


@pytest.mark.parametrize("rows_to_look_up", [1_000_000, 0])
@pytest.mark.parametrize("floor", [100_000, 30])
def test_dedupe_moves_rows_once(spark, monkeypatch, rows_to_look_up, floor):
    monkeypatch.setattr(identity, "BROADCAST_ROWS", rows_to_look_up)
    monkeypatch.setattr(identity, "HOT_FLOOR", floor)
    rng = random.Random(3)
    ids = [rng.choice([None, "hot", f"k{rng.randrange(60)}", f"u{i}"]) for i in range(400)]
    rows = [(i, rng.choice("st"), ids[i], "wide") for i in rng.sample(range(400), 400)]
    df = spark.createDataFrame(rows, "pos long, ds string, id string, text string").repartition(5)
    expected, seen = {}, Counter()
    for pos, ds, name, _ in sorted(rows):
        expected[pos] = name and name + (f"_dup{seen[ds, name]}" if seen[ds, name] else "")
        seen[ds, name] += 1
    found = identity.dedupe_ids(df, "ds", "id", "pos", "out")
    got = found.collect()
    assert {r["pos"]: r["out"] for r in got} == expected and len(got) == 400
    if not rows_to_look_up and floor > 400:
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("Window ") == 1


@pytest.fixture(scope="module")
def narratives(spark):
    rows = [(f"r{i}", "s" if i % 2 else "t", f"Text no {i}", i % 3 == 0) for i in range(60)]
    rows += [(f"d{i}", "s", "Same,  TEXT!" if i % 2 else "same text", i % 2 == 0) for i in range(25)]
    rows += [("e1", "t", "same text", False), ("e2", "t", None, False), ("e3", "t", "", False)]
    return spark.createDataFrame(rows, "record_id string, source_dataset string, narrative_text string, is_synthetic boolean")


def test_duplicate_groups(narratives):
    got = {r["record_id"]: r["is_duplicate_group_id"] for r in duplicates.duplicate_groups(narratives).collect()}
    assert {got[f"d{i}"] for i in range(25)} == {1}  # "s||same text" sorts before "t||"
    assert got["e2"] == got["e3"] == 2 and got["e1"] == 0 and got["r1"] == 0


def test_duplicate_groups_with_hot_group(narratives, monkeypatch):
    plain = {tuple(r) for r in duplicates.duplicate_groups(narratives).collect()}
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(skew, "HOT_FLOOR", 3)
    monkeypatch.setattr(skew, "HOT_KEYS", 5)
    assert {tuple(r) for r in duplicates.duplicate_groups(narratives).collect()} == plain


def test_assert_unique(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "record_id string")
    with pytest.raises(ValueError, match="a"):
        duplicates.assert_unique(df, "record_id")


@pytest.mark.parametrize("share", [0.15, 0.6])
def test_group_split_invariants(narratives, share, monkeypatch):
    monkeypatch.setattr(skew, "HOT_FLOOR", 3)
    monkeypatch.setattr(skew, "HOT_KEYS", 6)
    flagged = duplicates.flag_quality(narratives)
    rows = splits.group_split(flagged, share=share).collect()
    assert len(rows) == 88
    units = defaultdict(set)
    for r in rows:
        units[r["unit"]].add(r["split"])
    assert all(len(s) == 1 for s in units.values())
    test = [r for r in rows if r["split"] == "test"]
    assert all(not r["is_synthetic"] and r["is_duplicate_group_id"] == 0 for r in test)
    pool = [r for r in rows if not r["is_synthetic"] and r["is_duplicate_group_id"] == 0]
    target = round(88 * share)
    assert len(test) == min(target, len(pool))
    # a duplicate group larger than the target may overshoot it, but never stops below it with units left
    validation = [r for r in rows if r["split"] == "validation"]
    assert len(validation) >= min(target, 88 - len(test))


@pytest.mark.parametrize("share", [0.0, 0.15, 0.9])
def test_group_split_agrees_with_units_and_moves_no_rows(spark, share):
    # every fifth record id occurs twice, once as a synthetic row; some ids are null
    rows = [(None if i % 31 == 7 else f"r{i}", 0 if i % 4 else i // 40 + 1, i % 6 == 0, f"text {i}") for i in range(300)]
    rows += [(f"r{i}", 0, True, f"again {i}") for i in range(0, 300, 5) if i % 4]
    df = spark.createDataFrame(rows, "record_id string, is_duplicate_group_id int, is_synthetic boolean, narrative_text string")
    got = splits.group_split(df, share=share)
    assert got.columns == [*df.columns, "unit", "split"]
    per_unit = {r["unit"]: r["split"] for r in splits.split_units(df, share=share).collect()}
    done = got.collect()
    assert Counter(r["narrative_text"] for r in done) == Counter(r[3] for r in rows)
    assert all(per_unit[r["unit"]] == r["split"] for r in done)
    if share == 0:
        assert set(per_unit.values()) == {"train"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in line and "narrative_text" in line for line in plan.splitlines())


def test_split_checks_find_leaks(spark):
    rows = [("a", "train", False, 0), ("a", "test", True, 0), ("b", "test", False, 4)]
    df = spark.createDataFrame(rows, "unit string, split string, is_synthetic boolean, is_duplicate_group_id int")
    got = {r["check_name"]: r["violations"] for r in splits.split_checks(df, F.lit(4)).collect()}
    assert got == {"missing_rows": -1, "shared_units": 1, "synthetic_in_test": 1, "duplicates_in_test": 1}
    assert splits.split_overlap(df).first().asDict() == {"train_validation": 0, "train_test": 1, "validation_test": 0}


def test_stratified_split_shares(spark):
    df = spark.createDataFrame([(i, "A" if i < 700 else "B" if i < 990 else None) for i in range(1000)], "id int, label string")
    got = Counter((r["label"], r["split"]) for r in splits.stratified_split(df, "label", "id").collect())
    assert got[("A", "test")] == 140 and got[("B", "test")] == 58 and got[(None, "test")] == 2


VOCABULARY = {"unsafe_act": [("bypass", ["bypassed", "override"]), ("rush", ["hurry"])],
              "barrier": [("guard", ["machine guard", "Guard"]), ("permit", ["permit"])]}


def test_extract_evidence(spark):
    rows = [("1", "s", "They BYPASSED the Guard", "UNKNOWN", ""), ("2", "s", "override in a hurry", "UNKNOWN", "UNKNOWN"),
            ("3", "s", "bypassed again", "known", "UNKNOWN"), ("4", "s", "unknown", "UNKNOWN", "UNKNOWN"),
            ("5", "s", "İ override, then bypassed", "UNKNOWN", "UNKNOWN")]
    df = spark.createDataFrame(rows, "record_id string, source_dataset string, narrative_text string, unsafe_act string, barrier string")
    fields = ("unsafe_act", "barrier")
    got = {r["record_id"]: r for r in evidence.extract_evidence(df, VOCABULARY, fields=fields).collect()}
    one = got["1"]
    assert (one["unsafe_act"], one["unsafe_act_evidence_span"], one["unsafe_act_evidence_start"], one["unsafe_act_evidence_end"]) == ("bypass", "BYPASSED", 5, 13)
    assert one["barrier"] == "guard" and one["barrier_evidence_span"] == "Guard"
    assert got["2"]["unsafe_act_status"] == "ambiguous" and got["2"]["unsafe_act"] == "UNKNOWN"
    assert got["3"]["unsafe_act"] == "known" and got["3"]["unsafe_act_status"] == "skipped"
    assert got["4"]["unsafe_act_status"] == "unknown"
    # first phrase in vocabulary order, offset in the original text although lower() lengthens it
    five = got["5"]
    assert (five["unsafe_act_evidence_span"], five["unsafe_act_evidence_start"]) == ("bypassed", 17)
    log = evidence.ambiguous_matches(df, VOCABULARY, fields=fields).collect()
    assert [(r["record_id"], r["matched_categories"], r["matched_spans"]) for r in log] == [("2", "bypass|rush", "'override'|'hurry'")]


def test_evidence_agrees_with_vocabulary_matches(spark):
    rng = random.Random(3)
    words = ["bypassed", "Override", "hurry", "machine", "guard", "PERMIT", "x", "the"]
    rows = [(str(i), "s", " ".join(rng.choices(words, k=4)), "UNKNOWN", "UNKNOWN") for i in range(200)]
    df = spark.createDataFrame(rows, "record_id string, source_dataset string, narrative_text string, unsafe_act string, barrier string")
    categories = defaultdict(set)
    for r in evidence.vocabulary_matches(df, VOCABULARY).collect():
        categories[(r["record_id"], r["field"])].add(r["category"])
    for r in evidence.extract_evidence(df, VOCABULARY, fields=("unsafe_act", "barrier")).collect():
        for field in ("unsafe_act", "barrier"):
            found = categories[(r["record_id"], field)]
            expected = "unknown" if not found else "matched" if len(found) == 1 else "ambiguous"
            assert r[f"{field}_status"] == expected


def test_phrases_that_share_words(spark):
    words = ["guard", "permit", "ladder", "valve", "spill"]
    vocabulary = {field: [(f"{a}-{i}", [f"{a} {b}", f"{b} of {a}"]) for i, (a, b) in enumerate(pairs)]
                  for field, pairs in (("unsafe_act", [(a, b) for a in words for b in words if a != b]), ("barrier", [("no", "Guard")]))}
    guards = evidence._guards(vocabulary)
    assert all(guard in phrase for phrase, guard in guards.items()) and len(set(guards.values())) < len(guards) / 4
    texts = ["Unguarded ladder", "guard laddered", "a permit of VALVE", "no guard of ladders", "guard", "spill valve of spill", ""]
    df = spark.createDataFrame([(str(i), t, "", "") for i, t in enumerate(texts)],
                               "record_id string, narrative_text string, unsafe_act string, barrier string")
    expected = {(str(i), p) for i, t in enumerate(texts) for cs in vocabulary.values() for _, ps in cs for p in ps if p.lower() in t.lower()}
    assert {(r["record_id"], r["phrase"]) for r in evidence.vocabulary_matches(df, vocabulary).collect()} == expected
    hits = evidence.extract_evidence(df, vocabulary, fields=("unsafe_act", "barrier"), keep_hits=True)
    found = {(r["record_id"], h["category"]) for r in hits.collect() for f in ("unsafe_act", "barrier") for h in r[f"_{f}_hits"]}
    assert found == {(i, c) for i, p in expected for cs in vocabulary.values() for c, ps in cs if p in ps}


def test_load_vocabulary_orders_and_turns_to_a_table(spark):
    rows = [("f", 1, "b", 0, "two"), ("f", 0, "a", 1, "one-b"), ("f", 0, "a", 0, "one-a")]
    table = spark.createDataFrame(rows, "field string, category_order int, category string, phrase_order int, phrase string")
    assert evidence.load_vocabulary(table) == {"f": [("a", ["one-a", "one-b"]), ("b", ["two"])]}
    assert evidence.load_vocabulary(table, limit=2) is table


def made_up_texts(pick, n):
    letters = ["a", "b", "é", "I", "ſ", "İ", "ı", "K", "1"]
    word = lambda: "".join(pick.choice(letters) for _ in range(pick.randrange(0, 5)))
    return [" ".join(word() for _ in range(pick.randrange(0, 25))) for _ in range(n)] + ["", "  ", "unknown", None]


def test_indexed_vocabulary_equals_the_literal_one(spark):
    """Phrases of one to four words, whole or cut out of words, with blanks at their ends and letters that fold."""
    pick = random.Random(12)
    texts = made_up_texts(pick, 150)
    phrases = {"a", "b ", " é", "zz", "  "}
    while len(phrases) < 120:
        text = pick.choice(texts[:150])
        a = pick.randrange(len(text) + 1)
        piece = text[a:a + pick.randrange(1, 12)]
        if piece:
            phrases.add(piece)
    rows, vocabulary = [], {}
    for i, phrase in enumerate(sorted(phrases)):
        field, category = ("barrier", "unsafe_act")[i % 2], i // 2 % 5
        rows.append((field, category, f"c{category}", i // 10, phrase))
    for field, order, category, _, phrase in sorted(rows):
        categories = vocabulary.setdefault(field, [])
        if not categories or categories[-1][0] != category:
            categories.append((category, []))
        categories[-1][1].append(phrase)
    table = spark.createDataFrame(rows, "field string, category_order int, category string, phrase_order int, phrase string")
    df = spark.createDataFrame([(str(i), t, "UNKNOWN", "UNKNOWN") for i, t in enumerate(texts)], "record_id string, narrative_text string, barrier string, unsafe_act string")
    fields = ("barrier", "unsafe_act")
    literal = evidence.extract_evidence(df, vocabulary, fields=fields, keep_hits=True)
    indexed = evidence.extract_evidence(df, table, fields=fields, keep_hits=True)
    assert sorted(map(str, indexed.select(literal.columns).collect())) == sorted(map(str, literal.collect()))
    found = evidence.vocabulary_matches(df, table)
    assert sorted(found.collect()) == sorted(evidence.vocabulary_matches(df, vocabulary).collect()) and found.count() > 500


def test_phrase_index_keeps_only_pieces_that_a_phrase_has(spark, monkeypatch):
    seen, write = {}, evidence.written

    def kept(df, label):
        seen[label] = write(df, label)
        return seen[label]

    monkeypatch.setattr(evidence, "written", kept)
    phrases = ["rope", "xy rope", "a b", "ab", "b", "big old dog", "no", "z ", " q", "qu ", "İst"]
    numbered = spark.createDataFrame(list(enumerate(phrases)), "no bigint, low string")
    words = ["ropes", "rope", "arope", "axy", "xy", "a", "b", "ab", "cab", "old", "cold", "", "z", "az", "q", "qa", "qu", "aqu", "none", "many", "others"]
    tokens = spark.createDataFrame([(w, 1) for w in words], "token string, n bigint")
    got = {r.token: set(r.nos) for r in evidence.phrase_index(numbered, tokens).collect()}
    for no, phrase in enumerate(phrases):
        parts = phrase.split(" ")
        for word in words:
            if len(parts) == 1 and phrase in word or len(parts) > 2 and word == parts[1]:
                assert no in got[word]
            elif len(parts) == 2:
                first, last = parts
                wanted = word.endswith(first) if len(first) >= len(last) else word.startswith(last)
                assert (no in got.get(word, set())) == wanted
            else:
                assert no not in got.get(word, set())
    pieces = {r.gram for r in seen["grams"].select("gram").collect()}
    assert pieces and pieces <= {p[i:i + 3] for p in phrases for i in range(len(p))}


def test_a_million_phrases(spark):
    table = spark.range(1_000_000).select(
        F.lit("barrier").alias("field"), (F.col("id") % 7).cast("int").alias("category_order"), (F.col("id") % 7).cast("string").alias("category"),
        F.col("id").cast("int").alias("phrase_order"),
        F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" x"), (F.col("id") % 1000).cast("string"), F.lit(" end")).alias("phrase"))
    df = spark.createDataFrame([("1", "so W5 x5 end here", "UNKNOWN"), ("2", "w77 x78 end", "UNKNOWN"), ("3", "aw999999 X999 ending", "UNKNOWN")],
                               "record_id string, narrative_text string, barrier string")
    assert evidence.load_vocabulary(table) is table
    got = {r.record_id: (r.barrier, r.barrier_evidence_span) for r in evidence.extract_evidence(df, table, fields=("barrier",)).collect()}
    assert got == {"1": ("5", "W5 x5 end"), "2": ("UNKNOWN", None), "3": (str(999_999 % 7), "w999999 X999 end")}

def scored_rows(seed, n=300):
    rng = random.Random(seed)
    return [(i, int(rng.random() < 0.4), rng.choice([rng.random(), round(rng.random(), 2), 0.0, 1.0])) for i in range(n)]


def test_threshold_sweep_matches_brute_force(spark):
    rows = scored_rows(4)
    curve = evaluation.threshold_sweep(spark.createDataFrame(rows, "id int, y int, p double")).collect()
    assert len(curve) == 91
    for r in curve:
        t = r["step"] / 100
        tp = sum(p >= t and y == 1 for _, y, p in rows)
        fp = sum(p >= t and y == 0 for _, y, p in rows)
        assert (r["tp"], r["fp"]) == (tp, fp) and sum(r[c] for c in ("tp", "fp", "tn", "fn")) == len(rows)


def test_pr_auc_matches_brute_force(spark):
    rows = scored_rows(5)
    positives, points = sum(y for _, y, _ in rows), [(0.0, 1.0)]
    for t in sorted({p for _, _, p in rows}, reverse=True):
        tp = sum(p >= t and y == 1 for _, y, p in rows)
        points.append((tp / positives, tp / sum(p >= t for _, _, p in rows)))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    got = evaluation.pr_auc(spark.createDataFrame(rows, "id int, y int, p double")).first()["pr_auc"]
    assert got == pytest.approx(area, abs=6e-5)


def test_calibration_edges(spark):
    rows = [(1, 0.0), (0, 0.1), (1, 0.30000000000000004), (1, 0.3), (0, 0.7), (1, 1.0), (0, 0.6)]
    got = {r["bin"]: r["n"] for r in evaluation.calibration_bins(spark.createDataFrame(rows, "y int, p double")).collect()}
    expected = Counter(max(i for i in range(10) if i * 0.1 <= p) for _, p in rows if p < 1.0)
    assert got == {i: expected.get(i, 0) for i in range(10)}


# published curve points (threshold step, tp, fp) with 69 positives and 130 negatives
PUBLISHED = [(42, 63, 99), (56, 57, 68), (72, 42, 41), (86, 20, 13), (13, 69, 127)]


def test_reference_points_on_published_curve(spark):
    rows = []
    for step, tp, fp in PUBLISHED:
        precision, recall = tp / (tp + fp), tp / 69
        rows.append((step, step / 100, round(precision, 4), round(recall, 4), round(2 * precision * recall / (precision + recall), 4), tp, fp, 130 - fp, 69 - tp))
    curve = spark.createDataFrame(rows, "step int, threshold double, precision double, recall double, f1 double, tp long, fp long, tn long, fn long")
    got = {r["point"]: (r["step"], r["closest_only"]) for r in evaluation.reference_points(curve).collect()}
    assert got == {"high_recall": (42, False), "max_f1": (56, False), "near_precision": (86, True), "above_floor": (72, False)}
    best = curve.filter("step = 56").first()
    assert (best["precision"], best["recall"], best["f1"]) == (0.456, 0.8261, 0.5876)


def test_pick_threshold_default(spark):
    none = spark.createDataFrame([(0, 0.9), (0, 0.2)], "y int, p double")
    assert evaluation.pick_threshold(evaluation.threshold_sweep(none)).first().asDict() == {"threshold": 0.05, "precision": 0.0, "recall": 0.0}


def test_upsert_semantics(spark):
    schema = "report_id string, status string, source string"
    current = spark.createDataFrame([("a", "Closed", "api"), ("b", "Closed", "api")], schema)
    new = spark.createDataFrame([("a", "Open", "bulk", 1), ("a", "Reviewed", "pdf", 2), ("c", "X", "one", 1), ("c", "Y", "two", 2)], schema + ", o int")
    got = {tuple(r) for r in tables.upsert(current, new, "report_id", "o").collect()}
    assert got == {("a", "Reviewed", "api"), ("b", "Closed", "api"), ("c", "Y", "one")}
    kept = {tuple(r) for r in tables.insert_ignore(current, new, "report_id", "o").collect()}
    assert kept == {("a", "Closed", "api"), ("b", "Closed", "api"), ("c", "X", "one")}


def test_inbox_keyset_equals_offset(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(2), rng.choice(["Closed", "Submitted"]), "api") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, critical int, status string, source string")
    page = R.inbox_page(df, page=3, per_page=20).collect()
    last = R.inbox_page(df, page=2, per_page=20).collect()[-1]
    after = R.inbox_after(df, last["critical"], last["status"] != "Closed", last["id"], per_page=20).collect()
    assert [r["id"] for r in page] == [r["id"] for r in after] and page[0]["pages"] == 10


def test_null_source_is_not_listed(spark):
    df = spark.createDataFrame([(1, None), (2, "api"), (3, "synthetic")], "id long, source string")
    assert [r["id"] for r in R.exclude_seed(df).collect()] == [2]


def test_severity_flags_are_one_way(spark):
    df = spark.createDataFrame([("Yes",), ("0",), (None,), (" NO ",), ("1",)], "flag string")
    row = quality.severity_flags(df, ["flag"]).first()
    assert (row["total"], row["positive"]) == (5, 2)


def test_nonzero_median_of_even_and_odd_counts(spark):
    def median(values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        row = quality.nonzero_stats(df, "v").first()
        return row["median_nonzero"], row["positive"]

    assert median(["3", "1", " 2 ", "0", None, "x"]) == (2.0, 3)
    assert median(["4", "1", "1", "2"]) == (1.5, 4)
    assert median(["0", None]) == (None, 0)


def test_lookup_size_counts_bytes(spark, monkeypatch):
    table = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit("y")).alias("tags"))
    monkeypatch.setattr(skew, "TRUSTED_BYTES", 0)
    assert skew.small(table)
    assert not skew.small(table, 49)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 50_000)
    assert not skew.small(table)
    assert skew.small(table.drop("text"))
    assert skew.small(table.filter("id < 0"))


def test_sequential_ids_over_text_blocks(spark):
    df = spark.createDataFrame([("b", 5), ("a", 9), ("b", 2), ("a", 1)], "block string, pos long")
    got = {(r["block"], r["pos"]): r["id"] for r in identity.sequential_ids(df, "block", "pos", "id").collect()}
    assert got == {("a", 1): "OIL-00001", ("a", 9): "OIL-00002", ("b", 2): "OIL-00003", ("b", 5): "OIL-00004"}


def test_candidates_are_skipped_with_a_reason(spark):
    from pyspark.ml.functions import array_to_vector

    from narrascope.plans.models import evaluate_candidates, skip_reason

    rng = random.Random(4)
    rows = [(["train", "validation", "test"][i % 3], i % 2, [rng.random() + (i % 2), 1.0 - (i % 2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "split string, y int, v array<double>").withColumn("features", array_to_vector("v"))
    got = {r["model_id"]: r for r in evaluate_candidates(df, {"a": "features", "b": None, "c": "absent"}).collect()}
    assert (got["b"]["skip_reason"], got["c"]["skip_reason"]) == ("no qualifying checkpoint", "no column absent")
    assert not got["a"]["skipped"] and got["a"]["skip_reason"] is None
    assert got["a"]["recall"] == 1.0 and got["a"]["pr_auc"] == 1.0 and got["a"]["tp"] == 10
    assert sum(b["n"] for b in got["a"]["calibration_bins"]) == 20
    assert skip_reason(df.filter("split <> 'test'"), "features") == "no test rows"
    assert skip_reason(df.filter("split <> 'train' or y = 1"), "features") == "train rows of one class only"
    assert skip_reason(df.limit(0), "features") == "no train rows"


def test_grouped_row_number_with_far_apart_positions(spark):
    rows = [(i * 10**12, "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "pos long, key string")
    got = {r["pos"]: r["n"] for r in ordering.grouped_row_number(df, ["key"], "pos", "n").collect()}
    assert got == {i * 10**12: i // 2 + 1 for i in range(300)}
    whole = ordering.grouped_row_number(df, [], "pos", "n")
    assert {r["pos"]: r["n"] for r in whole.collect()} == {i * 10**12: i + 1 for i in range(300)}


@pytest.mark.parametrize("fits", [True, False])
def test_upsert_by_broadcast_and_by_shuffle(spark, monkeypatch, fits):
    monkeypatch.setattr(tables, "small", lambda rows: fits)
    schema = "id string, risk int, note string"
    current = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", None, None)], schema)
    new = spark.createDataFrame([("b", 9, "new"), ("d", 4, "fresh"), ("c", 5, "late"), (None, 7, "none")], schema)
    got = sorted(tuple(r) for r in tables.upsert(current, new, "id", replaced=("risk",)).collect())
    assert got == [("a", 1, "x"), ("b", 9, "y"), ("c", 5, None), ("d", 4, "fresh")]
    assert tables.upsert(current, new.limit(0), "id").count() == 3
    assert tables.upsert(current.limit(0), new, "id").count() == 3


def test_duplicate_groups_do_not_depend_on_row_ids(spark):
    rows = [("r1", "a", "Same text"), ("r1", "a", "same  TEXT"), (None, "a", "Other"), (None, "a", "other"), (None, "b", "single"), ("r1", "b", "Third"), ("r2", "b", "third")]
    df = spark.createDataFrame(rows, "record_id string, source_dataset string, narrative_text string")
    groups = {(r.narrative_text.lower().split()[0], r.is_duplicate_group_id) for r in duplicates.flag_quality(df).collect()}
    assert groups == {("other", 1), ("same", 2), ("third", 3), ("single", 0)} and duplicates.flag_quality(df).count() == 7


def test_draft_ids_of_equal_rows_differ(spark):
    from narrascope.plans.scoring import submission_defaults

    df = spark.createDataFrame([(i, None, "x") for i in range(4)], "position long, report_id string, site string").withColumn("date", F.lit(None).cast("string"))
    df = df.withColumns({n: F.lit(None).cast("string") for n in ("top_phrases", "sif_reasons", "sif_decision_thresholds")}).drop(
        "top_phrases", "sif_reasons", "sif_decision_thresholds")
    made = df.select("*", F.array(F.struct(F.lit("a").alias("phrase"))).alias("top_phrases"), F.array(F.lit("r")).alias("sif_reasons"),
                     F.create_map(F.lit("low"), F.lit(0.5)).alias("sif_decision_thresholds"))
    ids = [r.report_id for r in submission_defaults(made, F.lit("2024-01-01 00:00:00").cast("timestamp"), "position").collect()]
    assert len(set(ids)) == 4 and all(i.startswith("DRAFT-20240101") for i in ids)


def test_explain_terms_moves_words_once(spark, monkeypatch):
    """With a coefficient table of any size the same words are named, and a report's words are counted where its text is."""
    from narrascope.plans import models as M

    reports = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 23} w{k}" for k in range(12))) for i in range(40)], "doc_id long, narrative_text string")
    table = spark.createDataFrame([(f"w{i}", float(i % 7) + 0.5, (-1.0) ** i if i % 5 else None) for i in range(20)], "word string, idf double, beta double")
    plain = M.explain_terms(reports, table)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("REPARTITION") <= 2 and plan.count("Exchange hashpartitioning") == 1
    expected = sorted(map(tuple, plain.collect()))
    assert len(expected) == 240
    for frequent in (0, 4):
        monkeypatch.setattr(M, "BROADCAST_WORDS", frequent or 1)
        monkeypatch.setattr(M, "small", lambda rows: 0 < rows.count() <= frequent)
        assert sorted(map(tuple, M.explain_terms(reports, table).collect())) == expected
