"""Readers, mappers and the corpus build on small files."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from narrascope.operators.evidence import load_vocabulary, vocabulary_from_taxonomy
from narrascope.plans.corpus import CorpusPaths, build_corpus
from narrascope.plans.scoring import bulk_upload
from narrascope.schemas import MASTER_COLUMNS
from narrascope.session import local_table, new_scratch
from narrascope.sources import files, mapping, taxonomy


def test_read_mixed_encodings_and_newlines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,text\r\n1,"two\nlines, ""quoted"""\r\n2,plain\r\n'.encode())
    (tmp_path / "b.csv").write_bytes("text,id,größe\ncafé,3,x\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("﻿id,text\n4,bom\n".encode())
    got = {r["id"]: r["text"] for r in files.read_csv_robust(spark, [str(tmp_path)]).collect()}
    assert got["2"] == "plain" and got["3"] == "café" and got["4"] == "bom"
    assert got["1"].replace("\r", "") == 'two\nlines, "quoted"'
    assert "größe" in files.read_csv_robust(spark, [str(tmp_path)]).columns


def test_short_and_long_lines_and_odd_names(spark, tmp_path):
    (tmp_path / "jan 2020 [a]+50%.csv").write_text("id,text,flag\n1,one,x\n2,short\n3,long,x,more\n4\n5,five,x,\n")
    got = {r["id"]: (r["text"], r["flag"]) for r in files.read_csv_robust(spark, [str(tmp_path)]).collect()}
    assert got == {"1": ("one", "x"), "2": ("short", None), "4": (None, None), "5": ("five", "x")}
    skipped = files.surplus_lines(spark, [str(tmp_path)]).collect()
    assert [(r["file"].endswith("jan 2020 [a]+50%.csv"), r["lines"]) for r in skipped] == [(True, 1)]


@pytest.mark.parametrize("multiline", [True, False])
def test_positions_follow_files_and_lines(spark, tmp_path, multiline):
    for name, rows in (("b.csv", range(400)), ("a 1.csv", range(400, 420)), ("c.csv", range(420, 1000))):
        (tmp_path / name).write_text("id,text\n" + "".join(f"{i},row {i}{',x' if i == 410 else ''}\n" for i in rows))
    expected = [str(i) for rows in (range(400, 420), range(400), range(420, 1000)) for i in rows]
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = files.read_csv_robust(spark, [str(tmp_path)], multiline=multiline, position=True)
        got = [(r["_position"], r["id"]) for r in rows.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    # a skipped line keeps its place
    assert sorted(got) == [(i, v) for i, v in enumerate(expected) if v != "410"]


def test_scan_reports_lacking_files(spark, tmp_path):
    (tmp_path / "1.csv").write_text("id,flag\n1,Yes\n")
    (tmp_path / "2.csv").write_text("id\n2\n")
    rows, lacking = files.scan_drifting_dir(spark, [str(tmp_path)], ["id", "flag"])
    assert [r["id"] for r in rows.collect()] == ["1"]
    report = lacking.collect()
    assert len(report) == 1 and report[0]["file"].endswith("2.csv") and report[0]["missing"] == ["flag"]


def test_hazmat_ids(spark):
    rows = [(0, "<a>X-1</a>"), (1, None), (2, "<a>X-1</a>"), (3, "<br>"), (4, " ")]
    df = local_table(spark, rows, f"{mapping.POSITION} bigint, `Report Number` string")
    got = mapping.map_hazmat(df, mapping.Provenance("hz"), "2024").orderBy("record_id")
    assert tuple(got.columns) == MASTER_COLUMNS
    assert {r["source_record_id"] for r in got.collect()} == {"X-1", "phmsa_1", "X-1_dup1", "<br>", "phmsa_4"}


def test_term_maps(spark):
    known = taxonomy.known_terms(spark, {"severe_injury": "sev", "abstracts": "abs"})
    terms = local_table(spark, [("sev", "Event", "2312"), ("sev", "Event", "640.0"), ("sev", "Event", "999"), ("abs", "Event type", "Shock")],
                        "source_dataset string, column_name string, source_term string")
    got = {r["source_term"]: (r["mapped_rule_id"], r["mapping_confidence"]) for r in taxonomy.map_terms(terms, known).collect()}
    assert got == {"2312": ("driving", "high"), "640.0": ("energy_isolation", "high"), "999": ("Unmapped", "n/a"), "Shock": ("energy_isolation", "high")}


def test_taxonomy_file_and_vocabulary(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"life_saving_rules": [{"rule": "Hot Work", "barriers": ["Fire watch", "Permit"], "typical_hazards": []}]}, indent=2))
    rules = taxonomy.read_taxonomy(spark, str(path))
    row = rules.first()
    assert (row["rule_id"], row["hazard_examples"], row["barrier_examples"]) == ("hot_work", "", "Fire watch; Permit")
    assert load_vocabulary(vocabulary_from_taxonomy(rules)) == {"barrier": [("hot_work", ["Fire watch", "Permit"])]}


def test_corpus_build(spark):
    rows = [(i, f"id{i}", f"the guard was bypassed in case {i}" if i % 4 else "same words", "synthetic" if i % 5 == 0 else "real") for i in range(80)]
    seed = local_table(spark, rows, "n bigint, report_id string, report_text string, source string")
    master = mapping.map_seed(seed, mapping.Provenance("seed_reports"), "2024")
    root = new_scratch(spark, "corpus")
    vocabulary = {field: [("bypass", ["bypassed"])] for field in ("unsafe_act", "unsafe_condition", "barrier", "potential_consequence")}
    done = build_corpus(master, vocabulary, CorpusPaths(f"{root}/a", f"{root}/b", f"{root}/c"), "seed_reports")
    assert done.count() == 80
    assert done.filter("unsafe_act = 'bypass' and unsafe_act_evidence_start is not null").count() == 60
    assert done.filter("is_duplicate_group_id <> 0").select("split").distinct().count() == 1
    assert done.groupBy("split").agg(F.count("*").alias("n")).filter("split = 'test'").first()["n"] == 12


def test_bulk_upload(spark):
    current = spark.createDataFrame([("A", "old text", "Closed", "api", "S1", 0), ("B", "kept", "Closed", "api", "S2", 0)],
                                    "report_id string, report_text string, status string, source string, site string, critical int")
    uploaded = spark.sql("""SELECT id, report_id, report_text, CAST(NULL AS STRING) site, p,
        array(named_struct('rule', 'Hot Work', 'p', 0.9D), named_struct('rule', 'Driving', 'p', 0.1D)) class_probs
        FROM VALUES (1, 'A', 'new text', 0.95D), (2, ' ', 'draft one', 0.1D), (3, 'nan', 'draft two', 0.5D), (4, 'C', '  ', 0.9D)
        AS t(id, report_id, report_text, p)""")
    table, counts = bulk_upload(current, uploaded, F.lit("2024-05-06 07:08:09").cast("timestamp"), "id")
    got = {r["report_id"]: r for r in table.collect()}
    assert set(got) == {"A", "B", "DRAFT-20240506070809000000-2", "DRAFT-20240506070809000000-3"}
    assert (got["A"]["report_text"], got["A"]["status"], got["A"]["source"], got["A"]["site"], got["A"]["critical"]) == (
        "new text", "Submitted", "api", "Unknown", 1)
    assert got["B"]["report_text"] == "kept"
    assert counts.first().asDict() == {"total_processed": 3, "sif_flagged": 1, "non_sif": 2}


def test_no_duplicates_at_all(spark):
    from narrascope.operators.duplicates import duplicate_groups
    df = spark.createDataFrame([("1", "s", "a"), ("2", "s", "b")], "record_id string, source_dataset string, narrative_text string")
    assert {r["is_duplicate_group_id"] for r in duplicate_groups(df).collect()} == {0}


def rows_scanned(df):
    """Rows that the scan of an executed plan gave out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_clustered_store_skips_what_a_filter_cannot_hold(spark, tmp_path):
    from narrascope.operators import reporting as R
    from narrascope.sources.files import write_clustered, write_table

    n = 40_000
    df = spark.range(n).select(
        "id", (F.col("id") * 7919 % 97 == 0).cast("int").alias("critical"), F.when(F.col("id") * 31 % 5 == 0, "Closed").otherwise("Submitted").alias("status"),
        F.concat(F.lit("site "), (F.col("id") * 7 % 40).cast("string")).alias("site"), F.lit("api").alias("source"),
        F.lit("a").alias("activity"), F.concat(F.lit("R"), F.xxhash64("id").cast("string")).alias("report_id")).repartition(8)
    write_table(df, f"{tmp_path}/plain")
    write_clustered(df, f"{tmp_path}/by_site", ["site", "id"], files=8)
    write_clustered(df, f"{tmp_path}/inbox", ["critical", "status", "id"], files=8, group_bytes=1 << 16)
    write_clustered(df, f"{tmp_path}/ids", ["id"], {"report_id": n // 8}, files=8)
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    by_site = R.filter_reports(read("by_site"), site="site 7")
    assert by_site.count() == R.filter_reports(read("plain"), site="site 7").count() == n // 40
    assert rows_scanned(by_site) <= n // 4 < n == rows_scanned(R.filter_reports(read("plain"), site="site 7"))
    deep = dict(critical=0, is_open=False, last_id=900, per_page=25)
    assert [r.id for r in R.inbox_after(read("inbox"), **deep).collect()] == [r.id for r in R.inbox_after(df, **deep).collect()]
    # the same filter without the top-k, so that the plan is the scan and the filter only
    closed = read("inbox").filter("critical < 0 OR (critical = 0 AND status = 'Closed' AND id < 900)")
    assert closed.count() > 0 and rows_scanned(closed) <= n // 3
    one = df.filter("id = 1234").first().report_id
    found = read("ids").filter(F.col("report_id") == one)
    assert found.count() == 1 and rows_scanned(found) <= n // 4


def test_sketches_merge(spark):
    from narrascope.operators import sketches as K

    df = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 3).alias("source"),
                                    F.when(F.col("id") % 11 > 0, F.xxhash64("id") % 1000).alias("v"), (F.col("id") % 7001).alias("user"))
    numbers, distinct = {"v": F.col("v")}, {"user": F.col("user")}
    daily = K.sketch(df, ["source", "day"], numbers, distinct)
    merged = {r.source: r for r in K.figures(K.merged(daily.drop("day"), ["source"])).collect()}
    whole = {r.source: r for r in K.figures(K.sketch(df, ["source"], numbers, distinct)).collect()}
    rows = df.collect()
    for source, m in merged.items():
        w = whole[source]
        assert (m.n, m.v_n, m.v_sum, m.v_min, m.v_max, m.v_mean) == (w.n, w.v_n, w.v_sum, w.v_min, w.v_max, w.v_mean)
        assert m.user_distinct == w.user_distinct  # registers do not depend on the split
        users = len({r.user for r in rows if r.source == source})
        assert abs(m.user_distinct - users) <= K.DISTINCT_ERROR * users
        values = sorted(r.v for r in rows if r.source == source and r.v is not None)
        for q, value in zip((0.25, 0.5, 0.75), m.v_quantiles):
            below, upto = sum(v < value for v in values) / len(values), sum(v <= value for v in values) / len(values)
            assert below - K.RANK_ERROR <= q <= upto + K.RANK_ERROR
    assert K.figures(K.sketch(df.limit(0), ["source"], numbers, distinct)).count() == 0
    empty = K.figures(K.merged(K.sketch(df.filter("v is null"), ["source", "day"], numbers, distinct).drop("day"), ["source"])).first()
    assert empty.v_n == 0 and empty.v_mean is None and empty.v_quantiles is None


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_csv_with_line_breaks_is_read_in_many_tasks(spark, tmp_path, encoding):
    pick = random.Random(21)
    piece = lambda: pick.choice(["a", "é", ",", '"', "\n", " ", "\n\n", 'x"y', "", ",\n"])
    rows = [[str(i), "".join(piece() for _ in range(pick.randrange(0, 12))), pick.choice(["", "end", "l\nm"])] for i in range(3000)]
    rows[7][1] = "long\n" * 3000  # one field over many splits
    with open(tmp_path / "a.csv", "w", encoding=encoding, newline="") as file:
        writer = csv.writer(file, lineterminator="\n")
        writer.writerow(["id", "text", "note"])
        for i, row in enumerate(rows):
            writer.writerow([*row, "surplus"] if i == 11 else row[:2] if i == 12 else row)
            if i % 500 == 0:
                file.write("\n")  # blank lines are no records
    with open(tmp_path / "b.csv", "w", encoding=encoding, newline="") as file:
        csv.writer(file, lineterminator="\n").writerows([["id", "text", "other"], ["b1", "x\ny", "z"]])
    paths = [str(tmp_path / name) for name in ("a.csv", "b.csv")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(paths[0]).rdd.getNumPartitions() > 10
        got = {r["_position"]: r for r in files.read_csv_robust(spark, paths, multiline="split", position=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kept = [row for i, row in enumerate(rows) if i != 11]
    assert sorted(got) == list(range(len(kept) + 1))
    for place, row in enumerate(kept):
        assert (got[place]["id"], got[place]["text"] or "") == (row[0], row[1]), place
    assert got[11]["note"] is None and (got[len(kept)]["id"], got[len(kept)]["text"], got[len(kept)]["other"]) == ("b1", "x\ny", "z")
    whole = files.read_csv_robust(spark, paths[:1])
    assert sorted((r["id"], r["text"], r["note"]) for r in whole.collect() if r["id"] != "12") == sorted(
        (r["id"], r["text"], r["note"]) for r in got.values() if r["id"] not in ("b1", "12"))


def test_source_files_grow_in_number(spark, monkeypatch):
    from bindings import QUERIES, mapped

    made, files = [], mapped.files
    write = files.write_csv
    monkeypatch.setattr(mapped, "part_count", lambda rows, least: 9)
    monkeypatch.setattr(files, "write_csv", lambda df, path: (made.append(df.rdd.getNumPartitions()), write(df, path)))
    QUERIES["ingest_files"](spark, "/root/testdata/sf0.001")
    assert made == [9, 9]
