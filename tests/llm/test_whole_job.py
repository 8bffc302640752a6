"""Operators do the whole job: planted cases that a smaller job would miss."""

import collections
import hashlib
import pathlib
import random
import zlib

import pyarrow.parquet as pq

from narrascope.llm import sharding
from narrascope.llm.queries import QUERIES


def test_sharding_query_moves_whole_texts(spark, tmp_path, monkeypatch):
    dice = random.Random(4)
    rows = [(i, "".join(dice.choices("abc \n", k=dice.choice([0, 50, 3000])))) for i in range(300)] + [(None, None), (7, "same"), (7, "same")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    dealt, files = [], []
    shuffled, write_shards = sharding.shuffled, sharding.write_shards
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1 << 16)  # so the texts, not the row count, make the buckets
    monkeypatch.setattr(sharding, "shuffled", lambda records, size, **how: dealt.append(records.columns) or shuffled(records, size, **how))
    monkeypatch.setattr(sharding, "write_shards", lambda records, size, path, **how: files.append(path) or write_shards(records, size, path, **how))
    got = QUERIES["op4_sharding"](spark, str(tmp_path)).collect()
    assert dealt == [["doc_id", "text"]]
    key = lambda r: (str(r[0]), r[1], r[2])
    plain = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(map(key, plain)) == sorted(map(key, got))
    assert sharding.bucket_count(len(rows), sum(r[1] for r in plain)) > 5
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by) == sharding.SHARDS
    # the texts lie in the files, in slot order
    shards = sorted(pathlib.Path(files[0].removeprefix("file:")).glob("shard=*"))
    assert len(shards) == sharding.SHARDS
    stored = [t for s in shards for f in sorted(s.glob("*.parquet")) for t in (r["text"] for r in pq.ParquetFile(f).read().column("record").to_pylist())]
    assert sorted(t or "" for t in stored) == sorted(t or "" for _, t in rows)


def test_line_query_digests_the_texts_that_stay(spark, tmp_path):
    rows = [(1, "one line\n\nsame line here\n  same line here \nlast"), (2, "same line hers\nother words\nonly two"), (3, None), (4, ""),
            (5, "other words"), (6, "z\n" * 12 + "y y y y")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {1: "one line\n\nsame line here\nlast", 2: "other words\nonly two", 3: None, 4: "", 5: "", 6: "z\ny y y y"}
    got = {r.doc_id: r for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    counts = {1: (4, 3, 1, 0), 2: (3, 2, 0, 1), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), 5: (1, 0, 1, 0), 6: (13, 2, 11, 0)}
    for i, text in wanted.items():
        assert (got[i].n_lines, got[i].n_kept, got[i].n_exact, got[i].n_near) == counts[i]
        assert got[i].text_sha256 == (None if text is None else hashlib.sha256(text.encode()).hexdigest())
        assert got[i].text_chars == (None if text is None else len(text))
