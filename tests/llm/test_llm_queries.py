"""The registered queries against DuckDB or brute force, and the pipeline's stages, on the smallest tables."""

import collections
import math
import pathlib
import zlib

import pytest

import corpus_pipeline
from check_oracle import compare, duck
from narrascope.llm.language_model import discounts, tokens
from narrascope.llm.queries import ORACLES, QUERIES
from narrascope.session import written

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    ok, note = compare(spark, duck(FOLDER), name, FOLDER, QUERIES, ORACLES)
    assert ok, note


def test_language_model_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    uni, bi, total, kinds = (collections.Counter() for _ in range(4))
    by = collections.defaultdict(lambda: [0, 0, 0])
    for row in rows:
        if not held(row.doc_id):
            words = tokens(row.text.encode())
            uni.update(words)
            bi.update(zip([None, *words], words))
    for (u, v), c in bi.items():
        total[u] += c
        kinds[v] += 1
        by[u][min(c, 3) - 1] += 1
    times, of = collections.Counter(bi.values()), collections.Counter(kinds.values())
    high, low = (discounts([c[k] for k in (1, 2, 3, 4)]) for c in (times, of))
    mass = low[0] * of[1] + low[1] * of[2] + low[2] * sum(n for k, n in of.items() if k > 2)
    cut = lambda c, d: c - d[min(c, 3) - 1] if c else 0

    def chance(u, v):
        base = (cut(kinds[v], low) + mass / (len(uni) + 1)) / len(bi)
        return base if not total[u] else (cut(bi[u, v], high) + sum(a * b for a, b in zip(high, by[u])) * base) / total[u]
    texts = {r.doc_id: tokens(r.text.encode()) for r in rows}
    for row in QUERIES["op10_lm_scoring"](spark, FOLDER).collect():
        words = texts[row.doc_id]
        assert row.score == pytest.approx(sum(math.log10(chance(u, v)) for u, v in zip([None, *words], words)))
        assert row.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (sum(uni.values()) + len(uni) + 1)) for w in words))
        assert row.held_out == held(row.doc_id)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        if name != "mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
