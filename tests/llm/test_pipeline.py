"""The whole pipeline on a small corpus with planted toxic documents, exact copies and near copies, against plain Python and SQL."""

import collections
import random

import duckdb
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from narrascope.llm import simhash
from narrascope.llm.queries import ORACLES, WORD_BPE, tokenizer

BAD = ("zugblorf", "zugblorfen", "zugblorfisch", "grmpfzug")


def plain_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest id reachable over links of at most two differing bits, by comparing all pairs."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, p in prints.items():
        for b, q in prints.items():
            if a < b and (p ^ q).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def corpus():
    dice = random.Random(17)
    words = ["".join(dice.choice("abdeilnorstu") for _ in range(dice.randrange(3, 9))) for _ in range(800)]
    rows, labels = [], []
    for i in range(240):
        text = [dice.choice(words) for _ in range(dice.randrange(20, 300))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(dice.randrange(len(text)), dice.choice(BAD))
        rows.append((i, " ".join(text), "en", f"s{i % 3}" if i % 7 else None, 0))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(1000 + i, r[1].upper() if i % 2 else r[1], "en", "s1", 0) for i, r in enumerate(clean[:30])]  # exact copies
    rows += [(2000 + i, r[1].replace(" ", "  ", 5) + "\n", "en", "s2", 0) for i, r in enumerate(clean[30:60])]  # near copies: only blanks differ
    rows += [(3000, None, "en", "s0", 0), (3001, "", "en", "s0", 0), (3002, " \n", "en", None, 0)]
    return rows, labels


def test_fingerprints_and_components_end_to_end(spark):
    rows, _ = corpus()
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    prints = {r[0]: plain_print(r[1]) for r in rows}
    got = {r.id: (r.fp & 2 ** 64 - 1, r.component) for r in simhash.near_duplicates(table).collect()}
    roots = components(prints)
    assert got == {i: (prints[i], roots[i]) for i in prints} and len(set(roots.values())) < len(roots)


def test_run_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r for r in rows if not any(bad in (r[1] or "") for bad in BAD)]
    groups = collections.defaultdict(list)
    for r in kept:
        groups[(r[1] or "").lower()].append(r)  # these texts are ASCII
    kept = [max(group, key=lambda r: r[0]) for group in groups.values()]
    roots = components({r[0]: plain_print(r[1]) for r in kept})
    kept = [r for r in kept if roots[r[0]] == r[0]]
    assert len(kept) == 180 + 1  # one of each group of copies, one text without words
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", kept)
    names = [d[0] for d in con.execute(ORACLES["op9_source_mixing"]).description]
    copies = {}
    for row in con.fetchall():
        row = dict(zip(names, row))
        if row["size"]:
            copies[row["doc_id"]] = row["taken"] // row["size"]
    library = Tokenizer.from_file(tokenizer(WORD_BPE))
    tokens = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in kept}
    lengths, windows = collections.Counter(), collections.Counter()
    for piece in packed:
        lengths[piece.doc_id] += piece.length
        windows[piece.sequence_id] += piece.length
        assert piece.doc_tokens == tokens[piece.doc_id]
    assert {i: n for i, n in lengths.items() if i in copies} == {i: n * tokens[i] for i, n in copies.items() if n}
    assert set(lengths) - set(copies) <= {r[0] for r in kept if not (r[1] or "").split()}
    assert max(windows.values()) <= 2048
