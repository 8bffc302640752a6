"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.llm import (
    clustering, conversations, exact_dedup, language_id, language_model, line_dedup, mixing, packing, prefix_tokens, quality,
    sharding, simhash, toxicity)
from narrascope.llm.common import held_out
from narrascope.session import new_scratch

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
TOKEN_LIMIT = 1024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# words of a text, and A-Z in lower case, in the other engine's terms
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None, table: str = "documents"):
    def register(build: Callable[[SparkSession, DataFrame, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(
            spark, spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"), folder.rstrip("/"))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_simhash_near_dedup")
def _(spark, docs, folder):
    found = simhash.near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op2_line_quality")
def _(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.judge(docs, quality.train(*quality.sample(docs, labels))).withColumnRenamed("id", "doc_id")


@query("op3_token_counts")
def _(spark, docs, folder):
    counted = prefix_tokens.prefix_counts(docs, tokenizer(BYTE_BPE), TOKEN_LIMIT)
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "keep_chars")


@query("op4_sharding")
def _(spark, docs, folder):
    records = sharding.write_shards(docs, sharding.record_bytes("text"), new_scratch(spark, "shards"))
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return records.select(
        "record.doc_id", (F.octet_length(text) + sharding.OVERHEAD).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_packing")
def _(spark, docs, folder):
    return packing.pack_documents(docs, tokenizer(WORD_BPE), with_ids=False).withColumnRenamed("id", "doc_id")


@query("op6_toxicity")
def _(spark, docs, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels, ~held_out(F.col("id"), 5, 0))
    return toxicity.scores(docs, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_line_dedup", """
WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
l AS (SELECT doc_id, no, trim(raw) AS line FROM e WHERE trim(raw) <> ''),
x AS (SELECT line, min((doc_id, no)) AS f, length(line) AS n FROM l GROUP BY line),
h AS (SELECT line, f, m, 'first' AS half, left(line, m // 2) AS part FROM (SELECT *, unnest([n, n - 1]) AS m FROM x)
  UNION ALL SELECT line, f, m, 'last', right(line, m - m // 2) FROM (SELECT *, unnest([n, n - 1]) AS m FROM x)),
pairs AS (SELECT DISTINCT a.line AS p, b.line AS q, length(a.line) AS m, length(b.line) AS n
  FROM h a JOIN h b ON a.m = b.m AND a.half = b.half AND a.part = b.part AND b.f < a.f),
-- place of the first character that differs; the rest must agree after one edit there
differ AS (SELECT *, coalesce(list_min(list_filter(range(1, least(m, n) + 1), lambda i: substr(p, i, 1) <> substr(q, i, 1))),
  least(m, n) + 1) AS i FROM pairs),
near AS (SELECT DISTINCT p AS line FROM differ WHERE (m = n AND substr(p, i + 1) = substr(q, i + 1))
  OR (m = n + 1 AND substr(p, i + 1) = substr(q, i)) OR (n = m + 1 AND substr(p, i) = substr(q, i + 1))),
per AS (SELECT f[1] AS doc_id, count(*) FILTER (WHERE near.line IS NULL) AS n_kept, count(near.line) AS n_near
  FROM x LEFT JOIN near ON x.line = near.line GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1),
k AS (SELECT e.doc_id, string_agg(e.raw, chr(10) ORDER BY e.no) AS cut FROM e
  LEFT JOIN x ON trim(e.raw) = x.line LEFT JOIN near ON x.line = near.line
  WHERE trim(e.raw) = '' OR (near.line IS NULL AND x.f[1] = e.doc_id AND x.f[2] = e.no) GROUP BY 1),
r AS (SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.cut, '') END AS cut FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept,
  coalesce(c.n, 0) - coalesce(n_kept, 0) - coalesce(n_near, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
  sha256(r.cut) AS text_sha256, CAST(length(r.cut) AS BIGINT) AS text_chars
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN per ON d.doc_id = per.doc_id JOIN r ON d.doc_id = r.doc_id""")
def _(spark, docs, folder):
    text = F.col("row.text")
    return line_dedup.deduplicated(docs, counted=True).select(
        "row.doc_id", "counts.*", F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.char_length(text).cast("bigint").alias("text_chars"))


@query("op8_exact_dedup", f"""
WITH t AS (SELECT doc_id, {SQL_LOWER} AS normal FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(normal) AS text_sha256
FROM t WINDOW g AS (PARTITION BY normal)""")
def _(spark, docs, folder):
    return exact_dedup.mark_copies(docs).withColumnRenamed("id", "doc_id")


@query("op9_source_mixing", f"""
WITH d AS (SELECT doc_id, source, len({SQL_WORDS}) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
    WHEN 0 THEN {mixing.WEIGHTS[0]} WHEN 1 THEN {mixing.WEIGHTS[1]} ELSE {mixing.WEIGHTS[2]} END AS weight,
  row_number() OVER (ORDER BY source IS NULL, source) AS idx FROM s),
f AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER b, 0))
    / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) >= cap::DOUBLE / weight AS is_full FROM w
  WINDOW b AS (ORDER BY cap::DOUBLE / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT 1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) FILTER (is_full), 0) AS free,
  coalesce(sum(weight) FILTER (NOT is_full), 1)::DOUBLE AS open FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE free * weight / open END AS target FROM f, g),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(least(floor(rate * place + {mixing.offset()!r}::DOUBLE) - floor(rate * (place - 1) + {mixing.offset()!r}::DOUBLE), 2) AS BIGINT) * size AS taken
FROM r""")
def _(spark, docs, folder):
    return mixing.mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                                   (F.col("copies") * F.col("size")).alias("taken"))


@query("op10_lm_scoring")
def _(spark, docs, folder):
    held = held_out(F.col("doc_id"), 7, 2)
    scored, model = language_model.fit_and_score(docs, held)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 7, 2).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


@query("op11_language_id")
def _(spark, docs, folder):
    model = language_id.fit(docs, ~held_out(F.col("id"), 5, 0))
    return language_id.predict(docs, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id"), 5, 0).alias("held_out"), "lang_pred", "score")


@query("op12_centroid_clustering", table="embeddings")
def _(spark, vectors, folder):
    return clustering.with_inertia(clustering.cluster(vectors, "vec_id", "embedding")).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op13_conversation_repair", table="conversations")
def _(spark, rows, folder):
    return conversations.digests(conversations.repair(rows, damage=True)).withColumnRenamed("conv", "conv_id")
