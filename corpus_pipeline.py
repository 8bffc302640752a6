"""The corpus pipeline: documents in, packed training sequences out.

Stages, in order: toxic documents go, exact copies go, of near duplicates one
document stays, sources are mixed to their target weights, and the mix is packed
into windows. Each stage is written as Parquet and read again as the next one's
input, so a lost executor costs one stage's work and no plan grows.

Defined cases are those of the operators: null texts count as empty, null ids and
null sources are kept, rows that repeat are judged each, extra columns are carried
on, and an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.llm import exact_dedup, mixing, packing, simhash, toxicity
from narrascope.llm.common import held_out
from narrascope.llm.queries import WORD_BPE, tokenizer
from narrascope.session import written


# workers of one job run all stages, so this one keeps a smaller table of words than the query does
CACHED_WORDS = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity limit. The labels' own documents are the training sample; none is an input of a score."""
    folder = sf_dir.rstrip("/")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels, ~held_out(F.col("id"), 5, 0))
    return toxicity.not_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose fingerprints (three-word shingles) are linked by two or fewer differing bits."""
    return simhash.drop_near_copies(docs, threshold=simhash.THRESHOLD)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer(WORD_BPE), cached=CACHED_WORDS).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
# a trained model and window packing have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; every stage's result is a written table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
