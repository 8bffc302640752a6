"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Inside a source each document
expects target / source words copies. The documents are put in order of size (ties
by a hash of the id), the expected copies are summed along this order, one random
offset is added, and a document is emitted once per integer boundary that its own
stretch crosses. Because neighbours in the order have like sizes, the words taken
stay within about one large document of the target.

Order and sums never gather a source in one task: rows are cut into ranges along the
order and only one count per range is carried on (`running_totals`).

Defined cases: a null text has size 0; a null source is a source of its own, the last;
sources without words have target 0 and give no copies; rows that repeat an id
are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import WORD, written
from narrascope.operators.ordering import dense_index, running_totals
from narrascope.operators.skew import lookup_join

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
SEED = 20_240_917


def offset(seed: int = SEED) -> float:
    """The one random offset, in [0, 1)."""
    return random.Random(seed).random()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """A key that is never null and differs for every source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   limit: int = LIMIT) -> DataFrame:
    """(key, source_size, docs, before, target) per source of a table of (source, key, size).

    Targets share `share` of all words by weight; none exceeds `limit` times its
    source. What a full source leaves goes to the others by weight. Sources fill up in order
    of their limit per weight, so the full ones are found by running sums.
    """
    sources = sizes.groupBy("key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"),
                                       F.count(F.lit(1)).alias("docs"))
    order = [F.col("source").isNull(), F.col("source")]
    counted = running_totals(sources.withColumn("one", F.lit(1).cast("bigint")), order, {"rank": "one", "upto": "docs"})
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]),
                          ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighted = written(counted.select(
        "key", "source_size", "docs", (F.col("upto") - F.col("docs")).alias("before"), "rank", weight.alias("weight"),
        (F.col("source_size") * limit).alias("cap")), "sources")
    total, all_weights = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    filled = written(running_totals(weighted, [F.col("cap") / F.col("weight"), F.col("rank")],
                                    {"caps": "cap", "weights": "weight"}).withColumn(
        "full", (F.lit(budget) - (F.col("caps") - F.col("cap"))) / (F.lit(all_weights or 0) - (F.col("weights") - F.col("weight")))
        >= F.col("cap") / F.col("weight")), "filled")
    used, open_weight = filled.agg(F.sum(F.when(F.col("full"), F.col("cap"))),
                                   F.sum(F.when(~F.col("full"), F.col("weight")))).first()
    free = budget - (used or 0)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        F.lit(free) * F.col("weight") / F.lit(float(open_weight or 1)))
    return filled.select("key", "source_size", "docs", "before", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = SEED, carry: bool = False, **law) -> DataFrame:
    """id, size, source_size, target and copies of every row; the whole row too (`row`) if `carry`."""
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        source_key(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("tie"), *([F.struct("*").alias("row")] if carry else []))
    targets = written(source_targets(sized, **law), "targets")
    order = [F.col("source").isNull(), F.col("source"), F.col("size"),
             F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.col("id"), F.col("tie")]
    ranked = lookup_join(dense_index(sized, order, "rank"), targets, ["key"], F.col("tie"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    place = F.col("rank") - F.col("before")
    crossed = F.floor(rate * place + F.lit(offset(seed))) - F.floor(rate * (place - 1) + F.lit(offset(seed)))
    limit = law.get("limit", LIMIT)
    return ranked.select("id", "size", "source_size", "target", F.least(crossed, F.lit(limit)).alias("copies"),
                         *(["row"] if carry else []))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix: each input row as often as it is emitted, with its own columns."""
    return (mix(docs, carry=True, **how).filter("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).select("row.*"))
