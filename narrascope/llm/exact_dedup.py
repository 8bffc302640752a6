"""Exact duplicates by a 128-bit content hash, with a comparison of the bytes inside groups.

Equal texts are texts that are identical after lower-casing A-Z. The row with the
largest id of a group stays (or the smallest, on request). Rows of one hash whose
bytes differ from the group's chosen row are split off into groups of their own,
so a collision never merges two texts.

Defined cases: a null text counts as empty, and empty texts are equal to each
other; a null id ranks below all ids; of rows that repeat an id and a text, exactly
one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import ascii_lower, key_filter, maybe_in, without, written

# rows of one group that one task compares with the group's chosen row
COMPARED = 1024


def md5_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _normal(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _keys(docs: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column]) -> DataFrame:
    text = docs.select(F.col(id_col).alias("id"), _normal(text_col).alias("normal"))
    return text.select("id", "normal", key(F.col("normal")).alias("key"), F.unhex(F.sha2("normal", 256)).alias("sha"))


def _pick(keep: str) -> Callable[[str], Column]:
    return F.max if keep == "largest" else F.min


def colliding(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column],
              keep: str) -> DataFrame:
    """(id, key, sha, keep, size) of rows whose bytes differ from the chosen row of their hash group.

    Only texts of hashes that occur twice are moved. A large group is dealt over
    many tasks by a salt, and the chosen text goes to each of them.
    """
    parts = F.ceil(F.col("size") / COMPARED).cast("int")
    # a bit table of the repeated hashes keeps nearly all other texts from being moved
    bits = key_filter(groups.select(F.xxhash64("key").alias("code")), "code")
    texts = maybe_in(_keys(docs, id_col, text_col, key).withColumn("code", F.xxhash64("key")), "code", bits).drop("code")
    members = written(texts.join(groups, "key").withColumn(
        "salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")), "members")
    chosen = (members.filter(F.col("id").eqNullSafe(F.col("keep"))).groupBy("key")
              .agg(F.min("normal").alias("chosen"), F.max("size").alias("size"))
              .select("key", "chosen", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")))
    odd = written(members.join(chosen, ["key", "salt"]).filter(F.col("normal") != F.col("chosen"))
                  .select("id", "key", "sha", "normal"), "odd")
    classes = odd.groupBy("key", "normal").agg(_pick(keep)("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    return odd.join(classes, ["key", "normal"]).select("id", "key", "sha", "keep", "size").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                 key: Callable[[Column], Column] = md5_key) -> DataFrame:
    """One row per (id, text): id, key, sha, n (rows that repeat it), keep (id that stays), size of the group."""
    rows = written(_keys(docs, id_col, text_col, key).groupBy("id", "key", "sha")
                   .agg(F.count(F.lit(1)).alias("n")), "keys")
    groups = written(rows.groupBy("key").agg(F.sum("n").alias("size"), _pick(keep)("id").alias("keep"))
                     .filter(F.col("size") > 1), "groups")
    odd = written(colliding(docs, groups, id_col, text_col, key, keep).select(
        F.col("id").alias("odd_id"), F.col("key").alias("odd_key"), F.col("sha").alias("odd_sha"),
        F.col("keep").alias("odd_keep"), F.col("size").alias("odd_size")), "classes")
    # an odd class counts once per group, however many rows it has
    gone = (odd.select("odd_key", "odd_sha", "odd_keep", "odd_size").distinct()
            .groupBy("odd_key").agg(F.sum("odd_size").alias("gone")))
    true = groups.join(gone, groups.key == gone.odd_key, "left").select(
        "key", "keep", (F.col("size") - F.coalesce("gone", F.lit(0))).alias("size"))
    own = rows.join(true, "key", "left")
    both = own.join(odd, own.id.eqNullSafe(odd.odd_id) & (own.key == odd.odd_key) & (own.sha == odd.odd_sha), "left")
    return both.select(
        "id", "key", "sha", "n",
        F.when(F.col("odd_size").isNotNull(), F.col("odd_keep"))
        .when(F.col("size").isNotNull(), F.col("keep")).otherwise(F.col("id")).alias("keep"),
        F.coalesce("odd_size", "size", F.lit(1)).cast("bigint").alias("size"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    groups = exact_groups(docs, id_col, text_col, **how)
    each = groups.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select(
        "id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows that stay, with all their columns."""
    groups = written(exact_groups(docs, id_col, text_col, **how).filter("size > 1"), "decisions")
    stays = F.col("id").eqNullSafe(F.col("keep"))
    key = how.get("key", md5_key)
    keys = {"id": F.col(id_col), "key": key(_normal(text_col)), "sha": F.unhex(F.sha2(_normal(text_col), 256))}
    return without(docs, keys, groups.filter(~stays), groups.filter(stays & (F.col("n") > 1)))
