"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are duplicates if they are equal or one edit (a character inserted, deleted or replaced) apart,
after blanks at their ends are cut off. Lines without another character are always kept. Of
equal lines the earliest occurrence stays; a line is also dropped if an earlier line
lies within the edit bound. Earlier means the smaller document id, then the smaller line number.

Method: every line emits a hashed key for each of its variants with one character
deleted, and one for itself. Lines that share a variant at the same place differ by a
replaced character; a line whose own key equals another's variant lacks that character.
Equal keys are joined to the earliest line of their group only, the edit distance of
the joined lines is verified, and the later line goes.

Distinct lines that can have a partner are numbered in the order of their first occurrence, so keys travel with one number.
Keys of variants are xors of hashes of (character, place), so a running xor over a line gives all
of them in linear time, however long the line is. Only lines that can have a partner
emit variants: one edit leaves the first or the last half of a line untouched, so
a line needs an equal half in another line (no pair is lost). The few such halves and lines are
found again in the text by bit tables of bounded size before any text is moved.

Defined cases: a null text has no lines; null ids count as earliest; rows that repeat an id and
a text count as one document and share its result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrascope.llm.common import key_filter, marked_in, maybe_in, written
from narrascope.operators.ordering import dense_index


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(first: struct of id, text hash and line number; line; key: 128 bits) of every line with a character."""
    text = F.col(text_col).cast("string")
    each = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"),
                       F.posexplode(F.split(text, "\n")).alias("no", "raw"))
    cut = each.select(F.struct("id", "tie", "no").alias("first"), F.trim("raw").alias("line")).filter("line <> ''")
    return cut.withColumn("key", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")))


def _halves(line: Column) -> Column:
    """Keys of the halves that a line shares with any partner, as the longer and as the shorter one."""
    size = F.char_length(line)
    keys = []
    for least in (size, size - 1):
        half = F.floor(least / 2).cast("int")
        keys += [F.xxhash64(F.lit("first"), least, F.substring(line, F.lit(1), half)),
                 F.xxhash64(F.lit("last"), least, F.substring(line, size - (least - half) + 1, least - half))]
    return F.array(*keys)


def _candidates(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, key, line) of distinct lines that share a half with another line; ids count first occurrences in order."""
    halves = lines.select("key", F.col("key.a").alias("a"), F.explode(_halves(F.col("line"))).alias("half"))
    shared = written(halves.groupBy("half").agg(F.min("a").alias("low"), F.max("a").alias("high"))
                     .filter("low <> high").select("half"), "halves")
    found = written(maybe_in(halves, "half", key_filter(shared, "half")).join(shared, "half", "left_semi")
                    .select("key").distinct(), "partners")
    numbers = written(dense_index(found.join(firsts, "key").select("key", "first"), [F.col("first")], "id", "numbers")
                      .select("key", "id"), "numbered")
    texts = maybe_in(lines.select("key", F.col("key.a").alias("a"), "line"), "a", key_filter(found.select(F.col("key.a").alias("a")), "a"))
    return texts.groupBy("key").agg(F.min("line").alias("line")).join(numbers, "key").select("id", "key", "line")


def _variants(lines: DataFrame) -> DataFrame:
    """(id, place, cut, own) of every character of every line: the key of the line without it and, once, of the line.

    Lines are dealt out before they are taken apart, so their characters need no shuffle.
    """
    chars = lines.select("id", "line").repartition("id").select("id", F.posexplode(F.split("line", "")).alias("place", "char"))
    here, moved = F.xxhash64("char", "place"), F.xxhash64("char", F.col("place") - 1)
    whole = W.partitionBy("id").orderBy("place")
    upto, rest = whole.rowsBetween(W.unboundedPreceding, 0), whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    hashed = chars.select("id", "place", here.alias("here"), moved.alias("moved"))
    sums = hashed.select("id", "place", "here", F.bit_xor("here").over(upto).alias("before"), F.bit_xor("moved").over(upto).alias("gone"),
                         F.bit_xor("here").over(rest).alias("own"), F.bit_xor("moved").over(rest).alias("all"))
    # the characters in front at their places, those behind moved up by one
    cut = F.col("before").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("all")).bitwiseXOR(F.col("gone"))
    return sums.select("id", "place", cut.alias("cut"), F.when(F.col("place") == 0, F.col("own")).alias("own"))


def near_lines(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Keys of distinct lines that lie within one edit of an earlier line."""
    known = written(_candidates(lines, firsts), "candidates")
    variants = written(_variants(known), "variants")
    # replaced characters: all lines of a group are within one edit, so the earliest stands for them
    groups = written(variants.groupBy("cut", "place").agg(F.min("id").alias("low"), F.max("id").alias("high"))
                     .filter("low <> high").select("cut", "place", "low"), "cuts")
    replaced = maybe_in(variants.select("id", "place", "cut"), "cut", key_filter(groups, "cut")).join(groups, ["cut", "place"]).filter(
        "id <> low").select(F.col("id").alias("later"), F.col("low").alias("earlier"))
    # one character more: the shorter line's own key is a variant of the longer one
    own = written(variants.filter("place = 0").select(F.col("own").alias("cut"), F.col("id").alias("short")), "own")
    longer = maybe_in(variants.select("id", "cut"), "cut", key_filter(own, "cut")).join(own, "cut").filter("id <> short")
    grown = longer.select(F.greatest("id", "short").alias("later"), F.least("id", "short").alias("earlier"))
    pairs = replaced.union(grown).distinct()
    checked = (pairs.join(known.select(F.col("id").alias("later"), F.col("line").alias("later_line")), "later")
               .join(known.select(F.col("id").alias("earlier"), F.col("line").alias("earlier_line")), "earlier"))
    within = F.levenshtein("later_line", "earlier_line", 1)
    near = checked.filter((within >= 0) & (within <= 1)).select(F.col("later").alias("id")).distinct()
    return known.select("id", "key").join(near, "id", "left_semi").select("key")


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per different line: key, first occurrence, times it occurs, near (an earlier line is within the bound)."""
    lines = _lines(docs, id_col, text_col)
    exact = written(lines.groupBy("key").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("times")), "lines")
    near = written(near_lines(lines, exact.select("key", "first")), "near").withColumn("near", F.lit(True))
    return exact.join(near, "key", "left").select("key", "first", "times", F.coalesce("near", F.lit(False)).alias("near"))


def _line_number(text: Column) -> Column:
    """Lines of a text that hold a character."""
    return F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")), F.lit(0)).cast("bigint")


def _losses(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tie, kept: numbers of the lines that stay, near: near-duplicates among the others) of documents that lose a line."""
    text = F.col(text_col).cast("string")
    sizes = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), _line_number(text).alias("n")).groupBy(
        "id", "tie").agg(F.max("n").alias("n"))
    kept = line_decisions(docs, id_col, text_col).groupBy(F.col("first.id").alias("_id"), F.col("first.tie").alias("_tie")).agg(
        F.collect_list(F.when(~F.col("near"), F.col("first.no"))).alias("kept"), F.sum(F.col("near").cast("bigint")).alias("near"))
    both = sizes.join(kept, sizes.id.eqNullSafe(kept["_id"]) & (sizes.tie == kept["_tie"]), "left")
    none = F.array().cast("array<int>")
    return both.select("id", "tie", "n", F.coalesce("kept", none).alias("kept"), F.coalesce("near", F.lit(0)).alias("near")).filter(
        F.size("kept") < F.col("n")).drop("n")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counted: bool = False) -> DataFrame:
    """The rows with their texts cut down to the lines that stay (lines without a character stay too).

    Only documents that may lose a line are moved; the others are sent on from where they are read. With `counted` the
    result is (row, counts): the row, and n_lines, n_kept, n_exact and n_near, of lines with a character.
    """
    losses = written(_losses(docs, id_col, text_col), "losses")
    code = F.xxhash64("id", "tie")
    hit = key_filter(losses.select(code.alias("code")), "code", "losers")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct("*").alias("row"), text.alias("own"), F.col(id_col).alias("id"), F.xxhash64(text).alias("tie")).withColumn("code", code)
    marked = marked_in(rows, "code", hit, "hit")
    zero = F.lit(0).cast("bigint")
    stay = marked.filter(~F.col("hit")).select("row", F.struct(
        _line_number(F.col("own")).alias("n_lines"), _line_number(F.col("own")).alias("n_kept"), zero.alias("n_exact"),
        zero.alias("n_near")).alias("counts"))
    other = losses.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), "kept", "near")
    # split behind the join, so that a text is moved once
    moved = marked.filter("hit").select("row", "id", "tie").join(
        other, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left").select(
        "row", "kept", "near", F.split(F.col("row")[text_col].cast("string"), "\n").alias("all"))
    blank = F.filter(F.transform("all", lambda line, no: F.when(F.trim(line) == "", no)), lambda no: no.isNotNull())
    numbered = moved.select("row", "kept", "near", "all", F.coalesce(blank, F.array().cast("array<int>")).alias("blank"))
    stays = F.transform(F.array_sort(F.concat("kept", "blank")), lambda no: F.get("all", no))
    cut = F.when(F.col("kept").isNotNull(), F.array_join(stays, "\n")).otherwise(F.array_join("all", "\n"))
    lines = F.coalesce(F.size("all") - F.size("blank"), F.lit(0)).cast("bigint")
    kept = F.coalesce(F.size("kept"), lines).cast("bigint")
    near = F.coalesce("near", F.lit(0))
    done = numbered.select(F.col("row").withField(f"`{text_col}`", cut).alias("row"), F.struct(
        lines.alias("n_lines"), kept.alias("n_kept"), (lines - kept - near).alias("n_exact"), near.alias("n_near")).alias("counts"))
    stay = stay.select(F.col("row").withField(f"`{text_col}`", F.col("row")[text_col].cast("string")).alias("row"), "counts")
    result = stay.union(done)
    return result if counted else result.select("row.*")


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_kept, n_exact and n_near of every row; lines with a character only."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return deduplicated(narrow, "id", "text", counted=True).select(F.col("row.id").alias("id"), "counts.*")
