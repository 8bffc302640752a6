"""Evidence extraction: vocabulary phrases quoted from narratives with offsets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.functions.numbers import round_even
from narrascope.functions.text import bound, strip, usable_text
from narrascope.operators.ordering import dense_index
from narrascope.operators.skew import lookup_join, small
from narrascope.schemas import EVIDENCE_FIELDS, UNKNOWN
from narrascope.session import written

# letters whose lower case is not one equal-length letter, or that match others ignoring case
FOLDING = ("İ", "ı", "ſ")
GUARD_LETTERS = 4  # shorter words occur in most texts
NO_HITS = "array<struct<category:string,phrase:string,at:int>>"

LITERAL_PHRASES = 200  # longer vocabularies are searched through an index
GRAM = 3  # letters of the pieces by which short phrases find the words that may hold them

Vocabulary = dict[str, list[tuple[str, list[str]]]]


def load_vocabulary(table: DataFrame, limit: int = LITERAL_PHRASES) -> Vocabulary | DataFrame:
    """Field -> ordered categories -> ordered phrases, from a vocabulary table.

    A short, hand-kept word list becomes a literal of the plan; beyond `limit` phrases the
    table itself is returned, which every function here takes too and searches through an index.
    """
    rows = table.orderBy("field", "category_order", "phrase_order").limit(limit + 1).collect()
    if len(rows) > limit:
        return table
    vocabulary: Vocabulary = {}
    for row in rows:
        categories = vocabulary.setdefault(row["field"], [])
        if not categories or categories[-1][0] != row["category"]:
            categories.append((row["category"], []))
        categories[-1][1].append(row["phrase"])
    return vocabulary


def vocabulary_from_taxonomy(rules: DataFrame, field: str = "barrier") -> DataFrame:
    """Vocabulary rows from taxonomy examples (rule_id, "; "-joined barrier_examples)."""
    parts = rules.select(
        "rule_id", F.posexplode(F.split("barrier_examples", "; ")).alias("phrase_order", "phrase"))
    ordered = dense_index(rules.select("rule_id").distinct(), [F.col("rule_id")], "category_order", "rule-order")
    return lookup_join(parts.filter("phrase <> ''"), ordered, ["rule_id"], F.xxhash64("rule_id", "phrase_order")).select(
        F.lit(field).alias("field"), F.col("category_order").cast("int").alias("category_order"), F.col("rule_id").alias("category"),
        "phrase_order", "phrase")


def _guards(vocabulary: Vocabulary) -> dict[str, str]:
    """Lowered phrase -> the part of it that is searched first.

    A text without the guard cannot hold the phrase, so phrases that share a word are
    searched only in texts that hold the word. Words are given out from the one that
    most phrases share; a phrase that shares none guards itself.
    """
    open_phrases = {p.lower() for categories in vocabulary.values() for _, phrases in categories for p in phrases}
    guards: dict[str, str] = {}
    while open_phrases:
        shared = Counter(word for phrase in open_phrases for word in set(phrase.split()) if len(word) >= GUARD_LETTERS)
        word, times = max(shared.items(), key=lambda item: (item[1], len(item[0]), item[0]), default=("", 0))
        if times < 2:
            break
        held = {phrase for phrase in open_phrases if word in phrase.split()}
        guards.update(dict.fromkeys(held, word))
        open_phrases -= held
    return guards | {phrase: phrase for phrase in open_phrases}


def _literal(categories: list[tuple[str, list[str]]], place: Callable[[str], int]) -> Column:
    """array<struct<category, array<struct<phrase, lowered, guard>>>> as a literal; `guard` is a place in a list."""
    return F.array(*[
        F.struct(
            F.lit(category).alias("category"),
            F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(p.lower()).alias("lowered"), F.lit(place(p)).alias("guard"))
                      for p in phrases]).alias("phrases"))
        for category, phrases in categories])


def _pattern(phrase: Column) -> Column:
    return F.concat(F.lit("(?iu)\\Q"), phrase, F.lit("\\E"))


def _folds(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(letter)) for letter in FOLDING])


def _search(literal: Column, present: Callable[[Column], Column],
            position: Callable[[Column], Column]) -> Column:
    """array<struct<category, phrase, at>> with one entry per category that occurs.

    The phrase is the category's first in vocabulary order that occurs, and
    `at` its 1-based first position.
    """
    def first(entry: Column) -> Column:
        return bound(F.get(F.filter(entry["phrases"], present), F.lit(0)), lambda found: F.struct(
            entry["category"].alias("category"), found["phrase"].alias("phrase"), position(found).alias("at")))

    return F.filter(F.transform(literal, first), lambda hit: hit["phrase"].isNotNull())


def _all_hits(text: Column, wanted: dict[str, Column], vocabulary: Vocabulary) -> Column:
    """struct<field: hits> for the fields that are wanted on the row.

    The text is lowered once per row for all fields; texts with letters that
    fold unusually take the slower regular-expression route.
    """
    nothing = F.array().cast(NO_HITS)
    guards = _guards({field: vocabulary[field] for field in wanted})
    words = sorted(set(guards.values()))
    places = {word: i for i, word in enumerate(words)}

    def every(present, position) -> Column:
        return F.struct(*[F.when(open_field, _search(
            _literal(vocabulary[field], lambda p: places[guards[p.lower()]]), present, position))
            .otherwise(nothing).alias(field) for field, open_field in wanted.items()])

    def guarded(low: Column) -> Column:
        held = F.transform(F.array(*[F.lit(word) for word in words]), lambda word: F.contains(low, word))
        return bound(held, lambda flags: every(
            lambda p: F.get(flags, p["guard"]) & F.contains(low, p["lowered"]), lambda p: F.instr(low, p["lowered"])))

    plain = bound(F.lower(text), guarded)
    folded = every(lambda p: F.regexp_like(text, _pattern(p["phrase"])),
                   lambda p: F.regexp_instr(text, _pattern(p["phrase"])))
    return F.when(_folds(text), folded).otherwise(plain)


def folded(text: Column) -> Column:
    """The text in lower case, letter for letter, the unusual ones as the letters that they match ignoring case.

    `translate` goes letter by letter and costs far more than the search for the three, so only texts that hold one take it.
    """
    return F.lower(F.when(_folds(text), F.translate(text, "".join(FOLDING), "iis")).otherwise(text))


def _grams(word: Column, size: int = GRAM) -> Column:
    """Different pieces of `size` letters of a word, and the word itself if it is shorter."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(word) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(word, i, F.lit(size))))


def _rarest(numbered: DataFrame, frequencies: DataFrame, token: str) -> DataFrame:
    """The least frequent of a phrase's tokens in the texts: (no, token). One that no text has is rarest of all."""
    known = numbered.join(frequencies, token, "left")
    order = F.struct(F.coalesce("n", F.lit(0)), -F.char_length(token), token)
    return known.groupBy("no").agg(F.min_by(token, order).alias(token))


def _fitting(table: DataFrame) -> DataFrame:
    """The table, to be broadcast while it is small."""
    return F.broadcast(table) if small(table) else table


def _among(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Rows whose value is among the wanted ones; they are not moved while these fit a broadcast."""
    return rows.join(_fitting(wanted.select(name).distinct()), name, "left_semi")


def phrase_index(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, nos: phrases that a text with this token may hold): an inverted index of the phrases over a table of the
    texts' tokens (token, n). Tokens are what single spaces part.

    A phrase of three tokens or more holds its inner ones whole, so its rarest inner token stands for it. Of a shorter
    phrase any token of a text may hold a piece: its own word inside, its first one at the end, or its last one at the
    beginning. These tokens are found among the different tokens through pieces of three letters, again by the rarest.
    Tokens are cut to pieces once, and only pieces that a phrase has are kept.
    """
    split = vocabulary.select("no", F.split("low", " ").alias("parts"))
    long = split.filter(F.size("parts") > 2).select(
        "no", F.explode(F.array_distinct(F.slice("parts", F.lit(2), F.size("parts") - 2))).alias("token"))
    whole = _rarest(long, _among(tokens, long, "token"), "token")
    # of two tokens the longer one is looked for, where it touches the space
    first, last = F.get("parts", F.lit(0)), F.get("parts", F.size("parts") - 1)
    ahead = F.char_length(first) >= F.char_length(last)
    short = split.filter(F.size("parts") <= 2).select(
        "no", F.when(ahead, first).otherwise(last).alias("piece"),
        F.when(F.size("parts") == 1, "inside").when(ahead, "end").otherwise("start").alias("side"))
    keyed = short.filter(F.char_length("piece") >= GRAM)
    pieces = keyed.select("no", F.explode(_grams(F.col("piece"))).alias("gram"))
    words = written(_among(tokens.select("token", F.explode(_grams(F.col("token"))).alias("gram")), pieces, "gram"), "grams")
    key = _rarest(pieces, words.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram")
    token, piece, side = F.col("token"), F.col("piece"), F.col("side")
    holds = (F.when(side == "inside", F.contains(token, piece)).when(side == "end", F.endswith(token, piece))
             .otherwise(F.startswith(token, piece)))
    found = words.join(_fitting(written(keyed.join(key, "no"), "keys")), "gram").filter(holds).select("token", "no")
    # pieces of one or two letters (few, and in nearly every text) are compared with the words themselves
    tiny = short.filter(F.char_length("piece") < GRAM)
    ends = F.array(*[F.substring(token, at, size) for at, size in ((1, 1), (1, 2), (-1, 1), (-2, 2))], F.lit(""))
    sides = [(tiny.filter(side != "inside"), ends), (tiny.filter(side == "inside"), F.concat(_grams(token, 1), _grams(token, 2), F.array(F.lit(""))))]
    for some, cut in sides:
        if not some.isEmpty():
            found = found.union(tokens.select("token", F.explode(F.array_distinct(cut)).alias("piece"))
                                .join(_fitting(some), "piece").filter(holds).select("token", "no"))
    return whole.select("token", "no").union(found).distinct().groupBy("token").agg(F.collect_list("no").alias("nos"))


def indexed_hits(df: DataFrame, vocabulary: DataFrame, text: str) -> DataFrame:
    """The rows with `_candidates`: the phrases of a vocabulary table that their text may hold, in vocabulary order, each
    with its lower-case form. Texts without a candidate are not moved while the candidates fit a broadcast.
    """
    numbered = written(dense_index(
        vocabulary.select("field", "category_order", "category", "phrase_order", "phrase").distinct(),
        [F.col(c) for c in ("field", "category_order", "phrase_order", "category", "phrase")], "no", "vocabulary")
        .withColumn("low", folded(F.col("phrase"))), "phrases")
    body = F.col(text)
    each = df.filter(usable_text(body)).select(F.xxhash64(body).alias("key"), F.explode(F.array_distinct(F.split(folded(body), " "))).alias("token"))
    tokens = written(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "tokens")
    index = written(phrase_index(numbered, tokens), "index")
    met = lookup_join(each, index, ["token"], F.col("key")).filter(F.col("nos").isNotNull()).select("key", F.explode("nos").alias("no")).distinct()
    phrases = numbered.select("no", F.struct("no", "field", "category", "phrase", "low").alias("entry"))
    of_text = lookup_join(met, phrases, ["no"], F.col("key")).groupBy("key").agg(F.sort_array(F.collect_list("entry")).alias("_candidates"))
    keyed = df.withColumn("_text_key", F.xxhash64(body))
    return lookup_join(keyed, written(of_text.withColumnRenamed("key", "_text_key"), "candidates"), ["_text_key"], F.col("_text_key")).drop("_text_key")


def _verified(text: Column) -> Column:
    """The candidates that the text holds: array<struct<field, category, phrase, at>>, in vocabulary order."""
    return bound(folded(text), lambda low: F.transform(
        F.filter(F.coalesce(F.col("_candidates"), F.array().cast("array<struct<no:bigint,field:string,category:string,phrase:string,low:string>>")),
                 lambda e: F.contains(low, e["low"])),
        lambda e: F.struct(e["field"].alias("field"), e["category"].alias("category"), e["phrase"].alias("phrase"),
                           F.instr(low, e["low"]).alias("at"))))


def _first_of_category(hits: Column) -> Column:
    """The first hit of every run of one category."""
    new = lambda e, i: (i == 0) | (e["category"] != F.get(hits, i - 1)["category"])
    return F.transform(F.filter(hits, new), lambda e: F.struct(e["category"].alias("category"), e["phrase"].alias("phrase"), e["at"].alias("at")))


def _indexed_struct(text: Column, wanted: dict[str, Column]) -> Column:
    """As `_all_hits`, from the candidates of the row."""
    nothing = F.array().cast(NO_HITS)

    def of_field(hits: Column, field: str) -> Column:
        return bound(F.filter(hits, lambda e: e["field"] == field), _first_of_category)

    return bound(_verified(text), lambda hits: F.struct(*[
        F.when(open_field, of_field(hits, field)).otherwise(nothing).alias(field) for field, open_field in wanted.items()]))


def _span(text: Column, hit: Column) -> Column:
    return F.substring(text, hit["at"], F.length(hit["phrase"]))


def _status(open_field: Column, usable: Column, hits: Column) -> Column:
    return (F.when(usable & ~open_field, "skipped")
            .when(~usable & ~open_field, "filled_unusable")
            .when(~usable | (F.size(hits) == 0), "unknown")
            .when(F.size(hits) == 1, "matched").otherwise("ambiguous"))


def extract_evidence(df: DataFrame, vocabulary: Vocabulary | DataFrame, text: str = "narrative_text",
                     fields: tuple[str, ...] = EVIDENCE_FIELDS, keep_hits: bool = False) -> DataFrame:
    """Fill UNKNOWN fields from a single matching category, with quoted evidence.

    A known value is never overwritten; several categories leave the field
    open. Each field gains _evidence_span, _evidence_start (0-based),
    _evidence_end and _status. With a literal vocabulary one narrow pass: no shuffle, no UDF. A
    vocabulary table of any size is searched through an inverted index, with equal results.
    """
    body = F.col(text)
    indexed = isinstance(vocabulary, DataFrame)
    if indexed:
        df = indexed_hits(df, vocabulary, text)
    values = {field: strip(F.coalesce(F.col(field), F.lit(""))) for field in fields}
    plan = df.withColumn("_usable", usable_text(body)).withColumns(
        {f"_{field}_open": (value == "") | (value == UNKNOWN) for field, value in values.items()})
    wanted = {field: F.col("_usable") & F.col(f"_{field}_open") for field in fields}
    plan = plan.withColumn("_hits", _indexed_struct(body, wanted) if indexed else _all_hits(body, wanted, vocabulary))
    plan = plan.withColumns({f"_{field}_hits": F.col(f"_hits.{field}") for field in fields})
    plan = plan.withColumns({f"{field}_status": _status(
        F.col(f"_{field}_open"), F.col("_usable"), F.col(f"_{field}_hits")) for field in fields})
    for field in fields:
        hit = F.get(F.col(f"_{field}_hits"), F.lit(0))
        matched = F.col(f"{field}_status") == "matched"
        start = F.when(matched, hit["at"] - 1)
        plan = plan.withColumns({
            field: F.when(matched, hit["category"]).otherwise(F.col(field)),
            f"{field}_evidence_span": F.when(matched, _span(body, hit)),
            f"{field}_evidence_start": start,
            f"{field}_evidence_end": start + F.length(hit["phrase"])})
    plan = plan.drop("_hits", "_usable", "_candidates", *[f"_{field}_open" for field in fields])
    return plan if keep_hits else plan.drop(*[f"_{field}_hits" for field in fields])


def ambiguous_matches(df: DataFrame, vocabulary: Vocabulary | DataFrame, row_id: str = "record_id",
                      dataset: str = "source_dataset", text: str = "narrative_text",
                      fields: tuple[str, ...] = EVIDENCE_FIELDS) -> DataFrame:
    """Long log of fields with several matching categories."""
    extracted = extract_evidence(df, vocabulary, text, fields, keep_hits=True)
    body = F.col(text)
    entries = F.array(*[F.struct(
        F.lit(field).alias("field"), F.col(f"{field}_status").alias("status"),
        F.transform(F.col(f"_{field}_hits"), lambda h: h["category"]).alias("categories"),
        F.transform(F.col(f"_{field}_hits"), lambda h: F.concat(
            F.lit("'"), _span(body, h), F.lit("'"))).alias("spans")) for field in fields])
    long = extracted.select(row_id, dataset, F.explode(
        F.filter(entries, lambda e: e["status"] == "ambiguous")).alias("e"))
    return long.select(
        row_id, dataset, "e.field", F.array_join("e.categories", "|").alias("matched_categories"),
        F.array_join("e.spans", "|").alias("matched_spans"))


def vocabulary_matches(df: DataFrame, vocabulary: Vocabulary | DataFrame, row_id: str = "record_id",
                       text: str = "narrative_text") -> DataFrame:
    """Every (row, phrase) that occurs, long form: the audit of the extraction.

    Phrases are tested in place and only those found become rows.
    """
    if isinstance(vocabulary, DataFrame):
        held = indexed_hits(df, vocabulary, text).filter(usable_text(F.col(text)))
        return held.select(row_id, F.inline(_verified(F.col(text)))).select(row_id, "field", "category", "phrase")
    guards = _guards(vocabulary)
    words = sorted(set(guards.values()))
    places = {word: i for i, word in enumerate(words)}
    entries = F.array(*[
        F.struct(F.lit(field).alias("field"), F.lit(category).alias("category"), F.lit(phrase).alias("phrase"),
                 F.lit(phrase.lower()).alias("lowered"), F.lit(places[guards[phrase.lower()]]).alias("guard"))
        for field, categories in vocabulary.items() for category, phrases in categories for phrase in phrases])
    body = F.col(text)

    def guarded(low: Column) -> Column:
        held = F.transform(F.array(*[F.lit(word) for word in words]), lambda word: F.contains(low, word))
        return bound(held, lambda flags: F.filter(
            entries, lambda e: F.get(flags, e["guard"]) & F.contains(low, e["lowered"])))

    plain = bound(F.lower(body), guarded)
    folded = F.filter(entries, lambda e: F.regexp_like(body, _pattern(e["phrase"])))
    found = F.when(_folds(body), folded).otherwise(plain)
    return df.filter(usable_text(body)).select(row_id, F.explode(found).alias("m")).select(
        row_id, "m.field", "m.category", "m.phrase")


def match_rate_report(extracted: DataFrame, dataset: str = "source_dataset",
                      fields: tuple[str, ...] = EVIDENCE_FIELDS) -> DataFrame:
    """Matched, ambiguous, skipped and unknown counts per field and source.

    The row with a null source is the field's total. One row per (source,
    statuses) leaves each task, whatever the number of narratives.
    """
    names = [f"{field}_status" for field in fields]
    long = (extracted.groupBy(dataset, *names).agg(F.count(F.lit(1)).alias("n"))
            .unpivot([dataset, "n"], names, "status_column", "status"))
    field = F.regexp_replace("status_column", "_status$", "")
    kinds = ("matched", "ambiguous", "skipped", "unknown")
    counted = long.select(dataset, field.alias("field"), "n", "status").groupBy("field", dataset).agg(
        *[F.sum(F.when(F.col("status") == kind, F.col("n")).otherwise(0)).alias(kind) for kind in kinds])
    report = counted.groupingSets([["field", dataset], ["field"]], "field", dataset).agg(
        *[F.sum(kind).alias(kind) for kind in kinds])
    total = F.col("matched") + F.col("ambiguous") + F.col("skipped") + F.col("unknown")
    return report.withColumn("total", total).withColumn(
        "match_pct", F.when(total > 0, round_even(100.0 * F.col("matched") / total, 2)))
