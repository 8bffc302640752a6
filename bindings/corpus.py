"""Corpus audit, duplicates, evidence and splits."""

from pyspark.sql import functions as F

from bindings.columns import SQL_MALFORMED, SQL_MESSY, SQL_PII, SQL_WORDS, messy, sql_norm, sql_strip
from bindings.registry import query
from bindings.views import Tables, sql_text
from narrascope.functions.text import normalize_text
from narrascope.operators import duplicates as D
from narrascope.operators import evidence as V
from narrascope.operators import identity as I
from narrascope.operators import quality as Q
from narrascope.operators import sketches as K
from narrascope.operators import splits as S
from narrascope.operators.ordering import dense_index
from narrascope.schemas import EVIDENCE_FIELDS
from narrascope.session import new_scratch, written

N = ("narratives",)


def pct(part: str, whole: str, digits: int = 1) -> str:
    return f"round_even(100.0::DOUBLE * {part} / {whole}, {digits})"


# --- audit --------------------------------------------------------------------

@query("drop_empty_narratives", f"""
SELECT source, count(*) AS rows_read, count(*) FILTER (WHERE NOT blank) AS rows_kept, count(*) FILTER (WHERE blank) AS rows_dropped
FROM (SELECT source, coalesce({sql_strip('value')}, '') = '' AS blank FROM (SELECT source, {SQL_MESSY} AS value FROM documents)) GROUP BY 1""")
def _(t: Tables):
    return Q.empty_report(messy(t), "source", "value")


@query("value_counts", f"""
WITH long AS (SELECT 'industry_domain' AS column_name, industry_domain AS value FROM narratives
  UNION ALL SELECT 'sif_potential', sif_potential FROM narratives UNION ALL SELECT 'is_synthetic', CAST(is_synthetic AS VARCHAR) FROM narratives)
SELECT column_name, value, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM narratives)')} AS pct FROM long GROUP BY 1, 2""", N)
def _(t):
    return Q.value_counts(t.narratives, ["industry_domain", "sif_potential", "is_synthetic"])


@query("top_k_values", f"""
SELECT CAST(l_quantity AS BIGINT)::VARCHAR AS value, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM lineitem)')} AS pct
FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def _(t):
    return Q.top_values(t.lineitem.select(F.col("l_quantity").cast("bigint").alias("code")), "code", 10)


@query("column_cardinality", f"""
WITH long AS (SELECT 'lang' AS column_name, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents
  UNION ALL SELECT 'text', md5(text) FROM documents),
c AS (SELECT column_name, value, count(*) AS n FROM long GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value DESC) AS rn, count(*) OVER (PARTITION BY column_name) AS d FROM c)
SELECT column_name, d AS distinct_values, value AS top_value, n AS top_n, {pct('n', '(SELECT count(*) FROM documents)')} AS top_pct FROM r WHERE rn = 1""")
def _(t):
    return Q.cardinality(t.documents.withColumn("text", F.md5("text")), ["lang", "source", "text"])


@query("length_stats", f"""
SELECT source_dataset, count(*) FILTER (WHERE ok) AS rows_used, count(*) FILTER (WHERE NOT ok) AS rows_excluded,
  round_even(avg(w) FILTER (WHERE ok), 1) AS mean_words, median(w) FILTER (WHERE ok) AS median_words,
  CAST(min(w) FILTER (WHERE ok) AS INT) AS min_words, CAST(max(w) FILTER (WHERE ok) AS INT) AS max_words
FROM (SELECT source_dataset, {SQL_WORDS} AS w, NOT {SQL_MALFORMED} AS ok FROM narratives) GROUP BY 1""", N)
def _(t):
    return Q.length_stats(t.narratives, "source_dataset", "narrative_text")


@query("composition_report", f"""
WITH n AS (SELECT source_dataset, CASE industry_domain WHEN 'en' THEN 'oil_and_gas' ELSE industry_domain END AS industry_domain, is_synthetic FROM narratives)
SELECT source_dataset, industry_domain, count(*) AS n_rows, count(*) FILTER (WHERE is_synthetic) AS synthetic_rows,
  count(*) FILTER (WHERE NOT is_synthetic) AS real_rows, count(*) FILTER (WHERE regexp_matches(lower(industry_domain), 'oil|gas|hazmat|pipeline')) AS relevant_rows,
  {pct('count(*)', '(SELECT count(*) FROM n)')} AS pct_of_total
FROM n GROUP BY ROLLUP (source_dataset, industry_domain)""", N)
def _(t):
    domain = F.when(F.col("industry_domain") == "en", "oil_and_gas").otherwise(F.col("industry_domain"))
    return Q.composition(t.narratives.withColumn("industry_domain", domain))


@query("real_contribution", f"""
SELECT source_dataset, count(*) FILTER (WHERE NOT is_synthetic) AS real_rows,
  {pct('count(*) FILTER (WHERE NOT is_synthetic)', '(SELECT count(*) FROM narratives WHERE NOT is_synthetic)')} AS pct_of_real
FROM narratives GROUP BY 1""", N)
def _(t):
    return Q.real_contribution(t.narratives)


@query("severity_flags", f"""
WITH x AS (SELECT l_returnflag = 'R' AS a, l_quantity <> 0 AND l_linestatus = 'O' AS b FROM lineitem)
SELECT 'hospitalized' AS flag, count(*) AS total, count(*) FILTER (WHERE a) AS positive, {pct('count(*) FILTER (WHERE a)', 'count(*)')} AS pct FROM x
UNION ALL SELECT 'amputation', count(*), count(*) FILTER (WHERE b), {pct('count(*) FILTER (WHERE b)', 'count(*)')} FROM x""")
def _(t):
    flags = t.lineitem.select(
        F.when(F.col("l_returnflag") == "R", "Yes").when(F.col("l_returnflag") == "A", " No ").otherwise("0").alias("hospitalized"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("string")).alias("amputation"))
    return Q.severity_flags(flags, ["hospitalized", "amputation"])


@query("nonzero_stats", """
WITH x AS (SELECT CASE l_returnflag WHEN 'R' THEN CAST(l_quantity AS BIGINT) WHEN 'A' THEN 0 END AS v FROM lineitem)
SELECT count(v) AS parsed, count(*) FILTER (WHERE v > 0) AS positive, count(*) FILTER (WHERE v = 0) AS zeros,
  round_even(avg(v) FILTER (WHERE v > 0), 2) AS mean_nonzero, median(v) FILTER (WHERE v > 0) AS median_nonzero,
  min(v) FILTER (WHERE v > 0) AS min_nonzero, max(v) FILTER (WHERE v > 0) AS max_nonzero FROM x""")
def _(t):
    flag = F.col("l_returnflag")
    raw = (F.when(flag == "R", F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(" ")))
           .when(flag == "A", "0").otherwise("n/a"))
    return Q.nonzero_stats(t.lineitem.select(raw.alias("injuries")), "injuries")


@query("crosstab", """
SELECT activity, count(*) FILTER (WHERE sif_potential = 'Yes') AS "Yes", count(*) FILTER (WHERE sif_potential = 'No') AS "No",
  count(*) FILTER (WHERE sif_potential = 'NEEDS_REVIEW') AS "NEEDS_REVIEW" FROM reports GROUP BY 1""", ("reports",))
def _(t):
    return Q.crosstab(t.reports, "activity", "sif_potential", ["Yes", "No", "NEEDS_REVIEW"])


@query("label_leakage", """
SELECT reporter_id, count(*) AS n, min(sif_potential) AS only_label FROM reports GROUP BY 1 HAVING count(DISTINCT sif_potential) = 1""", ("reports",))
def _(t):
    return Q.label_leakage(t.reports, "reporter_id", "sif_potential")


MISSING = ("doc_id", "lang", "value")


@query("missingness", "WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN lang = 'en' THEN 'UNKNOWN' ELSE lang END AS lang, " + SQL_MESSY + " AS value FROM documents)\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
    f"count(*) FILTER (WHERE lower({sql_strip(c)}) IN ('', 'nan', 'none')) AS blanks, "
    f"count(*) FILTER (WHERE {sql_strip(c)} = 'UNKNOWN') AS sentinels FROM m" for c in MISSING))
def _(t):
    shown = messy(t).withColumn("lang", F.when(F.col("lang") == "en", "UNKNOWN").otherwise(F.col("lang")))
    return Q.missingness(shown, list(MISSING))


@query("year_histogram", """
SELECT source, CASE WHEN status = 'Submitted' THEN NULL ELSE CAST(year(ts) AS INT) END AS year, count(*) AS n FROM reports GROUP BY 1, 2""", ("reports",))
def _(t):
    date = F.when(F.col("status") == "Submitted", "not a date").otherwise(F.col("ts").cast("string"))
    return Q.year_histogram(t.reports.withColumn("date", date), "source", "date")


@query("label_join", "SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'No' WHEN 0 THEN 'Yes' END, 'UNKNOWN') AS sif_potential FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    labels = t.labels.select("doc_id", F.when(F.col("quality") == 1, "No").otherwise("Yes").alias("sif_potential"))
    return Q.label_join(t.documents.select("doc_id"), labels, "doc_id", "sif_potential")


@query("assert_unique", """
SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    D.assert_unique(t.narratives, "record_id")
    return D.repeated_keys(t.part.select(F.col("p_name").alias("name")), "name")


# --- duplicates and ids -------------------------------------------------------

# page hosts repeat, so pages give larger duplicate groups than the documents do
GROUPS = f"""keyed AS (SELECT {{key}}, {{ds}} AS ds, concat({{ds}}, '||', {{norm}}) AS k FROM {{table}}),
multi AS (SELECT k, row_number() OVER (ORDER BY k) AS g FROM (SELECT k FROM keyed GROUP BY 1 HAVING count(*) > 1))"""
DOC_GROUPS = GROUPS.format(key="record_id, doc_id", ds="source_dataset", norm=sql_norm("narrative_text"), table="narratives")
# names of parts repeat within a type
PART_GROUPS = GROUPS.format(key="p_partkey", ds="p_type", norm=sql_norm("p_name"), table="part")


@query("duplicate_groups", f"WITH {DOC_GROUPS} SELECT record_id, ds AS source_dataset, CAST(coalesce(g, 0) AS INT) AS is_duplicate_group_id FROM keyed LEFT JOIN multi USING (k)", N)
def _(t):
    return D.duplicate_groups(t.narratives).withColumn("is_duplicate_group_id", F.col("is_duplicate_group_id").cast("int"))


@query("duplicate_summary", f"""
WITH {PART_GROUPS} SELECT ds AS p_type, count(*) AS duplicate_rows, count(DISTINCT k) AS duplicate_groups
FROM keyed JOIN multi USING (k) GROUP BY ROLLUP (ds)""")
def _(t):
    return D.duplicate_summary(D.duplicate_groups(t.part, "p_type", "p_name", "p_partkey"), "p_type")


@query("flag_quality", f"""
WITH {DOC_GROUPS} SELECT n.record_id, CAST(coalesce(g, 0) AS INT) AS is_duplicate_group_id, {SQL_MALFORMED} AS is_empty_or_malformed, {SQL_PII} AS has_possible_pii
FROM narratives n JOIN keyed k USING (record_id) LEFT JOIN multi m ON m.k = k.k""", N)
def _(t):
    return D.flag_quality(t.narratives).select(
        "record_id", F.col("is_duplicate_group_id").cast("int").alias("is_duplicate_group_id"), "is_empty_or_malformed", "has_possible_pii")


@query("duplicate_size_histogram", """
SELECT group_size, count(*) AS groups, count(*) * group_size AS covered_rows
FROM (SELECT p_name, count(*) AS group_size FROM part GROUP BY 1) GROUP BY 1""")
def _(t):
    return D.size_histogram(t.part, F.col("p_name"))


@query("duplicate_label_conflicts", f"""
SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS covered_rows, count(*) FILTER (WHERE labels > 1) AS label_conflicts, count(*) FILTER (WHERE sources > 1) AS cross_source_groups
FROM (SELECT {sql_norm('narrative_text')} AS k, count(*) AS n, count(DISTINCT sif_potential) AS labels, count(DISTINCT source_dataset) AS sources FROM narratives GROUP BY 1 HAVING count(*) > 1)""", N)
def _(t):
    return D.label_conflicts(t.narratives, normalize_text(F.col("narrative_text")), "sif_potential", "source_dataset")


@query("dedupe_ids", """
SELECT event_id, CASE WHEN rn = 1 THEN k ELSE concat(k, '_dup', CAST(rn - 1 AS VARCHAR)) END AS record
FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS k, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rn FROM events)""")
def _(t):
    rows = t.events.select("event_id", "event_type", F.col("user_id").cast("string").alias("user"))
    return I.dedupe_ids(rows, "event_type", "user", "event_id", "record").select("event_id", "record")


@query("row_index_ids", """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY source_dataset ORDER BY doc_id) - 1 AS VARCHAR) AS source_record_id FROM narratives""", N)
def _(t):
    return I.row_index_ids(t.narratives.select("doc_id", "source_dataset"), "source_dataset", "doc_id",
                           "source_record_id").select("doc_id", "source_record_id")


@query("phmsa_fallback_id", """
SELECT event_id, CASE WHEN event_type = 'error' THEN concat('phmsa_', CAST(row_number() OVER (ORDER BY event_id) - 1 AS VARCHAR)) ELSE CAST(user_id AS VARCHAR) END AS record FROM events""")
def _(t):
    known = F.when(F.col("event_type") != "error", F.col("user_id").cast("string"))
    return I.fallback_ids(t.events, known, "event_id", "record").select("event_id", "record")


@query("sequential_report_id", """
SELECT block, pos, concat('OIL-', CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE CAST(n AS VARCHAR) END) AS report_id
FROM (SELECT *, row_number() OVER (ORDER BY block, pos) AS n FROM (
  SELECT 0 AS block, c_custkey AS pos FROM customer UNION ALL SELECT 1, o_orderkey FROM orders))""")
def _(t):
    rows = t.customer.select(F.lit(0).alias("block"), F.col("c_custkey").alias("pos")).unionByName(
        t.orders.select(F.lit(1).alias("block"), F.col("o_orderkey").alias("pos")))
    return I.sequential_ids(rows, "block", "pos", "report_id")


# --- evidence -----------------------------------------------------------------

# a vocabulary of words that occur in the invented prose of the documents
VOCABULARY = {
    "unsafe_act": [("overriding", ["annd", "Reon the", "anhe"]), ("entering", ["mentou", "oivieau"])],
    "unsafe_condition": [("leaking", ["thining", "erheor"]), ("corroded", ["ERNTHA", "ungsch"]), ("blocked", ["treque", "forrendsten"])],
    "barrier": [("permit", ["erreble", "rement"]), ("guard", ["doción", "thanha"])],
    "potential_consequence": [("fall", ["the", "von"]), ("fire", ["zzqq", "réaux"])],
}
PHRASES = ",\n  ".join(
    f"({sql_text(field)}, {c}, {sql_text(category)}, {p}, {sql_text(phrase)})"
    for field, categories in VOCABULARY.items() for c, (category, phrases) in enumerate(categories)
    for p, phrase in enumerate(phrases))
VOCAB_SQL = f"""vocab(field, cat_ord, category, phrase_ord, phrase) AS (VALUES
  {PHRASES}),
m AS (SELECT n.record_id, n.source_dataset, v.*, instr(lower(n.narrative_text), lower(v.phrase)) AS pos, n.narrative_text
  FROM narratives n, vocab v WHERE contains(lower(n.narrative_text), lower(v.phrase))
    AND {sql_strip('n.narrative_text')} <> '' AND upper({sql_strip('n.narrative_text')}) <> 'UNKNOWN')"""
FIRST_SQL = f"""{VOCAB_SQL},
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, field, category ORDER BY phrase_ord) AS rn FROM m)
  WHERE rn = 1 AND NOT (field = 'unsafe_act' AND record_id IN (SELECT record_id FROM narratives WHERE is_synthetic))),
per AS (SELECT record_id, field, count(*) AS cats, min(category) AS category, min(pos) AS pos, min(phrase) AS phrase,
  min(substring(narrative_text, pos, length(phrase))) AS span FROM hits GROUP BY 1, 2)"""


def open_master(t: Tables):
    """Narratives with the four fields open, except a known act on synthetic rows."""
    unknown = F.lit("UNKNOWN")
    return t.narratives.withColumns({
        "unsafe_act": F.when(F.col("is_synthetic"), "known act").otherwise(unknown), "unsafe_condition": unknown,
        "barrier": F.lit(""), "potential_consequence": unknown})


def _evidence_sql() -> str:
    selects = []
    for field in EVIDENCE_FIELDS:
        start = {"unsafe_act": "CASE WHEN n.is_synthetic THEN 'known act' ELSE 'UNKNOWN' END", "barrier": "''"}.get(field, "'UNKNOWN'")
        skipped = "n.is_synthetic" if field == "unsafe_act" else "false"
        selects.append(f"""SELECT n.record_id, n.source_dataset, '{field}' AS field,
  CASE WHEN p.cats = 1 THEN p.category ELSE {start} END AS value,
  CASE WHEN p.cats = 1 THEN p.span END AS span, CASE WHEN p.cats = 1 THEN CAST(p.pos - 1 AS INT) END AS start_at,
  CASE WHEN p.cats = 1 THEN CAST(p.pos - 1 + length(p.phrase) AS INT) END AS end_at,
  CASE WHEN {skipped} THEN 'skipped' WHEN p.cats IS NULL THEN 'unknown' WHEN p.cats = 1 THEN 'matched' ELSE 'ambiguous' END AS status
FROM narratives n LEFT JOIN per p ON p.record_id = n.record_id AND p.field = '{field}'""")
    return " UNION ALL ".join(selects)


@query("extract_evidence", f"WITH {FIRST_SQL} {_evidence_sql()}", N)
def _(t):
    done = V.extract_evidence(open_master(t), VOCABULARY)
    entries = F.array(*[F.struct(
        F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"{f}_evidence_span").alias("span"),
        F.col(f"{f}_evidence_start").alias("start_at"), F.col(f"{f}_evidence_end").alias("end_at"),
        F.col(f"{f}_status").alias("status")) for f in EVIDENCE_FIELDS])
    return done.select("record_id", "source_dataset", F.inline(entries))


@query("ambiguous_matches", f"""
WITH {FIRST_SQL} SELECT record_id, source_dataset, field, string_agg(category, '|' ORDER BY cat_ord) AS matched_categories,
  string_agg(concat('''', substring(narrative_text, pos, length(phrase)), ''''), '|' ORDER BY cat_ord) AS matched_spans
FROM hits GROUP BY 1, 2, 3 HAVING count(*) > 1""", N)
def _(t):
    return V.ambiguous_matches(open_master(t), VOCABULARY)


@query("vocab_match", f"WITH {VOCAB_SQL} SELECT record_id, field, category, phrase FROM m", N)
def _(t):
    return V.vocabulary_matches(t.narratives, VOCABULARY)


@query("match_rate_report", f"""
WITH {FIRST_SQL}, e AS ({_evidence_sql()}),
c AS (SELECT field, source_dataset, count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous,
  count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) AS total
  FROM e GROUP BY GROUPING SETS ((field, source_dataset), (field)))
SELECT *, {pct('matched', 'total', 2)} AS match_pct FROM c""", N)
def _(t):
    return V.match_rate_report(V.extract_evidence(open_master(t), VOCABULARY))


# --- mergeable audit figures ------------------------------------------------------

@query("audit_sketches", """
SELECT event_type, count(*) AS n, count(value) AS value_n, min(value) AS value_min, max(value) AS value_max, count(DISTINCT user_id) AS distinct_users,
  true AS distinct_within_bound, true AS median_within_bound, true AS sum_agrees FROM events GROUP BY 1""")
def _(t):
    """Sketches stored per type and day, merged per type, held against the exact figures of all rows."""
    path = new_scratch(t.spark, "sketches")
    daily = K.sketch(t.events.withColumn("day", F.to_date("ts")), ["event_type", "day"], {"value": F.col("value")}, {"user": F.col("user_id")})
    daily.write.partitionBy("event_type").parquet(path)
    found = K.figures(K.merged(t.spark.read.parquet(path).drop("day"), ["event_type"]), (0.5,))
    exact = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("distinct_users"), F.sum("value").alias("exact_sum"))
    # the share of values up to the estimated median
    ranked = t.events.join(F.broadcast(found.select("event_type", F.col("value_quantiles")[0].alias("m"))), "event_type").groupBy("event_type").agg(
        F.avg((F.col("value") < F.col("m")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("m")).cast("double")).alias("upto"))
    near = F.abs(F.col("user_distinct") - F.col("distinct_users")) <= F.greatest(F.lit(1.0), K.DISTINCT_ERROR * F.col("distinct_users"))
    return found.join(exact, "event_type").join(ranked, "event_type").select(
        "event_type", "n", "value_n", "value_min", "value_max", "distinct_users", near.alias("distinct_within_bound"),
        ((F.col("below") <= 0.5 + K.RANK_ERROR) & (F.col("upto") >= 0.5 - K.RANK_ERROR)).alias("median_within_bound"),
        (F.abs(F.col("value_sum") - F.col("exact_sum")) <= 1e-6 * F.abs("exact_sum")).alias("sum_agrees"))


# --- evidence with a vocabulary table --------------------------------------------

PHRASES_WANTED = 478
# one to three words of every document in turn, until there are enough different phrases; fields and categories follow from the number
TABLE_SQL = f"""words AS (SELECT doc_id, string_split(narrative_text, ' ') AS w FROM narratives WHERE doc_id % 2 = 0),
picked AS (SELECT DISTINCT array_to_string(w[2:2 + CAST(doc_id // 2 % 3 AS INT)], ' ') AS phrase FROM words WHERE len(w) > 6),
vocab AS (SELECT ['unsafe_act', 'unsafe_condition', 'barrier', 'potential_consequence'][CAST((rn - 1) % 4 AS INT) + 1] AS field,
  CAST((rn - 1) // 4 % 6 AS INT) AS cat_ord, concat('category ', CAST((rn - 1) // 4 % 6 AS VARCHAR)) AS category, CAST((rn - 1) // 24 AS INT) AS phrase_ord, phrase
  FROM (SELECT phrase, row_number() OVER (ORDER BY md5(phrase), phrase) AS rn FROM picked WHERE length(phrase) > 2) WHERE rn <= {PHRASES_WANTED}),
m AS (SELECT n.record_id, n.source_dataset, v.*, instr(lower(n.narrative_text), lower(v.phrase)) AS pos, n.narrative_text
  FROM narratives n, vocab v WHERE contains(lower(n.narrative_text), lower(v.phrase))
    AND {sql_strip('n.narrative_text')} <> '' AND upper({sql_strip('n.narrative_text')}) <> 'UNKNOWN')"""
TABLE_FIRST_SQL = TABLE_SQL + FIRST_SQL[len(VOCAB_SQL):]


def vocabulary_table(t: Tables):
    """As many phrases as the reference keeps, of one to three words each, as a table."""
    words = F.split("narrative_text", " ", 8)  # the first seven are looked at
    cut = F.slice(words, F.lit(2), (F.floor(F.col("doc_id") / 2) % 3 + 1).cast("int"))
    picked = t.narratives.filter((F.col("doc_id") % 2 == 0) & (F.size(words) > 6)).select(F.array_join(cut, " ").alias("phrase")).distinct()
    first = picked.filter(F.char_length("phrase") > 2).orderBy(F.md5(F.col("phrase").cast("binary")), "phrase").limit(PHRASES_WANTED)
    at = (dense_index(first.withColumn("hash", F.md5(F.col("phrase").cast("binary"))), [F.col("hash"), F.col("phrase")], "rn", "vocabulary")
          .withColumn("at", F.col("rn") - 1))
    group = F.floor(F.col("at") / 4) % 6
    fields = F.array(*[F.lit(f) for f in ("unsafe_act", "unsafe_condition", "barrier", "potential_consequence")])
    return written(at.select(
        F.get(fields, (F.col("at") % 4).cast("int")).alias("field"), group.cast("int").alias("category_order"),
        F.concat(F.lit("category "), group.cast("string")).alias("category"), F.floor(F.col("at") / 24).cast("int").alias("phrase_order"),
        "phrase"), "vocabulary")


@query("extract_evidence_table", f"WITH {TABLE_FIRST_SQL} {_evidence_sql()}", N)
def _(t):
    done = V.extract_evidence(open_master(t), V.load_vocabulary(vocabulary_table(t)))
    entries = F.array(*[F.struct(
        F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"{f}_evidence_span").alias("span"),
        F.col(f"{f}_evidence_start").alias("start_at"), F.col(f"{f}_evidence_end").alias("end_at"),
        F.col(f"{f}_status").alias("status")) for f in EVIDENCE_FIELDS])
    return done.select("record_id", "source_dataset", F.inline(entries))


@query("ambiguous_matches_table", f"""
WITH {TABLE_FIRST_SQL} SELECT record_id, source_dataset, field, string_agg(category, '|' ORDER BY cat_ord) AS matched_categories,
  string_agg(concat('\'\'', substring(narrative_text, pos, length(phrase)), '\'\''), '|' ORDER BY cat_ord) AS matched_spans
FROM hits GROUP BY 1, 2, 3 HAVING count(*) > 1""", N)
def _(t):
    return V.ambiguous_matches(open_master(t), vocabulary_table(t))


@query("vocab_match_table", f"WITH {TABLE_SQL} SELECT record_id, field, category, phrase FROM m", N)
def _(t):
    return V.vocabulary_matches(t.narratives, vocabulary_table(t))


# --- splits -------------------------------------------------------------------

SPLIT_SQL = f"""{DOC_GROUPS},
w AS (SELECT n.*, coalesce(g, 0) AS grp, CASE WHEN coalesce(g, 0) <> 0 THEN concat('g', CAST(g AS VARCHAR)) ELSE concat('r', n.record_id) END AS unit
  FROM narratives n JOIN keyed k USING (record_id) LEFT JOIN multi m ON m.k = k.k WHERE NOT {SQL_MALFORMED}),
tgt AS (SELECT CAST(round_even(count(*) * 0.15::DOUBLE, 0) AS BIGINT) AS target, count(*) AS total FROM w),
u AS (SELECT unit, count(*) AS rows, bool_or(grp = 0 AND NOT is_synthetic) AS candidate, md5(concat(unit, '|42')) AS h FROM w GROUP BY 1),
a AS (SELECT *, sum(CASE WHEN candidate THEN 1 ELSE 0 END) OVER (ORDER BY h, unit) AS taken FROM u),
b AS (SELECT *, candidate AND taken <= (SELECT target FROM tgt) AS is_test FROM a),
d AS (SELECT *, sum(CASE WHEN is_test THEN 0 ELSE rows END) OVER (ORDER BY h, unit) AS upto FROM b),
units AS (SELECT unit, rows, CASE WHEN is_test THEN 'test' WHEN upto - rows < (SELECT target FROM tgt) THEN 'validation' ELSE 'train' END AS split FROM d),
split_rows AS (SELECT w.*, split FROM w JOIN units USING (unit))"""


def flagged(t: Tables):
    """The flagged table, written once as in the corpus build, without malformed rows."""
    table = written(D.flag_quality(t.narratives), "flagged")
    return table.filter(~F.col("is_empty_or_malformed"))


@query("group_split", f"WITH {SPLIT_SQL} SELECT record_id, unit, split FROM split_rows", N)
def _(t):
    return S.group_split(flagged(t)).select("record_id", "unit", "split")


@query("split_report", f"""
WITH {SPLIT_SQL} SELECT split, count(*) AS rows, count(*) FILTER (WHERE sif_potential = 'Yes') AS yes_rows, count(*) FILTER (WHERE sif_potential = 'No') AS no_rows,
  count(*) FILTER (WHERE is_synthetic) AS synthetic_rows, count(*) FILTER (WHERE NOT is_synthetic) AS real_rows,
  {pct('count(*)', '(SELECT total FROM tgt)')} AS pct FROM split_rows GROUP BY 1""", N)
def _(t):
    return S.split_report(S.group_split(flagged(t)))


@query("split_checks", f"""
WITH {SPLIT_SQL}, c AS (SELECT (SELECT count(*) FROM split_rows) - (SELECT total FROM tgt) AS a,
  (SELECT count(*) FROM (SELECT unit FROM split_rows GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS b,
  (SELECT count(*) FROM split_rows WHERE split = 'test' AND is_synthetic) AS c, (SELECT count(*) FROM split_rows WHERE split = 'test' AND grp <> 0) AS d)
SELECT 'missing_rows' AS check_name, a AS violations, a = 0 AS passed FROM c UNION ALL SELECT 'shared_units', b, b = 0 FROM c
UNION ALL SELECT 'synthetic_in_test', c, c = 0 FROM c UNION ALL SELECT 'duplicates_in_test', d, d = 0 FROM c""", N)
def _(t):
    rows = flagged(t)
    return S.split_checks(S.group_split(rows), rows.agg(F.count(F.lit(1))).scalar())


# a careless split by row, so that units do overlap
NAIVE = "(SELECT source AS unit, CASE WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 5 = 1 AND lang = 'en' THEN 'validation' ELSE 'train' END AS split FROM documents)"


def _overlap(a: str, b: str, rows: str = NAIVE) -> str:
    return f"(SELECT count(*) FROM (SELECT unit FROM {rows} WHERE split = '{a}' INTERSECT SELECT unit FROM {rows} WHERE split = '{b}'))"


@query("split_overlap", f"""
SELECT {_overlap('train', 'validation')} AS train_validation, {_overlap('train', 'test')} AS train_test, {_overlap('validation', 'test')} AS validation_test""")
def _(t):
    place = F.when(F.col("doc_id") % 5 == 0, "test").when((F.col("doc_id") % 5 == 1) & (F.col("lang") == "en"), "validation").otherwise("train")
    return S.split_overlap(t.documents.select(F.col("source").alias("unit"), place.alias("split")))


@query("split_disjoint", f"""
WITH {SPLIT_SQL} SELECT {_overlap('train', 'validation', 'split_rows')} AS train_validation,
  {_overlap('train', 'test', 'split_rows')} AS train_test, {_overlap('validation', 'test', 'split_rows')} AS validation_test""", N)
def _(t):
    return S.split_overlap(S.group_split(flagged(t)))


@query("stratified_split", """
SELECT doc_id, sif_potential, CASE WHEN rn <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, sif_potential, count(*) OVER (PARTITION BY sif_potential) AS n,
  row_number() OVER (PARTITION BY sif_potential ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '|42')), doc_id) AS rn FROM narratives)""", N)
def _(t):
    return S.stratified_split(t.narratives.select("doc_id", "sif_potential"), "sif_potential", "doc_id")
