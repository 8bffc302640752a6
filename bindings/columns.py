"""Column functions over narratives, pages and other text columns."""

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.views import SQL_RULES, SQL_WHITESPACE, Tables
from narrascope.functions import contracts as C
from narrascope.functions import text as X
from narrascope.schemas import RULES

N = ("narratives",)
STRIP = f"trim({{c}}, {SQL_WHITESPACE})"


def sql_strip(column: str) -> str:
    return STRIP.format(c=column)


def sql_unknown(column: str) -> str:
    bare = sql_strip(column)
    return (f"CASE WHEN {column} IS NULL OR lower({bare}) IN ('', 'nan', 'none') THEN 'UNKNOWN' ELSE {bare} END")


def sql_known(column: str) -> str:
    bare = sql_strip(column)
    return f"CASE WHEN lower({bare}) NOT IN ('', 'nan', 'none') THEN {bare} END"


def sql_norm(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


# texts with blanks around them and spelled-out nulls, made from the documents
SQL_MESSY = """CASE lang WHEN 'fr' THEN ' None ' WHEN 'de' THEN concat('\t', text, ' \n') WHEN 'es' THEN NULL ELSE text END"""


def messy(t: Tables):
    lang, text = F.col("lang"), F.col("text")
    made = (F.when(lang == "fr", " None ").when(lang == "de", F.concat(F.lit("\t"), text, F.lit(" \n")))
            .when(lang == "es", None).otherwise(text))
    return t.documents.select("doc_id", "lang", "source", made.alias("value"))


@query("unknown_if_blank", f"""
SELECT doc_id, md5({sql_unknown('value')}) AS value_md5, {sql_unknown('value')} = 'UNKNOWN' AS is_unknown
FROM (SELECT doc_id, {SQL_MESSY} AS value FROM documents)""")
def _(t):
    value = X.unknown_if_blank(F.col("value"))
    return messy(t).select("doc_id", F.md5(value).alias("value_md5"), (value == "UNKNOWN").alias("is_unknown"))


@query("strip_html", f"""
SELECT page_id, md5(coalesce(nullif(trim(regexp_replace({sql_strip('html')}, '<[^>]+>', '', 'g'), {SQL_WHITESPACE}), ''), {sql_strip('html')})) AS text_md5
FROM pages""")
def _(t):
    return t.pages.select("page_id", F.md5(X.strip_html(F.col("html"))).alias("text_md5"))


@query("make_record_id", "SELECT doc_id, concat(source_dataset, '__', CAST(doc_id AS VARCHAR)) AS record_id FROM narratives", N)
def _(t):
    return t.narratives.select("doc_id", X.make_record_id(F.col("source_dataset"), F.col("doc_id").cast("string")).alias("record_id"))


@query("site_label", """
SELECT c_custkey, CASE WHEN place IS NOT NULL AND region IS NOT NULL THEN concat(place, ', ', region)
  ELSE coalesce(place, region, 'UNKNOWN') END AS site
FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS place,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_name END AS region FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def _(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.when(F.col("c_custkey") % 4 == 0, " NaN ").otherwise(F.concat(F.lit(" "), F.col("c_mktsegment")))
    region = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("n_name"))
    return joined.select("c_custkey", X.site_label(place, region).alias("site"))


@query("normalize_code", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN concat('P', l_linestatus)
  WHEN l_returnflag = 'A' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE concat(CAST(l_linenumber AS VARCHAR), '.5') END AS code
FROM lineitem""")
def _(t):
    flag = F.col("l_returnflag")
    raw = (F.when(flag == "R", F.concat(F.lit("P"), F.col("l_linestatus")))
           .when(flag == "A", F.concat(F.lit(" "), F.col("l_quantity").cast("string")))
           .otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(".5"))))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.normalize_code(raw).alias("code"))


@query("decode_sex", """
SELECT c_custkey, CASE CAST(c_nationkey % 4 AS INT) WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'UNKNOWN' END AS sex FROM customer""")
def _(t):
    code = F.when(F.col("c_custkey") % 2 == 0, (F.col("c_nationkey") % 4).cast("double").cast("string")).otherwise(
        (F.col("c_nationkey") % 4).cast("string"))
    return t.customer.select("c_custkey", X.decode_sex(F.when(code.isin("0", "0.0"), "").otherwise(code)).alias("sex"))


@query("normalize_text", f"SELECT doc_id, md5({sql_norm('narrative_text')}) AS norm_md5, length({sql_norm('narrative_text')}) AS norm_length FROM narratives", N)
def _(t):
    norm = X.normalize_text(F.col("narrative_text"))
    return t.narratives.select("doc_id", F.md5(norm).alias("norm_md5"), F.length(norm).alias("norm_length"))


SQL_MALFORMED = f"(length(coalesce({sql_strip('narrative_text')}, '')) < 5 OR upper({sql_strip('narrative_text')}) = 'UNKNOWN')"


@query("flag_empty", f"""
SELECT doc_id, (length(coalesce({sql_strip('value')}, '')) < 5 OR upper({sql_strip('value')}) = 'UNKNOWN') AS is_empty_or_malformed
FROM (SELECT doc_id, {SQL_MESSY} AS value FROM documents)""")
def _(t):
    return messy(t).select("doc_id", X.is_malformed(F.col("value")).alias("is_empty_or_malformed"))


SQL_PII = r"""(regexp_matches(narrative_text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}')
  OR regexp_matches(narrative_text, '(?:^|[^0-9])(?:\+?[0-9]{1,3}[-.\s]?)?(?:\(?[0-9]{2,4}\)?[-.\s]?)[0-9]{3,4}[-.\s]?[0-9]{3,4}(?:[^0-9]|$)'))"""


@query("flag_pii", f"SELECT doc_id, {SQL_PII} AS has_possible_pii FROM narratives", N)
def _(t):
    return t.narratives.select("doc_id", X.has_pii(F.col("narrative_text")).alias("has_possible_pii"))


@query("parse_bool", "SELECT doc_id, is_synthetic AS parsed FROM narratives", N)
def _(t):
    text = F.when(F.col("is_synthetic"), F.when(F.col("doc_id") % 2 == 0, " True").otherwise("TRUE")).otherwise(
        F.when(F.col("doc_id") % 2 == 0, "False").otherwise("yes"))
    return t.narratives.select("doc_id", X.parse_bool(text).alias("parsed"))


SQL_WORDS = r"len(regexp_extract_all(narrative_text, '[^\s\x1c-\x1f\x85\xa0]+'))"


@query("word_count", f"SELECT doc_id, CAST({SQL_WORDS} AS INT) AS words FROM narratives", N)
def _(t):
    return t.narratives.select("doc_id", X.word_count(F.col("narrative_text")).alias("words"))


@query("domain_relevant", "SELECT p_partkey, regexp_matches(concat(lower(p_name), CASE WHEN p_size > 25 THEN ' GasLine' ELSE '' END), '(?i)oil|gas|hazmat|pipeline') AS relevant FROM part")
def _(t):
    domain = F.concat(F.col("p_name"), F.when(F.col("p_size") > 25, " GasLine").otherwise(""))
    return t.part.select("p_partkey", X.domain_relevant(domain).alias("relevant"))


@query("usable_text", f"""
SELECT doc_id, (coalesce({sql_strip('value')}, '') <> '' AND upper({sql_strip('value')}) <> 'UNKNOWN') AS usable
FROM (SELECT doc_id, CASE lang WHEN 'fr' THEN ' unknown ' WHEN 'de' THEN '  ' WHEN 'es' THEN NULL ELSE text END AS value FROM documents)""")
def _(t):
    lang = F.col("lang")
    value = F.when(lang == "fr", " unknown ").when(lang == "de", "  ").when(lang == "es", None).otherwise(F.col("text"))
    return t.documents.select("doc_id", X.usable_text(value).alias("usable"))


@query("valid_rule_rows", f"SELECT id, life_saving_rule FROM reports WHERE list_contains({SQL_RULES}, life_saving_rule)", ("reports",))
def _(t):
    return t.reports.filter(F.col("life_saving_rule").isin(*RULES)).select("id", "life_saving_rule")


# each conversation turn: its speaker as a phrase to mark, with a sign from the turn number
@query("highlight_phrases", r"""
SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '(?i)the|an', '<mark>\0</mark>', 'g') ELSE text END) AS marked_md5
FROM conversations""")
def _(t):
    sign = F.when(F.col("turn") % 2 == 0, 1.0).otherwise(-1.0)
    phrases = F.array(F.struct(F.lit("the").alias("phrase"), sign.alias("weight")),
                      F.struct(F.lit("AN").alias("phrase"), sign.alias("weight")),
                      F.struct(F.lit("a").alias("phrase"), F.lit(0.0).alias("weight")))
    return t.conversations.select("conv_id", "turn", F.md5(C.highlight_phrases(F.col("text"), phrases)).alias("marked_md5"))
