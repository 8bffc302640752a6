"""Readers, source mappers, taxonomy and sinks."""

from pyspark.sql import functions as F

from bindings.columns import sql_strip, sql_unknown
from bindings.registry import query
from bindings.views import Tables, sql_text
from narrascope.operators.identity import sequential_ids
from narrascope.operators.skew import part_count
from narrascope.operators.splits import group_split
from narrascope.schemas import MANIFEST_COLUMNS, MASTER_COLUMNS, RULES, SEED_COLUMNS
from narrascope.session import new_scratch
from narrascope.sources import files, manifest, mapping, taxonomy
from narrascope.sources.term_maps import CRITICAL_RISK_RULES

DAY = "2024-01-01T00:00:00Z"
N = ("narratives",)
TERMS = ("Fall", "Traffic", "Power lock", "Others", "Projection", "Confined space")


# --- readers and sinks --------------------------------------------------------

def _document_files(t: Tables) -> list[str]:
    """Documents as CSV files, English ones in UTF-8 and the others in Latin-1; texts hold line breaks."""
    path = new_scratch(t.spark, "csv")
    english = F.col("lang") == "en"
    for name, kept, encoding in (("utf8", english, "UTF-8"), ("latin1", ~english, "ISO-8859-1")):
        t.documents.filter(kept).select("doc_id", "source", "text").write.options(header=True, escape='"', quoteAll=True, encoding=encoding, ignoreLeadingWhiteSpace=False,
                           ignoreTrailingWhiteSpace=False).csv(f"{path}/{name}")
    return [f"{path}/utf8", f"{path}/latin1"]


DOCUMENT_SQL = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, md5(text) AS text_md5 FROM documents"


@query("read_csv_robust", DOCUMENT_SQL)
def _(t):
    read = files.read_csv_robust(t.spark, _document_files(t))
    return read.select("doc_id", "source", F.md5("text").alias("text_md5"))


@query("read_csv_split", DOCUMENT_SQL)
def _(t):
    """The same files, each read in many tasks and folded to records by the parity of quotes."""
    read = files.read_csv_robust(t.spark, _document_files(t), multiline=files.SPLIT)
    return read.select("doc_id", "source", F.md5("text").alias("text_md5"))


def _yearly_files(t: Tables) -> str:
    """Orders as one folder of CSV files per year; odd years lack the priority column."""
    path = new_scratch(t.spark, "yearly")
    rows = t.orders.withColumn("y", F.year("o_orderdate")).select(
        F.col("o_orderkey").alias("Report Number"), F.col("o_orderstatus").alias("Status"),
        F.col("o_orderpriority").alias("Priority"), "y")
    for name, part in (("even", rows.filter("y % 2 = 0")), ("odd", rows.filter("y % 2 = 1").drop("Priority"))):
        part.write.option("header", True).partitionBy("y").csv(f"{path}/{name}")
    return path


@query("scan_drifting_dir", """
SELECT CAST(o_orderkey AS VARCHAR) AS report_number, o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS file_year
FROM orders WHERE year(o_orderdate) % 2 = 0""")
def _(t):
    path = _yearly_files(t)
    rows, _lacking = files.scan_drifting_dir(t.spark, [f"{path}/even/*", f"{path}/odd/*"], ["Report Number", "Priority"])
    return rows.select(F.col("Report Number").alias("report_number"), F.col("Priority").alias("priority"),
                       F.regexp_extract(files.FILE, "y=([0-9]+)", 1).alias("file_year"))


@query("drifting_report", """
SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS file_year, 'Priority' AS missing FROM orders WHERE year(o_orderdate) % 2 = 1""")
def _(t):
    path = _yearly_files(t)
    _rows, lacking = files.scan_drifting_dir(t.spark, [f"{path}/even/*", f"{path}/odd/*"], ["Report Number", "Priority"])
    return lacking.select(F.regexp_extract("file", "y=([0-9]+)", 1).alias("file_year"),
                          F.array_join("missing", ", ").alias("missing")).distinct()


@query("write_table", """
SELECT kind, CAST(doc_id AS VARCHAR) AS doc_id, md5(narrative_text) AS text_md5, CAST(is_synthetic AS VARCHAR) AS is_synthetic
FROM narratives, (SELECT unnest(['quoted', 'minimal', 'parquet']) AS kind)""", N)
def _(t):
    path = new_scratch(t.spark, "sink")
    rows = t.narratives.select("doc_id", "narrative_text", "is_synthetic")
    files.write_csv(rows, f"{path}/quoted")
    files.write_csv(rows, f"{path}/minimal", quote_all=False)
    files.write_table(rows, f"{path}/parquet")
    back = [files.read_csv_robust(t.spark, [f"{path}/{kind}"]).drop(files.FILE).withColumn("kind", F.lit(kind))
            for kind in ("quoted", "minimal")]
    stored = t.spark.read.parquet(f"{path}/parquet").select(
        *[F.col(c).cast("string").alias(c) for c in rows.columns], F.lit("parquet").alias("kind"))
    return back[0].unionByName(back[1]).unionByName(stored).select(
        "kind", "doc_id", F.md5("narrative_text").alias("text_md5"), "is_synthetic")


@query("write_splits", """
WITH u AS (SELECT record_id, narrative_text, NOT is_synthetic AS candidate, md5(concat('r', record_id, '|42')) AS h FROM narratives),
t AS (SELECT CAST(round_even(count(*) * 0.15::DOUBLE, 0) AS BIGINT) AS target FROM u),
a AS (SELECT *, sum(CASE WHEN candidate THEN 1 ELSE 0 END) OVER (ORDER BY h) AS taken FROM u),
b AS (SELECT *, candidate AND taken <= (SELECT target FROM t) AS is_test FROM a),
c AS (SELECT *, sum(CASE WHEN is_test THEN 0 ELSE 1 END) OVER (ORDER BY h) AS upto FROM b)
SELECT record_id, md5(narrative_text) AS text_md5, CASE WHEN is_test THEN 'test' WHEN upto - 1 < (SELECT target FROM t) THEN 'validation' ELSE 'train' END AS split FROM c""", N)
def _(t):
    path = new_scratch(t.spark, "splits")
    single = t.narratives.withColumn("is_duplicate_group_id", F.lit(0))
    files.write_splits(group_split(single), path)
    return t.spark.read.parquet(path).select("record_id", F.md5("narrative_text").alias("text_md5"), "split")


# --- manifest -----------------------------------------------------------------

def _entry(name: str, narrative: str, key: str) -> dict[str, str]:
    return {"category": "test", "dataset_name": name, "local_path": f"{name}.parquet", "source_organization": "Driver",
            "source_url": "nan", "license": "public", "source_record_id_field": key, "source_type_value": f"real_{name}",
            "narrative_text_column": narrative}


ENTRIES = [
    _entry("documents", "report_text", "doc_id"), _entry("conversations", "Final Narrative", "conv_id"),
    _entry("nation", "N/A", "n_nationkey"), _entry("embeddings", "vector", "vec_id"),
    _entry("pages", "body", "page_id"), _entry("lost", "text", "id"),
]
COUNTED = ("documents", "conversations", "nation", "embeddings", "pages")


@query("build_manifest", "SELECT dataset_name, local_path, source_type_value, narrative_text_column, n AS row_count FROM (\n" + " UNION ALL ".join(
    f"SELECT {sql_text(e['dataset_name'])} AS dataset_name, {sql_text(e['local_path'])} AS local_path, {sql_text(e['source_type_value'])} AS source_type_value, "
    f"{sql_text(e['narrative_text_column'])} AS narrative_text_column, "
    + (f"(SELECT CAST(count(*) AS VARCHAR) FROM {e['dataset_name']})" if e["dataset_name"] in COUNTED else "NULL") + " AS n"
    for e in ENTRIES) + ")")
def _(t):
    made = manifest.build_manifest(t.spark, ENTRIES, {name: getattr(t, name) for name in COUNTED})
    assert tuple(made.columns) == MANIFEST_COLUMNS
    return made.select("dataset_name", "local_path", "source_type_value", "narrative_text_column", "row_count")


def _ingest(t: Tables):
    documents = t.documents.select(
        F.col("doc_id").cast("string").alias("report_id"),
        F.when(F.col("lang") == "fr", "  ").otherwise(F.col("text")).alias("report_text"), F.col("source"))
    turns = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias(mapping.POSITION), F.col("conv_id").cast("string").alias("ID"),
        F.when(F.col("role") == "user", F.col("text")).alias("Final Narrative"))
    readers = {"documents": lambda: documents, "conversations": lambda: turns, "pages": lambda: t.pages}
    mappers = {"documents": mapping.map_seed, "conversations": mapping.map_severe_injury,
               "pages": mapping.map_seed, "lost": mapping.map_seed}
    rows = manifest.build_manifest(t.spark, ENTRIES, {name: getattr(t, name) for name in COUNTED})
    return manifest.ingest(t.spark, rows, readers, mappers, DAY)


@query("manifest_ingest", """
SELECT 'documents' AS dataset, count(*) AS rows_read, count(*) FILTER (WHERE lang <> 'fr') AS rows_written, false AS skipped, '' AS reason FROM documents
UNION ALL SELECT 'conversations', count(*), count(*) FILTER (WHERE role = 'user'), false, '' FROM conversations
UNION ALL SELECT 'nation', 0, 0, true, 'N/A narrative column (reference file)'
UNION ALL SELECT 'embeddings', 0, 0, true, 'No mapper registered'
UNION ALL SELECT 'pages', count(*), 0, true, 'Narrative column ''body'' not found' FROM pages
UNION ALL SELECT 'lost', 0, 0, true, 'File not found'""")
def _(t):
    return _ingest(t).summary


@query("union_sources", f"""
SELECT concat('documents__', CAST(doc_id AS VARCHAR)) AS record_id, 'documents' AS source_dataset, md5({sql_strip('text')}) AS text_md5, 'UNKNOWN' AS source_url
FROM documents WHERE lang <> 'fr'
UNION ALL SELECT concat('conversations__', CAST(conv_id AS VARCHAR), CASE WHEN rn > 1 THEN concat('_dup', CAST(rn - 1 AS VARCHAR)) ELSE '' END), 'conversations', md5({sql_strip('text')}), 'UNKNOWN'
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user')""")
def _(t):
    return _ingest(t).master.select("record_id", "source_dataset", F.md5("narrative_text").alias("text_md5"), "source_url")


FROM_FILES = "\nUNION ALL BY NAME ".join((f"""
SELECT concat('hazmat__', raw, CASE WHEN rn > 1 THEN concat('_dup', CAST(rn - 1 AS VARCHAR)) ELSE '' END) AS record_id, 'hazmat' AS source_dataset,
  {sql_unknown('told')} AS narrative_text
FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY o_orderkey) AS rn FROM (
  SELECT *, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS told,
    CASE WHEN o_orderkey % 4 = 0 THEN concat('phmsa_', CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR))
      ELSE concat('I-', CAST(o_custkey AS VARCHAR)) END AS raw FROM orders))""", """
SELECT concat('severe__', CAST(user_id AS VARCHAR), CASE WHEN rn > 1 THEN concat('_dup', CAST(rn - 1 AS VARCHAR)) ELSE '' END) AS record_id,
  'severe' AS source_dataset, event_type AS narrative_text
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type <> 'error')"""))


@query("ingest_files", FROM_FILES)
def _(t):
    """Orders and events as CSV files, read in file order and mapped; hazmat rows without a narrative stay."""
    path = new_scratch(t.spark, "sources")
    hazmat = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("<b>I-"), F.col("o_custkey").cast("string"), F.lit("</b>"))).alias("Report Number"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("Description Of Events"))
    severe = t.events.select(
        "event_id", F.col("user_id").cast("double").cast("string").alias("ID"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("Final Narrative"))
    for name, rows, key in (("hazmat jan 2020", hazmat, "o_orderkey"), ("severe", severe, "event_id")):
        count = part_count(rows, 4)  # files grow in number with the table, not in size
        files.write_csv(rows.repartitionByRange(count, key).sortWithinPartitions(key).drop(key), f"{path}/{name}")

    def reader(name: str):
        return lambda: files.read_csv_robust(t.spark, [f"{path}/{name}"], multiline=False, position=True)

    listed = manifest.build_manifest(t.spark, [
        {"dataset_name": "hazmat", "narrative_text_column": "Description Of Events"},
        {"dataset_name": "severe", "narrative_text_column": "Final Narrative"}], {})
    done = manifest.ingest(
        t.spark, listed, {"hazmat": reader("hazmat jan 2020"), "severe": reader("severe")},
        {"hazmat": mapping.map_hazmat, "severe": mapping.map_severe_injury}, DAY, keep_empty=frozenset({"hazmat"}))
    return done.master.select("record_id", "source_dataset", "narrative_text")


# --- the six mappers ----------------------------------------------------------

def master_sql(dataset: str, source_type: str, record: str, table: str, given: dict[str, str]) -> str:
    """The 29 columns in SQL: given expressions, constants and UNKNOWN."""
    base = {
        "record_id": f"concat({sql_text(dataset)}, '__', {record})", "source_organization": "'Agency'",
        "source_dataset": sql_text(dataset), "source_url": "'UNKNOWN'", "source_record_id": record,
        "source_type": sql_text(source_type), "is_synthetic": "false", "ingestion_date": sql_text(DAY),
        "schema_version": "'1.0.0'", **given}
    return "SELECT " + ", ".join(f"{base.get(c, chr(39) + 'UNKNOWN' + chr(39))} AS {c}" for c in MASTER_COLUMNS) + f"\nFROM {table}"


def provenance(dataset: str, source_type: str) -> mapping.Provenance:
    return mapping.Provenance(dataset, " Agency ", "nan", source_type)


SUFFIX = "CASE WHEN rn > 1 THEN concat('_dup', CAST(rn - 1 AS VARCHAR)) ELSE '' END"
RISK = "CASE CAST(risk_score % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN ' None' ELSE 'Lifted load' END"
HAZARD = f"({sql_unknown('hz')})"


@query("map_master_seed", master_sql("seed_reports", "UNKNOWN", "report_id", f"(SELECT *, {RISK} AS hz FROM reports)", {
    "is_synthetic": "source = 'synthetic'", "date": "strftime(ts, '%Y-%m-%d')", "site": "site", "industry_domain": "'oil_and_gas'",
    "report_type": "'Incident'", "activity": "activity", "narrative_text": "concat('work at ', site)", "hazard": HAZARD,
    "barrier": "'UNKNOWN'", "barrier_status": "'UNKNOWN'", "sif_potential": "sif_potential", "life_saving_rule": "life_saving_rule"}), ("reports",))
def _(t):
    risk = F.col("risk_score") % 3
    rows = t.reports.withColumns({
        "date": F.date_format("ts", "yyyy-MM-dd"), "report_type": F.lit("Incident"),
        "report_text": F.concat(F.lit(" work at "), F.col("site"), F.lit("\n")),
        "hazard": F.when(risk == 0, "").when(risk == 1, " None").otherwise("Lifted load"), "barrier": F.lit("nan")})
    return mapping.map_seed(rows, provenance("seed_reports", ""), DAY)


@query("map_master_severe_injury", master_sql(
    "severe_injury", "real_severe", f"concat(CAST(user_id AS VARCHAR), {SUFFIX})",
    "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)", {
        "date": "strftime(ts, '%Y-%m-%d')", "site": "CASE WHEN event_type = 'view' THEN 'TX' ELSE concat(event_type, ', TX') END",
        "industry_domain": "'general_industrial'", "report_type": "'severe_injury_report'", "narrative_text": "props",
        "hazard": "event_type", "actual_outcome": "CASE WHEN value > 10 THEN 'Fracture' ELSE 'UNKNOWN' END",
        "injury_severity_actual": "CASE WHEN value > 10 THEN 'Fracture' ELSE 'UNKNOWN' END", "naics_code": "CAST(event_id % 100 AS VARCHAR)"}))
def _(t):
    rows = t.events.select(
        F.col("event_id").alias(mapping.POSITION), F.col("user_id").cast("double").cast("string").alias("ID"),
        F.date_format("ts", "yyyy-MM-dd").alias("EventDate"),
        F.when(F.col("event_type") == "view", None).otherwise(F.col("event_type")).alias("City"), F.lit("TX").alias("State"),
        F.col("props").alias("Final Narrative"), F.col("event_type").alias("SourceTitle"),
        F.when(F.col("value") > 10, "Fracture").alias("NatureTitle"), (F.col("event_id") % 100).cast("string").alias("Primary NAICS"))
    return mapping.map_severe_injury(rows, provenance("severe_injury", "real_severe"), DAY)


@query("map_master_abstracts", master_sql(
    "abstracts", "real_abstracts", f"concat(CAST(conv_id AS VARCHAR), {SUFFIX})",
    "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)", {
        "industry_domain": "'construction'", "report_type": "'hse_abstract'", "activity": "role", "narrative_text": sql_unknown("text"),
        "hazard": "'Other'", "injury_severity_actual": "CAST(turn AS VARCHAR)"}))
def _(t):
    rows = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias(mapping.POSITION), F.col("conv_id").cast("string").alias("summary_nr"),
        F.col("role").alias("Task Assigned"), F.col("text").alias("Abstract Text"), F.lit(" Other").alias("Environmental Factor"),
        F.col("turn").cast("string").alias("Degree of Injury"))
    return mapping.map_abstracts(rows, provenance("abstracts", "real_abstracts"), DAY)


@query("map_master_industrial", master_sql(
    "industrial", "real_industrial", "CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR)", "documents", {
        "date": "'2016-01-01 00:00:00'", "site": "concat(source, ', Country_', lang)", "industry_domain": "'Mining'",
        "report_type": "'accident_report'", "narrative_text": sql_unknown("text"), "hazard": "CASE WHEN lang = 'fr' THEN 'UNKNOWN' ELSE 'Fall' END",
        "injury_severity_actual": "'IV'", "sex": "'Male'"}))
def _(t):
    rows = t.documents.select(
        F.col("doc_id").alias(mapping.POSITION), F.lit("2016-01-01 00:00:00").alias("Data"), F.col("source").alias("Local"),
        F.concat(F.lit("Country_"), F.col("lang")).alias("Countries"), F.lit("Mining").alias("Industry Sector"),
        F.col("text").alias("Description"), F.when(F.col("lang") != "fr", "Fall").alias("Critical Risk"),
        F.lit("IV").alias("Accident Level"), F.lit("Male").alias("Genre"))
    return mapping.map_industrial(rows, provenance("industrial", "real_industrial"), DAY)


@query("map_master_injury_narratives", master_sql(
    "injury_narratives", "real_narratives", "CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR)", "documents", {
        "industry_domain": "'general_industrial'", "report_type": "'injury_narrative'", "narrative_text": sql_unknown("text"),
        "age": "CASE WHEN doc_id % 7 = 0 THEN 'UNKNOWN' ELSE CAST(doc_id % 70 AS VARCHAR) END",
        "sex": "CASE CAST(doc_id % 3 AS INT) WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'UNKNOWN' END"}))
def _(t):
    rows = t.documents.select(
        F.col("doc_id").alias(mapping.POSITION), "text",
        F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 70).cast("double").cast("string")).alias("age"),
        F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 3).cast("string")).alias("sex"))
    return mapping.map_injury_narratives(rows, provenance("injury_narratives", "real_narratives"), DAY)


@query("map_master_hazmat", master_sql(
    "hazmat", "real_phmsa_hazmat", f"concat(raw, {SUFFIX})", """(
  SELECT *, row_number() OVER (PARTITION BY raw ORDER BY o_orderkey) AS rn FROM (
    SELECT *, CASE WHEN o_orderstatus = 'P' THEN concat('phmsa_', CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR))
      ELSE concat('I-', CAST(o_custkey AS VARCHAR)) END AS raw FROM orders))""", {
        "date": "strftime(o_orderdate, '%m/%d/%Y')", "site": "'Austin, TX'", "industry_domain": "'hazmat_transportation'",
        "report_type": "'hazmat_incident_report'", "activity": "'Highway'", "narrative_text": "o_orderpriority", "hazard": "'ACETONE'"}))
def _(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias(mapping.POSITION),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("<a href='/r'>I-"), F.col("o_custkey").cast("string"), F.lit("</a>")))
        .alias("Report Number"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("Date Of Incident"),
        F.lit("Austin").alias("Incident City"), F.lit("TX").alias("Incident State"), F.lit("Highway").alias("Mode Of Transportation"),
        F.col("o_orderpriority").alias("Description Of Events"), F.lit("ACETONE").alias("Commodity Short Name"))
    return mapping.map_hazmat(rows, provenance("hazmat", "other"), DAY)


# --- seed merge and term maps -------------------------------------------------

RISK_TERMS = "[" + ", ".join(sql_text(x) for x in TERMS) + ", ' ']"
RULE_VALUES = "(VALUES " + ", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in CRITICAL_RISK_RULES.items()) + ")"
LEVELS = ("I", "II", "III", "IV", "V", "VI", "", "x")
LEVEL_LIST = "[" + ", ".join(sql_text(x) for x in LEVELS) + "]"
REAL = f"""real_rows AS (SELECT *, {LEVEL_LIST}[CAST(o_orderkey % 8 AS INT) + 1] AS pal, {RISK_TERMS}[CAST(o_custkey % 7 AS INT) + 1] AS risk FROM orders WHERE o_orderstatus <> 'P'),
merged AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, concat('Real-Local_', CAST(o_custkey % 12 AS VARCHAR)) AS site, 'Mining' AS activity,
  'Incident' AS report_type, concat('order ', o_orderpriority) AS report_text, CASE WHEN pal IN ('IV', 'V', 'VI') THEN 'Yes' ELSE 'No' END AS sif_potential,
  coalesce(rule, 'Unmapped') AS life_saving_rule, CASE WHEN trim(risk) = '' THEN 'Unspecified' ELSE risk END AS hazard, 'Unknown (not recorded in source)' AS barrier,
  'Unknown' AS barrier_status, CASE pal WHEN 'III' THEN 'MEDIUM' WHEN 'IV' THEN 'HIGH' WHEN 'V' THEN 'HIGH' WHEN 'VI' THEN 'HIGH' ELSE 'LOW' END AS risk_level,
  'real_ihm_stefanini' AS source FROM real_rows LEFT JOIN {RULE_VALUES} m(term, rule) ON trim(risk) = term)"""


def industrial_rows(t: Tables):
    level = F.array(*[F.lit(x) for x in LEVELS])[(F.col("o_orderkey") % 8).cast("int")]
    risk = F.array(*[F.lit(x) for x in (*TERMS, " ")])[(F.col("o_custkey") % 7).cast("int")]
    return t.orders.select(
        F.col("o_orderkey").alias(mapping.POSITION), F.col("o_orderdate").cast("string").alias("Data"),
        F.concat(F.lit("Local_"), (F.col("o_custkey") % 12).cast("string")).alias("Local"), F.lit("Mining").alias("Industry Sector"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.concat(F.lit("order "), F.col("o_orderpriority"), F.lit(" "))).alias("Description"),
        F.concat(F.lit(" "), level).alias("Potential Accident Level"), risk.alias("Critical Risk"))


@query("merge_real_seed", f"""
WITH {REAL}, synthetic AS (SELECT doc_id, text AS report_text FROM documents)
SELECT concat('OIL-', CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE CAST(n AS VARCHAR) END) AS report_id, * EXCLUDE (n) FROM (
  SELECT row_number() OVER (ORDER BY o_orderkey) AS n, * EXCLUDE (o_orderkey) FROM merged
  UNION ALL SELECT (SELECT count(*) FROM merged) + row_number() OVER (ORDER BY doc_id), '2025-01-01', 'Site A', 'Hot Work', 'Near Miss', report_text,
    'No', NULL, 'Fire', NULL, NULL, 'LOW', 'synthetic' FROM synthetic)""")
def _(t):
    rules = mapping.rule_table(t.spark, CRITICAL_RISK_RULES)
    real = mapping.real_to_seed(industrial_rows(t), rules).withColumn("block", F.lit(0))
    constants = {"date": "2025-01-01", "site": "Site A", "activity": "Hot Work", "report_type": "Near Miss",
                 "sif_potential": "No", "life_saving_rule": None, "hazard": "Fire",
                 "barrier": None, "barrier_status": None, "risk_level": "LOW", "source": "synthetic"}
    made = t.documents.select(
        F.col("doc_id").alias(mapping.POSITION), F.lit(1).alias("block"), F.col("text").alias("report_text"),
        *[F.lit(value).cast("string").alias(name) for name, value in constants.items()])
    return sequential_ids(real.unionByName(made), "block", mapping.POSITION, "report_id").select(*SEED_COLUMNS)


@query("map_critical_risk", f"""
SELECT o_orderkey, risk, coalesce(rule, 'Unmapped') AS mapped_rule
FROM (SELECT o_orderkey, {RISK_TERMS}[CAST(o_custkey % 7 AS INT) + 1] AS risk FROM orders) LEFT JOIN {RULE_VALUES} m(term, rule) ON risk = term""")
def _(t):
    rows = industrial_rows(t).select(F.col(mapping.POSITION).alias("o_orderkey"), F.col("Critical Risk").alias("risk"))
    return taxonomy.map_critical_risk(rows, mapping.rule_table(t.spark, CRITICAL_RISK_RULES), "risk")


TERM_ROWS = f"""terms AS (
  SELECT DISTINCT 'industrial' AS source_dataset, 'Critical Risk' AS column_name, trim(risk) AS source_term
  FROM (SELECT {RISK_TERMS}[CAST(o_custkey % 7 AS INT) + 1] AS risk FROM orders) WHERE trim(risk) <> ''
  UNION SELECT DISTINCT 'industrial', 'Industry Sector', 'Mining' FROM orders
  UNION SELECT DISTINCT 'injury_narratives', 'event', CAST(CAST(l_quantity AS BIGINT) + 10 AS VARCHAR) FROM lineitem
  UNION SELECT DISTINCT 'injury_narratives', 'note', concat(CAST(CAST(l_linenumber AS BIGINT) AS VARCHAR), '.5') FROM lineitem)"""
TEXT_RULES = {"Fall": "working_at_height", "Traffic": "driving", "Power lock": "energy_isolation", "Confined space": "confined_space"}
MAPPED = f"""{TERM_ROWS}, mapped AS (
  SELECT *, CASE WHEN column_name = 'Critical Risk' THEN CASE source_term {" ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in TEXT_RULES.items())} ELSE 'Unmapped' END
    WHEN column_name = 'event' THEN CASE WHEN source_term BETWEEN '20' AND '26' THEN 'driving' WHEN source_term BETWEEN '30' AND '32' THEN 'hot_work'
      WHEN source_term = '64' THEN 'energy_isolation' WHEN source_term BETWEEN '60' AND '66' THEN 'line_of_fire' ELSE 'Unmapped' END
    ELSE 'Unmapped' END AS mapped_rule_id FROM terms)"""


def terms(t: Tables):
    coded = t.lineitem.select((F.col("l_quantity") + 10).alias("event"), (F.col("l_linenumber") + 0.5).alias("note"))
    return taxonomy.distinct_terms(industrial_rows(t), F.lit("industrial"), ["Critical Risk", "Industry Sector"]).unionByName(
        taxonomy.distinct_terms(coded, F.lit("injury_narratives"), ["event", "note"]))


def mapped_terms(t: Tables):
    known = taxonomy.known_terms(t.spark, {"industrial": "industrial", "injury_narratives": "injury_narratives"})
    return taxonomy.map_terms(terms(t), known)


@query("distinct_terms", f"WITH {TERM_ROWS} SELECT * FROM terms")
def _(t):
    return terms(t)


@query("legacy_term_mapping", f"""
WITH {MAPPED} SELECT *, CASE WHEN mapped_rule_id = 'Unmapped' THEN 'n/a' ELSE 'high' END AS mapping_confidence,
  CASE WHEN mapped_rule_id = 'Unmapped' THEN concat('No confident IOGP rule match for ''', source_term, ''' in ', column_name) ELSE '' END AS notes FROM mapped""")
def _(t):
    return mapped_terms(t)


@query("mapping_rate", f"""
WITH {MAPPED} SELECT source_dataset, count(*) AS terms, count(*) FILTER (WHERE mapped_rule_id <> 'Unmapped') AS mapped,
  round_even(100.0::DOUBLE * count(*) FILTER (WHERE mapped_rule_id <> 'Unmapped') / count(*), 1) AS pct FROM mapped GROUP BY ROLLUP (source_dataset)""")
def _(t):
    return taxonomy.mapping_rate(mapped_terms(t))


# --- taxonomy -----------------------------------------------------------------

@query("read_taxonomy", """
SELECT lower(replace(replace(rule, ' ', '_'), '/', '_')) AS rule_id, rule AS rule_name, concat('IOGP Life-Saving Rule: ', rule) AS description,
  string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS hazard_examples, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS barrier_examples
FROM (SELECT concat(p_type, ' Part/Rule') AS rule, p_brand, p_name FROM part) GROUP BY 2""")
def _(t):
    """Part types as rules, written as one multi-line JSON document and read back."""
    path = new_scratch(t.spark, "taxonomy")
    rules = t.part.groupBy(F.concat(F.col("p_type"), F.lit(" Part/Rule")).alias("rule")).agg(
        F.sort_array(F.collect_set("p_name")).alias("barriers"), F.sort_array(F.collect_set("p_brand")).alias("typical_hazards"))
    document = rules.agg(F.to_json(F.struct(F.collect_list(F.struct("rule", "barriers", "typical_hazards")).alias("life_saving_rules")),
                                   {"pretty": "true"}).alias("value"))
    document.write.text(path)
    return taxonomy.read_taxonomy(t.spark, path)


@query("taxonomy_lookup", """
SELECT id, life_saving_rule, coalesce(hazards, 'N/A') AS typical_hazard, coalesce(barriers, 'N/A') AS typical_barrier FROM reports LEFT JOIN (
  SELECT rule, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS hazards, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS barriers
  FROM (SELECT """ + "[" + ", ".join(sql_text(r) for r in RULES) + "]" + """[CAST(p_partkey % 9 AS INT) + 1] AS rule, p_brand, p_type FROM part)
  WHERE rule <> 'Driving' GROUP BY 1) ON rule = life_saving_rule""", ("reports",))
def _(t):
    from bindings.evaluate import part_taxonomy
    return taxonomy.taxonomy_lookup(t.reports.select("id", "life_saving_rule"), part_taxonomy(t))


@query("enrich_taxonomy", """
SELECT life_saving_rule, n, coalesce(hazards, 'N/A') AS typical_hazard, coalesce(barriers, 'N/A') AS typical_barrier
FROM (SELECT life_saving_rule, count(*) AS n FROM reports GROUP BY 1) LEFT JOIN (
  SELECT rule, NULL AS hazards, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS barriers
  FROM (SELECT """ + "[" + ", ".join(sql_text(r) for r in RULES) + "]" + """[CAST(p_partkey % 9 AS INT) + 1] AS rule, p_type FROM part) GROUP BY 1) ON rule = life_saving_rule""", ("reports",))
def _(t):
    """A taxonomy without hazards: an empty list also reads N/A."""
    from bindings.evaluate import part_taxonomy
    empty = part_taxonomy(t).withColumn("typical_hazards", F.array().cast("array<string>"))
    extra = empty.unionByName(t.part.select(F.lit("Driving").alias("rule"), F.lit(None).cast("array<string>").alias("typical_hazards"),
                                            F.col("p_type")).filter("p_type is not null").groupBy("rule").agg(
        F.first("typical_hazards").alias("typical_hazards"), F.sort_array(F.collect_set("p_type")).alias("barriers")))
    counts = t.reports.groupBy("life_saving_rule").agg(F.count(F.lit(1)).alias("n"))
    return taxonomy.taxonomy_lookup(counts, extra)


@query("taxonomy_diff", """
SELECT rule, 'expected_only' AS side FROM (SELECT DISTINCT c_mktsegment AS rule FROM customer EXCEPT SELECT p_type FROM part)
UNION ALL SELECT rule, 'actual_only' FROM (SELECT DISTINCT p_type AS rule FROM part EXCEPT SELECT c_mktsegment FROM customer)""")
def _(t):
    return taxonomy.taxonomy_diff(t.customer.select(F.col("c_mktsegment").alias("rule")), t.part.select(F.col("p_type").alias("rule")))
