"""Views of the test tables in the shapes the operators expect, for both engines."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.functions.text import WHITESPACE
from narrascope.operators.skew import spread
from narrascope.schemas import RULE_SEVERITY, RULES

CLASSES = len(RULES)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_RULES = "[" + ", ".join(sql_text(rule) for rule in RULES) + "]"
SQL_WHITESPACE = sql_text(WHITESPACE)
SQL_SEVERITY = "CASE {rule} " + " ".join(
    f"WHEN {sql_text(rule)} THEN {weight}::DOUBLE" for rule, weight in RULE_SEVERITY.items()
) + " ELSE 0.5::DOUBLE END"

def _sql_mass(i: int) -> str:
    """Weight of class i of a report; one class of some reports weighs much more."""
    return (f"sqrt(CAST((((o_orderkey * {i + 3} * 31 + o_custkey * {i + 1}) % 97) + 1)"
            f" * CASE WHEN o_custkey % 9 = {i} AND o_orderkey % 2 = 0 THEN 900 ELSE 1 END AS DOUBLE))")


SQL_MASSES = "[" + ", ".join(_sql_mass(i) for i in range(CLASSES)) + "]"
SQL_TOTAL = " + ".join(f"a[{i + 1}]" for i in range(CLASSES))
SQL_SIZES = "[" + ", ".join(f"abs(CAST(embedding[{i + 1}] AS DOUBLE))" for i in range(CLASSES)) + "]"

SQL_VIEWS = {
    "narratives": """
SELECT concat(d.source, '__', CAST(d.doc_id AS VARCHAR)) AS record_id, d.doc_id,
       d.source AS source_dataset, d.text AS narrative_text, d.lang AS industry_domain,
       (d.doc_id % 3 = 0) AS is_synthetic,
       CASE WHEN l.quality IS NULL THEN 'UNKNOWN' WHEN l.quality = 1 THEN 'No' ELSE 'Yes' END AS sif_potential
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "reports": """
SELECT o.o_orderkey AS id, concat('RPT-', lpad(CAST(o.o_orderkey AS VARCHAR), CAST(greatest(length(CAST(o.o_orderkey AS VARCHAR)), 8) AS INT), '0')) AS report_id,
       o.o_custkey AS reporter_id, n.n_name AS site, c.c_mktsegment AS activity,
       CASE o.o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'P' THEN 'Investigation' ELSE 'Submitted' END AS status,
       CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Yes'
            WHEN o.o_orderpriority = '3-MEDIUM' THEN 'NEEDS_REVIEW' ELSE 'No' END AS sif_potential,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'Driving' WHEN 1 THEN 'Hot Work' WHEN 2 THEN 'Line of Fire'
            WHEN 3 THEN 'Unmapped' ELSE 'N/A' END AS life_saving_rule,
       CAST(floor(o.o_totalprice / 5000) AS INT) AS risk_score,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'bulk_upload' ELSE 'api' END AS source,
       o.o_orderdate AS ts,
       CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') AND floor(o.o_totalprice / 5000) >= 70
            THEN 1 ELSE 0 END AS critical
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "audit_log": """
SELECT event_id AS id, user_id AS actor_user_id, event_type AS action,
       CASE WHEN event_id % 2 = 0 THEN 'report' ELSE 'user' END AS target_type,
       CAST(event_id % 500 AS VARCHAR) AS target_id, value,
       CASE event_type WHEN 'view' THEN 'Submitted' WHEN 'click' THEN 'Reviewed'
            WHEN 'error' THEN 'Investigation' WHEN 'purchase' THEN 'Action Assigned' ELSE 'Closed' END AS new_value,
       ts AS created_at
FROM events""",
    "scored": """
SELECT vec_id, label, CASE WHEN label < 3 THEN 1 ELSE 0 END AS y,
       least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + 2 * CAST(embedding[1] AS DOUBLE))) AS p
FROM embeddings""",
    "class_long": f"""
SELECT vec_id, label, true_rule, rule, m / s AS p FROM (
  SELECT vec_id, label, {SQL_RULES}[CAST(label % 9 AS INT) + 1] AS true_rule, unnest({SQL_RULES}) AS rule,
         unnest(a) AS m, {SQL_TOTAL} AS s
  FROM (SELECT vec_id, label, {SQL_SIZES} AS a FROM embeddings))""",
    "report_p": """
SELECT o_orderkey AS id, least(1.0::DOUBLE, o_totalprice / 400000.0::DOUBLE) AS p FROM orders""",
    "report_classes": f"""
SELECT id, rule, m / s AS p FROM (
  SELECT id, unnest({SQL_RULES}) AS rule, unnest(a) AS m, {SQL_TOTAL} AS s
  FROM (SELECT o_orderkey AS id, {SQL_MASSES} AS a FROM orders))""",
}


class Tables:
    """The tables of one folder, and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"}:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def texts(self) -> DataFrame:
        """Documents, in enough tasks for heavy work per row."""
        return spread(self.documents, "doc_id")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Rows with a `doc_id` and the decision that their label stands for. Labels beyond a broadcast move the rows, so let them be narrow."""
        quality = F.col("quality")
        return rows.join(self.labels.select("doc_id", "quality"), "doc_id", "left").withColumn(
            "sif_potential", F.when(quality.isNull(), "UNKNOWN").when(quality == 1, "No").otherwise("Yes")).drop("quality")

    @cached_property
    def narratives(self) -> DataFrame:
        return self.labelled(self.texts).select(
            F.concat_ws("__", "source", F.col("doc_id").cast("string")).alias("record_id"), "doc_id",
            F.col("source").alias("source_dataset"), F.col("text").alias("narrative_text"),
            F.col("lang").alias("industry_domain"), (F.col("doc_id") % 3 == 0).alias("is_synthetic"), "sif_potential")

    @cached_property
    def reports(self) -> DataFrame:
        key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
        score = F.floor(F.col("o_totalprice") / 5000)
        urgent = priority.isin("1-URGENT", "2-HIGH")
        joined = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(
            self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        rule = (F.when(key % 5 == 0, "Driving").when(key % 5 == 1, "Hot Work")
                .when(key % 5 == 2, "Line of Fire").when(key % 5 == 3, "Unmapped").otherwise("N/A"))
        return joined.select(
            key.alias("id"), report_id(key).alias("report_id"), F.col("o_custkey").alias("reporter_id"),
            F.col("n_name").alias("site"), F.col("c_mktsegment").alias("activity"),
            F.when(status == "F", "Closed").when(status == "P", "Investigation").otherwise("Submitted").alias("status"),
            F.when(urgent, "Yes").when(priority == "3-MEDIUM", "NEEDS_REVIEW").otherwise("No").alias("sif_potential"),
            rule.alias("life_saving_rule"), score.cast("int").alias("risk_score"),
            F.when(key % 4 == 0, "synthetic").when(key % 4 == 1, "bulk_upload").otherwise("api").alias("source"),
            F.col("o_orderdate").alias("ts"), (urgent & (score >= 70)).cast("int").alias("critical"))

    @cached_property
    def audit_log(self) -> DataFrame:
        key, kind = F.col("event_id"), F.col("event_type")
        return self.events.select(
            key.alias("id"), F.col("user_id").alias("actor_user_id"), kind.alias("action"),
            F.when(key % 2 == 0, "report").otherwise("user").alias("target_type"),
            (key % 500).cast("string").alias("target_id"), "value",
            F.when(kind == "view", "Submitted").when(kind == "click", "Reviewed")
            .when(kind == "error", "Investigation").when(kind == "purchase", "Action Assigned")
            .otherwise("Closed").alias("new_value"), F.col("ts").alias("created_at"))

    @cached_property
    def scored(self) -> DataFrame:
        raw = F.lit(0.5) + 2 * F.col("embedding")[0].cast("double")
        return self.embeddings.select(
            "vec_id", "label", (F.col("label") < 3).cast("int").alias("y"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)).alias("p"))

    @cached_property
    def class_probs(self) -> DataFrame:
        """One row per vector with array<struct<rule, p>>."""
        size = [F.abs(F.col("embedding")[i].cast("double")) for i in range(CLASSES)]
        total = size[0]
        for value in size[1:]:
            total = total + value
        probs = F.array(*[F.struct(F.lit(rule).alias("rule"), (size[i] / F.col("_s")).alias("p"))
                          for i, rule in enumerate(RULES)])
        true_rule = F.array(*[F.lit(rule) for rule in RULES])[F.col("label") % CLASSES]
        return self.embeddings.withColumn("_s", total).select(
            "vec_id", "label", true_rule.alias("true_rule"), probs.alias("class_probs"))

    @cached_property
    def class_long(self) -> DataFrame:
        return self.class_probs.select("vec_id", "label", "true_rule", F.inline("class_probs"))

    @cached_property
    def scored_reports(self) -> DataFrame:
        """Reports with P(Yes) and class probabilities computed from their order."""
        key, owner = F.col("o_orderkey"), F.col("o_custkey")
        mass = {f"m{i}": F.sqrt((((key * (i + 3) * 31 + owner * (i + 1)) % 97 + 1)
                                 * F.when((owner % CLASSES == i) & (key % 2 == 0), 900).otherwise(1)).cast("double"))
                for i in range(CLASSES)}
        total = reduce(lambda a, b: a + b, [F.col(name) for name in mass])
        probs = F.array(*[F.struct(F.lit(rule).alias("rule"), (F.col(name) / F.col("s")).alias("p"))
                          for rule, name in zip(RULES, mass)])
        scores = spread(self.orders, "o_orderkey").select(
            key.alias("id"), F.least(F.lit(1.0), F.col("o_totalprice") / 400000.0).alias("p"),
            *[value.alias(name) for name, value in mass.items()]).withColumn("s", total).select(
            "id", "p", probs.alias("class_probs"))
        kept = self.reports.drop("sif_potential", "life_saving_rule", "risk_score", "critical")
        return scores.join(kept, "id")


def report_id(key) -> "F.Column":
    text = key.cast("string")
    return F.concat(F.lit("RPT-"), F.lpad(text, F.greatest(F.length(text), F.lit(8)), F.lit("0")))
