"""Decision contracts, risk, and evaluation of scored rows."""

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.views import CLASSES, SQL_RULES, SQL_SEVERITY, Tables
from narrascope.functions import contracts as C
from narrascope.operators import evaluation as E
from narrascope.operators.quality import class_weights, top_classes
from narrascope.operators.reporting import recurrence_table
from narrascope.plans.scoring import RULE_COLUMNS, score_reports, with_recurrence
from narrascope.schemas import RULES
from narrascope.session import local_table, written

S, L = ("scored",), ("class_long",)


# --- contracts ----------------------------------------------------------------

@query("risk_level", """
SELECT id, risk_score, CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level
FROM reports""", ("reports",))
def _(t: Tables):
    return t.reports.select("id", "risk_score", C.risk_level(F.col("risk_score")).alias("risk_level"))


@query("flag_critical", """
SELECT id, (sif_potential = 'Yes' AND risk_score >= 70) AS critical FROM reports""", ("reports",))
def _(t):
    return t.reports.select("id", C.flag_critical(F.col("sif_potential"), F.col("risk_score")).alias("critical"))


BAND = """CASE WHEN p < 0.35 THEN printf('P(Yes)=%.3f below low threshold 0.35 -> No', p)
  WHEN p >= 0.70 THEN printf('P(Yes)=%.3f at/above high threshold 0.7 -> Yes', p)
  ELSE printf('P(Yes)=%.3f between thresholds [0.35, 0.7) -> NEEDS_REVIEW (Phase 11 found this range unreliable on real narratives)', p) END"""
LABEL = "CASE WHEN p < 0.35 THEN 'No' WHEN p >= 0.70 THEN 'Yes' ELSE 'NEEDS_REVIEW' END"


@query("sif_contract", f"""
SELECT vec_id, {LABEL} AS sif_potential, round_even(p, 4) AS confidence, {BAND} AS band_reason,
       0.35::DOUBLE AS low, 0.70::DOUBLE AS high FROM scored""", S)
def _(t):
    # scored far outside [0, 1] first, so that the contract has to clip
    raw = t.scored.withColumn("p", F.when(F.col("p") == 1.0, 1.5).when(F.col("p") == 0.0, -0.5).otherwise(F.col("p")))
    decided = raw.withColumn("c", C.sif_contract(F.col("p")))
    return decided.select("vec_id", "c.sif_potential", "c.confidence", "c.band_reason",
                          F.col("c.thresholds")["low"].alias("low"), F.col("c.thresholds")["high"].alias("high"))


# four phrases per vector: a word for each of four components, the component as weight
PHRASES = "[('alpha', 1), ('beta', 2), ('gamma', 3), ('delta', 4)]"


@query("sif_reasons", f"""
WITH long AS (
  SELECT vec_id, unnest(['alpha', 'beta', 'gamma', 'delta']) AS phrase,
         unnest([CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE), CAST(embedding[5] AS DOUBLE)]) AS w,
         unnest([1, 2, 3, 4]) AS i FROM embeddings),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(w) DESC, i) AS rn FROM long) WHERE rn <= 3)
SELECT s.vec_id, concat({BAND}, ' / ', t.reasons) AS reasons
FROM scored s JOIN (SELECT vec_id, string_agg(printf('contributing phrase ''%s'' (%s, weight=%.3f)', phrase,
  CASE WHEN w > 0 THEN 'toward Yes' ELSE 'toward No' END, w), ' / ' ORDER BY rn) AS reasons FROM top GROUP BY 1) t USING (vec_id)""", S)
def _(t):
    phrases = F.array(*[F.struct(F.lit(name).alias("phrase"), F.col("embedding")[i].cast("double").alias("weight"))
                        for i, name in enumerate(("alpha", "beta", "gamma", "delta"), start=1)])
    raw = t.embeddings.select("vec_id", phrases.alias("phrases")).join(t.scored, "vec_id")
    return raw.select("vec_id", F.array_join(C.sif_reasons(F.col("p"), F.col("phrases")), " / ").alias("reasons"))


RANKED = """ranked AS (
  SELECT vec_id, true_rule, max(rule) FILTER (WHERE rn = 1) AS top_rule, max(p) FILTER (WHERE rn = 1) AS p1,
         max(rule) FILTER (WHERE rn = 2) AS second_rule, max(p) FILTER (WHERE rn = 2) AS p2
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, rule DESC) AS rn FROM class_long)
  GROUP BY 1, 2)"""
REASON = """concat_ws('; ', CASE WHEN p1 < 0.5 THEN printf('top-class confidence %.3f < threshold 0.50', p1) END,
  CASE WHEN p1 - p2 < 0.15 THEN printf('confidence gap %.3f < ambiguity margin 0.15 (''%s'' vs ''%s'')', p1 - p2, top_rule, second_rule) END)"""
REVIEW = "(p1 < 0.5 OR p1 - p2 < 0.15)"


def _contract_sql(key: str, source: str) -> str:
    return f"""
SELECT {key}, CASE WHEN {REVIEW} THEN 'NEEDS_REVIEW' ELSE top_rule END AS rule_prediction,
       round_even(p1, 6) AS confidence, second_rule AS runner_up_rule, round_even(p2, 6) AS runner_up_confidence,
       {REVIEW} AS needs_review, CASE WHEN {REVIEW} THEN {REASON} END AS review_reason
FROM {source}"""


CONTRACT_COLUMNS = ("rule_prediction", "confidence", "runner_up_rule", "runner_up_confidence",
                    "needs_review", "review_reason")


@query("rule_contract", f"WITH {RANKED} {_contract_sql('vec_id', 'ranked')}", L)
def _(t):
    decided = t.class_probs.withColumn("c", C.rule_contract(F.col("class_probs")))
    return decided.select("vec_id", *[f"c.{name}" for name in CONTRACT_COLUMNS])


REPORT_RANKED = """ranked AS (
  SELECT id, max(rule) FILTER (WHERE rn = 1) AS top_rule, max(p) FILTER (WHERE rn = 1) AS p1,
         max(rule) FILTER (WHERE rn = 2) AS second_rule, max(p) FILTER (WHERE rn = 2) AS p2
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, rule DESC) AS rn FROM report_classes)
  GROUP BY 1)"""
EVALUATED = "p >= 0.35"
CONDITIONAL = f"""
SELECT id, p, CASE WHEN {EVALUATED} THEN CASE WHEN {REVIEW} THEN 'NEEDS_REVIEW' ELSE top_rule END ELSE 'N/A' END AS life_saving_rule,
       CASE WHEN {EVALUATED} THEN CAST(round_even(CAST(round_even(p1, 6) AS DECIMAL(18, 6)), 4) AS DOUBLE) ELSE 0.0::DOUBLE END AS rule_confidence,
       ({EVALUATED} AND {REVIEW}) AS rule_needs_review,
       CASE WHEN {EVALUATED} AND {REVIEW} THEN {REASON} END AS rule_review_reason,
       CASE WHEN {EVALUATED} THEN second_rule END AS rule_runner_up,
       CASE WHEN {EVALUATED} THEN round_even(p2, 6) END AS rule_runner_up_confidence
FROM report_p JOIN ranked USING (id)"""
CONDITIONAL_COLUMNS = ("life_saving_rule", "rule_confidence", "rule_needs_review", "rule_review_reason",
                       "rule_runner_up", "rule_runner_up_confidence")


@query("conditional_rule", f"WITH {REPORT_RANKED} SELECT * EXCLUDE (p) FROM ({CONDITIONAL})",
       ("report_p", "report_classes"))
def _(t):
    c = C.conditional_rule(C.sif_label(F.col("p")), C.rule_contract(F.col("class_probs")))
    return t.scored_reports.withColumn("c", c).select("id", *[f"c.{name}" for name in CONDITIONAL_COLUMNS])


RECURRENCE = """recurrence AS (SELECT site, activity, life_saving_rule, count(*) AS n FROM reports
  WHERE source = 'synthetic' GROUP BY 1, 2, 3)"""


def _risk_sql(rule: str, share: str) -> str:
    return (f"CAST(round_even(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100.0::DOUBLE * (0.60::DOUBLE * p + {share} "
            f"+ 0.15::DOUBLE * ({SQL_SEVERITY.format(rule=rule)})))), 0) AS INT)")


SHARE = "0.25::DOUBLE * least(coalesce(n, 0) / CAST((SELECT max(n) FROM recurrence) AS DOUBLE), 1.0::DOUBLE)"


@query("recurrence_lookup", f"""
WITH {RECURRENCE} SELECT r.id, coalesce(n, 0) AS recurrence FROM reports r
LEFT JOIN recurrence c ON r.site = c.site AND r.activity = c.activity AND r.life_saving_rule = c.life_saving_rule""", ("reports",))
def _(t):
    return with_recurrence(t.reports, stored_recurrence(t), F.col("id")).select("id", "recurrence")


@query("severity_lookup", f"SELECT id, {SQL_SEVERITY.format(rule='life_saving_rule')} AS severity FROM reports", ("reports",))
def _(t):
    return t.reports.select("id", C.severity_of(F.col("life_saving_rule")).alias("severity"))


@query("risk_score", f"""
WITH {RECURRENCE} SELECT r.id, {_risk_sql('r.life_saving_rule', SHARE)} AS risk_score
FROM reports r JOIN report_p USING (id)
LEFT JOIN recurrence c ON r.site = c.site AND r.activity = c.activity AND r.life_saving_rule = c.life_saving_rule""",
       ("reports", "report_p"))
def _(t):
    table = stored_recurrence(t)
    rows = with_recurrence(t.reports.join(t.scored_reports.select("id", "p"), "id"), table, F.col("id"))
    score = C.risk_score(F.col("p"), F.col("life_saving_rule"), F.col("recurrence"), table.agg(F.max("n")).scalar())
    return rows.select("id", score.alias("risk_score"))


@query("risk_score_stateless", f"""
SELECT r.id, {_risk_sql('r.life_saving_rule', '0.0::DOUBLE')} AS risk_score FROM reports r JOIN report_p USING (id)""",
       ("reports", "report_p"))
def _(t):
    rows = t.reports.join(t.scored_reports.select("id", "p"), "id")
    return rows.select("id", C.risk_score(F.col("p"), F.col("life_saving_rule")).alias("risk_score"))


SCORED_COLUMNS = ("sif_potential", "confidence", "sif_reasons", "sif_model_name", "sif_model_version", "low", "high", *RULE_COLUMNS,
                  "risk_score", "risk_level", "critical")
# every column of a scored report, arrays and maps spelled out
SCORED_SQL = f"""{RECURRENCE}, decided AS ({CONDITIONAL}),
risked AS (SELECT r.id, p, {LABEL} AS sif_potential, round_even(p, 4) AS confidence, {BAND} AS sif_reasons,
  'embedding + logistic regression' AS sif_model_name, '1.0.0' AS sif_model_version, 0.35::DOUBLE AS low, 0.70::DOUBLE AS high,
  d.life_saving_rule, rule_confidence, rule_needs_review, rule_review_reason, rule_runner_up, rule_runner_up_confidence,
  CASE WHEN {EVALUATED} THEN 'rule_classifier' END AS rule_model_name, CASE WHEN {EVALUATED} THEN '1.0.0' END AS rule_model_version,
  {_risk_sql('d.life_saving_rule', SHARE)} AS risk_score
  FROM reports r JOIN decided d USING (id)
  LEFT JOIN recurrence c ON r.site = c.site AND r.activity = c.activity AND d.life_saving_rule = c.life_saving_rule),
scored_rows AS (SELECT *, CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END AS risk_level,
  CASE WHEN sif_potential = 'Yes' AND risk_score >= 70 THEN 1 ELSE 0 END AS critical FROM risked)"""


def flat(scored):
    """Reasons as one text and the thresholds as two columns, for the comparison."""
    at = F.col("sif_decision_thresholds")
    return scored.withColumns({"sif_reasons": F.array_join("sif_reasons", " / "), "low": at["low"], "high": at["high"]}).drop(
        "sif_decision_thresholds")


@query("score_reports", f"""
WITH {REPORT_RANKED}, {SCORED_SQL}
SELECT id, {", ".join(SCORED_COLUMNS)}, coalesce(hazards, 'N/A') AS typical_hazard, coalesce(barriers, 'N/A') AS typical_barrier
FROM scored_rows LEFT JOIN (
  SELECT rule, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS hazards,
         string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS barriers
  FROM (SELECT {SQL_RULES}[CAST(p_partkey % 9 AS INT) + 1] AS rule, p_brand, p_type FROM part) WHERE rule <> 'Driving' GROUP BY 1)
  ON rule = life_saving_rule""", ("reports", "report_p", "report_classes"))
def _(t):
    scored = score_reports(t.scored_reports, stored_recurrence(t), part_taxonomy(t), row_id="id")
    return flat(scored).select("id", *SCORED_COLUMNS, "typical_hazard", "typical_barrier")


def stored_recurrence(t: Tables):
    """The recurrence table as a job would keep it: computed once, read by every scoring run."""
    return written(recurrence_table(t.reports), "recurrence")


def part_taxonomy(t: Tables):
    """A taxonomy from the parts: brands as hazards and types as barriers of a rule."""
    rule = F.array(*[F.lit(r) for r in RULES])[(F.col("p_partkey") % CLASSES).cast("int")]
    return (t.part.select(rule.alias("rule"), "p_brand", "p_type").filter("rule <> 'Driving'").groupBy("rule").agg(
        F.sort_array(F.collect_set("p_brand")).alias("typical_hazards"),
        F.sort_array(F.collect_set("p_type")).alias("barriers")))


@query("top2_classes", """
SELECT vec_id, rule, p, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, rule DESC) AS rn FROM class_long) WHERE rn <= 2""", L)
def _(t):
    return top_classes(t.class_long, "vec_id").select("vec_id", "rule", "p", "rank")


# --- evaluation ---------------------------------------------------------------

COUNTS = """count(*) FILTER (WHERE p >= {t} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {t} AND y = 0) AS fp,
  count(*) FILTER (WHERE p < {t} AND y = 0) AS tn, count(*) FILTER (WHERE p < {t} AND y = 1) AS fn"""
PREC = "CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0::DOUBLE END"
REC = "CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0::DOUBLE END"
F1 = "CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0::DOUBLE END"


@query("confusion_matrix", f"SELECT {COUNTS.format(t=0.5)} FROM scored", S)
def _(t):
    return E.confusion_binary(t.scored, 0.5)


@query("confusion_classes", "WITH " + RANKED + "SELECT true_rule, " + ", ".join(
    f"count(*) FILTER (WHERE top_rule = '{r}') AS \"{r}\"" for r in RULES) + " FROM ranked GROUP BY 1", L)
def _(t):
    return E.confusion_classes(predicted(t), "true_rule", "top_rule")


@query("binary_metrics", f"""
SELECT tp, fp, tn, fn, round_even(pr, 4) AS precision, round_even(re, 4) AS recall, round_even({F1}, 4) AS f1,
  round_even(CASE WHEN tp + fn > 0 THEN fn / CAST(tp + fn AS DOUBLE) ELSE 0.0 END, 4) AS fn_rate,
  round_even(CASE WHEN fp + tn > 0 THEN fp / CAST(fp + tn AS DOUBLE) ELSE 0.0 END, 4) AS fp_rate
FROM (SELECT *, {PREC} AS pr, {REC} AS re FROM (SELECT {COUNTS.format(t=0.5)} FROM scored))""", S)
def _(t):
    return E.binary_metrics(t.scored, 0.5)


def predicted(t: Tables):
    ranked = C.ranked_classes(F.col("class_probs"))
    top = t.class_probs.withColumn("r", F.slice(ranked, 1, 2))
    return top.select("vec_id", "true_rule", F.col("r")[0]["rule"].alias("top_rule"), F.col("r")[0]["p"].alias("p1"),
                      F.col("r")[1]["rule"].alias("second_rule"), F.col("r")[1]["p"].alias("p2"))


def all_rules(t: Tables):
    return local_table(t.spark, [(r,) for r in RULES], "rule string")


@query("class_report", f"""
WITH {RANKED}, classes AS (SELECT unnest({SQL_RULES}) AS rule),
c AS (SELECT rule, (SELECT count(*) FROM ranked WHERE true_rule = rule) AS support,
  (SELECT count(*) FROM ranked WHERE top_rule = rule) AS said,
  (SELECT count(*) FROM ranked WHERE top_rule = rule AND true_rule = rule) AS hits FROM classes),
x AS (SELECT *, CASE WHEN said > 0 THEN hits / CAST(said AS DOUBLE) ELSE 0.0::DOUBLE END AS pr,
  CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0.0::DOUBLE END AS re FROM c)
SELECT rule, round_even(pr, 4) AS precision, round_even(re, 4) AS recall, round_even({F1}, 4) AS f1, support FROM x""", L)
def _(t):
    return E.class_report(predicted(t), "true_rule", "top_rule", all_rules(t))


@query("class_support", f"""
WITH classes AS (SELECT unnest({SQL_RULES}) AS rule),
c AS (SELECT life_saving_rule AS rule, count(*) AS n FROM reports GROUP BY 1)
SELECT rule, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AS absent, coalesce(n, 0) < 5 AS unreliable
FROM classes LEFT JOIN c USING (rule)""", ("reports",))
def _(t):
    return E.class_support(t.reports, all_rules(t), "life_saving_rule")


@query("accuracy", f"""
WITH {RANKED} SELECT count(*) AS n, round_even(avg(CASE WHEN true_rule = top_rule THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS accuracy FROM ranked""", L)
def _(t):
    return E.accuracy(predicted(t), "true_rule", "top_rule")


CURVE = f"""curve AS (
  SELECT step, step / 100.0::DOUBLE AS threshold, round_even(pr, 4) AS precision, round_even(re, 4) AS recall,
         round_even({F1}, 4) AS f1, tp, fp, tn, fn, pr, re
  FROM (SELECT *, {PREC} AS pr, {REC} AS re FROM (
    SELECT step, {COUNTS.format(t='(step / 100.0::DOUBLE)')} FROM scored, (SELECT unnest(range(5, 96)) AS step) GROUP BY step)))"""
CURVE_COLUMNS = "CAST(step AS INT) AS step, threshold, precision, recall, f1, tp, fp, tn, fn"


@query("threshold_sweep", f"WITH {CURVE} SELECT {CURVE_COLUMNS} FROM curve", S)
def _(t):
    return E.threshold_sweep(t.scored)


@query("pick_threshold", f"""
WITH {CURVE}, best AS (SELECT * FROM curve WHERE pr >= 0.5 AND re > 0 ORDER BY re DESC, step LIMIT 1)
SELECT coalesce(max(threshold), 0.05) AS threshold, coalesce(max(precision), 0.0) AS precision, coalesce(max(recall), 0.0) AS recall FROM best""", S)
def _(t):
    return E.pick_threshold(E.threshold_sweep(t.scored))


@query("reference_points", f"""
WITH {CURVE},
a AS (SELECT 'high_recall' AS point, false AS closest_only, {CURVE_COLUMNS} FROM curve WHERE recall >= 0.90 ORDER BY step DESC LIMIT 1),
b AS (SELECT 'max_f1' AS point, false AS closest_only, {CURVE_COLUMNS} FROM curve ORDER BY f1 DESC, step LIMIT 1),
n AS (SELECT 'near_precision' AS point, false AS closest_only, {CURVE_COLUMNS} FROM curve WHERE abs(precision - 0.70::DOUBLE) <= 0.05::DOUBLE ORDER BY recall DESC, step LIMIT 1),
m AS (SELECT 'near_precision' AS point, true AS closest_only, {CURVE_COLUMNS} FROM curve WHERE NOT EXISTS (SELECT 1 FROM n) ORDER BY abs(precision - 0.70::DOUBLE), step LIMIT 1),
e AS (SELECT 'above_floor' AS point, false AS closest_only, {CURVE_COLUMNS} FROM curve WHERE precision > 0.5 ORDER BY recall DESC, step LIMIT 1)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM n UNION ALL SELECT * FROM m UNION ALL SELECT * FROM e""", S)
def _(t):
    return E.reference_points(E.threshold_sweep(t.scored))


SCORE_CURVE = """per AS (SELECT p AS score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM scored GROUP BY 1),
sc AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS total FROM per)"""


@query("pick_threshold_recall_first", f"""
WITH {SCORE_CURVE},
r AS (SELECT score, tp / CAST(tp + fp AS DOUBLE) AS pr, tp / CAST(total AS DOUBLE) AS re FROM sc),
f AS (SELECT *, 2 * pr * re / (pr + re + 1e-10::DOUBLE) AS f1 FROM r),
a AS (SELECT 1 AS k, * FROM f WHERE re >= 0.85 ORDER BY f1 DESC, score LIMIT 1),
b AS (SELECT 2 AS k, * FROM f ORDER BY abs(re - 0.85::DOUBLE), score LIMIT 1)
SELECT round_even(score, 6) AS threshold, round_even(pr, 4) AS precision, round_even(re, 4) AS recall
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY k LIMIT 1""", S)
def _(t):
    return E.pick_threshold_recall_first(t.scored)


@query("pr_auc", f"""
WITH {SCORE_CURVE}, r AS (SELECT score, tp / CAST(tp + fp AS DOUBLE) AS pr, tp / CAST(total AS DOUBLE) AS re FROM sc)
SELECT round_even(sum((re - re0) * (pr + pr0) / 2), 4) AS pr_auc FROM (
  SELECT *, coalesce(lag(re) OVER (ORDER BY score DESC), 0.0) AS re0, coalesce(lag(pr) OVER (ORDER BY score DESC), 1.0) AS pr0 FROM r)""", S)
def _(t):
    return E.pr_auc(t.scored)


@query("brier_score", "SELECT round_even(avg((p - y) * (p - y)), 4) AS brier_score FROM scored", S)
def _(t):
    return E.brier_score(t.scored)


@query("calibration_bins", """
WITH bins AS (SELECT CAST(unnest(range(0, 10)) AS INT) AS bin)
SELECT bin, round_even(bin * 0.1::DOUBLE, 2) AS bin_low, round_even((bin + 1) * 0.1::DOUBLE, 2) AS bin_high, count(p) AS n,
       round_even(avg(p), 4) AS mean_predicted_prob, round_even(avg(CAST(y AS DOUBLE)), 4) AS actual_positive_rate
FROM bins LEFT JOIN scored ON p >= bin * 0.1::DOUBLE AND p < (bin + 1) * 0.1::DOUBLE GROUP BY bin""", S)
def _(t):
    return E.calibration_bins(t.scored)


@query("review_triggers", f"""
WITH {RANKED}, x AS (SELECT *, p1 < 0.5 AS low, p1 - p2 < 0.15 AS near, true_rule = top_rule AS hit FROM ranked),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE low) AS low_confidence, count(*) FILTER (WHERE near) AS low_gap,
  count(*) FILTER (WHERE low AND near) AS both, count(*) FILTER (WHERE low OR near) AS needs_review,
  count(*) FILTER (WHERE (low OR near) AND hit) AS review_correct, count(*) FILTER (WHERE NOT (low OR near) AND hit) AS confident_correct FROM x)
SELECT *, round_even(needs_review / CAST(n AS DOUBLE), 4) AS review_fraction,
  round_even(CASE WHEN n > needs_review THEN confident_correct / CAST(n - needs_review AS DOUBLE) ELSE 0.0 END, 4) AS confident_accuracy FROM c""", L)
def _(t):
    return E.review_triggers(predicted(t), "true_rule", "top_rule", "p1", "p2")


@query("curve_parity", f"""
WITH {CURVE}, stored AS (SELECT 13 AS step, count(*) FILTER (WHERE p >= 0.13 AND y = 1) AS tp,
  count(*) FILTER (WHERE p >= 0.13 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.13 AND y = 0) AS tn, count(*) FILTER (WHERE p < 0.13 AND y = 1) AS fn FROM scored
  UNION ALL SELECT 50, count(*), 0, 0, 0 FROM scored)
SELECT CAST(s.step AS INT) AS step, c.tp, c.fp, c.tn, c.fn, s.tp AS stored_tp, s.fp AS stored_fp, s.tn AS stored_tn, s.fn AS stored_fn,
  (c.tp = s.tp AND c.fp = s.fp AND c.tn = s.tn AND c.fn = s.fn) AS parity_ok
FROM stored s LEFT JOIN curve c ON c.step = s.step""", S)
def _(t):
    """Stored counts at two thresholds: one right, one wrong on purpose."""
    right = E.confusion_binary(t.scored, 0.13).withColumn("step", F.lit(13))
    zero = F.lit(0).cast("bigint")
    wrong = t.scored.agg(F.count(F.lit(1)).alias("tp")).select(
        "tp", zero.alias("fp"), zero.alias("tn"), zero.alias("fn"), F.lit(50).alias("step"))
    return E.curve_parity(E.threshold_sweep(t.scored), right.unionByName(wrong), ["step"])


def _metrics_sql(model: str, p: str) -> str:
    return f"""SELECT '{model}' AS model_id, round_even({PREC}, 4) AS precision, round_even({REC}, 4) AS recall
FROM (SELECT {COUNTS.format(t=0.5)} FROM (SELECT y, {p} AS p FROM scored))"""


@query("model_comparison", f"""
WITH results AS ({_metrics_sql('first', 'p')} UNION ALL {_metrics_sql('second', '1.0::DOUBLE - p')}),
skipped AS (SELECT 'third' AS model_id, 'no qualifying checkpoint' AS skip_reason),
registry AS (SELECT 'first' AS model_id, 'in_production' AS status UNION ALL SELECT 'fourth', 'candidate')
SELECT coalesce(r.model_id, s.model_id, g.model_id) AS model_id, precision, recall, skip_reason, status, precision IS NOT NULL AS evaluated
FROM results r FULL OUTER JOIN skipped s ON r.model_id = s.model_id FULL OUTER JOIN registry g ON g.model_id = coalesce(r.model_id, s.model_id)""", S)
def _(t):
    def row(name, scored):
        return E.binary_metrics(scored, 0.5).select(F.lit(name).alias("model_id"), "precision", "recall")

    results = row("first", t.scored).unionByName(row("second", t.scored.withColumn("p", 1.0 - F.col("p"))))
    skipped = local_table(t.spark, [("third", "no qualifying checkpoint")], "model_id string, skip_reason string")
    registry = local_table(t.spark, [("first", "in_production"), ("fourth", "candidate")], "model_id string, status string")
    return E.model_comparison(results, skipped, registry)


@query("class_weights", """
SELECT sif_potential, n, round_even(sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE), 6) AS weight
FROM (SELECT sif_potential, count(*) AS n FROM reports GROUP BY 1)""", ("reports",))
def _(t):
    return class_weights(t.reports, "sif_potential")
