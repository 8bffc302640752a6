"""Features, classifiers and explanations."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from bindings.evaluate import COUNTS, CURVE, F1, PREC, REC, SCORE_CURVE
from bindings.registry import query
from bindings.views import Tables, sql_text
from narrascope.operators.quality import class_weights
from narrascope.plans import models as M
from narrascope.plans.scoring import score_reports
from narrascope.plans.stages import scoring_pipeline
from narrascope.schemas import RULES
from narrascope.session import local_table, new_scratch, written


def vectors(t: Tables):
    """Embeddings as labelled training rows with a rule each."""
    rule = F.array(*[F.lit(r) for r in RULES])[F.col("label") % len(RULES)]
    return t.embeddings.select(
        "vec_id", array_to_vector(F.col("embedding")).alias("features"), (F.col("label") < 3).cast("int").alias("y"),
        rule.alias("life_saving_rule"))


@query("embed_text", r"""
SELECT doc_id, 384 AS dims, CASE WHEN regexp_matches(narrative_text, '[\p{L}\p{N}_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM narratives""", ("narratives",))
def _(t):
    fitted = M.text_features("narrative_text").fit(t.narratives)
    vector = vector_to_array("features")
    made = fitted.transform(t.narratives.select("doc_id", "narrative_text")).select("doc_id", vector.alias("v"))
    return made.select("doc_id", F.size("v").alias("dims"),
                       F.bround(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


def _count_letters():
    """An encoder for the test of the slot: shares of five letters."""
    def encode(texts: list[str]) -> list[list[float]]:
        return [[float(text.count(letter)) for letter in "aeiou"] for text in texts]

    return encode


@query("encoder_slot", """
SELECT doc_id, length(text) - length(replace(text, 'a', '')) AS a, length(text) - length(replace(text, 'u', '')) AS u FROM documents""")
def _(t):
    made = M.embed_with(t.documents.select("doc_id", "text"), "text", _count_letters)
    return made.select("doc_id", F.col("embedding")[0].cast("bigint").alias("a"), F.col("embedding")[4].cast("bigint").alias("u"))


@query("mean_pool_l2", """
WITH long AS (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i,
  CASE WHEN vec_id % 7 <> 0 AND label <> 2 THEN 1 ELSE 0 END AS k FROM embeddings),
m AS (SELECT label, i, sum(CASE WHEN k = 1 THEN CAST(x AS DOUBLE) ELSE 0 END) / greatest(sum(k), 1e-9::DOUBLE) AS x FROM long GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
SELECT label, CAST(i AS INT) AS i, round_even(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS x FROM m JOIN n USING (label)""")
def _(t):
    tokens = t.embeddings.withColumn("mask", ((F.col("vec_id") % 7 != 0) & (F.col("label") != 2)).cast("int"))
    pooled = M.mean_pool(tokens, "label", "embedding", "mask")
    long = pooled.select("label", F.posexplode("embedding").alias("i", "x"))
    return long.select("label", (F.col("i") + 1).alias("i"), F.bround("x", 6).alias("x"))


@query("label_weights", """
SELECT y, n, round_even(sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE), 6) AS weight
FROM (SELECT CASE WHEN label < 3 THEN 1 ELSE 0 END AS y, count(*) AS n FROM embeddings GROUP BY 1)""")
def _(t):
    return class_weights(vectors(t), "y")


OPTIMUM = 1e-5  # largest gradient entry of a finished fit


@query("train_sif", """
SELECT CAST(unnest(range(0, 65)) AS INT) AS dimension, true AS at_optimum, count(*) AS n, count(*) FILTER (WHERE label < 3) AS positive FROM embeddings""")
def _(t):
    """The fit's first-order condition per coefficient, and for the intercept (dimension 64)."""
    rows = vectors(t)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("positive"))
    met = M.fit_gradient(M.train_sif(rows), rows).select("dimension", (F.abs("gradient") < OPTIMUM).alias("at_optimum"))
    return met.withColumns({"n": sizes.select("n").scalar(), "positive": sizes.select("positive").scalar()})


@query("train_rule", "SELECT " + "[" + ", ".join(sql_text(r) for r in RULES) + "]" + """[CAST(label % 9 AS INT) + 1] AS life_saving_rule,
  count(*) AS n, 65 AS dimensions, 65 AS at_optimum FROM embeddings GROUP BY 1""")
def _(t):
    """Per rule: its rows, and how many entries of its gradient vanish (64 coefficients, one intercept)."""
    rows = vectors(t)
    met = M.fit_gradient(M.train_rule(rows), M.rule_rows(rows), label="label").groupBy("class").agg(
        F.count(F.lit(1)).alias("dimensions"), F.count_if(F.abs("gradient") < OPTIMUM).alias("at_optimum"))
    named = met.withColumn("life_saving_rule", F.array(*[F.lit(r) for r in RULES])[F.col("class")]).drop("class")
    return rows.groupBy("life_saving_rule").agg(F.count(F.lit(1)).alias("n")).join(named, "life_saving_rule")


@query("save_load_model", "SELECT count(*) AS n, count(*) AS equal_predictions, 2 AS classes FROM embeddings")
def _(t):
    path = new_scratch(t.spark, "model")
    rows = vectors(t)
    model = M.train_sif(rows)
    M.save_model(model, local_table(t.spark, [(2, "1.0.0")], "classes int, model_version string"), path)
    loaded, metadata = M.load_model(t.spark, path)
    before = M.positive_probability(model.transform(rows)).select("vec_id", F.col("p").alias("p0"))
    after = M.positive_probability(loaded.transform(rows)).select("vec_id", "p")
    return before.join(after, "vec_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == F.col("p0")).alias("equal_predictions")).withColumn(
        "classes", metadata.select(F.col("classes").cast("int")).scalar())


@query("scoring_pipeline", """
SELECT count(*) AS n, count(*) AS equal_rows, 0 AS hidden_columns FROM narratives WHERE narrative_text IS NOT NULL""", ("narratives",))
def _(t):
    """Raw texts scored by one saved pipeline, and by its parts step by step, from the stored features.

    Both meet in the row that holds the text; only narrow rows meet the labels.
    """
    rows = t.texts.filter("text IS NOT NULL").select(
        "doc_id", F.col("text").alias("narrative_text"), F.col("source").alias("site"), F.col("lang").alias("activity"),
        F.get(F.array(*[F.lit(r) for r in RULES]), (F.col("doc_id") % 4).cast("int")).alias("life_saving_rule"))
    features = M.text_features("narrative_text", dimensions=32).fit(rows)
    made = written(features.transform(rows).select(*rows.columns, "features"), "features")
    labelled = t.labelled(made.drop("narrative_text"))
    taught = written(labelled.withColumn("y", F.when(F.col("sif_potential") == "Yes", 1).otherwise(0)), "labelled")
    sif, rule = M.train_sif(taught), M.train_rule(taught)
    recurrence = written(taught.groupBy("site", "activity", "life_saving_rule").agg(F.count(F.lit(1)).alias("n")), "recurrence")
    path = new_scratch(t.spark, "pipeline")
    scoring_pipeline(features, sif, rule, recurrence.scratch_path, row_id="doc_id").write().save(path)
    columns = ("sif_potential", "confidence", "sif_reasons", "life_saving_rule", "rule_confidence", "rule_review_reason", "risk_score", "risk_level", "critical")
    shown = F.to_json(F.struct(*columns))
    loaded = PipelineModel.load(path).transform(made.select("doc_id", "narrative_text", "site", "activity", F.col("features").alias("stored")))
    hidden = sum(c.startswith("_") or c == "features" for c in loaded.columns)
    scored = loaded.select("doc_id", "site", "activity", F.col("stored").alias("features"), shown.alias("a"))
    once = M.positive_probability(sif.transform(scored)).drop("probability", "prediction", "rawPrediction")
    plain = score_reports(rule.transform(once).withColumn("class_probs", M.class_probabilities()), recurrence, row_id="doc_id")
    return t.labelled(plain.select("doc_id", (F.col("a") == shown).alias("equal"))).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("equal").alias("equal_rows")).withColumn("hidden_columns", F.lit(hidden))


COEFFICIENTS = r"""words AS (SELECT doc_id, sif_potential, unnest(regexp_split_to_array(lower(narrative_text), '[^\p{L}\p{N}_]+')) AS word FROM narratives),
tf AS (SELECT doc_id, sif_potential, word, count(*) AS tf FROM words WHERE word <> '' GROUP BY 1, 2, 3),
coef AS (SELECT word, ln((SELECT count(*) + 1 FROM narratives) / CAST(count(*) + 1 AS DOUBLE)) AS idf,
  (count(*) FILTER (WHERE sif_potential = 'Yes') - count(*) FILTER (WHERE sif_potential = 'No')) / CAST(count(*) AS DOUBLE) AS beta FROM tf GROUP BY 1)"""


@query("explain_terms", f"""
WITH {COEFFICIENTS}, w AS (SELECT doc_id, word, round_even(tf * idf * beta, 6) AS weight FROM tf JOIN coef USING (word))
SELECT doc_id, rank, word, weight FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY abs(weight) DESC, word) AS INT) AS rank FROM w) WHERE rank <= 6""",
       ("narratives",))
def _(t):
    """Coefficients from document counts of the labels, as a stand-in for a fitted model."""
    tf = M.term_frequencies(t.narratives, "doc_id", "narrative_text", "sif_potential")
    documents = t.narratives.agg(F.count(F.lit(1)) + 1).scalar()
    df = F.count(F.lit(1))
    gap = F.count_if(F.col("sif_potential") == "Yes") - F.count_if(F.col("sif_potential") == "No")
    coefficients = tf.groupBy("word").agg(df.alias("df"), gap.alias("gap")).select(
        "word", F.ln(documents / (F.col("df") + 1)).alias("idf"), (F.col("gap") / F.col("df")).alias("beta"))
    return M.explain_terms(t.narratives, written(coefficients, "coefficients"))


@query("evaluate_model", """
SELECT 'embedding_lr' AS model_id, false AS skipped, NULL AS skip_reason, count(*) AS test_rows, count(*) FILTER (WHERE label < 3) AS positive, true AS in_range FROM embeddings WHERE vec_id % 10 >= 8
UNION ALL SELECT 'no_checkpoint', true, 'no qualifying checkpoint', NULL, NULL, NULL
UNION ALL SELECT 'no_column', true, 'no column sentence', NULL, NULL, NULL""")
def _(t):
    """A trained candidate and two skipped ones; the figures of a scored one are in `evaluate_scored`."""
    made = M.evaluate_candidates(vectors(t).withColumn("split", split_of()), {
        "embedding_lr": "features", "no_checkpoint": None, "no_column": "sentence"})
    in_range = (F.col("pr_auc").between(0, 1) & F.col("brier_score").between(0, 1) & F.col("threshold").between(0.05, 0.95)
                & (F.size("calibration_bins") == 10))
    return made.select("model_id", "skipped", "skip_reason", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("test_rows"),
                       (F.col("tp") + F.col("fn")).alias("positive"), in_range.alias("in_range"))


def split_of():
    """Six, two and two of ten rows in train, validation and test."""
    digit = F.col("vec_id") % 10
    return F.when(digit < 6, "train").when(digit < 8, "validation").otherwise("test")


@query("evaluate_scored", f"""
WITH validation AS (SELECT y, p FROM scored WHERE vec_id % 10 BETWEEN 6 AND 7), test AS (SELECT y, p FROM scored WHERE vec_id % 10 >= 8),
{CURVE.replace("FROM scored", "FROM validation")},
best AS (SELECT coalesce(max(threshold), 0.05::DOUBLE) AS t FROM (SELECT * FROM curve WHERE pr >= 0.5 AND re > 0 ORDER BY re DESC, step LIMIT 1)),
rates AS (SELECT *, {PREC} AS pr, {REC} AS re FROM (SELECT t AS threshold, {COUNTS.format(t='t')} FROM test, best GROUP BY t)),
{SCORE_CURVE.replace("FROM scored", "FROM test")},
points AS (SELECT score, tp / CAST(tp + fp AS DOUBLE) AS pr, tp / CAST(total AS DOUBLE) AS re FROM sc),
area AS (SELECT round_even(sum((re - re0) * (pr + pr0) / 2), 4) AS pr_auc FROM (
  SELECT *, coalesce(lag(re) OVER (ORDER BY score DESC), 0.0) AS re0, coalesce(lag(pr) OVER (ORDER BY score DESC), 1.0) AS pr0 FROM points)),
bins AS (SELECT bin, count(p) AS bin_n, round_even(avg(p), 4) AS mean_predicted_prob, round_even(avg(CAST(y AS DOUBLE)), 4) AS actual_positive_rate
  FROM (SELECT CAST(unnest(range(0, 10)) AS INT) AS bin) LEFT JOIN test ON p >= bin * 0.1::DOUBLE AND p < (bin + 1) * 0.1::DOUBLE GROUP BY bin)
SELECT 'raw' AS model_id, threshold, tp, fp, tn, fn, round_even(pr, 4) AS precision, round_even(re, 4) AS recall, round_even({F1}, 4) AS f1,
  round_even(CASE WHEN tp + fn > 0 THEN fn / CAST(tp + fn AS DOUBLE) ELSE 0 END, 4) AS fn_rate,
  round_even(CASE WHEN fp + tn > 0 THEN fp / CAST(fp + tn AS DOUBLE) ELSE 0 END, 4) AS fp_rate, pr_auc,
  (SELECT round_even(avg((p - y) * (p - y)), 4) FROM test) AS brier_score, bins.* FROM rates, area, bins""", ("scored",))
def _(t):
    """The whole evaluation row of given scores, one line per calibration bin."""
    made = M.evaluate_scored(t.scored.withColumn("split", split_of()), "raw")
    bins = F.inline("calibration_bins").alias("bin", "bin_low", "bin_high", "bin_n", "mean_predicted_prob", "actual_positive_rate")
    return made.select(*[c for c in made.columns if c != "calibration_bins"], bins).drop("bin_low", "bin_high")
