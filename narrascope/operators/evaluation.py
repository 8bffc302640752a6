"""Model evaluation as aggregates: curves, reports, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrascope.functions.numbers import round_even
from narrascope.operators.ordering import running_totals
from narrascope.schemas import (
    CALIBRATION_BINS, PRECISION_FLOOR, RECALL_TARGET, RULE_CONFIDENCE, RULE_MARGIN, RULES,
    THRESHOLD_STEPS,
)

# fixed values: reference points of a threshold curve
HIGH_RECALL = 0.90
PRECISION_TARGET = 0.70
PRECISION_BAND = 0.05
FEW_EXAMPLES = 5


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0,
                  2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def _rates() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(name) for name in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": round_even(precision, 4),
        "recall": round_even(recall, 4),
        "f1": round_even(f1_of(precision, recall), 4),
        "fn_rate": round_even(ratio(fn, tp + fn), 4),
        "fp_rate": round_even(ratio(fp, fp + tn), 4),
    }


def confusion_binary(scored: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    said, true = F.col(p) >= threshold, F.col(y) == 1
    return scored.agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & ~true).alias("tn"), F.count_if(~said & true).alias("fn"))


def binary_metrics(scored: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    return confusion_binary(scored, threshold, y, p).withColumns(_rates())


def confusion_classes(df: DataFrame, truth: str, predicted: str, classes: tuple[str, ...] = RULES) -> DataFrame:
    """n-class matrix: one row per true class, one column per predicted class."""
    return df.groupBy(truth).pivot(predicted, list(classes)).count().na.fill(0)


def class_report(df: DataFrame, truth: str, predicted: str, classes: DataFrame, name: str = "rule") -> DataFrame:
    """Precision, recall, F1 and support per class; classes without rows get zeros.

    Pairs are counted before anything else, so the shuffle carries at most
    classes x classes rows per task.
    """
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    roles = pairs.select("t", "q", "n", F.explode(F.array(
        F.struct(F.col("t").alias(name), F.lit(True).alias("actual")),
        F.struct(F.col("q").alias(name), F.lit(False).alias("actual")))).alias("r"))
    counts = roles.groupBy(F.col("r")[name].alias(name)).agg(
        F.sum(F.when(F.col("r.actual"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("r.actual"), F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("r.actual") & (F.col("t") == F.col("q")), F.col("n")).otherwise(0)).alias("hits"))
    filled = classes.select(name).join(counts, name, "left").na.fill(0)
    precision, recall = ratio(F.col("hits"), F.col("said")), ratio(F.col("hits"), F.col("support"))
    return filled.select(
        name, round_even(precision, 4).alias("precision"), round_even(recall, 4).alias("recall"),
        round_even(f1_of(precision, recall), 4).alias("f1"), F.col("support"))


def class_support(df: DataFrame, classes: DataFrame, label: str, name: str = "rule") -> DataFrame:
    """Rows per class, including classes without any, with reliability flags."""
    counts = df.groupBy(F.col(label).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return classes.select(name).join(counts, name, "left").select(
        name, F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) == 0).alias("absent"),
        (F.coalesce("n", F.lit(0)) < FEW_EXAMPLES).alias("unreliable"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"),
                  round_even(F.avg((F.col(truth) == F.col(predicted)).cast("int")), 4).alias("accuracy"))


def grid_step(p: Column) -> Column:
    """Largest k with k/100 <= p, compared exactly as doubles."""
    near = F.floor(p * 100).cast("int")
    return F.when(p >= (near + 1) / 100.0, near + 1).when(p >= near / 100.0, near).otherwise(near - 1)


def threshold_sweep(scored: DataFrame, y: str = "y", p: str = "p",
                    steps: tuple[int, int] = THRESHOLD_STEPS) -> DataFrame:
    """Counts and rates at every threshold from `steps`, in hundredths.

    One pass makes a histogram over the grid; the curve is a reverse running
    sum over that bounded table, so each row is read once, not per threshold.
    """
    low, high = steps
    spark = scored.sparkSession
    binned = scored.select(
        F.greatest(F.lit(low - 1), F.least(F.lit(high), grid_step(F.col(p)))).alias("step"),
        (F.col(y) == 1).alias("_y"))
    histogram = binned.groupBy("step").agg(
        F.count_if("_y").alias("pos"), F.count_if(~F.col("_y")).alias("neg"))
    grid = spark.range(low - 1, high + 1).select(F.col("id").cast("int").alias("step"))
    filled = grid.join(histogram, "step", "left").na.fill(0)
    above = W.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy()
    curve = filled.select(
        "step", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n"),
    ).select("step", "tp", "fp", (F.col("_n") - F.col("fp")).alias("tn"), (F.col("_p") - F.col("tp")).alias("fn"))
    rates = _rates()
    return curve.filter(F.col("step") >= low).select(
        "step", (F.col("step") / 100.0).alias("threshold"),
        *[rates[name].alias(name) for name in ("precision", "recall", "f1")], "tp", "fp", "tn", "fn")


def _exact_rates(curve: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return curve.withColumns({"_prec": ratio(tp, tp + fp), "_rec": ratio(tp, tp + fn)})


def pick_threshold(curve: DataFrame, floor: float = PRECISION_FLOOR,
                   default_step: int = THRESHOLD_STEPS[0]) -> DataFrame:
    """Lowest threshold that attains the best recall with enough precision.

    Without any such threshold (recall must exceed 0) the default is returned
    with zero rates.
    """
    exact = _exact_rates(curve)
    ok = (F.col("_prec") >= floor) & (F.col("_rec") > 0)
    best = exact.agg(F.max(F.when(ok, F.struct(
        "_rec", (-F.col("step")).alias("neg"), "_prec"))).alias("b"))
    return best.select(
        (F.coalesce(-F.col("b.neg"), F.lit(default_step)) / 100.0).alias("threshold"),
        round_even(F.coalesce("b._prec", F.lit(0.0)), 4).alias("precision"),
        round_even(F.coalesce("b._rec", F.lit(0.0)), 4).alias("recall"))


def reference_points(curve: DataFrame) -> DataFrame:
    """Four named points of a curve, on its rounded rates.

    Rows without a qualifying threshold are absent; near_precision falls back
    to the closest threshold and says so.
    """
    keep = F.struct("step", "threshold", "precision", "recall", "f1", "tp", "fp", "tn", "fn")
    step, distance = F.col("step"), F.abs(F.col("precision") - PRECISION_TARGET)
    near = distance <= PRECISION_BAND

    def best(condition: Column, order: list[Column]) -> Column:
        return F.max_by(keep, F.when(condition, F.struct(*order)))

    always = F.lit(True)
    found = curve.agg(
        best(F.col("recall") >= HIGH_RECALL, [step]).alias("high_recall"),
        best(always, [F.col("f1"), -step]).alias("max_f1"),
        best(near, [F.col("recall"), -step]).alias("_near"),
        best(always, [-distance, -step]).alias("_closest"),
        best(F.col("precision") > PRECISION_FLOOR, [F.col("recall"), -step]).alias("above_floor"))
    rows = found.select(F.explode(F.array(
        F.struct(F.lit("high_recall").alias("point"), F.col("high_recall").alias("row"), F.lit(False).alias("closest_only")),
        F.struct(F.lit("max_f1").alias("point"), F.col("max_f1").alias("row"), F.lit(False).alias("closest_only")),
        F.struct(F.lit("near_precision").alias("point"), F.coalesce("_near", "_closest").alias("row"),
                 F.col("_near").isNull().alias("closest_only")),
        F.struct(F.lit("above_floor").alias("point"), F.col("above_floor").alias("row"), F.lit(False).alias("closest_only")),
    )).alias("x"))
    return rows.select("x.point", "x.closest_only", "x.row.*").filter("step is not null")


def score_curve(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Cumulative true and false positives at every distinct score.

    Rows are summed per distinct score first; the running totals then go over
    range-partitioned scores instead of one ordered window.
    """
    per_score = scored.groupBy(F.col(p).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    return running_totals(per_score, [F.desc("score")], {"tp": "pos", "fp": "neg"}, "scores")


def pr_auc(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Trapezoid area under precision over recall, from the point (recall 0, precision 1).

    The point before a score has the counts without that score's own rows, so
    no neighbouring row is needed.
    """
    curve = score_curve(scored, y, p)
    positives = scored.agg(F.count_if(F.col(y) == 1)).scalar()
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = (F.col("pos") / positives) * (here + before) / 2
    return curve.agg(round_even(F.sum(area), 4).alias("pr_auc"))


def pick_threshold_recall_first(scored: DataFrame, y: str = "y", p: str = "p",
                                target: float = RECALL_TARGET) -> DataFrame:
    """Among distinct scores: best F1 with recall at the target, else nearest recall."""
    curve = score_curve(scored, y, p)
    positives = scored.agg(F.count_if(F.col(y) == 1)).scalar()
    rated = curve.select(
        "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp"), positives).alias("recall"))
    # the small constant keeps the quotient finite and must stay for equal ties
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-10))
    keep = F.struct("score", "precision", "recall")
    met = F.col("recall") >= target
    found = rated.agg(
        F.max_by(keep, F.when(met, F.struct(f1.alias("f"), (-F.col("score")).alias("s")))).alias("ok"),
        F.min_by(keep, F.struct(F.abs(F.col("recall") - target).alias("d"), F.col("score").alias("s"))).alias("near"))
    chosen = found.select(F.coalesce("ok", "near").alias("c"))
    return chosen.select(
        round_even(F.col("c.score"), 6).alias("threshold"), round_even(F.col("c.precision"), 4).alias("precision"),
        round_even(F.col("c.recall"), 4).alias("recall"))


def brier_score(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return scored.agg(round_even(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))), 4).alias("brier_score"))


def calibration_bins(scored: DataFrame, y: str = "y", p: str = "p",
                     bins: int = CALIBRATION_BINS) -> DataFrame:
    """Half-open reliability bins; empty ones are kept and a score of 1 is in none.

    Bin edges are multiples of the bin width as doubles, compared exactly.
    """
    width = 1.0 / bins
    near = F.floor(F.col(p) * bins).cast("int")
    edge = lambda i: i * F.lit(width)
    index = F.when(F.col(p) >= edge(near + 1), near + 1).when(F.col(p) >= edge(near), near).otherwise(near - 1)
    stats = scored.filter((F.col(p) >= 0.0) & (F.col(p) < 1.0)).groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), round_even(F.avg(p), 4).alias("mean_predicted_prob"),
        round_even(F.avg(F.col(y).cast("double")), 4).alias("actual_positive_rate"))
    all_bins = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(stats, "bin", "left").select(
        "bin", round_even(edge(F.col("bin")), 2).alias("bin_low"), round_even(edge(F.col("bin") + 1), 2).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted_prob", "actual_positive_rate")


def review_triggers(ranked: DataFrame, truth: str, top: str, top_p: str, second_p: str,
                    confidence: float = RULE_CONFIDENCE, margin: float = RULE_MARGIN) -> DataFrame:
    """How often each review trigger fires and how right the model is on either side."""
    low = F.col(top_p) < confidence
    close = (F.col(top_p) - F.coalesce(second_p, F.lit(0.0))) < margin
    review, right = low | close, F.col(truth) == F.col(top)
    counts = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(low).alias("low_confidence"),
        F.count_if(close).alias("low_gap"), F.count_if(low & close).alias("both"),
        F.count_if(review).alias("needs_review"), F.count_if(review & right).alias("review_correct"),
        F.count_if(~review & right).alias("confident_correct"))
    return counts.withColumns({
        "review_fraction": round_even(ratio(F.col("needs_review"), F.col("n")), 4),
        "confident_accuracy": round_even(
            ratio(F.col("confident_correct"), F.col("n") - F.col("needs_review")), 4)})


def curve_parity(curve: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Curve rows at the stored thresholds, with a verdict on equal counts; a curve has one row per grid step and is broadcast."""
    names = ("tp", "fp", "tn", "fn")
    kept = stored.select(*keys, *[F.col(n).alias(f"stored_{n}") for n in names])
    same = F.lit(True)
    for name in names:
        same = same & F.col(name).eqNullSafe(F.col(f"stored_{name}"))
    return (kept.join(F.broadcast(curve.select(*keys, *names)), keys, "left")
            .select(*keys, *names, *[f"stored_{n}" for n in names], same.alias("parity_ok")))


def model_comparison(results: DataFrame, skipped: DataFrame, registry: DataFrame, key: str = "model_id") -> DataFrame:
    """Results, skip reasons and registry status side by side, one row per model."""
    return (results.join(skipped, key, "full_outer").join(registry, key, "full_outer")
            .withColumn("evaluated", F.col("precision").isNotNull()))
