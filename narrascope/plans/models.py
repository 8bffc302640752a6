"""Training and explaining linear text classifiers over corpus tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrascope.functions.numbers import round_even
from narrascope.operators import evaluation
from narrascope.operators.skew import in_parts, left_lookup, lookup_join, small
from narrascope.schemas import RULES
from narrascope.session import local_table, written

# fixed values: vector length and fit settings of the classifiers
DIMENSIONS = 384
INVERSE_PENALTY = 1.0
SIF_ITERATIONS = 2000
RULE_ITERATIONS = 1000
TOP_TERMS = 6
BROADCAST_WORDS = 500_000  # coefficients of the most frequent words that are broadcast
TOLERANCE = 1e-7  # of the fits: their gradients must vanish
BATCH = 64
WORD = r"[^\w\p{L}\p{N}]+"  # letters, digits and _ make words; \w (ASCII) is tested first, without a look at character tables


def text_features(text: str, out: str = "features", dimensions: int = DIMENSIONS, idf: bool = False) -> Pipeline:
    """Text to unit vectors by feature hashing, optionally weighted by idf.

    Hashing holds no vocabulary, so memory does not grow with the corpus, and
    without idf the pipeline needs no pass over the data to fit.
    """
    stages = [RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=WORD, toLowercase=True),
              HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions)]
    if idf:
        stages.append(IDF(inputCol="_tf", outputCol="_tfidf"))
    stages.append(Normalizer(inputCol="_tfidf" if idf else "_tf", outputCol=out, p=2.0))
    return Pipeline(stages=stages)


def word_vectors(text: str, out: str = "features", dimensions: int = DIMENSIONS,
                 min_count: int = 50, partitions: int = 16) -> Pipeline:
    """Text to mean-pooled, normalised word vectors trained on the corpus.

    The word table is held by every task; `min_count` bounds it.
    """
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=WORD, toLowercase=True),
        Word2Vec(inputCol="_tokens", outputCol="_mean", vectorSize=dimensions, minCount=min_count,
                 numPartitions=partitions, seed=42),
        Normalizer(inputCol="_mean", outputCol=out, p=2.0)])


def embed_with(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]],
               out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """The slot for a real encoder: loaded once per task, fed Arrow batches."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for series in batches:
            texts = series.fillna("").tolist()
            vectors: list = []
            for start in range(0, len(texts), batch):
                vectors.extend(encoder(texts[start:start + batch]))
            yield pd.Series(vectors)

    return df.withColumn(out, encode(F.col(text)))


def mean_pool(tokens: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Masked mean of token vectors per key, divided by its norm (zero vectors stay).

    A key whose tokens are all masked keeps its row, with a zero vector.

    The summarizer keeps one running vector per key and task; vectors are
    neither exploded nor collected.
    """
    weight = F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    weighted = F.transform(vector, lambda x: F.when(weight == 0, 0.0).otherwise(x.cast("double") * weight))
    # every token counts in the sum, so that a fully masked key has one too
    pooled = tokens.groupBy(key).agg(F.sum(weight).alias("_w"), Summarizer.sum(array_to_vector(weighted)).alias("_m"))
    mean = F.transform(vector_to_array("_m"), lambda x: x / F.greatest(F.col("_w"), F.lit(1e-9)))
    return unit_vector(pooled.withColumn("_a", mean), "_a").select(
        key, F.col("_a").alias("embedding"))


def unit_vector(df: DataFrame, vector: str) -> DataFrame:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    with_norm = df.withColumn("_norm", F.when(norm == 0, F.lit(1.0)).otherwise(norm))
    return with_norm.withColumn(vector, F.transform(vector, lambda x: x / F.col("_norm"))).drop("_norm")


def balanced(df: DataFrame, label: str, out: str = "_weight") -> DataFrame:
    """Rows with their balanced class weight; there is one lookup row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy()
    weights = counts.select(
        label, (F.sum("_n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("_n"))).alias(out))
    return lookup_join(df, weights, [label], F.xxhash64(F.col(label)))


def _penalty(rows: int) -> float:
    """The ridge term that equals an inverse penalty per summed weight of balanced rows."""
    return 1.0 / (INVERSE_PENALTY * rows)


def train_sif(df: DataFrame, features: str = "features", label: str = "y") -> LogisticRegressionModel:
    """Binary classifier with balanced classes; `label` is 0 or 1."""
    weighted = balanced(df.select(features, F.col(label).cast("double").alias(label)), label)
    return LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="_weight", regParam=_penalty(df.count()),
        standardization=False, maxIter=SIF_ITERATIONS, tol=TOLERANCE, family="binomial").fit(weighted)


def rule_rows(df: DataFrame, features: str = "features", rule: str = "life_saving_rule",
              rules: tuple[str, ...] = RULES) -> DataFrame:
    """Features and class index of the rows with a valid rule."""
    index = F.array_position(F.array(*[F.lit(name) for name in rules]), F.col(rule)) - 1
    return df.filter(F.col(rule).isin(*rules)).select(features, index.cast("double").alias("label"))


def train_rule(df: DataFrame, features: str = "features", rule: str = "life_saving_rule",
               rules: tuple[str, ...] = RULES) -> LogisticRegressionModel:
    """Multinomial classifier over the valid rules, class index = position in `rules`."""
    rows = rule_rows(df, features, rule, rules)
    weighted = balanced(rows, "label")
    return LogisticRegression(
        featuresCol=features, labelCol="label", weightCol="_weight", regParam=_penalty(rows.count()),
        standardization=False, maxIter=RULE_ITERATIONS, tol=TOLERANCE, family="multinomial").fit(weighted)


def fit_gradient(model: LogisticRegressionModel, df: DataFrame, features: str = "features",
                 label: str = "y") -> DataFrame:
    """(class, dimension, gradient) of the fitted objective over its training rows.

    Every entry is 0 at the optimum: the mean weighted residual times the feature,
    plus the ridge term. The dimension after the last feature is the intercept,
    whose residuals alone sum to 0. Classes are those with own coefficients, so a
    binary fit has class 1 only. Sums combine before the shuffle, which carries
    one row per class and task; coefficients number classes x dimensions.
    """
    coefficients = model.coefficientMatrix.toArray()
    classes = [1] if len(coefficients) == 1 else list(range(len(coefficients)))
    size, penalty = model.numFeatures, model.getOrDefault("regParam")
    weighted = balanced(df.select(features, F.col(label).cast("double").alias(label)), label)
    probability = vector_to_array("probability")
    residuals = F.array(*[F.struct(F.lit(c).alias("class"), (F.col("_weight") * (
        probability[c] - (F.col(label) == c).cast("double"))).alias("r")) for c in classes])
    rows = model.transform(weighted).select(
        "_weight", vector_to_array(features).alias("x"), F.explode(residuals).alias("c"))
    sums = rows.groupBy("c.class").agg(
        F.sum("_weight").alias("w"),
        F.array(*[F.sum(F.col("c.r") * F.col("x")[j]) for j in range(size)], F.sum("c.r")).alias("sums"))
    ridge = local_table(df.sparkSession, [
        (c, j, float(penalty * own[j]) if j < size else 0.0)
        for c, own in zip(classes, coefficients) for j in range(size + 1)], "class int, dimension int, ridge double")
    return (sums.select("class", "w", F.posexplode("sums").alias("dimension", "s"))
            .join(F.broadcast(ridge), ["class", "dimension"])
            .select("class", "dimension", (F.col("s") / F.col("w") + F.col("ridge")).alias("gradient")))


def positive_probability(df: DataFrame, probability: str = "probability", out: str = "p") -> DataFrame:
    return df.withColumn(out, vector_to_array(probability)[1])


def class_probabilities(probability: str = "probability", rules: tuple[str, ...] = RULES) -> Column:
    """array<struct<rule, p>> from a class-probability vector."""
    values = vector_to_array(probability)
    return F.array(*[F.struct(F.lit(rule).alias("rule"), F.get(values, F.lit(i)).alias("p"))
                     for i, rule in enumerate(rules)])


def save_model(model, metadata: DataFrame, path: str) -> None:
    """Persist a fitted model with its metadata snapshot beside it."""
    PipelineModel([model]).write().overwrite().save(f"{path}/model")
    metadata.write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark, path: str):
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/metadata")


def term_frequencies(df: DataFrame, row_id: str, text: str, *others: str) -> DataFrame:
    """(row id, other columns, word, tf): the texts are dealt by row id into small parts, so that their words are counted where they are."""
    words = F.explode(F.split(F.lower(F.col(text)), WORD)).alias("word")
    dealt = in_parts(df.select(row_id, *others, text), row_id)
    return dealt.select(row_id, *others, words).filter("word <> ''").groupBy(row_id, *others, "word").agg(
        F.count(F.lit(1)).alias("tf"))


def _frequent(coefficients: DataFrame) -> DataFrame:
    """The rows with the smallest idf, as many as fit a broadcast; none if they do not fit by bytes."""
    share = BROADCAST_WORDS / max(coefficients.count(), BROADCAST_WORDS)
    least = coefficients.approxQuantile("idf", [share], 0.001)
    chosen = coefficients.filter(F.col("idf") < F.lit(least[0] if least else None))
    return chosen if small(chosen) else coefficients.limit(0)


def explain_terms(df: DataFrame, coefficients: DataFrame, row_id: str = "doc_id",
                  text: str = "narrative_text", top: int = TOP_TERMS) -> DataFrame:
    """The words that move each report most: tf x idf x coefficient.

    `coefficients` is (word, idf, beta). Of a table too large to broadcast, the frequent words are: each report keeps its
    best of them where its words are counted. Only these, and the words that are not frequent, are moved; the latter are
    joined skew-safely.
    """
    def weighted(joined: DataFrame) -> DataFrame:
        return joined.filter("beta is not null").select(
            row_id, "word", round_even(F.col("tf") * F.col("idf") * F.col("beta"), 6).alias("weight"))

    def ranked(rows: DataFrame) -> DataFrame:
        best = W.partitionBy(row_id).orderBy(F.desc(F.abs("weight")), "word")
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select(row_id, "rank", "word", "weight")

    terms = term_frequencies(df, row_id, text)
    if small(coefficients):
        return ranked(weighted(terms.join(F.broadcast(coefficients), "word", "left")))
    frequent = _frequent(coefficients)
    met = terms.join(F.broadcast(frequent.withColumn("_met", F.lit(True))), "word", "left")
    place = W.partitionBy(row_id, "_met").orderBy(F.desc(F.abs("weight")), "word")
    kept = written(met.withColumn("weight", round_even(F.col("tf") * F.col("idf") * F.col("beta"), 6)).withColumn(
        "_place", F.row_number().over(place)).filter(F.col("_met").isNull() | (F.col("beta").isNotNull() & (F.col("_place") <= top))).select(
        row_id, "word", "tf", "weight", "_met"), "terms")
    rare = left_lookup(kept.filter("_met is null").select(row_id, "word", "tf"), coefficients, ["word"], F.xxhash64(row_id, "word"))
    return ranked(kept.filter("_met").select(row_id, "word", "weight").union(weighted(rare)))


def evaluate_scored(scored: DataFrame, model_id: str, label: str = "y", p: str = "p",
                    split: str = "split") -> DataFrame:
    """One row: the threshold is chosen on validation rows, everything else is read off the test rows once."""
    def part(name: str) -> DataFrame:
        return scored.filter(F.col(split) == name).select(label, p)

    chosen = evaluation.pick_threshold(evaluation.threshold_sweep(part("validation"), label, p)).first()["threshold"]
    test = part("test")
    bins = evaluation.calibration_bins(test, label, p)
    by_bin = F.sort_array(F.collect_list(F.struct(*bins.columns)))  # as many as there are bins
    return evaluation.binary_metrics(test, chosen, label, p).select(
        F.lit(model_id).alias("model_id"), F.lit(chosen).alias("threshold"), "*",
        evaluation.pr_auc(test, label, p).scalar().alias("pr_auc"),
        evaluation.brier_score(test, label, p).scalar().alias("brier_score"),
        bins.agg(by_bin).scalar().alias("calibration_bins"))


def evaluate_model(df: DataFrame, model_id: str, features: str = "features", label: str = "y",
                   split: str = "split") -> DataFrame:
    """Train on train rows, then evaluate the scored validation and test rows (stored, since they are read often)."""
    model = train_sif(df.filter(F.col(split) == "train"), features, label)
    rest = df.filter(F.col(split).isin("validation", "test"))
    scored = positive_probability(model.transform(rest)).select(label, "p", split)
    return evaluate_scored(written(scored, "scored"), model_id, label, "p", split)


def skip_reason(df: DataFrame, features: str | None, label: str = "y", split: str = "split") -> str | None:
    """Why a candidate cannot be evaluated, or None if it can."""
    if features is None:
        return "no qualifying checkpoint"
    if features not in df.columns:
        return f"no column {features}"
    known = df.filter(F.col(split).isin("train", "validation", "test") & F.col(label).isin(0, 1))
    seen = {(row[split], int(row[label])) for row in known.groupBy(split, label).count().collect()}  # at most six
    for name in ("train", "validation", "test"):
        if not any(part == name for part, _ in seen):
            return f"no {name} rows"
    if not {("train", 0), ("train", 1)} <= seen:
        return "train rows of one class only"
    return None


def evaluate_candidates(df: DataFrame, candidates: dict[str, str | None], label: str = "y",
                        split: str = "split") -> DataFrame:
    """One row per candidate (features column, or None without a checkpoint); a skipped one carries its reason."""
    rows = None
    for model_id, features in candidates.items():
        reason = skip_reason(df, features, label, split)
        if reason is None:
            row = evaluate_model(df, model_id, features, label, split).withColumns(
                {"skipped": F.lit(False), "skip_reason": F.lit(None).cast("string")})
        else:
            row = df.sparkSession.range(1).select(
                F.lit(model_id).alias("model_id"), F.lit(True).alias("skipped"), F.lit(reason).alias("skip_reason"))
        rows = row if rows is None else rows.unionByName(row, allowMissingColumns=True)
    return rows
