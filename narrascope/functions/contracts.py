"""Decision contracts: probabilities in, reviewed decisions out."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrascope.functions.numbers import round_even, three_places
from narrascope.functions.text import bound
from narrascope.schemas import (
    CRITICAL_RISK, DEFAULT_SEVERITY, NEEDS_REVIEW, NOT_EVALUATED, RISK_HIGH, RISK_MEDIUM,
    RISK_WEIGHTS, RULE_CONFIDENCE, RULE_MARGIN, RULE_SEVERITY, SIF_HIGH, SIF_LOW,
)

# fixed values: wording of the reasons shown to reviewers
BELOW = "P(Yes)=%s below low threshold {low} -> No"
ABOVE = "P(Yes)=%s at/above high threshold {high} -> Yes"
BETWEEN = (
    "P(Yes)=%s between thresholds [{low}, {high}) -> NEEDS_REVIEW "
    "(Phase 11 found this range unreliable on real narratives)"
)
PHRASE = "contributing phrase '%s' (%s, weight=%s%s)"
LOW_CONFIDENCE = "top-class confidence %s < threshold {confidence:.2f}"
LOW_GAP = "confidence gap %s < ambiguity margin {margin:.2f} (%s vs %s)"


def fill(form: str, *values: Column) -> Column:
    """`form` with each %s replaced by the next value."""
    head, *tails = form.split("%s")
    parts = [F.lit(head)]
    for value, tail in zip(values, tails, strict=True):
        parts += [value, F.lit(tail)]
    return F.concat(*parts)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def risk_level(score: Column) -> Column:
    return F.when(score >= RISK_HIGH, "High").when(score >= RISK_MEDIUM, "Medium").otherwise("Low")


def flag_critical(sif: Column, score: Column) -> Column:
    """Only a confident Yes with a high score; NEEDS_REVIEW never raises the flag."""
    return F.coalesce((sif == "Yes") & (score >= CRITICAL_RISK), F.lit(False))


def precursor_severity(count: Column) -> Column:
    return F.when(count >= 10, "High").when(count >= 5, "Medium").otherwise("Low")


def sif_label(p: Column, low: float = SIF_LOW, high: float = SIF_HIGH) -> Column:
    return F.when(p < low, "No").when(p >= high, "Yes").otherwise(NEEDS_REVIEW)


def band_reason(p: Column, low: float = SIF_LOW, high: float = SIF_HIGH) -> Column:
    def text(form: str) -> Column:
        return fill(form.format(low=low, high=high), three_places(p))

    return F.when(p < low, text(BELOW)).when(p >= high, text(ABOVE)).otherwise(text(BETWEEN))


def phrase_reasons(phrases: Column, top: int = 3) -> Column:
    """Reasons for the phrases of largest absolute weight.

    `phrases` is array<struct<phrase, weight>>; ties keep the phrase order.
    """
    numbered = F.transform(
        phrases,
        lambda x, i: F.struct((-F.abs(x["weight"])).alias("rank"), i.alias("at"),
                              x["phrase"].alias("phrase"), x["weight"].alias("weight")),
    )
    best = F.slice(F.array_sort(numbered), 1, top)
    return F.transform(best, lambda x: F.format_string(
        PHRASE, x["phrase"], F.when(x["weight"] > 0, "toward Yes").otherwise("toward No"),
        F.when(x["weight"] < 0, "-").otherwise(""), three_places(F.abs(x["weight"]))))


def sif_reasons(p: Column, phrases: Column, low: float = SIF_LOW, high: float = SIF_HIGH) -> Column:
    band = F.array(band_reason(p, low, high))
    return F.concat(band, F.coalesce(phrase_reasons(phrases), F.array().cast("array<string>")))


def sif_contract(p: Column, low: float = SIF_LOW, high: float = SIF_HIGH,
                 model_name: str = "embedding + logistic regression",
                 model_version: str = "1.0.0") -> Column:
    """Three-way decision struct for one probability of Yes."""
    p = clip(p, 0.0, 1.0)
    return F.struct(
        sif_label(p, low, high).alias("sif_potential"),
        round_even(p, 4).alias("confidence"),
        band_reason(p, low, high).alias("band_reason"),
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        F.create_map(F.lit("low"), F.lit(low), F.lit("high"), F.lit(high)).alias("thresholds"),
    )


def ranked_classes(probs: Column) -> Column:
    """array<struct<rule, p>> ordered from the most to the least probable."""
    swapped = F.transform(probs, lambda x: F.struct(x["p"].alias("p"), x["rule"].alias("rule")))
    return F.sort_array(swapped, asc=False)


def _quoted(name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), name, F.lit("'")), F.lit("None"))


def rule_contract(probs: Column, confidence: float = RULE_CONFIDENCE, margin: float = RULE_MARGIN,
                  model_name: str = "rule_classifier", model_version: str = "1.0.0") -> Column:
    """Top rule with runner-up; low confidence or a small lead asks for review."""
    def decide(ranked: Column) -> Column:
        top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        gap = top["p"] - F.coalesce(second["p"], F.lit(0.0))
        unsure, close = top["p"] < confidence, gap < margin
        review = unsure | close
        reason = F.concat_ws(
            "; ",
            F.when(unsure, fill(LOW_CONFIDENCE.format(confidence=confidence), three_places(top["p"]))),
            F.when(close, fill(LOW_GAP.format(margin=margin), three_places(gap),
                               _quoted(top["rule"]), _quoted(second["rule"]))))
        return F.struct(
            F.when(review, NEEDS_REVIEW).otherwise(top["rule"]).alias("rule_prediction"),
            round_even(top["p"], 6).alias("confidence"),
            second["rule"].alias("runner_up_rule"),
            round_even(second["p"], 6).alias("runner_up_confidence"),
            review.alias("needs_review"),
            F.when(review, reason).alias("review_reason"),
            top["rule"].alias("top_rule"),
            F.lit(model_name).alias("model_name"),
            F.lit(model_version).alias("model_version"),
        )

    return bound(ranked_classes(probs), decide)


def conditional_rule(sif: Column, contract: Column) -> Column:
    """The rule decision where SIF is not a confident No, defaults elsewhere."""
    evaluated = sif.isin("Yes", NEEDS_REVIEW)
    defaults = {"life_saving_rule": NOT_EVALUATED, "rule_confidence": 0.0, "rule_needs_review": False}

    def fields(c: Column) -> Column:
        return F.struct(
            c["rule_prediction"].alias("life_saving_rule"),
            F.bround(c["confidence"], 4).alias("rule_confidence"),
            c["needs_review"].alias("rule_needs_review"),
            c["review_reason"].alias("rule_review_reason"),
            c["runner_up_rule"].alias("rule_runner_up"),
            c["runner_up_confidence"].alias("rule_runner_up_confidence"),
            c["model_name"].alias("rule_model_name"),
            c["model_version"].alias("rule_model_version"))

    texts = ("rule_review_reason", "rule_runner_up", "rule_model_name", "rule_model_version")
    skipped = F.struct(
        *[F.lit(defaults[name]).alias(name) for name in ("life_saving_rule", "rule_confidence", "rule_needs_review")],
        *[F.lit(None).cast("string").alias(name) for name in texts[:2]],
        F.lit(None).cast("double").alias("rule_runner_up_confidence"),
        *[F.lit(None).cast("string").alias(name) for name in texts[2:]])
    return F.when(evaluated, bound(contract, fields)).otherwise(skipped)


def severity_of(rule: Column, severities: dict[str, float] | None = None) -> Column:
    """Severity weight of a rule; a nine-entry literal map, 0.5 when unknown."""
    table = RULE_SEVERITY if severities is None else severities
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in table.items()))
    return F.coalesce(F.try_element_at(pairs, F.coalesce(rule, F.lit(""))), F.lit(DEFAULT_SEVERITY))


def risk_score(confidence: Column, rule: Column, recurrence: Column | None = None,
               max_recurrence: Column | None = None) -> Column:
    """Composite 0-100 score; without recurrence counts that term contributes nothing."""
    score = RISK_WEIGHTS["confidence"] * clip(confidence, 0.0, 1.0)
    if recurrence is not None:
        share = F.when(max_recurrence > 0, F.least(recurrence / max_recurrence, F.lit(1.0)))
        score = score + RISK_WEIGHTS["recurrence"] * F.coalesce(share, F.lit(0.0))
    else:
        score = score + F.lit(0.0)
    score = score + RISK_WEIGHTS["severity"] * severity_of(rule)
    return F.bround(clip(100.0 * score, 0.0, 100.0)).cast("int")


def highlight_phrases(text: Column, phrases: Column, before: str = "<mark>",
                      after: str = "</mark>") -> Column:
    """Mark the phrases of positive weight in the text, ignoring case."""
    wanted = F.transform(
        F.filter(phrases, lambda x: (x["weight"] > 0) & (x["phrase"] != "")),
        lambda x: F.concat(F.lit("\\Q"), F.replace(x["phrase"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                           F.lit("\\E")),
    )
    pattern = F.concat(F.lit("(?iu)"), F.array_join(wanted, "|"))
    marked = F.regexp_replace(text, pattern, F.lit(f"{before}$0{after}"))
    return F.when(F.size(wanted) > 0, marked).otherwise(text)
