"""Column functions for blending, verdicts, actions and ensembles."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blend weights, verdict limits and the message label threshold.
BLEND_WITH_LLM = (0.30, 0.30, 0.40)
BLEND_WITHOUT_LLM = (0.50, 0.50)
PHISHING_FROM = 66
SUSPICIOUS_FROM = 31
BLOCK_FROM = 70
LABEL_THRESHOLD = 0.61


def clamp(col: Column, low: float, high: float) -> Column:
    # least and greatest skip nulls; a missing value has to stay missing.
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def combine_scores(rule: Column, ml: Column, llm: Column, llm_ok: Column) -> Column:
    """Weighted blend of the layers, clamped to 0..100 and rounded to one decimal."""
    w_rule, w_ml, w_llm = BLEND_WITH_LLM
    v_rule, v_ml = BLEND_WITHOUT_LLM
    with_llm = rule * F.lit(w_rule) + ml * F.lit(w_ml) + llm * F.lit(w_llm)
    without = rule * F.lit(v_rule) + ml * F.lit(v_ml)
    blended = F.when(F.coalesce(llm_ok, F.lit(False)), with_llm).otherwise(without)
    return F.bround(clamp(blended.cast("double"), 0.0, 100.0), 1)


def verdict(score: Column) -> Column:
    return (
        F.when(score >= PHISHING_FROM, "PHISHING")
        .when(score >= SUSPICIOUS_FROM, "SUSPICIOUS")
        .otherwise("SAFE")
    )


def action(verdict_col: Column, score: Column) -> Column:
    """What a client does with a scanned page."""
    return (
        F.when((verdict_col == "PHISHING") & (score >= BLOCK_FROM), "block")
        .when(verdict_col.isin("PHISHING", "SUSPICIOUS"), "warn")
        .otherwise("allow")
    )


def threat_meter(probability: Column, prediction: Column, available: Column, risk: Column):
    """Display level: 5..30 for legitimate, 75..95 for phishing, else the risk score."""
    p = clamp(probability, 0.0, 1.0)
    cut = LABEL_THRESHOLD
    high = 75 + clamp((p - cut) / (1.0 - cut), 0.0, 1.0) * 20
    low = 5 + clamp(p / cut, 0.0, 1.0) * 25
    kind = F.upper(prediction)
    return (
        F.when(available & (kind == "PHISHING"), F.floor(high * 10 + 0.5) / 10)
        .when(available & (kind == "LEGITIMATE"), F.floor(low * 10 + 0.5) / 10)
        .otherwise(risk)
    )


def combine_probs(second: Column, nb: Column, mode="weighted", weights=(0.7, 0.3)) -> Column:
    if mode == "soft":
        return (second + nb) / 2.0
    total = float(sum(weights))
    if total <= 0:
        raise ValueError("Weights must sum to a positive value.")
    return second * (weights[0] / total) + nb * (weights[1] / total)


def binary_name(probability: Column) -> Column:
    return F.when(probability >= LABEL_THRESHOLD, "Phishing").otherwise("Legitimate")


def binary_label(probability: Column, threshold: float = 0.5) -> Column:
    return F.when(probability >= threshold, 1).otherwise(0)
