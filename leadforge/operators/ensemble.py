"""Blending the rule score with the classifier probability.

Two distinct strategies exist and are kept apart:
* ``ensemble_*`` — the blend with confidence-dependent thresholds (N1-N4);
* ``runner_*`` — the ingestion runner's own switch (N5): rule_based, ml, or
  hybrid = ml decision OR rule decision.
All are per-row ``when`` chains over two score columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .text import _c, confidence_band


def _rule_norm(rule, rule_threshold: float) -> Column:
    return F.least(_c(rule) / F.lit(rule_threshold), F.lit(1.0))


def ensemble_score(ml, rule, strategy: str = "hybrid", ml_available: bool = True,
                   rule_threshold: float = L.RULE_THRESHOLD, ml_weight: float = L.ENSEMBLE_ML_WEIGHT,
                   conf_high: float = L.ENSEMBLE_CONF_HIGH, conf_low: float = L.ENSEMBLE_CONF_LOW) -> Column:
    """struct(score, confidence, method, ml_score, ml_confidence, rule_score,
    rule_normalized, agreement)."""
    strategy = strategy.lower()
    m, r = _c(ml), _c(rule)
    none_d = F.lit(None).cast("double")
    none_s = F.lit(None).cast("string")
    if strategy == "rule_based" or not ml_available:
        n = _rule_norm(r, rule_threshold)
        return F.struct(
            n.alias("score"), F.when(n > 0.5, "medium").otherwise("low").alias("confidence"),
            F.lit("rule_based").alias("method"), none_d.alias("ml_score"), none_s.alias("ml_confidence"),
            r.alias("rule_score"), n.alias("rule_normalized"), none_d.alias("agreement"),
        )
    if strategy == "ml":
        return F.struct(
            m.alias("score"), confidence_band(m).alias("confidence"), F.lit("ml_only").alias("method"),
            m.alias("ml_score"), confidence_band(m).alias("ml_confidence"), none_d.alias("rule_score"),
            none_d.alias("rule_normalized"), none_d.alias("agreement"),
        )
    n = _rule_norm(r, rule_threshold)
    blended = F.lit(ml_weight) * m + F.lit(1.0 - ml_weight) * n
    agreement = F.abs(m - n)
    high, low = m >= conf_high, m <= conf_low
    return F.struct(
        F.when(high | low, m).otherwise(blended).alias("score"),
        F.when(high | low, "high").when(agreement < 0.2, "high").when(agreement < 0.4, "medium")
        .otherwise("low").alias("confidence"),
        F.when(high, "ml_high_confidence").when(low, "ml_low_confidence").otherwise("weighted_ensemble")
        .alias("method"),
        m.alias("ml_score"), confidence_band(m).alias("ml_confidence"), r.alias("rule_score"),
        F.when(high | low, none_d).otherwise(n).alias("rule_normalized"),
        F.when(high | low, none_d).otherwise(agreement).alias("agreement"),
    )


def ensemble_threshold(confidence, ml_threshold: float = L.ML_THRESHOLD) -> Column:
    """Base threshold + 0 (high), + 0.1 (medium), + 0.15 (otherwise)."""
    c = _c(confidence)
    return (F.when(c == "high", F.lit(ml_threshold)).when(c == "medium", F.lit(ml_threshold + 0.1))
            .otherwise(F.lit(ml_threshold + 0.15)))


def ensemble_decision(ens, ml_threshold: float = L.ML_THRESHOLD) -> Column:
    e = _c(ens)
    return e["score"] >= ensemble_threshold(e["confidence"], ml_threshold)


def ensemble_explain(ens, strategy: str = "hybrid", ml_threshold: float = L.ML_THRESHOLD) -> Column:
    """Explanation record; ``threshold`` is the base one (as reported), ``applied_threshold``
    the confidence-dependent one actually used."""
    e = _c(ens)
    return F.struct(
        ensemble_decision(e, ml_threshold).alias("is_lead"),
        e["score"].alias("score"),
        e["confidence"].alias("confidence"),
        F.struct(F.lit(strategy).alias("strategy"), e["method"].alias("method"), e["ml_score"].alias("ml_score"),
                 e["ml_confidence"].alias("ml_confidence"), e["rule_score"].alias("rule_score"),
                 e["rule_normalized"].alias("rule_normalized"), e["agreement"].alias("agreement"))
        .alias("explanation"),
        F.lit(ml_threshold).alias("threshold"),
        ensemble_threshold(e["confidence"], ml_threshold).alias("applied_threshold"),
    )


def runner_strategy(ml, rule, strategy: str = "rule_based", ml_available: bool = True,
                    ml_threshold: float = L.ML_THRESHOLD, rule_threshold: float = L.RULE_THRESHOLD) -> Column:
    """struct(is_lead, score, confidence) as the ingestion runner decides it."""
    strategy = strategy.strip().lower()
    r = _c(rule)
    rule_lead = r >= F.lit(rule_threshold)
    if strategy not in ("ml", "hybrid") or not ml_available:
        return F.struct(rule_lead.alias("is_lead"), r.alias("score"), F.lit("rule_based").alias("confidence"))
    m = _c(ml)
    ml_lead = m >= F.lit(ml_threshold)
    if strategy == "ml":
        return F.struct(ml_lead.alias("is_lead"), m.alias("score"), confidence_band(m).alias("confidence"))
    fallback = ~ml_lead & rule_lead
    return F.struct(
        (ml_lead | rule_lead).alias("is_lead"),
        F.when(fallback, r).otherwise(m).alias("score"),
        F.when(fallback, "rule_fallback").otherwise(confidence_band(m)).alias("confidence"),
    )
