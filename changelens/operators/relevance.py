"""Relevance: five weighted components, a location multiplier, a score of 0..100 and its band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import settled
from ..schema import HIGH_IMPACT, MAX_MODEL_SHIFT, SCORE_WEIGHTS, SEVERITY_BANDS, TOP_SEVERITY

# What a category and a page region weigh.
BUSINESS = {"pricing": 0.95, "product": 0.80, "features": 0.75, "integrations": 0.65, "hiring": 0.55, "messaging": 0.50, "other": 0.20}
CUSTOMER = {"pricing": 1.00, "features": 0.80, "product": 0.70, "integrations": 0.60, "messaging": 0.45, "hiring": 0.15, "other": 0.15}
STRATEGIC = {"pricing": 0.85, "product": 0.85, "hiring": 0.75, "features": 0.65, "integrations": 0.60, "messaging": 0.55, "other": 0.20}
LOCATION = {
    "pricing": 1.15, "careers": 1.05, "product": 1.08, "integrations": 1.05, "header": 1.05, "main": 1.02, "blog": 1.0, "body": 0.95, "navigation": 0.7, "footer": 0.6, "sidebar": 0.7,
    "cookie_banner": 0.4, "advertisement": 0.4,
}
NOISE_CEILING = 29.0


def _lookup(values: dict[str, float], c: Column, default: float) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def _signal(name: str) -> Column:
    return F.coalesce(F.try_element_at("signals", F.lit(name)), F.lit(0.0))


def _raise(base: Column, condition: Column, step: Column | float) -> Column:
    return F.least(F.lit(1.0), base + F.when(condition, step).otherwise(0.0))


def business() -> Column:
    delta = _signal("price_delta_ratio")
    out = _raise(_lookup(BUSINESS, F.col("category"), 0.2), delta > 0, F.least(F.lit(0.35), delta * 0.7))
    out = _raise(out, _signal("free_tier_shift") != 0, 0.15)
    out = _raise(out, _signal("ml_role_count") >= 2, 0.15)
    return _raise(out, _signal("new_partner_count") >= 1, 0.1)


def customer() -> Column:
    out = _raise(_lookup(CUSTOMER, F.col("category"), 0.15), (_signal("has_price_token") != 0) & (_signal("price_direction") != 0), 0.1)
    out = _raise(out, _signal("feature_quantities") != 0, 0.1)
    return F.when(F.col("location").isin("navigation", "footer", "cookie_banner"), out * 0.5).otherwise(out)


def strategic() -> Column:
    out = _raise(_lookup(STRATEGIC, F.col("category"), 0.2), _signal("ai_mention") != 0, 0.15)
    out = _raise(out, _signal("ml_role_count") > 0, 0.12)
    out = _raise(out, (_signal("positioning_language") != 0) | (_signal("headline_change") != 0), 0.08)
    return _raise(out, _signal("launch_phrase_count") >= 2, 0.08)


def notes() -> Column:
    """What raised the score, in words."""
    delta = _signal("price_delta_ratio")
    entries = [
        F.when(delta > 0, F.concat(F.lit("Price moved by "), F.format_string("%.0f", delta * 100), F.lit("% of the original value"))),
        F.when(_signal("free_tier_shift") != 0, "Free-tier availability changed"),
        F.when(_signal("ml_role_count") >= 2, "Multiple AI/ML roles opened simultaneously"),
        F.when((_signal("has_price_token") != 0) & (_signal("price_direction") > 0), "Customers face a higher price").when(
            (_signal("has_price_token") != 0) & (_signal("price_direction") < 0), "Customers gain a lower price"
        ),
        F.when(_signal("feature_quantities") != 0, "Plan limits or quantities changed"),
        F.when(_signal("ai_mention") != 0, "Signals investment in AI/ML capability"),
        F.when((_signal("positioning_language") != 0) | (_signal("headline_change") != 0), "Market positioning language shifted"),
    ]
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def severity(score: Column) -> Column:
    out = None
    for below, name in SEVERITY_BANDS:
        out = F.when(score < below, name) if out is None else out.when(score < below, name)
    return out.otherwise(TOP_SEVERITY)


def located(weighted: Column, location: Column) -> Column:
    """0..100 from a weighted sum: a boost lifts through the headroom that is left, a damping multiplies."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weighted)) * 100.0
    m = _lookup(LOCATION, location, 1.0)
    lifted = F.when(m > 1.0, base + (100.0 - base) * F.least(m - 1.0, F.lit(1.0))).otherwise(base * m)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), lifted))


def score_changes(changes: DataFrame, round_between_stages: bool = False) -> DataFrame:
    """changes with relevance_score, severity (of the unrounded score) and breakdown; notes are added to evidence.

    round_between_stages rounds confidence and magnitude first, as where stages exchange stored rows.
    """
    limit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    confidence, magnitude = F.col("classifier_confidence"), F.col("magnitude")
    if round_between_stages:
        confidence, magnitude = F.round(confidence, 3), F.round(magnitude, 4)
    parts = changes.withColumns({"__business": business(), "__customer": customer(), "__strategic": strategic(), "__magnitude": limit(magnitude), "__confidence": limit(confidence)})
    weighted = sum((F.lit(SCORE_WEIGHTS[k]) * F.col(f"__{k}") for k in ("customer", "strategic", "magnitude", "confidence")), F.lit(SCORE_WEIGHTS["business"]) * F.col("__business"))
    whole = parts.withColumn("__located", located(weighted, F.col("location")))
    raw = F.when(F.col("is_noise"), F.least("__located", F.lit(NOISE_CEILING))).otherwise(F.col("__located"))
    scored = whole.withColumns({
        "relevance_score": F.round(raw, 2), "severity": severity(raw),
        "breakdown": F.struct(*(F.round(f"__{k}", 3).alias(k) for k in SCORE_WEIGHTS), _lookup(LOCATION, F.col("location"), 1.0).alias("location_multiplier")),
        "evidence": F.concat("evidence", notes()),
        "signals": F.map_concat("signals", F.create_map(F.lit("relevance_business_impact"), F.col("__business"), F.lit("relevance_customer_impact"), F.col("__customer"), F.lit("relevance_strategic"), F.col("__strategic"))),
    })
    return settled(scored.drop("__located", *(f"__{k}" for k in SCORE_WEIGHTS)))


def blend(deterministic: Column, model: Column, shift: float = MAX_MODEL_SHIFT) -> Column:
    """A model's score moves the deterministic one by at most `shift`; null leaves it."""
    delta = F.greatest(F.lit(-shift), F.least(F.lit(shift), F.greatest(F.lit(0.0), F.least(F.lit(100.0), model)) - deterministic))
    return F.round(F.when(model.isNull(), deterministic).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), deterministic + delta))), 2)


def is_high_impact(score: Column) -> Column:
    return score >= HIGH_IMPACT
