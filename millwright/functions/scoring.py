"""Confidence, freshness and risk bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
GATES = {
    "Low": "ALLOW_WITH_CITATIONS",
    "Moderate": "VERIFY_BEFORE_EXECUTION",
    "High": "ENGINEERING_REVIEW_REQUIRED",
    "Critical": "BLOCK_FIELD_EXECUTION_UNTIL_CURRENT_SOURCE_CONFIRMED",
}
RECOMMENDATIONS = {
    "Low": "Use the cited answer, keeping normal plant approval workflow.",
    "Moderate": "Prefer fresher cited sources and verify revision status before execution.",
    "High": "Verify the latest approved engineering revision before field action.",
    "Critical": "Do not execute from this answer alone; obtain a current approved procedure or engineer sign-off.",
}


def _pick(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def stored_confidence(label: Column) -> Column:
    return F.when(label == "High", 0.9).when(label == "Low", 0.3).otherwise(0.6)


def percent_of_label(label: Column, has_sources: Column) -> Column:
    lowered = F.lower(F.coalesce(label, F.lit("")))
    return _bounded(F.when(lowered.contains("high"), 96).when(lowered.contains("low"), 45).otherwise(72), has_sources)


def percent_of_number(value: Column, has_sources: Column) -> Column:
    return _bounded(F.rint(F.when(value <= 1, value * 100).otherwise(value)).cast("int"), has_sources)


def _bounded(percent: Column, has_sources: Column) -> Column:
    capped = F.when(has_sources, percent).otherwise(F.least(percent, F.lit(35)))
    return F.greatest(F.lit(0), F.least(F.lit(100), capped)).cast("int")


def freshness_label(score: Column) -> Column:
    return F.when(score >= 85, "High").when(score >= 60, "Moderate Risk").when(score >= 40, "High Risk").otherwise("Expired")


def document_risk(score: Column) -> Column:
    return F.when(score >= 85, "Low").when(score >= 60, "Moderate").when(score >= 40, "High").otherwise("Critical")


def answer_risk(freshness: Column, confidence: Column, has_sources: Column) -> Column:
    return (
        F.when(~has_sources, "Critical")
        .when((freshness < 40) | (confidence < 50), "Critical")
        .when((freshness < 60) | (confidence < 70), "High")
        .when(freshness < 85, "Moderate")
        .otherwise("Low")
    )


def trust_gate(risk: Column) -> Column:
    return _pick(risk, GATES)


def recommendation(risk: Column) -> Column:
    return _pick(risk, RECOMMENDATIONS)


def history_bucket(confidence: Column) -> Column:
    return (
        F.when(confidence.isNull(), "Medium").when(confidence >= 0.8, "High").when(confidence >= 0.5, "Medium").otherwise("Low")
    )


def shown_confidence(value: Column) -> Column:
    return F.when(value >= 0.75, "High").when(value >= 0.45, "Medium").otherwise("Low")


def attribute_band(text: Column) -> Column:
    raw = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(raw.contains("low") | raw.contains("pending"), "low")
        .when(raw.contains("medium") | raw.contains("warning"), "medium")
        .when(raw.contains("high") | raw.contains("healthy") | raw.contains("reviewed"), "high")
        .otherwise("")
    )


def source_freshness_label(score: Column) -> Column:
    """Interface wording of a score given in 0..1 or 0..100; halves round up."""
    percent = F.floor(F.when(score <= 1, score * 100).otherwise(score) + 0.5).cast("long")
    shown = percent.cast("string")
    return (
        F.when(score.isNull(), "Not returned")
        .when(percent >= 80, F.concat(shown, F.lit("% fresh")))
        .when(percent >= 60, F.concat(shown, F.lit("% review soon")))
        .otherwise(F.concat(shown, F.lit("% stale - review")))
    )
