"""Structured extraction payloads: drawing and maintenance-log JSON under fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The payload layouts.
PID_SCHEMA = (
    "zone string, "
    "equipment array<struct<id:string,type:string,confidence:string>>, "
    "valves array<struct<valve_id:string,valve_type:string,connects_from:string,connects_to:string,confidence:string>>, "
    "instruments array<struct<tag:string,attached_to_line_between:array<string>,confidence:string>>, "
    "confidence_flags array<string>"
)
LOG_SCHEMA = (
    "entries array<struct<Asset_ID:string,Failure_Mode:string,Date:string,Technician_Notes:string,confidence:string>>, "
    "confidence_flags array<string>"
)
CORRUPT = "_corrupt"


def parse_payload(payload: Column, schema: str) -> Column:
    """The payload as a struct; an unreadable one is kept whole in its ``_corrupt`` field."""
    return F.from_json(payload, f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def scan_payloads(payloads: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(readable, corrupt) rows of ``payloads(document_id, document_low_confidence, received_at, payload)``."""
    parsed = payloads.withColumn("data", parse_payload(F.col("payload"), schema))
    bad = F.col("data").isNull() | F.col(f"data.{CORRUPT}").isNotNull()
    good = parsed.where(~bad).select("document_id", "document_low_confidence", "received_at", "data")
    return good, parsed.where(bad).select("document_id", "payload")


def low_confidence_count(data: Column, arrays: tuple[str, ...]) -> Column:
    """Objects marked low over the given arrays, plus the payload's flags."""
    total = F.size(F.coalesce(data["confidence_flags"], F.array().cast("array<string>")))
    for name in arrays:
        low = F.filter(data[name], lambda x: F.lower(F.coalesce(x["confidence"], F.lit(""))) == "low")
        total = total + F.coalesce(F.size(low), F.lit(0))
    return total
