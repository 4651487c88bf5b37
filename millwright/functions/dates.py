"""Review dates stated in text and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.common import let, strip

# ---- fixed values: two patterns, tried in this order, and the date layouts ----
REVIEW_PATTERNS = (
    r"(?i)(?:last\s+reviewed|reviewed|review\s+date|last\s+validated|validated|revision\s+date|rev(?:ision)?(?:\s+date)?)"
    r"[^\n\r]{0,32}?"
    r"(\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
    r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{4}\b|\b20\d{2}\b)",
    r"(?i)\b(?:revision|rev\.?|review)\s*(20\d{2})\b",
)
DATE_LAYOUTS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^[A-Za-z]{3} \d{4}$", "MMM yyyy"),
    (r"^[A-Za-z]{3,} \d{4}$", "MMMM yyyy"),
    (r"^\d{4}$", "yyyy"),
)
ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def parse_date(raw: Column) -> Column:
    """The first layout that fits, day before month; null when none does."""
    # strptime takes any run of blanks for the one blank of a layout
    cleaned = F.regexp_replace(F.replace(strip(raw), F.lit(","), F.lit("")), r"\s+", " ")
    return let(cleaned, _parse_cleaned)


def _parse_cleaned(text: Column) -> Column:
    century = F.concat(F.substring(text, 1, 6), F.lit("20"), F.substring(text, 7, 2))
    attempts = [F.when(text.rlike(r"^\d{2}/\d{2}/\d{2}$"), F.try_to_timestamp(century, F.lit("d/M/yyyy")))]
    attempts.append(F.when(text.rlike(r"^\d{2}/\d{2}/\d{2}$"), F.try_to_timestamp(century, F.lit("M/d/yyyy"))))
    attempts += [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout))) for shape, layout in DATE_LAYOUTS]
    attempts.append(_iso_moment(text))
    return F.coalesce(*attempts)


def _iso_moment(text: Column) -> Column:
    return F.when(text.rlike(ISO_MOMENT), F.try_to_timestamp(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")))


def stated_review_date(text: Column) -> Column:
    """Review date from the first match of each pattern; later matches do not count."""

    def search(body: Column) -> Column:
        found = [F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in REVIEW_PATTERNS]
        return F.coalesce(*[parse_date(raw) for raw in found])

    return let(F.coalesce(text, F.lit("")), search)


def iso_date(raw: Column) -> Column:
    """A plain ISO date or moment; anything else is null."""

    def read(text: Column) -> Column:
        day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
        return F.coalesce(day, _iso_moment(text))

    return let(strip(raw), read)
