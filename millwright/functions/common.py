"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# The characters a Unicode-aware strip() or \s treats as blank.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The same as ranges inside a character class, which a pattern tests in fewer steps.
BLANK_RANGES = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def micros(ts) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(rows: DataFrame, kept: list, items: Column, name: str, place: str | None = None) -> DataFrame:
    """One row per item of a computed array, with its position if ``place`` is given.

    A plain ``explode`` makes the optimizer add a filter that computes the array a
    second time; the outer form with its empty rows dropped does not.
    """
    if place is None:
        spread = rows.select(*kept, F.explode_outer(items).alias(name))
    else:
        spread = rows.select(*kept, F.posexplode_outer(items).alias(place, name))
    return spread.where(F.col(name).isNotNull())


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days, floored; not a count of midnights crossed."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(MICROS_PER_DAY)).cast("long")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def contains_any(text: Column, needles) -> Column:
    """True where the lower-cased text holds one of the needles; null text counts as empty."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    test = F.lit(False)
    for needle in needles:
        test = test | lowered.contains(needle)
    return test


def join_lines(items: Column, sep: str = "|") -> Column:
    return F.array_join(items, sep)


def flag_sum(condition: Column) -> Column:
    """How many rows meet the condition, as a long that is 0 on no rows."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def exact_round(x: Column, digits: int = 2) -> Column:
    """Round the binary value of a double half-even, the way a float's own ``round`` does.

    ``bround`` works on the printed decimal, so 10.155 (really 10.15499...) would
    go up.  The product with 10**digits is taken with its rounding error, which
    settles whether a printed tie is a real one.
    """
    return let(x.cast("double"), lambda v: exact_round_of(v, digits))


def exact_round_of(x: Column, digits: int = 2) -> Column:
    """``exact_round`` of a double that is a column of its own already."""
    scale = F.lit(float(10**digits))
    product = x * scale
    high = x * F.lit(134217729.0)
    high = high - (high - x)
    error = (high * scale - product) + (x - high) * scale
    base = F.floor(product).cast("double")
    half = product - base
    up = (half > 0.5) | ((half == 0.5) & ((error > 0) | ((error == 0) & (base % 2 != 0))))
    return (base + F.when(up, 1.0).otherwise(0.0)) / scale
