"""URL filters by a temporal list join.

A list is a history: dated entries add a rule to it or take one away. Entries become
validity intervals, and each capture of a page is judged by the rules that were in force
when it was fetched. A rule's pattern is a host, which also covers its subdomains, or a
host and the beginning of a path, ending at a segment. A capture has one key for every
suffix of its host and every beginning of its path, as deep as the lists' patterns
go, so rules are met by equality. Intervals are laid over slices of time and the slice is
part of the key: a host with most of the captures is parted by time, and a rule with a
long history meets a capture only with the intervals of one slice. Columns and joins
only, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm.common import free_name

RULE = ["list", "kind", "pattern"]
SLICE_DAYS = 14


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, without user, port and final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/:?#@]*)", 2))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of an absolute URL without query and fragment; empty if there is none."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until): when each rule was in force; ``until`` is exclusive, null means still.

    ``entries`` has list, kind ('block' or 'allow'), pattern, action ('add' or 'remove') and dated (timestamp). Entries
    with a null in any of these count for nothing. Of entries of a rule at one instant a removal wins.
    Adding a rule that is in force, or removing one that is not, changes nothing. Patterns are lower-cased up to
    the first slash and lose slashes at their ends.
    """
    pattern = F.concat(F.lower(F.substring_index("pattern", "/", 1)), F.regexp_extract("pattern", "(/.*?)/*$", 1))
    known = entries.where("list is not null and kind in ('block', 'allow') and action in ('add', 'remove')")
    known = known.select("list", "kind", pattern.alias("pattern"), "action", "dated").dropna()
    states = known.groupBy(*RULE, "dated").agg((F.max("action") == "add").alias("on"))
    rule = W.partitionBy(*RULE).orderBy("dated")
    turns = states.withColumn("was", F.lag("on", 1, False).over(rule)).where("on <> was")
    turns = turns.withColumn("until", F.lead("dated").over(rule))
    return turns.where("on").select(*RULE, F.col("dated").alias("since"), "until")


def _keys(host: Column, path: Column, labels: int, segments: int) -> Column:
    """Suffixes of the host of up to ``labels`` labels, and the host with beginnings of the path of up to ``segments``."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    steps = F.slice(F.split(path, "/"), 2, segments)
    begun = F.when(
        F.size(steps) > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps))),
            lambda n: F.concat_ws("/", host, F.array_join(F.slice(steps, 1, n), "/")),
        ),
    )
    return F.array_distinct(F.concat(suffixes, F.coalesce(begun, F.array().cast("array<string>"))))


def judge(
    captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", slice_days: int = SLICE_DAYS
) -> DataFrame:
    """``captures`` with a struct column ``verdict``: host, n_active, decision, list, pattern, since.

    ``n_active`` rules covered the URL when it was fetched. The longest pattern decides; of equally long ones
    an 'allow' rule, then the list that sorts first. ``decision`` is 'block', 'allow', 'none' (no rule) or 'no host' (null or
    malformed URL). A null fetch time meets no rule. Rows, repeated ones included, and columns stay; if ``verdict`` is
    in use the new column takes the next free name. Times are taken as they come, interval starts inclusive.
    """
    rules = intervals(entries)
    slash = F.size(F.split(F.regexp_extract("pattern", "/(.*)$", 1), "/"))
    depth = rules.agg(
        F.max(F.size(F.split(F.substring_index("pattern", "/", 1), r"\."))),
        F.max(F.when(F.col("pattern").contains("/"), slash)),
    ).first()
    span = captures.agg(F.min(fetched).cast("string"), F.max(fetched).cast("string")).first()
    labels, segments = depth[0] or 0, depth[1] or 0
    name = free_name(captures, "verdict")
    host = host_of(F.col(url))
    none = F.struct(
        host.alias("host"), F.lit(0).cast("long").alias("n_active"),
        F.when(host.isNull(), "no host").otherwise("none").alias("decision"), F.lit(None).cast("string").alias("list"),
        F.lit(None).cast("string").alias("pattern"), F.lit(None).cast(rules.schema["since"].dataType).alias("since"),
    )
    if not labels or span[0] is None:
        return captures.withColumn(name, none)

    number = lambda ts: F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(86_400 * slice_days)).cast("int")
    first, last = F.lit(span[0]).cast(captures.schema[fetched].dataType), F.lit(span[1]).cast(captures.schema[fetched].dataType)
    laid = rules.where((F.col("since") <= last) & (F.col("until").isNull() | (F.col("until") > first)))
    slices = F.sequence(number(F.greatest("since", first)), number(F.least(F.coalesce("until", last), last)))
    laid = laid.withColumn("slice", F.explode(slices))

    # a verdict depends on the URL and the time alone, so captures that share both ask once
    asked = captures.select(F.col(url).alias("url"), F.col(fetched).alias("at")).where("at is not null")
    asked = asked.where(host_of(F.col("url")).isNotNull()).distinct()
    keys = _keys(host_of(F.col("url")), path_of(F.col("url")), labels, segments)
    asked = asked.select("url", "at", number(F.col("at")).alias("slice"), F.explode(keys).alias("pattern"))
    met = asked.join(laid, ["pattern", "slice"]).where("since <= at and (until is null or at < until)")
    rank = F.struct(-F.length("pattern"), "kind", "list")  # 'allow' sorts before 'block'
    found = met.groupBy("url", "at").agg(
        F.count("*").alias("n_active"), F.min_by(F.struct("kind", "list", "pattern", "since"), rank).alias("best")
    )
    mark_url, mark_at, row = (free_name(captures, x) for x in ("found_url", "found_at", "found_row"))
    found = found.select(
        F.col("url").alias(mark_url), F.col("at").alias(mark_at),
        F.struct("n_active", "best.*").alias(row),
    )
    joined = captures.join(found, (captures[url] == F.col(mark_url)) & (captures[fetched] == F.col(mark_at)), "left")
    verdict = F.when(F.col(row).isNull(), none).otherwise(
        F.struct(
            host.alias("host"), F.col(row)["n_active"].alias("n_active"), F.col(row)["kind"].alias("decision"),
            F.col(row)["list"].alias("list"), F.col(row)["pattern"].alias("pattern"), F.col(row)["since"].alias("since"),
        )
    )
    return joined.withColumn(name, verdict).drop(mark_url, mark_at, row)
