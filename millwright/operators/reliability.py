"""Reliability analytics over inspection histories."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.common import MICROS_PER_DAY, contains_any, exact_round, exact_round_of, flag_sum, micros, whole_days
from millwright.session import cut_lineage, deal

# Fixed values.
FAILURE_SEVERITIES = ("major", "critical")
NEEDLES = {
    "loto": ("loto", "lockout", "tagout", "isolation"),
    "near_miss": ("near miss", "near-miss", "almost", "unsafe"),
    "audit_type": ("audit", "statutory"),
    "audit_text": ("audit", "non-conformance", "nonconformance", "ncr"),
    "non_conformance": ("non-conformance", "nonconformance", "ncr", "deviation"),
    "revision": ("supersede", "revision", "rev ", "outdated"),
}


def event_time() -> Column:
    return F.coalesce("inspection_date", "created_at")


def failure_records(inspections: DataFrame) -> DataFrame:
    """Major and critical inspections, dated by inspection or else by entry."""
    return inspections.where(F.col("severity").isin(*FAILURE_SEVERITIES)).select(
        "id", "equipment_tag", event_time().alias("inspection_date"), "severity", "findings"
    )


def failure_clusters(inspections: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """Assets with repeated failures, one aggregation with map-side combine."""
    return _clusters_of(failure_records(inspections), min_occurrences)


def _clusters_of(failures: DataFrame, min_occurrences: int = 2) -> DataFrame:
    grouped = (
        failures.groupBy("equipment_tag")
        .agg(
            F.count("*").alias("occurrence_count"),
            F.count_if(F.col("severity") == "major").alias("major_count"),
            F.count_if(F.col("severity") == "critical").alias("critical_count"),
            F.min("inspection_date").alias("first_seen"),
            F.max("inspection_date").alias("last_seen"),
        )
        .where(F.col("occurrence_count") >= min_occurrences)
    )
    months = F.greatest(whole_days(F.col("last_seen"), F.col("first_seen")) / F.lit(30.0), F.lit(1.0))
    weight = F.col("major_count") + 2 * F.col("critical_count")
    return grouped.select(
        "*",
        exact_round(F.col("occurrence_count") / months).alias("frequency_per_month"),
        exact_round(F.col("occurrence_count") * weight / months).alias("risk_score"),
    )


def ranked_clusters(inspections: DataFrame, min_occurrences: int = 2) -> DataFrame:
    return failure_clusters(inspections, min_occurrences).orderBy(F.desc("risk_score"), "equipment_tag")


def overdue_inspections(
    inspections: DataFrame,
    equipment: DataFrame,
    as_of: Column,
    threshold_days: int = 180,
    risk_level: str | None = None,
    equipment_type: str | None = None,
) -> DataFrame:
    """Assets whose latest inspection of any severity is older than the threshold."""
    latest = (
        inspections.groupBy("equipment_tag")
        .agg(F.max(event_time()).alias("last_inspection_date"))
        .withColumn("days_since_last_inspection", whole_days(as_of, F.col("last_inspection_date")))
        .where(F.col("days_since_last_inspection") > threshold_days)
    )
    register = equipment.select(F.col("tag").alias("equipment_tag"), "name", "equipment_type", F.lit(True).alias("known"))
    result = latest.join(register, "equipment_tag", "left").select(
        "equipment_tag",
        F.when(F.col("known"), F.col("name")).otherwise("").alias("equipment_name"),
        F.when(F.col("known"), F.col("equipment_type")).otherwise("").alias("equipment_type"),
        "last_inspection_date",
        "days_since_last_inspection",
        (F.col("days_since_last_inspection") - threshold_days).alias("overdue_by_days"),
        F.when(F.col("days_since_last_inspection") > 365, "high").otherwise("medium").alias("risk_level"),
    )
    if risk_level:
        result = result.where(F.col("risk_level") == risk_level)
    if equipment_type:
        result = result.where(F.lower("equipment_type") == equipment_type.lower())
    return result


PAIR_SUMS = "tag_a string, tag_b string, n long, gap_sum long, last_at timestamp_ntz"
# Piece numbers of a block stay below this.
PIECES = 1 << 20


def _cover(begins: list[np.ndarray], ends: list[np.ndarray], weights: list[int], size: int) -> np.ndarray:
    """For each of ``size`` positions, the weights of the runs over it summed up; run i of list j has weight ``weights[j]``."""
    at = np.concatenate([x.ravel() for x in (*begins, *ends)])
    steps = np.repeat(np.array([*weights, *(-w for w in weights)], dtype=np.float64), [x.size for x in (*begins, *ends)])
    if len(at) > size:
        return np.cumsum(np.bincount(at, weights=steps, minlength=size + 1))[:-1]
    # few runs leave long stretches of one height
    order = np.argsort(at, kind="stable")
    heights = np.concatenate([[0.0], np.cumsum(steps[order])])
    return np.repeat(heights, np.diff(np.concatenate([[0], at[order], [size]])))


def _met(times: np.ndarray, late: np.ndarray, codes: np.ndarray, final: np.ndarray, window_days: int):
    """(codes, pair counts, gap sums, latest times) of the records in ``late`` near one tag's sorted ``times``.

    ``late`` is sorted, so the records near one time form a run of positions.  The runs over a position tell how often its record is
    paired; runs for 1, 2, ... days give the whole days between.  Only positions that some run covers are looked at.
    ``final`` is the last position of each code.
    """
    reach = (window_days + 1) * MICROS_PER_DAY
    begin, end = np.searchsorted(late, times - reach, side="right"), np.searchsorted(late, times + reach, side="left")
    some = end > begin
    if not some.any():
        return None
    times, begin, end = times[some], begin[some], end[some]
    opens = np.concatenate([[0], np.flatnonzero(begin[1:] > end[:-1]) + 1])
    lows, highs = begin[opens], end[np.append(opens[1:] - 1, len(end) - 1)]
    sizes = highs - lows
    shift = np.repeat(lows - np.cumsum(sizes) + sizes, np.diff(np.append(opens, len(times))))
    covered = slice(lows[0], highs[0]) if len(lows) == 1 else np.concatenate([np.arange(x, y) for x, y in zip(lows, highs)])
    near_by, here = late[covered], codes[covered]
    size = len(here)
    days = np.arange(1, window_days + 1)[:, None] * MICROS_PER_DAY
    inner_begin = np.searchsorted(late, times - days, side="right") - shift
    inner_end = np.searchsorted(late, times + days, side="left") - shift
    begin, end = begin - shift, end - shift
    if size < len(final):
        known, here = np.unique(here, return_inverse=True)
    else:
        known = np.arange(len(final))
    summed = lambda weights: np.bincount(here, weights=weights, minlength=len(known)).astype(np.int64)
    # a double holds both sums, one above the other, as long as they are not too large
    most = len(times) * size
    bits = (window_days * most).bit_length()
    if most << bits <= 1 << 53:
        both = summed(_cover([begin, inner_begin], [end, inner_end], [1 << bits, 1], size))
        n, nearer = both >> bits, both & ((1 << bits) - 1)
    else:
        n, nearer = summed(_cover([begin], [end], [1], size)), summed(_cover([inner_begin], [inner_end], [1], size))
    gaps = window_days * n - nearer
    hit = np.flatnonzero(n)
    # the later of a record and the last time near it never falls along the positions
    if len(lows) == 1 and highs[0] == len(late):
        at = final[known[hit]] - lows[0]
    else:
        at = np.zeros(len(known), dtype=np.int64)
        np.maximum.at(at, here, np.arange(size))
        at = at[hit]
    last = np.maximum(near_by[at], times[np.searchsorted(begin, at, side="right") - 1])
    return known[hit], n[hit], gaps[hit], last


def _pair_cell(window_days: int, rows: int = 100_000):
    """Sums of every pair of tags that meet in one cell, a tag of one unit at a time, without listing record pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        coded = table["tag"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        names = coded.dictionary.take(order)
        rank = np.empty(len(names), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        codes, us = rank[coded.indices.to_numpy()], table["us"].to_numpy()
        second = table["second"].to_numpy().astype(bool)
        alone = table["lo"][0] == table["hi"][0]
        one = (codes[~second], us[~second])
        two = one if alone else (codes[second], us[second])
        if not len(one[0]) or not len(two[0]):
            return
        work = lambda x, y: len(np.unique(x[0])) * len(y[0])
        if not alone and work(one, two) > work(two, one):
            one, two = two, one
        by_time = np.argsort(two[1], kind="stable")
        others, local = np.unique(two[0][by_time], return_inverse=True)
        late = two[1][by_time]
        final = np.zeros(len(others), dtype=np.int64)
        np.maximum.at(final, local, np.arange(len(local)))
        by_tag = np.lexsort((one[1], one[0]))
        tags, times = one[0][by_tag], one[1][by_tag]
        found, held = [], 0

        def flushed():
            a, b, n, gaps, last = (np.concatenate(x) for x in zip(*found))
            tags = [names.take(pa.array(np.minimum(a, b))), names.take(pa.array(np.maximum(a, b)))]
            return pa.RecordBatch.from_arrays(
                [*tags, pa.array(n), pa.array(gaps), pa.array(last).view(pa.timestamp("us"))], ["tag_a", "tag_b", "n", "gap_sum", "last_at"])

        for own in np.split(np.arange(len(tags)), np.flatnonzero(np.diff(tags)) + 1):
            code = tags[own[0]]
            met = _met(times[own], late, local, final, window_days)
            if met is None:
                continue
            other = others[met[0]]
            # a pair inside one unit is met from both of its tags
            kept = other > code if alone else other != code
            if kept.any():
                found.append((np.full(np.count_nonzero(kept), code), other[kept], *(x[kept] for x in met[1:])))
                held += len(found[-1][0])
            if held >= rows:
                yield flushed()
                found, held = [], 0
        if found:
            yield flushed()

    return run


def cooccurrence_pairs(inspections: DataFrame, window_days: int = 30, rows_per_cell: int = 131_072) -> DataFrame:
    """Every pair of assets failing within the window: count, mean gap, latest date.

    Tags are dealt into blocks, and a cell holds the records of two of them, so that a pair of tags is
    summed up in one cell and no sums are shuffled.  Only a block that few tags overfill is cut
    into pieces by record; the sums of its cells are added up.
    """
    return cooccurrence_of(failure_records(inspections), window_days, rows_per_cell)


def cooccurrence_of(failures: DataFrame, window_days: int = 30, rows_per_cell: int = 131_072) -> DataFrame:
    records = failures.select(
        F.col("equipment_tag").alias("tag"), micros("inspection_date").alias("us"), F.xxhash64("id").alias("salt")
    ).where("tag is not null and us is not null")
    total = records.count()
    # cells enough to keep a small table's tasks busy
    blocks = max(1, -(-total // rows_per_cell), min(16, -(-total // 2048)))
    dealt = records.withColumn("block", F.pmod(F.xxhash64("tag"), F.lit(blocks)).cast("long"))
    sizes = dealt.groupBy("block").agg(F.ceil(F.count("*") / (2 * rows_per_cell)).cast("long").alias("pieces"))
    sizes = cut_lineage(sizes)
    unit = lambda piece: F.col("block") * PIECES + piece
    placed = dealt.join(F.broadcast(sizes), "block").select("tag", "us", "pieces", unit(F.pmod("salt", "pieces")).alias("unit"))
    units = sizes.select(
        F.explode(F.sequence(unit(F.lit(0)), unit(F.col("pieces") - 1))).alias("other"), F.col("pieces").alias("other_pieces")
    )
    met = placed.crossJoin(F.broadcast(units)).select(
        F.least("unit", "other").alias("lo"), F.greatest("unit", "other").alias("hi"),
        (F.col("unit") > F.col("other")).alias("second"), "tag", "us", (F.col("pieces") * F.col("other_pieces") == 1).alias("whole"),
    )

    def summed(rows: DataFrame) -> DataFrame:
        return deal(rows.drop("whole"), "lo", "hi").groupBy("lo", "hi").applyInArrow(_pair_cell(window_days), PAIR_SUMS)

    sums = summed(met.where("whole"))
    if not sizes.where("pieces > 1").isEmpty():
        parts = summed(met.where("not whole")).groupBy("tag_a", "tag_b")
        sums = sums.unionByName(parts.agg(F.sum("n").alias("n"), F.sum("gap_sum").alias("gap_sum"), F.max("last_at").alias("last_at")))
    # times without a zone stay so: sessions are in UTC, and a change of zone costs as much as the rest of a pair
    plain = isinstance(failures.schema["inspection_date"].dataType, T.TimestampNTZType)
    return sums.withColumn("gap", F.col("gap_sum") / F.col("n")).select(
        "tag_a", "tag_b",
        F.col("n").alias("co_occurrence_count"),
        exact_round_of(F.col("gap")).alias("typical_gap_days"),
        (F.col("last_at") if plain else F.col("last_at").cast("timestamp")).alias("last_occurrence"),
    )


def failure_cooccurrence(inspections: DataFrame, window_days: int = 30, top: int | None = 10) -> DataFrame:
    return top_cooccurrence(failure_records(inspections), window_days, top)


def top_cooccurrence(failures: DataFrame, window_days: int = 30, top: int | None = 10) -> DataFrame:
    """The pairs with most co-occurrences (None: all pairs, in no order)."""
    if top is None:
        return cooccurrence_of(failures, window_days)
    pairs = cooccurrence_of(_able_to_lead(failures, window_days, top), window_days)
    return _first_pairs(pairs, top)


def _first_pairs(pairs: DataFrame, top: int) -> DataFrame:
    return pairs.orderBy(F.desc("co_occurrence_count"), "tag_a", "tag_b").limit(top)


def _able_to_lead(failures: DataFrame, window_days: int, top: int, leaders: int = 256) -> DataFrame:
    """Failures of the assets that can be in one of the ``top`` pairs.

    A record meets others of its own slab of time, one window long, and of the two beside it.  So an asset's records
    times the most that any asset has there bound the count of each of its pairs.  Pairs among the assets
    of the highest bounds set a count to reach, and assets whose bound is below it are in no pair of the result.
    """
    slab = F.floor(micros("inspection_date") / F.lit((window_days + 1) * MICROS_PER_DAY)).cast("long")
    counts = failures.where("equipment_tag is not null and inspection_date is not null").groupBy(
        "equipment_tag", slab.alias("slab")).agg(F.count("*").alias("n"))
    counts = cut_lineage(counts)
    peaks = counts.groupBy("slab").agg(F.max("n").alias("peak"))
    around = peaks.select(F.explode(F.array(F.col("slab") - 1, F.col("slab"), F.col("slab") + 1)).alias("slab"), "peak")
    around = around.groupBy("slab").agg(F.sum("peak").alias("peaks"))
    bounds = cut_lineage(counts.join(around, "slab").groupBy("equipment_tag").agg(F.sum(F.col("n") * F.col("peaks")).alias("most")))
    ahead = bounds.orderBy(F.desc("most"), "equipment_tag").limit(leaders).select("equipment_tag")
    among = cooccurrence_of(failures.join(ahead, "equipment_tag", "left_semi"), window_days)
    reached = _first_pairs(among, top).agg(F.count("*").alias("pairs"), F.min("co_occurrence_count").alias("least")).first()
    if reached["pairs"] < top:
        return failures
    able = bounds.where(F.col("most") >= reached["least"]).select("equipment_tag")
    return failures.join(able, "equipment_tag", "left_semi")


def overall_risk(clusters: DataFrame, overdue: DataFrame) -> DataFrame:
    """One row: the plant's risk level from clusters and overdue assets, and how many are overdue."""
    signals = clusters.select(F.col("risk_score"), F.lit(None).cast("long").alias("days")).unionByName(
        overdue.select(F.lit(None).cast("double").alias("risk_score"), F.col("days_since_last_inspection").alias("days"))
    )
    totals = signals.agg(
        F.coalesce(F.max(F.col("risk_score") > 10), F.lit(False)).alias("risky"),
        F.coalesce(F.max("days"), F.lit(0)).alias("longest"),
        F.count("days").alias("overdue_inspections_count"),
    )
    return totals.select(
        F.when((F.col("longest") > 365) & F.col("risky"), "Critical")
        .when(F.col("longest") > 365, "High")
        .when(F.col("longest") > 180, "Medium")
        .otherwise("Low")
        .alias("overall_risk_level"),
        "overdue_inspections_count",
    )


def _top_clusters(inspections: DataFrame, n: int | None) -> DataFrame:
    return failure_clusters(inspections) if n is None else ranked_clusters(inspections).limit(n)


def _high_overdue(inspections: DataFrame, equipment: DataFrame, as_of: Column) -> DataFrame:
    return overdue_inspections(inspections, equipment, as_of, risk_level="high")


def risk_summary(
    inspections: DataFrame, equipment: DataFrame, as_of: Column, top_clusters: int | None = 5, top_pairs: int | None = 3
) -> DataFrame:
    """The summary as rows (part, rank, fields): 'level' (risk level and number of overdue assets), the top
    'cluster' and 'pair' rows (None: all, without ranks), and a 'critical_overdue' row for every high-risk overdue asset.

    Rows, not lists: overdue assets grow with the register. Fields of other parts are null.
    """
    failures = cut_lineage(failure_records(inspections))
    clusters = cut_lineage(_clusters_of(failures))
    overdue = cut_lineage(overdue_inspections(inspections, equipment, as_of))
    pairs = top_cooccurrence(failures, top=top_pairs)
    level = overall_risk(clusters, overdue).withColumn("part", F.lit("level"))
    by_risk, by_count = (F.desc("risk_score"), "equipment_tag"), (F.desc("co_occurrence_count"), "tag_a", "tag_b")
    top = clusters if top_clusters is None else clusters.orderBy(*by_risk).limit(top_clusters)
    ranked = lambda rows, n, order: rows if n is None else rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    parts = [
        level.withColumn("rank", F.lit(1)),
        ranked(top, top_clusters, by_risk).withColumn("part", F.lit("cluster")),
        ranked(pairs, top_pairs, by_count).withColumn("part", F.lit("pair")),
        overdue.where("risk_level = 'high'").withColumn("part", F.lit("critical_overdue")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# What each kind of warning recommends.
ADVICE = {
    "cluster": "Review the latest SOP, verify open corrective actions, and brief the next operating shift.",
    "overdue": "Schedule inspection or require supervisor acknowledgement before relying on this asset history.",
    "drift": "Force a trust-gated answer and verify the current approved isolation procedure before execution.",
}


def proactive_warnings(
    inspections: DataFrame, equipment: DataFrame, links: DataFrame, as_of: Column,
    top_clusters: int | None = 3, top_overdue: int | None = 3, drift_tags: int = 6,
) -> DataFrame:
    """The first cluster warnings by risk, the longest overdue ones (None: all) and one isolation drift.

    The drift is one row and names its first ``drift_tags`` assets. ``links(tag, related_tag)`` names the assets connected to a warned one.
    """
    clusters = _top_clusters(inspections, top_clusters).select(
        F.concat(F.lit("cluster-"), "equipment_tag").alias("id"),
        "equipment_tag",
        F.when(F.col("critical_count") > 0, "critical").otherwise("high").alias("severity"),
        F.concat(F.lit("Recurring failure pattern on "), "equipment_tag").alias("title"),
        F.concat(
            F.col("occurrence_count").cast("string"), F.lit(" major/critical records; risk score "),
            F.col("risk_score").cast("string"),
        ).alias("trigger"),
        F.lit("Repeated high-severity findings detected in inspection history.").alias("evidence"),
        F.lit(ADVICE["cluster"]).alias("recommended_action"),
        F.lit("incident_reports + inspection_history").alias("source_type"),
    )
    late = _high_overdue(inspections, equipment, as_of)
    if top_overdue is not None:
        late = late.orderBy(F.desc("days_since_last_inspection"), "equipment_tag").limit(top_overdue)
    overdue = late.select(
        F.concat(F.lit("overdue-"), "equipment_tag").alias("id"),
        "equipment_tag",
        F.lit("high").alias("severity"),
        F.concat(F.lit("Inspection review overdue for "), "equipment_tag").alias("title"),
        F.concat(F.col("days_since_last_inspection").cast("string"), F.lit(" days since last inspection")).alias("trigger"),
        F.concat(
            F.lit("Inspection is overdue by "), F.col("overdue_by_days").cast("string"),
            F.lit(" days against the active review threshold."),
        ).alias("evidence"),
        F.lit(ADVICE["overdue"]).alias("recommended_action"),
        F.lit("qms_review_cycle").alias("source_type"),
    )
    asset_warnings = clusters.unionByName(overdue)
    related = (
        links.join(asset_warnings.select(F.col("equipment_tag").alias("tag")).distinct(), "tag", "left_semi")
        .groupBy(F.col("tag").alias("equipment_tag"))
        .agg(F.array_sort(F.collect_set("related_tag")).alias("linked"))
    )
    with_assets = asset_warnings.join(related, "equipment_tag", "left").withColumn(
        "related_assets",
        F.array_distinct(F.concat(F.array("equipment_tag"), F.coalesce("linked", F.array().cast("array<string>")))),
    )
    loto = inspections.where(contains_any(F.col("findings"), NEEDLES["loto"]))
    first = loto.agg(F.min_by("findings", F.struct("created_at", "id")).alias("evidence")).where("evidence is not null")
    tags = loto.where("equipment_tag <> ''").select("equipment_tag").distinct().orderBy("equipment_tag").limit(drift_tags)
    drift = (
        first.select("evidence", F.lit(None).cast("string").alias("tag"))
        .unionByName(tags.select(F.lit(None).cast("string").alias("evidence"), F.col("equipment_tag").alias("tag")))
        .agg(F.max("evidence").alias("evidence"), F.array_sort(F.collect_set("tag")).alias("related_assets"))
        .where("evidence is not null")
        .select(
            F.lit("procedure-drift-loto").alias("id"),
            F.lit("critical").alias("severity"),
            F.lit("Isolation procedure drift detected").alias("title"),
            F.lit("LOTO / isolation language appeared in high-risk maintenance evidence.").alias("trigger"),
            "evidence",
            F.lit(ADVICE["drift"]).alias("recommended_action"),
            F.lit("near_miss + compliance_gap").alias("source_type"),
            "related_assets",
        )
    )
    return with_assets.drop("equipment_tag", "linked").unionByName(drift)


def systemic_patterns(
    inspections: DataFrame, top_pairs: int | None = 3, top_clusters: int | None = 3, rows: int | None = 5
) -> DataFrame:
    """The first asset pairs, then the first clusters, ``rows`` in all (None: no cut, and in no order)."""
    pairs = failure_cooccurrence(inspections, top=top_pairs).select(
        F.lit(0).alias("part"),
        (-F.col("co_occurrence_count")).cast("double").alias("rank"),
        F.lit("Cross-asset failure recurrence").alias("pattern"),
        F.concat_ws(",", "tag_a", "tag_b").alias("assets"),
        F.concat(
            F.col("co_occurrence_count").cast("string"), F.lit(" co-occurrences within a typical "),
            F.col("typical_gap_days").cast("string"), F.lit(" day gap"),
        ).alias("evidence"),
        F.lit("Inspect connected assets together instead of treating each event as isolated.").alias("lesson"),
    )
    clusters = _top_clusters(inspections, top_clusters).select(
        F.lit(1).alias("part"),
        (-F.col("risk_score")).alias("rank"),
        F.lit("Repeated defect on same equipment").alias("pattern"),
        F.col("equipment_tag").alias("assets"),
        F.concat(F.lit("Frequency "), F.col("frequency_per_month").cast("string"), F.lit(" events/month")).alias("evidence"),
        F.lit("Create a preventive maintenance action or engineering review trigger for this asset class.").alias("lesson"),
    )
    both = pairs.unionByName(clusters)
    return (both if rows is None else both.orderBy("part", "rank", "assets").limit(rows)).drop("part", "rank")


def qms_signals(inspections: DataFrame, equipment: DataFrame, as_of: Column) -> DataFrame:
    """Quality-system gaps, each present only when there is evidence for it."""
    high = _high_overdue(inspections, equipment, as_of).agg(F.count("*").alias("n"))
    review = high.where("n > 0").select(
        F.lit("Review-cycle non-conformance").alias("signal"),
        F.lit("open").alias("status"),
        F.concat(F.col("n").cast("string"), F.lit(" high-risk assets exceeded inspection review interval.")).alias("evidence"),
        F.lit("Maintenance / QMS").alias("owner"),
    )
    audit = contains_any(F.col("inspection_type"), NEEDLES["audit_type"]) | contains_any(F.col("findings"), NEEDLES["audit_text"])
    revision = contains_any(F.col("findings"), NEEDLES["revision"])
    seen = inspections.agg(
        F.count_if(audit).alias("audits"),
        F.min_by(F.coalesce("findings", F.lit("")), F.when(audit, F.struct("created_at", "id"))).alias("audit_evidence"),
        F.count_if(revision).alias("revisions"),
    )
    text = seen.select(
        F.explode(
            F.array(
                F.struct(
                    (F.col("audits") > 0).alias("present"),
                    F.lit("Audit finding linked to asset reliability").alias("signal"),
                    F.lit("needs_review").alias("status"),
                    F.col("audit_evidence").alias("evidence"),
                    F.lit("QMS / Reliability").alias("owner"),
                ),
                F.struct(
                    (F.col("revisions") > 0).alias("present"),
                    F.lit("Document revision conflict").alias("signal"),
                    F.lit("trust_gate_required").alias("status"),
                    F.lit("Maintenance evidence references revision or supersession language.").alias("evidence"),
                    F.lit("Document control").alias("owner"),
                ),
            )
        ).alias("s")
    )
    return review.unionByName(text.where("s.present").select("s.signal", "s.status", "s.evidence", "s.owner"))


def source_coverage(inspections: DataFrame) -> DataFrame:
    """How much of each evidence class the records hold, in one pass."""
    return inspections.agg(
        flag_sum(F.lower("severity").isin(*FAILURE_SEVERITIES)).alias("incident_reports_reviewed"),
        flag_sum(contains_any(F.col("findings"), NEEDLES["near_miss"])).alias("near_miss_records_reviewed"),
        flag_sum(contains_any(F.col("inspection_type"), NEEDLES["audit_type"])).alias("audit_findings_reviewed"),
        flag_sum(contains_any(F.col("findings"), NEEDLES["non_conformance"])).alias("quality_non_conformances_reviewed"),
        F.count_distinct(F.when(F.col("equipment_tag") != "", F.col("equipment_tag"))).alias("equipment_tags_detected"),
    )


def validation_metrics(inspections: DataFrame, equipment: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """Distinct tags, linked assets, compliance gaps and warnings, as metric rows."""
    tags = inspections.where("equipment_tag <> ''").agg(F.count_distinct("equipment_tag").alias("n"))
    gaps = _high_overdue(inspections, equipment, as_of).agg(F.count("*").alias("n"))
    warnings = proactive_warnings(inspections, equipment, links, as_of)
    warned = warnings.agg(F.flatten(F.collect_list("related_assets")).alias("assets"), F.count("*").alias("n"))

    def metric(df: DataFrame, name: str, value: Column, unit: str, status: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("name"), F.concat(value.cast("string"), F.lit(f" {unit}")).alias("value"), F.lit(status).alias("status")
        )

    return (
        metric(tags, "Entity extraction accuracy proxy", F.col("n"), "equipment tags", "measured")
        .unionByName(
            metric(warned, "Knowledge graph linkage completeness", F.size(F.array_distinct("assets")), "linked assets", "live")
        )
        .unionByName(metric(gaps, "Compliance gap detection", F.col("n"), "high-risk gaps", "live"))
        .unionByName(metric(warned, "Cross-functional discovery", F.col("n"), "proactive warnings", "live"))
    )
