"""Building the equipment graph by keyed upserts, and the review queue before it.

Nodes are rows keyed by id (or label and id), edges rows keyed by their ends and
relationship.  A batch of updates is first reduced to one row per key, with
map-side combine, and then joined to the table once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.common import strip, unnest
from millwright.functions.text import RELATIONSHIPS, wide_tags
from millwright.sources.payloads import low_confidence_count


def tidy(value: Column) -> Column:
    return F.upper(strip(F.coalesce(value, F.lit(""))))


def _last(column: str, order: Column) -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), order))


def _first(column: str, order: Column) -> Column:
    return F.min_by(column, F.when(F.col(column).isNotNull(), order))


# ---- nodes and edges --------------------------------------------------------
def merge_nodes(nodes: DataFrame, updates: DataFrame, attributes: list[str], newest_wins: bool = True) -> DataFrame:
    """Upsert ``updates(tag, seq, attributes...)`` by trimmed upper-case tag.

    A null never overwrites a value.  With ``newest_wins`` the last stated value
    replaces the stored one; otherwise the stored, else the first stated, stays.
    """
    pick = _last if newest_wins else _first
    changes = updates.withColumn("id", tidy(F.col("tag"))).groupBy("id").agg(
        *[pick(a, F.col("seq")).alias(f"_{a}") for a in attributes]
    )
    merged = nodes.select("id", *attributes).join(changes, "id", "full_outer")
    order = (lambda a: (f"_{a}", a)) if newest_wins else (lambda a: (a, f"_{a}"))
    return merged.select("id", *[F.coalesce(*order(a)).alias(a) for a in attributes])


def relationship_name(rel: Column) -> Column:
    return F.when(rel.isin(*RELATIONSHIPS), F.upper(rel)).otherwise("CONNECTED_TO")


def merge_edges(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert ``updates(src, rel, dst, source, confidence, seq)`` by ends and relationship.

    ``edges(src, rel, dst, source, confidence)``.  An unknown relationship becomes
    CONNECTED_TO.  The last stated source is kept, and the last confidence that
    was stated at all.
    """
    keyed = updates.select(
        tidy(F.col("src")).alias("src"), relationship_name(F.col("rel")).alias("rel"), tidy(F.col("dst")).alias("dst"),
        "source", "confidence", "seq",
    )
    changes = keyed.groupBy("src", "rel", "dst").agg(
        F.max_by("source", "seq").alias("_source"), _last("confidence", F.col("seq")).alias("_confidence"), F.lit(True).alias("_new")
    )
    return edges.join(changes, ["src", "rel", "dst"], "full_outer").select(
        "src", "rel", "dst",
        F.when(F.col("_new"), F.col("_source")).otherwise(F.col("source")).alias("source"),
        F.coalesce("_confidence", "confidence").alias("confidence"),
    )


def endpoint_nodes(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Ids the updates mention that the graph lacks; they become bare equipment nodes."""
    ends = updates.select(F.explode(F.array(tidy(F.col("src")), tidy(F.col("dst")))).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").withColumn("label", F.lit("Equipment"))


def merge_digraph_edges(nodes: DataFrame, edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert with one edge per pair of ends; an update counts only if both ends exist."""
    ids = nodes.select("id")
    keyed = updates.where(F.col("rel").isin(*RELATIONSHIPS)).select(
        tidy(F.col("src")).alias("src"), tidy(F.col("dst")).alias("dst"), "rel", "source", "seq"
    )
    whole = keyed.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    changes = whole.groupBy("src", "dst").agg(F.max_by(F.struct("rel", "source"), "seq").alias("_new"))
    kept = edges.groupBy("src", "dst").agg(F.max(F.struct("rel", "source")).alias("_old"))
    chosen = F.coalesce("_new", "_old")
    return kept.join(changes, ["src", "dst"], "full_outer").select(
        "src", "dst", chosen["rel"].alias("rel"), chosen["source"].alias("source")
    )


# ---- drawings ---------------------------------------------------------------
def pid_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(equipment, valves, instruments) of parsed drawings, ids tidied and incomplete items dropped."""
    base = ["document_id", "document_low_confidence", "received_at"]
    zone = F.col("data.zone").alias("zone")

    def stated(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("")) != ""

    confidence = F.coalesce("x.confidence", F.lit("low")).alias("confidence")
    equipment = (
        unnest(parsed, [*base, zone], F.col("data.equipment"), "x").where(stated("x.id"))
        .select(*base, "zone", tidy(F.col("x.id")).alias("id"), F.col("x.type").alias("type"), confidence)
    )
    valves = (
        unnest(parsed, [*base, zone], F.col("data.valves"), "x")
        .where(stated("x.valve_id") & stated("x.connects_from") & stated("x.connects_to"))
        .select(
            *base, "zone", tidy(F.col("x.valve_id")).alias("valve_id"), F.col("x.valve_type").alias("valve_type"),
            tidy(F.col("x.connects_from")).alias("connects_from"), tidy(F.col("x.connects_to")).alias("connects_to"), confidence,
        )
    )
    anchors = F.transform(
        F.filter(F.coalesce("x.attached_to_line_between", F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")) != ""),
        tidy,
    )
    instruments = (
        unnest(parsed, [*base, zone], F.col("data.instruments"), "x").where(stated("x.tag"))
        .select(*base, "zone", tidy(F.col("x.tag")).alias("tag"), anchors.alias("attached_to_line_between"), confidence)
    )
    return equipment, valves, instruments


def _low() -> Column:
    return F.lower("confidence") == "low"


def accepted(rows: DataFrame) -> DataFrame:
    """Rows that need no review: not low themselves, nor from a low-confidence document."""
    return rows.where(~_low() & ~F.col("document_low_confidence"))


def _latest(rows: DataFrame, key: str, label: str, values: list[str]) -> DataFrame:
    """One node per id; the last received item sets its attributes."""
    newest = F.max_by(F.struct(*values), F.struct("received_at", "document_id"))
    return rows.groupBy(F.col(key).alias("id")).agg(newest.alias("v")).select("id", F.lit(label).alias("label"), "v.*")


def merge_pid(parsed: DataFrame, known_equipment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that accepted drawing items write.

    ``known_equipment(id)`` are equipment nodes of the graph before the batch.  A
    valve is tied to its two ends only when both are equipment; an instrument
    with exactly two anchors creates the ones missing.
    """
    equipment, valves, instruments = (accepted(rows) for rows in pid_rows(parsed))
    attributes = ["type", "confidence", "zone", "document_id"]
    equipment_nodes = _latest(equipment, "id", "Equipment", attributes)
    valve_nodes = _latest(valves.withColumnRenamed("valve_type", "type"), "valve_id", "Valve", attributes)
    instrument_nodes = _latest(instruments.withColumn("type", F.lit(None).cast("string")), "tag", "Instrument", attributes)
    empty = {a: F.lit(None).cast("string") for a in attributes}
    zones = parsed.where(F.coalesce("data.zone", F.lit("")) != "").groupBy(F.col("data.zone").alias("id")).agg(
        F.max_by("document_id", F.struct("received_at", "document_id")).alias("document_id")
    ).withColumns({"label": F.lit("Zone"), **{a: empty[a] for a in attributes if a != "document_id"}})
    anchored = instruments.where(F.size("attached_to_line_between") == 2)
    known = known_equipment.select("id").unionByName(equipment_nodes.select("id"))
    stubs = (
        anchored.select(F.explode("attached_to_line_between").alias("id")).distinct()
        .join(known, "id", "left_anti").withColumns({"label": F.lit("Equipment"), **empty})
    )
    nodes = reduce(DataFrame.unionByName, [equipment_nodes, valve_nodes, instrument_nodes, zones, stubs])

    ends = known.distinct()
    tied = valves.join(ends.withColumnRenamed("id", "connects_from"), "connects_from", "left_semi").join(
        ends.withColumnRenamed("id", "connects_to"), "connects_to", "left_semi"
    )
    nobody = F.lit(None).cast("string")
    plain = {"valve_id": nobody, "confidence": nobody, "document_id": nobody, "received_at": F.lit(None).cast("timestamp_ntz")}

    def edge(src, rel, dst, **given):
        return F.struct(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), *[c.alias(n) for n, c in (plain | given).items()])

    frm, to, valve = F.col("connects_from"), F.col("connects_to"), F.col("valve_id")
    own = {n: F.col(n) for n in ("valve_id", "confidence", "document_id")} | {"received_at": F.col("received_at").cast("timestamp_ntz")}
    valve_edges = tied.select(
        F.explode(F.array(
            edge(frm, "CONNECTED_THROUGH", to, **own), edge(frm, "CONNECTED_TO", valve), edge(valve, "CONNECTED_TO", to)
        )).alias("e")
    )
    instrument_edges = anchored.select(
        F.explode(F.transform("attached_to_line_between", lambda a: edge(F.col("tag"), "HAS_INSTRUMENT", a))).alias("e")
    )
    zoned = [
        rows.where("zone is not null").select(edge(F.col("zone"), "CONTAINS", F.col(key)).alias("e"))
        for rows, key in ((equipment, "id"), (valves, "valve_id"), (instruments, "tag"))
    ]
    edges = reduce(DataFrame.unionByName, [valve_edges, instrument_edges, *zoned]).select("e.*")
    # a link written by several drawings keeps what the last one said
    last = F.max_by(F.struct("confidence", "document_id"), F.struct("received_at", "document_id"))
    edges = edges.groupBy("src", "rel", "dst", "valve_id").agg(last.alias("v"))
    return nodes, edges.select("src", "rel", "dst", "valve_id", "v.*")


def pid_counts(parsed: DataFrame) -> DataFrame:
    """Per drawing: written items of each kind, low-confidence objects and items held for review."""
    parts = pid_rows(parsed)
    kinds = ("equipment", "valves", "instruments")
    tallies = reduce(
        DataFrame.unionByName,
        [
            rows.groupBy("document_id").agg(
                F.count_if(~_low() & ~F.col("document_low_confidence")).alias("written"),
                F.count_if(_low() | F.col("document_low_confidence")).alias("held"),
            ).withColumn("kind", F.lit(kind))
            for rows, kind in zip(parts, kinds, strict=True)
        ],
    ).groupBy("document_id").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("written")).otherwise(0)).alias(k) for k in kinds], F.sum("held").alias("held")
    )
    flags = F.size(F.coalesce("data.confidence_flags", F.array().cast("array<string>")))
    return parsed.select(
        "document_id", low_confidence_count(F.col("data"), kinds).alias("low_confidence"), flags.alias("flags")
    ).join(tallies, "document_id", "left").select(
        "document_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds], "low_confidence",
        (F.coalesce("held", F.lit(0)) + F.col("flags")).alias("pending_review"),
    )


def merge_pid_digraph(parsed: DataFrame, known_equipment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the single-edge graph: nothing is held back, and valves need both ends."""
    base = parsed.select("document_id", "received_at", F.col("data.zone").alias("zone"), "data")
    items = unnest(base, ["document_id", "received_at", "zone"], F.col("data.equipment"), "x").select(
        "document_id", "received_at", "zone", tidy(F.col("x.id")).alias("id"), F.col("x.type").alias("type"),
        F.coalesce("x.confidence", F.lit("low")).alias("confidence"),
    ).where("id <> ''")
    valves = unnest(base, ["document_id", "received_at", "zone"], F.col("data.valves"), "x").select(
        "document_id", "received_at", "zone", tidy(F.col("x.valve_id")).alias("id"), F.lit("valve").alias("type"),
        tidy(F.col("x.connects_from")).alias("src"), tidy(F.col("x.connects_to")).alias("dst"),
        F.coalesce("x.confidence", F.lit("low")).alias("confidence"),
    )
    present = known_equipment.select("id").unionByName(items.select("id")).distinct()
    tied = valves.join(present.withColumnRenamed("id", "src"), "src", "left_semi").join(
        present.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    named = tied.where("id <> ''")
    nodes = _latest(
        items.unionByName(named.drop("src", "dst")), "id", "Equipment", ["type", "confidence", "zone", "document_id"]
    )
    whole = F.when(F.col("id") == "", F.array(F.struct("src", "dst"))).otherwise(
        F.array(F.struct("src", "dst"), F.struct("src", F.col("id").alias("dst")), F.struct(F.col("id").alias("src"), "dst"))
    )
    links = tied.select("document_id", "received_at", F.col("id").alias("valve_id"), "confidence", F.explode(whole).alias("l"))
    edges = links.groupBy("l.src", "l.dst").agg(
        F.max_by(F.struct("valve_id", "confidence", "document_id"), F.struct("received_at", "document_id")).alias("v")
    ).select("src", F.lit("connected_to").alias("rel"), "dst", "v.*")
    return nodes, edges


# ---- maintenance logs -------------------------------------------------------
def log_rows(parsed: DataFrame) -> DataFrame:
    entries = unnest(parsed, ["document_id", "document_low_confidence", "received_at"], F.col("data.entries"), "x", "position")
    return entries.where(F.coalesce("x.Asset_ID", F.lit("")) != "").select(
        "document_id", "document_low_confidence", "received_at", "position", tidy(F.col("x.Asset_ID")).alias("asset_id"),
        F.col("x.Date").alias("date"), F.col("x.Failure_Mode").alias("failure_mode"), F.col("x.Technician_Notes").alias("notes"),
        F.col("x.confidence").alias("confidence"),
    )


def merge_log(parsed: DataFrame, equipment: DataFrame) -> DataFrame:
    """Maintenance events, one per asset, date and failure mode; unknown assets write nothing."""
    rows = log_rows(parsed).where(~F.coalesce(_low(), F.lit(False)) & ~F.col("document_low_confidence"))
    known = rows.join(equipment.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    return known.groupBy("asset_id", "date", "failure_mode").agg(
        F.max_by(F.struct("notes", "confidence", "document_id"), F.struct("received_at", "document_id", "position")).alias("v")
    ).select("asset_id", "date", "failure_mode", "v.*")


def log_counts(parsed: DataFrame) -> DataFrame:
    """Per log: entries offered to the graph, whether or not their asset is known."""
    return log_rows(parsed).groupBy("document_id").agg(
        F.count_if(~F.coalesce(_low(), F.lit(False)) & ~F.col("document_low_confidence")).alias("maintenance_events")
    )


# ---- compliance graph -------------------------------------------------------
def merge_compliance_graph(rules: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rules and ``checks(rule_code, document_id, status, findings, procedure_text)``.

    Rule nodes carry the rule's fields and check nodes the status and findings of the last check written
    under their key; ``rules`` and ``checks`` order themselves by ``id``.
    """
    empty = {n: F.lit(None).cast("string") for n in ("title", "full_text", "category", "regulation_body", "status", "findings", "document_id")}
    empty |= {"is_active": F.lit(None).cast("boolean"), "written": F.lit(None).cast("string")}

    def node(label, key, **given):
        return F.struct(F.lit(label).alias("label"), key.alias("id"), *[c.alias(n) for n, c in (empty | given).items()])

    edge = lambda src, rel, dst: F.struct(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    code, body, category = F.col("rule_code"), F.col("regulation_body"), F.col("category")
    fields = {n: F.col(n) for n in ("title", "full_text", "category", "regulation_body", "is_active")}
    rule_nodes = rules.select(F.explode(F.array(
        node("ComplianceRule", code, **fields, written=F.lit("1")), node("RegulationBody", body), node("ComplianceCategory", category))).alias("n"))
    rule_edges = rules.select(F.explode(F.array(
        edge(body, "ISSUES", code), edge(code, "APPLIES_TO_CATEGORY", category))).alias("e"))
    named = F.coalesce(F.nullif("document_id", F.lit("")), F.lit("ad_hoc"))
    made = checks.select(
        "rule_code", F.coalesce("document_id", F.lit("")).alias("document_id"), "status", "findings", F.col("id").alias("written"),
        F.concat_ws(":", "rule_code", named, "status").alias("check_id"), wide_tags(F.col("procedure_text")).alias("tags"),
    )
    check, doc = F.col("check_id"), F.col("document_id")
    result = {n: F.col(n) for n in ("status", "findings", "document_id", "written")}
    written = F.concat(
        F.array(node("ComplianceCheck", check, **result), node("ComplianceRule", code)),
        F.when(doc != "", F.array(node("Document", doc))).otherwise(F.array()),
        F.transform("tags", lambda t: node("Equipment", t)),
    )
    linked = F.concat(
        F.array(edge(check, "EVALUATES", code)),
        F.when(doc != "", F.array(edge(doc, "HAS_COMPLIANCE_CHECK", check))).otherwise(
            F.array().cast("array<struct<src:string,rel:string,dst:string>>")),
        F.transform("tags", lambda t: edge(t, "SUBJECT_TO", code)),
        F.transform("tags", lambda t: edge(t, "HAS_COMPLIANCE_CHECK", check)),
    )
    nodes = rule_nodes.unionByName(made.select(F.explode(written).alias("n"))).select("n.*")
    kept = [n for n in empty if n != "written"]
    # nodes that only name an end carry no ``written`` and never win over the fields of a rule or check
    nodes = nodes.groupBy("label", "id").agg(
        F.max_by(F.struct(*kept), F.coalesce("written", F.lit(""))).alias("v")
    ).select("label", "id", "v.*")
    edges = rule_edges.unionByName(made.select(F.explode(linked).alias("e"))).select("e.*").distinct()
    return nodes, edges


# ---- review queue -----------------------------------------------------------
def _held(rows: DataFrame, entity_type: str, key: str, fields: dict[str, Column]) -> DataFrame:
    payload = F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"})
    held = rows.where(F.coalesce(_low(), F.lit(False)) | F.col("document_low_confidence"))
    return held.select(
        F.concat_ws(":", "document_id", F.lit(entity_type), F.col(key)).alias("id"),
        F.lit(entity_type).alias("entity_type"), F.col("document_id").alias("source_document_id"), payload.alias("payload_json"),
        F.when(F.col("document_low_confidence"), "document_low_confidence").otherwise("low_confidence_extraction").alias("reason"),
        F.coalesce("confidence", F.lit("low")).alias("confidence"), F.col("received_at").alias("created_at"),
    )


def _flags(parsed: DataFrame) -> DataFrame:
    flagged = unnest(parsed, ["document_id", "document_low_confidence", "received_at"], F.col("data.confidence_flags"), "flag")
    rows = flagged.withColumn("confidence", F.lit("low")).withColumn("digest", F.sha2(F.col("flag").cast("binary"), 256))
    return _held(rows, "confidence_flag", "digest", {"flag": F.col("flag"), "source_document_id": F.col("document_id")})


def pending_from_pid(parsed: DataFrame) -> DataFrame:
    """Review rows of drawings: low items, or every item of a low document, and each flag."""
    equipment, valves, instruments = pid_rows(parsed)
    own = lambda *names: {n: F.col(n) for n in names} | {"source_document_id": F.col("document_id")}
    return reduce(
        DataFrame.unionByName,
        [
            _held(equipment, "equipment", "id", own("id", "type", "confidence", "zone")),
            _held(valves, "valve", "valve_id", own("valve_id", "valve_type", "connects_from", "connects_to", "confidence", "zone")),
            _held(instruments, "instrument", "tag", own("tag", "attached_to_line_between", "confidence", "zone")),
            _flags(parsed),
        ],
    )


def pending_from_log(parsed: DataFrame) -> DataFrame:
    fields = {
        "Asset_ID": F.col("asset_id"), "Date": F.col("date"), "Failure_Mode": F.col("failure_mode"),
        "Technician_Notes": F.col("notes"), "confidence": F.col("confidence"), "source_document_id": F.col("document_id"),
    }
    return _held(log_rows(parsed), "maintenance_event", "asset_id", fields).unionByName(_flags(parsed))


def upsert_pending(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Queue after the batch: a row written again is pending anew but keeps its first time."""
    latest = rows.groupBy("id").agg(
        F.max_by(F.struct("entity_type", "source_document_id", "payload_json", "reason", "confidence"),
                 F.struct("created_at", "payload_json")).alias("v"),
        F.min("created_at").alias("_created"),
    ).select("id", "v.*", "_created", F.lit("pending").alias("status"))
    old = existing.select("id", F.col("created_at").alias("_old"))
    fresh = latest.join(old, "id", "left").withColumn("created_at", F.coalesce("_old", "_created")).drop("_old", "_created")
    return existing.join(latest.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def list_pending(pending: DataFrame, most: int | None = 100) -> DataFrame:
    """The newest pending rows (None: all) with their payload parsed; a broken payload reads as empty."""
    parsed = F.coalesce(F.from_json("payload_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    waiting = pending.where(F.coalesce("status", F.lit("pending")) == "pending")
    listed = waiting if most is None else waiting.orderBy(F.desc("created_at"), "id").limit(most)
    return listed.withColumn("payload", parsed)


PROMOTABLE = ("equipment", "valve", "instrument", "maintenance_event")


def promote_reviews(pending: DataFrame, actions: DataFrame) -> DataFrame:
    """Pending rows promoted by ``actions(review_id, corrected_fields)``, payload with the corrections applied.

    ``status`` is ``promoted``, or ``unsupported`` where the entity type has no place in the graph.
    """
    corrections = actions.select(F.col("review_id").alias("id"), "corrected_fields")
    chosen = pending.where(F.coalesce("status", F.lit("pending")) == "pending").join(corrections, "id")
    stored = F.coalesce(F.from_json("payload_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(stored, F.coalesce("corrected_fields", F.create_map().cast("map<string,string>")))
    return chosen.select(
        "id", "entity_type", "source_document_id", merged.alias("payload"),
        F.when(F.col("entity_type").isin(*PROMOTABLE), "promoted").otherwise("unsupported").alias("status"),
    )


def promoted_graph(promoted: DataFrame, equipment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) written by promoted rows; ``equipment(id)`` are the equipment nodes before."""
    p = lambda name: F.try_element_at("payload", F.lit(name))
    rows = promoted.where("status = 'promoted'")
    kind = F.col("entity_type")
    event_id = F.concat_ws("|", p("Asset_ID"), p("Date"), p("Failure_Mode"))
    node_id = (
        F.when(kind == "equipment", tidy(F.coalesce(F.nullif(p("id"), F.lit("")), p("tag"))))
        .when(kind == "valve", p("valve_id")).when(kind == "instrument", p("tag")).otherwise(event_id)
    )
    label = (
        F.when(kind == "equipment", "Equipment").when(kind == "valve", "Valve").when(kind == "instrument", "Instrument")
        .otherwise("MaintenanceEvent")
    )
    type_ = F.when(kind == "equipment", F.coalesce(p("equipment_type"), p("type"))).when(kind == "valve", p("valve_type"))
    reviewed = F.when(kind != "equipment", F.coalesce(p("confidence"), F.lit("reviewed")))
    nodes = rows.select(
        node_id.alias("id"), label.alias("label"), type_.alias("type"), reviewed.alias("confidence"),
        F.when(kind.isin("valve", "instrument"), p("zone")).alias("zone"), p("source_document_id").alias("source_document_id"),
        (kind != "equipment").alias("reviewed"), F.when(kind == "maintenance_event", p("Technician_Notes")).alias("notes"),
    )
    events = rows.where(kind == "maintenance_event")
    assets = events.select(p("Asset_ID").alias("id"), F.lit("Equipment").alias("label")).distinct().join(
        equipment.select("id"), "id", "left_anti"
    )
    all_nodes = nodes.unionByName(assets, allowMissingColumns=True)
    known = equipment.select("id").unionByName(all_nodes.where("label = 'Equipment'").select("id")).distinct()
    valves = rows.where(kind == "valve").select(
        p("valve_id").alias("valve_id"), p("connects_from").alias("frm"), p("connects_to").alias("to")
    )
    tied = valves.join(known.withColumnRenamed("id", "frm"), "frm", "left_semi").join(
        known.withColumnRenamed("id", "to"), "to", "left_semi"
    )
    edge = lambda src, rel, dst, valve=F.lit(None).cast("string"): F.struct(
        src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), valve.alias("valve_id")
    )
    frm, to, valve = F.col("frm"), F.col("to"), F.col("valve_id")
    edges = tied.select(
        F.explode(F.array(edge(frm, "CONNECTED_THROUGH", to, valve), edge(frm, "CONNECTED_TO", valve), edge(valve, "CONNECTED_TO", to))).alias("e")
    ).unionByName(events.select(edge(p("Asset_ID"), "HAD_EVENT", event_id).alias("e")))
    return all_nodes, edges.select("e.*").distinct()


def archive_reviews(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue with ``decisions(review_id, status, fields)`` stored on the rows decided."""
    decided = decisions.select(
        F.col("review_id").alias("id"), F.col("status").alias("_status"), F.to_json("fields").alias("archive_fields_json")
    )
    return pending.join(decided, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def reject_reviews(pending: DataFrame, rejections: DataFrame) -> DataFrame:
    """Queue with ``rejections(review_id, reason)`` archived."""
    fields = F.create_map(F.lit("reject_reason"), F.coalesce("reason", F.lit("")))
    return archive_reviews(pending, rejections.select("review_id", F.lit("rejected").alias("status"), fields.alias("fields")))
