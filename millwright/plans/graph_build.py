"""Named graph-building queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions.common import join_lines
from millwright.operators import graph_build as gb
from millwright.plans.registry import query
from millwright.plans.text import WIDE, duck_tags
from millwright.plans.views import CHECK_FRAGMENTS
from millwright.session import cut_lineage
from millwright.sources import payloads as pl

_LOG = '[{"Asset_ID":"VARCHAR","Failure_Mode":"VARCHAR","Date":"VARCHAR","Technician_Notes":"VARCHAR","confidence":"VARCHAR"}]'
_EQ = '[{"id":"VARCHAR","type":"VARCHAR","confidence":"VARCHAR"}]'
_VALVE = '[{"valve_id":"VARCHAR","valve_type":"VARCHAR","connects_from":"VARCHAR","connects_to":"VARCHAR","confidence":"VARCHAR"}]'
_INST = '[{"tag":"VARCHAR","attached_to_line_between":["VARCHAR"],"confidence":"VARCHAR"}]'

CHECK_FRAGMENTS.update(
    x_log_items=f"""
        select *, unnest(from_json(json_extract(payload, '$.entries'), '{_LOG}')) as x,
               unnest(range(0, json_array_length(payload, '$.entries')::bigint)) as position from v_log_payloads""",
    x_pid_ok="""select document_id, document_low_confidence as low_doc, received_at, payload,
                       json_extract_string(payload, '$.zone') as zone from v_pid_payloads where json_valid(payload)""",
    x_pid_equipment=f"""
        select * exclude (x), upper(trim(x.id)) as id, x.type as type, x.confidence as confidence
        from (select * exclude (payload), unnest(from_json(json_extract(payload, '$.equipment'), '{_EQ}')) as x from x_pid_ok) where coalesce(x.id, '') <> ''""",
    x_pid_valves=f"""
        select * exclude (x), upper(trim(x.valve_id)) as id, x.valve_type as type, upper(trim(x.connects_from)) as frm, upper(trim(x.connects_to)) as target, x.confidence as confidence
        from (select * exclude (payload), unnest(from_json(json_extract(payload, '$.valves'), '{_VALVE}')) as x from x_pid_ok)
        where coalesce(x.valve_id, '') <> '' and coalesce(x.connects_from, '') <> '' and coalesce(x.connects_to, '') <> ''""",
    x_pid_instruments=f"""
        select * exclude (x), upper(trim(x.tag)) as id, list_transform(x.attached_to_line_between, lambda a: upper(trim(a))) as anchors, x.confidence as confidence
        from (select * exclude (payload), unnest(from_json(json_extract(payload, '$.instruments'), '{_INST}')) as x from x_pid_ok) where coalesce(x.tag, '') <> ''""",
    x_pid_written="""
        select 'Equipment' as label, id, type, confidence, zone, document_id, received_at from x_pid_equipment where confidence <> 'low' and not low_doc
        union all select 'Valve', id, type, confidence, zone, document_id, received_at from x_pid_valves where confidence <> 'low' and not low_doc
        union all select 'Instrument', id, null, confidence, zone, document_id, received_at from x_pid_instruments where confidence <> 'low' and not low_doc""",
    x_pid_anchored="select * from x_pid_instruments where confidence <> 'low' and not low_doc and len(anchors) = 2",
    x_pid_nodes="""
        select label, id, (arg_max({'t': type, 'c': confidence, 'z': zone, 'd': document_id}, (received_at, document_id))) as v from x_pid_written group by 1, 2""",
    x_pid_known="select id from v_known_equipment union select id from x_pid_nodes where label = 'Equipment'",
    x_log_rows="""
        select document_id, document_low_confidence as low_doc, received_at, position, upper(trim(x.Asset_ID)) as asset_id, x."Date" as date,
               x.Failure_Mode as failure_mode, x.Technician_Notes as notes, x.confidence as confidence
        from x_log_items where coalesce(x.Asset_ID, '') <> ''""",
    x_node_changes="""
        select upper(trim(tag)) as id, arg_max(name, seq) filter (name is not null) as last_name, arg_max(type, seq) filter (type is not null) as last_type,
               arg_min(source_document_id, seq) filter (source_document_id is not null) as first_source,
               arg_max(source_document_id, seq) filter (source_document_id is not null) as last_source from v_node_updates group by 1""",
    x_all_edge_updates="""
        select upper(trim(src)) as src, rel, upper(trim(dst)) as dst, source, confidence, seq from v_edge_updates
        union all select src, rel, dst, 'resync', null, -1 from v_edges where rel = 'part_of'""",
)


@query(
    "merge_nodes",
    """select coalesce(n.id, c.id) as id, coalesce(c.last_name, n.name) as name, coalesce(c.last_type, n.type) as type,
              c.last_source as source_document_id from v_nodes n full outer join x_node_changes c on c.id = n.id""",
)
def _(t):
    nodes = t.nodes.withColumn("source_document_id", F.lit(None).cast("string"))
    return gb.merge_nodes(nodes, t.node_updates, ["name", "type", "source_document_id"])


@query(
    "merge_text_equipment",
    """select coalesce(n.id, c.id) as id, coalesce(n.confidence, c.first_source) as source_document_id
       from v_nodes n full outer join x_node_changes c on c.id = n.id""",
)
def _(t):
    nodes = t.nodes.select("id", F.col("confidence").alias("source_document_id"))
    return gb.merge_nodes(nodes, t.node_updates, ["source_document_id"], newest_wins=False)


def edge_updates(t):
    resync = t.edges.where("rel = 'part_of'").select(
        "src", "rel", "dst", F.lit("resync").alias("source"), F.lit(None).cast("string").alias("confidence"), F.lit(-1).cast("long").alias("seq")
    )
    return t.edge_updates.unionByName(resync)


_REL = "case when rel in ('feeds_into', 'controls', 'bypasses', 'connected_to', 'part_of') then upper(rel) else 'CONNECTED_TO' end"


@query(
    "merge_edges",
    f"""with x_changes as (select src, {_REL} as rel, dst, arg_max(source, seq) as source, arg_max(confidence, seq) filter (confidence is not null) as confidence
                           from x_all_edge_updates group by 1, 2, 3)
        select coalesce(e.src, c.src) as src, coalesce(e.rel, c.rel) as rel, coalesce(e.dst, c.dst) as dst, coalesce(c.source, 'load') as source, c.confidence
        from (select src, upper(rel) as rel, dst from v_edges) e full outer join x_changes c on c.src = e.src and c.rel = e.rel and c.dst = e.dst""",
)
def _(t):
    edges = t.edges.select(
        "src", F.upper("rel").alias("rel"), "dst", F.lit("load").alias("source"), F.lit(None).cast("string").alias("confidence")
    )
    return gb.merge_edges(edges, edge_updates(t))


@query(
    "edge_endpoint_nodes",
    """select distinct id, 'Equipment' as label from (select src as id from x_all_edge_updates union select dst from x_all_edge_updates)
       where id not in (select id from v_nodes)""",
)
def _(t):
    return gb.endpoint_nodes(t.nodes, edge_updates(t))


@query(
    "merge_edges_digraph",
    """with x_ids as materialized (select id from v_nodes), x_old as materialized (select src, dst, rel from v_edges),
            x_sent as materialized (select * from x_all_edge_updates),
            x_changes as materialized (
              select src, dst, arg_max(rel, seq) as rel, arg_max(source, seq) as source from x_sent
              where src in (select id from x_ids) and dst in (select id from x_ids)
                and rel in ('feeds_into', 'controls', 'bypasses', 'connected_to', 'part_of') group by 1, 2)
       select coalesce(e.src, c.src) as src, coalesce(e.dst, c.dst) as dst, coalesce(c.rel, e.rel) as rel, coalesce(c.source, 'load') as source
       from x_old e full outer join x_changes c on c.src = e.src and c.dst = e.dst""",
)
def _(t):
    return gb.merge_digraph_edges(t.nodes, t.edges.withColumn("source", F.lit("load")), edge_updates(t))


def pid(t):
    return pl.scan_payloads(t.pid_payloads, pl.PID_SCHEMA)[0]


def log(t):
    return pl.scan_payloads(t.log_payloads, pl.LOG_SCHEMA)[0]


@query(
    "pid_rows",
    """select 'equipment' as kind, document_id, id, type, confidence, zone, '' as ends from x_pid_equipment
       union all select 'valve', document_id, id, type, confidence, zone, frm || '>' || target from x_pid_valves
       union all select 'instrument', document_id, id, null, confidence, zone, array_to_string(anchors, '|') from x_pid_instruments""",
)
def _(t):
    equipment, valves, instruments = gb.pid_rows(pid(t))
    return (
        equipment.select(F.lit("equipment").alias("kind"), "document_id", "id", "type", "confidence", "zone", F.lit("").alias("ends"))
        .unionByName(valves.select(F.lit("valve").alias("kind"), "document_id", F.col("valve_id").alias("id"), F.col("valve_type").alias("type"),
                                   "confidence", "zone", F.concat_ws(">", "connects_from", "connects_to").alias("ends")))
        .unionByName(instruments.select(F.lit("instrument").alias("kind"), "document_id", F.col("tag").alias("id"),
                                        F.lit(None).cast("string").alias("type"), "confidence", "zone",
                                        join_lines(F.col("attached_to_line_between")).alias("ends")))
    )


@query(
    "merge_pid_nodes",
    """select label, id, v.t as type, v.c as confidence, v.z as zone, v.d as document_id from x_pid_nodes
       union all select 'Zone', zone, null, null, null, arg_max(document_id, (received_at, document_id)) from x_pid_ok where coalesce(zone, '') <> '' group by zone
       union all select distinct 'Equipment', a, null, null, null, null from (select unnest(anchors) as a from x_pid_anchored) where a not in (select id from x_pid_known)""",
)
def _(t):
    return gb.merge_pid(pid(t), t.known_equipment)[0]


@query(
    "merge_pid_edges",
    """with x_tied as (select * from x_pid_valves where confidence <> 'low' and not low_doc and frm in (select id from x_pid_known) and target in (select id from x_pid_known))
       select frm as src, 'CONNECTED_THROUGH' as rel, target as dst, id as valve_id,
              arg_max(confidence, (received_at, document_id)) as confidence, arg_max(document_id, (received_at, document_id)) as document_id
         from x_tied group by all
       union all select distinct *, null, null, null from (
         select frm, 'CONNECTED_TO', id from x_tied union all select id, 'CONNECTED_TO', target from x_tied
         union all select id, 'HAS_INSTRUMENT', unnest(anchors) from x_pid_anchored
         union all select zone, 'CONTAINS', id from x_pid_written where zone is not null)""",
)
def _(t):
    return gb.merge_pid(pid(t), t.known_equipment)[1]


_ITEMS = """(select document_id, low_doc, confidence, 'equipment' as kind from x_pid_equipment union all select document_id, low_doc, confidence, 'valves' from x_pid_valves
             union all select document_id, low_doc, confidence, 'instruments' from x_pid_instruments)"""


@query(
    "merge_pid_counts",
    f"""select p.document_id, {", ".join(f"count(*) filter (i.kind = '{k}' and i.confidence <> 'low' and not i.low_doc) as {k}" for k in ("equipment", "valves", "instruments"))},
               (select count(*) from (select unnest(json_extract_string(any_value(p.payload), ['$.equipment[0].confidence', '$.equipment[1].confidence',
                  '$.valves[0].confidence', '$.instruments[0].confidence'])) as u) where u = 'low')::int + json_array_length(any_value(p.payload), '$.confidence_flags')::int as low_confidence,
               count(*) filter (i.confidence = 'low' or i.low_doc) + json_array_length(any_value(p.payload), '$.confidence_flags')::bigint as pending_review
        from x_pid_ok p left join {_ITEMS} i on i.document_id = p.document_id group by p.document_id""",
)
def _(t):
    return gb.pid_counts(pid(t))


_DIGRAPH = """with x_present as (select id from v_known_equipment union select id from x_pid_equipment),
     x_raw_valves as (select * exclude (x), upper(trim(coalesce(x.valve_id, ''))) as id, x.confidence as confidence, upper(trim(coalesce(x.connects_from, ''))) as src, upper(trim(coalesce(x.connects_to, ''))) as dst
         from (select * exclude (payload), unnest(from_json(json_extract(payload, '$.valves'), '""" + _VALVE + """')) as x from x_pid_ok)),
     x_tied as (select * from x_raw_valves where src in (select id from x_present) and dst in (select id from x_present))"""


@query(
    "merge_pid_digraph_nodes",
    _DIGRAPH + """ select id, 'Equipment' as label, v.t as type, v.c as confidence, v.z as zone, v.d as document_id from (
         select id, arg_max({'t': type, 'c': confidence, 'z': zone, 'd': document_id}, (received_at, document_id)) as v from (
           select id, type, confidence, zone, document_id, received_at from x_pid_equipment
           union all select id, 'valve', confidence, zone, document_id, received_at from x_tied where id <> '') group by 1)""",
)
def _(t):
    return gb.merge_pid_digraph(pid(t), t.known_equipment)[0]


@query(
    "merge_pid_digraph_edges",
    _DIGRAPH + """ select src, 'connected_to' as rel, dst, v.i as valve_id, v.c as confidence, v.d as document_id from (
         select src, dst, arg_max({'i': id, 'c': confidence, 'd': document_id}, (received_at, document_id)) as v from (
           select src, dst, id, confidence, document_id, received_at from x_tied
           union all select src, id, id, confidence, document_id, received_at from x_tied where id <> ''
           union all select id, dst, id, confidence, document_id, received_at from x_tied where id <> '') group by 1, 2)""",
)
def _(t):
    return gb.merge_pid_digraph(pid(t), t.known_equipment)[1]


@query(
    "merge_log",
    """select asset_id, date, failure_mode, v.n as notes, v.c as confidence, v.d as document_id from (
         select asset_id, date, failure_mode, arg_max({'n': notes, 'c': confidence, 'd': document_id}, (received_at, document_id, position)) as v
         from x_log_rows where confidence <> 'low' and not low_doc and asset_id in (select tag from v_equipment) group by 1, 2, 3)""",
)
def _(t):
    return gb.merge_log(log(t), t.equipment.select(F.col("tag").alias("id")))


@query(
    "merge_log_counts",
    "select document_id, count(*) filter (confidence <> 'low' and not low_doc) as maintenance_events from x_log_rows group by 1",
)
def _(t):
    return gb.log_counts(log(t))


CHECK_FRAGMENTS.update(
    x_rule_checks="""
        select c.id, c.findings, r.rule_code, case when c.status = 'PARTIAL' then null else c.document_id end as document_id, c.status,
               c.findings || ' on P-' || right('00' || c.id, 3) || ' and tk-' || right(c.id, 2) as procedure_text
        from v_checks c join v_rules r on r.id = c.rule_id""",
    x_made_checks=f"""
        select *, rule_code || ':' || coalesce(document_id, 'ad_hoc') || ':' || status as check_id, {duck_tags('procedure_text', WIDE)} as tags from x_rule_checks""",
)


def rule_checks(t):
    named = t.checks.join(t.rules.select(F.col("id").alias("rule_id"), "rule_code"), "rule_id")
    return named.select(
        "id", "findings", "rule_code", F.when(F.col("status") == "PARTIAL", None).otherwise(F.col("document_id")).alias("document_id"), "status",
        F.concat("findings", F.lit(" on P-"), F.right(F.concat(F.lit("00"), "id"), F.lit(3)), F.lit(" and tk-"), F.right("id", F.lit(2))).alias("procedure_text"),
    )


@query(
    "merge_compliance_nodes",
    """select 'ComplianceRule' as label, rule_code as id, title, full_text, category, regulation_body, is_active, null as status, null as findings, null as document_id from v_rules
       union all by name select 'ComplianceCheck' as label, check_id as id, arg_max(status, id) as status, arg_max(findings, id) as findings,
              coalesce(arg_max(coalesce(document_id, ''), id), '') as document_id from x_made_checks group by check_id
       union all by name select distinct label, id from (
         select 'RegulationBody' as label, regulation_body as id from v_rules union all select 'ComplianceCategory', category from v_rules
         union all select 'Document', document_id from x_made_checks where document_id is not null
         union all select 'Equipment', unnest(tags) from x_made_checks)""",
)
def _(t):
    return gb.merge_compliance_graph(t.rules, rule_checks(t))[0]


@query(
    "merge_compliance_edges",
    """select distinct * from (
         select regulation_body as src, 'ISSUES' as rel, rule_code as dst from v_rules union all select rule_code, 'APPLIES_TO_CATEGORY', category from v_rules
         union all select check_id, 'EVALUATES', rule_code from x_made_checks
         union all select document_id, 'HAS_COMPLIANCE_CHECK', check_id from x_made_checks where document_id is not null
         union all select unnest(tags), 'SUBJECT_TO', rule_code from x_made_checks union all select unnest(tags), 'HAS_COMPLIANCE_CHECK', check_id from x_made_checks)""",
)
def _(t):
    return gb.merge_compliance_graph(t.rules, rule_checks(t))[1]


def _q(v: str) -> str:
    return f"case when {v} is null then 'null' else '\"' || {v} || '\"' end"


def _json(**fields: str) -> str:
    body = " || ',' || ".join(f"'\"{n}\":' || {fields[n]}" for n in sorted(fields))
    return f"'{{' || {body} || '}}'"


_HELD = "where confidence = 'low' or low_doc"
_ROW = "document_id as source_document_id, case when low_doc then 'document_low_confidence' else 'low_confidence_extraction' end as reason, confidence, received_at as created_at"
_FLAG_COLS = "document_id, low_doc, received_at, 'low' as confidence"
CHECK_FRAGMENTS.update(
    x_pid_flags=f"select {_FLAG_COLS}, unnest(from_json(json_extract(payload, '$.confidence_flags'), '[\"VARCHAR\"]')) as flag from x_pid_ok",
    x_log_flags="""select document_id, document_low_confidence as low_doc, received_at, 'low' as confidence,
                   unnest(from_json(json_extract(payload, '$.confidence_flags'), '["VARCHAR"]')) as flag from v_log_payloads""",
    x_pending_raw=f"""
        select document_id || ':equipment:' || id as id, 'equipment' as entity_type, {_ROW},
               {_json(confidence=_q('confidence'), id=_q('id'), type=_q('type'), zone=_q('zone'), source_document_id=_q('document_id'))} as payload_json from x_pid_equipment {_HELD}
        union all select document_id || ':valve:' || id, 'valve', {_ROW},
               {_json(confidence=_q('confidence'), valve_id=_q('id'), valve_type=_q('type'), connects_from=_q('frm'), connects_to=_q('target'), zone=_q('zone'), source_document_id=_q('document_id'))} from x_pid_valves {_HELD}
        union all select document_id || ':instrument:' || id, 'instrument', {_ROW},
               {_json(confidence=_q('confidence'), tag=_q('id'), zone=_q('zone'), source_document_id=_q('document_id'),
                      attached_to_line_between="'[' || array_to_string(list_transform(anchors, lambda a: chr(34) || a || chr(34)), ',') || ']'")} from x_pid_instruments {_HELD}
        union all select document_id || ':maintenance_event:' || asset_id, 'maintenance_event', {_ROW},
               {_json(Asset_ID=_q('asset_id'), Date=_q('date'), Failure_Mode=_q('failure_mode'), Technician_Notes=_q('notes'), confidence=_q('confidence'), source_document_id=_q('document_id'))} from x_log_rows {_HELD}
        union all select document_id || ':confidence_flag:' || sha256(flag), 'confidence_flag', {_ROW}, {_json(flag=_q('flag'), source_document_id=_q('document_id'))}
               from (select * from x_pid_flags union all select * from x_log_flags)""",
    x_pending="""
        select id, v.e as entity_type, v.s as source_document_id, v.p as payload_json, v.r as reason, v.c as confidence,
               case when left(id, 4) = 'PID-' and v.e = 'valve' then timestamp '2024-01-01' else created_at end as created_at, 'pending' as status
        from (select id, min(created_at) as created_at, arg_max({'e': entity_type, 's': source_document_id, 'p': payload_json, 'r': reason, 'c': confidence}, (created_at, payload_json)) as v
              from x_pending_raw group by 1)""",
)


def pending(t):
    """Review queue after the batch, over an older queue that holds every valve already."""
    drawings = gb.pending_from_pid(pid(t))
    old = drawings.where("entity_type = 'valve'").select(
        "id", "entity_type", "source_document_id", F.lit("{}").alias("payload_json"), "reason", "confidence",
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"), F.lit("rejected").alias("status"),
    ).dropDuplicates(["id"])
    return gb.upsert_pending(old, drawings.unionByName(gb.pending_from_log(log(t))))


PENDING = ["id", "entity_type", "source_document_id", "payload_json", "reason", "confidence", "created_at", "status"]


@query("pending_reviews", f"select {', '.join(PENDING)} from x_pending")
def _(t):
    return pending(t).select(*PENDING)


@query(
    "list_pending",
    """select id, entity_type, reason, confidence, created_at, json_extract_string(payload_json, '$.source_document_id') as payload_source
       from x_pending order by created_at desc, id limit 100""",
)
def _(t):
    return gb.list_pending(pending(t)).select(
        "id", "entity_type", "reason", "confidence", "created_at", F.try_element_at("payload", F.lit("source_document_id")).alias("payload_source")
    )


def promoted(t):
    """Everything low in an extraction promoted, with corrections by entity type.

    The queue is a stored table in a running plant; here it is stored once so
    that the decisions and the graph read it instead of deriving it again.
    """
    queue = cut_lineage(pending(t).select(*PENDING))
    actions = queue.where("reason = 'low_confidence_extraction'").select(
        F.col("id").alias("review_id"),
        F.when(F.col("entity_type") == "valve", F.create_map(F.lit("valve_type"), F.lit("globe")))
        .when(F.col("entity_type") == "instrument", F.create_map(F.lit("confidence"), F.lit("high"), F.lit("zone"), F.lit("Z-0")))
        .alias("corrected_fields"),
    )
    return gb.promote_reviews(queue, actions)


CHECK_FRAGMENTS.update(
    x_promoted="""
        select *, case when entity_type = 'confidence_flag' then 'unsupported' else 'promoted' end as outcome,
               json_extract_string(payload_json, '$.valve_id') as valve_id, json_extract_string(payload_json, '$.connects_from') as frm,
               json_extract_string(payload_json, '$.connects_to') as target, json_extract_string(payload_json, '$.Asset_ID') as asset_id,
               array_to_string(list_filter([json_extract_string(payload_json, '$.Asset_ID'), json_extract_string(payload_json, '$.Date'), json_extract_string(payload_json, '$.Failure_Mode')], lambda x: x is not null), '|') as event_id
        from x_pending where reason = 'low_confidence_extraction'""",
    x_promoted_nodes="""
        select case entity_type when 'equipment' then upper(trim(json_extract_string(payload_json, '$.id'))) when 'valve' then valve_id
                    when 'instrument' then json_extract_string(payload_json, '$.tag') else event_id end as id,
               case entity_type when 'equipment' then 'Equipment' when 'valve' then 'Valve' when 'instrument' then 'Instrument' else 'MaintenanceEvent' end as label,
               case entity_type when 'equipment' then json_extract_string(payload_json, '$.type') when 'valve' then 'globe' end as type,
               case entity_type when 'equipment' then null when 'instrument' then 'high' else coalesce(json_extract_string(payload_json, '$.confidence'), 'reviewed') end as confidence,
               case entity_type when 'instrument' then 'Z-0' when 'valve' then json_extract_string(payload_json, '$.zone') end as zone,
               json_extract_string(payload_json, '$.source_document_id') as source_document_id, entity_type <> 'equipment' as reviewed,
               case when entity_type = 'maintenance_event' then json_extract_string(payload_json, '$.Technician_Notes') end as notes
        from x_promoted where outcome = 'promoted'
        union all select distinct asset_id, 'Equipment', null, null, null, null, cast(null as boolean), null from x_promoted
         where entity_type = 'maintenance_event' and asset_id not in (select tag from v_equipment)""",
    x_promoted_known="select tag as id from v_equipment union select id from x_promoted_nodes where label = 'Equipment'",
)


@query("promote_reviews", "select id, entity_type, source_document_id, outcome as status from x_promoted")
def _(t):
    return promoted(t).select("id", "entity_type", "source_document_id", "status")


@query("promoted_nodes", "select * from x_promoted_nodes")
def _(t):
    return gb.promoted_graph(promoted(t), t.equipment.select(F.col("tag").alias("id")))[0]


@query(
    "promoted_edges",
    """with x_tied as (select * from x_promoted where entity_type = 'valve' and frm in (select id from x_promoted_known) and target in (select id from x_promoted_known))
       select distinct * from (
         select frm as src, 'CONNECTED_THROUGH' as rel, target as dst, valve_id from x_tied union all select frm, 'CONNECTED_TO', valve_id, null from x_tied
         union all select valve_id, 'CONNECTED_TO', target, null from x_tied
         union all select asset_id, 'HAD_EVENT', event_id, null from x_promoted where entity_type = 'maintenance_event')""",
)
def _(t):
    return gb.promoted_graph(promoted(t), t.equipment.select(F.col("tag").alias("id")))[1]


@query(
    "reject_reviews",
    """select id, case when reason = 'document_low_confidence' then 'rejected' else status end as status,
              case when reason = 'document_low_confidence' then '{"reject_reason":"from ' || source_document_id || '"}' end as archive_fields_json from x_pending""",
)
def _(t):
    queue = pending(t)
    rejections = queue.where("reason = 'document_low_confidence'").select(
        F.col("id").alias("review_id"), F.concat(F.lit("from "), "source_document_id").alias("reason")
    )
    return gb.reject_reviews(queue, rejections).select("id", "status", "archive_fields_json")
