"""Named extraction queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions import text as tx
from millwright.functions.common import join_lines
from millwright.operators import extraction as ex
from millwright.plans.registry import query
from millwright.plans.text import STRICT, VOICE, contains_case, duck_sentences, duck_tags
from millwright.plans.views import CHECK_FRAGMENTS, duck_round
from millwright.sources import payloads as pl

CHECK_FRAGMENTS.update(
    x_spoken=f"select id, uploaded_at, unnest({duck_sentences('text')}) as s from v_documents",
    x_named_tags=f"select id, uploaded_at, unnest({duck_tags('text', STRICT)}) as tag from v_documents",
)


def documents(t):
    return t.spread.documents.select(F.col("id").alias("document_id"), "text", "uploaded_at")


@query(
    "store_new_equipment",
    """select tag, source_document_id from (
         select tag, id as source_document_id, row_number() over (partition by tag order by uploaded_at, id) as r from x_named_tags) where r = 1
          and tag not in (select tag from v_equipment)""",
)
def _(t):
    return ex.store_new_equipment(documents(t), t.equipment)


@query(
    "inspection_events_from_text",
    f"""select id as source_document_id, s as findings, unnest(regexp_extract_all(s, '{STRICT}', 1)) as equipment_tag, 'auto_extracted' as inspection_type,
               cast(null as varchar) as severity
        from x_spoken where {" or ".join(f"contains(lower(s), '{w}')" for w in tx.INSPECTION_WORDS)}""",
)
def _(t):
    return ex.inspection_events(documents(t))


@query(
    "log_events",
    """select upper(trim(x.Asset_ID)) as equipment_tag, case when regexp_full_match(x."Date", '\\d{4}-\\d{2}-\\d{2}') then try_strptime(x."Date", '%Y-%m-%d') end as inspection_date,
              coalesce(nullif(x.Technician_Notes, ''), x.Failure_Mode) as findings, case when x.confidence = 'low' then 'low' else 'routine' end as severity,
              document_id as source_document_id, 'maintenance_log_extracted' as inspection_type
       from x_log_items where coalesce(trim(x.Asset_ID), '') <> ''""",
)
def _(t):
    good, _ = pl.scan_payloads(t.log_payloads, pl.LOG_SCHEMA)
    return ex.log_events(good)


_PID_LIST = """list_concat(list_transform(from_json(json_extract(payload, '$.equipment'), '[{"id":"VARCHAR"}]'), lambda x: upper(trim(x.id))),
                            list_transform(from_json(json_extract(payload, '$.valves'), '[{"valve_id":"VARCHAR"}]'), lambda x: upper(trim(x.valve_id))))"""
_LOG_LIST = """list_transform(from_json(json_extract(payload, '$.entries'), '[{"Asset_ID":"VARCHAR"}]'), lambda x: upper(trim(x.Asset_ID)))"""


def _tag_union(source: str, found: str, where: str) -> str:
    return f"""select document_id, array_to_string(list_filter(l, lambda v, i: coalesce(v, '') <> '' and list_position(l, v) = i), '|') as tags
               from (select document_id, list_concat({duck_tags('payload', STRICT)}, {found}) as l from {source} {where})"""


@query(
    "structured_tags",
    _tag_union("v_pid_payloads", _PID_LIST, "where json_valid(payload)") + " union all " + _tag_union("v_log_payloads", _LOG_LIST, ""),
)
def _(t):
    def rows(payloads, schema, kind):
        good, _ = pl.scan_payloads(payloads, schema)
        text = payloads.select("document_id", "payload")
        both = good.join(text, "document_id")
        return both.select("document_id", join_lines(ex.structured_tags(F.col("payload"), F.col("data"), kind)).alias("tags"))

    return rows(t.pid_payloads, pl.PID_SCHEMA, "pid").unionByName(rows(t.log_payloads, pl.LOG_SCHEMA, "maintenance_log"))


@query(
    "sentence_cooccurrence_edges",
    f"""select src, dst, arg_max(id, (uploaded_at, id)) as source_document_id, 'connected_to' as rel from (
          select id, uploaded_at, g[i] as src, g[i + 1] as dst
          from (select id, uploaded_at, {duck_tags('s', STRICT)} as g from x_spoken), unnest(range(1, len(g))) as u(i)) group by 1, 2""",
)
def _(t):
    return ex.sentence_edges(documents(t))


_SEVERITY = contains_case("lower(text)", (("critical", tx.VOICE_CRITICAL), ("minor", tx.VOICE_MINOR)), "routine")


@query(
    "voice_inspections",
    f"""select {duck_tags('upper(text)', VOICE)}[1] as equipment_tag, timestamp '2025-01-01' as inspection_date, 'voice_note' as inspector_name,
               'voice_auto_extracted' as inspection_type, text as findings, {_SEVERITY} as severity, document_id as source_document_id
        from v_captures where {_SEVERITY} <> 'routine' and len({duck_tags('upper(text)', VOICE)}) > 0""",
)
def _(t):
    return ex.voice_inspections(t.captures, F.lit("2025-01-01").cast("timestamp_ntz"))


@query(
    "typed_capture",
    """select upper(trim(equipment_tag)) as equipment_tag, inspector_name, 'text_manual_capture' as inspection_type, text as findings, lower(severity) as severity
       from v_captures where trim(equipment_tag) <> ''
       union all
       select upper(trim(' ' || lower(equipment_tag))), inspector_name, inspection_type, findings, lower(severity) from v_inspections""",
)
def _(t):
    columns = ["equipment_tag", "inspector_name", "inspection_type", "findings", "severity"]
    by_hand = t.inspections.withColumn("equipment_tag", F.concat(F.lit(" "), F.lower("equipment_tag")))
    return ex.typed_captures(t.captures).select(columns).unionByName(ex.manual_inspections(by_hand).select(columns))


@query(
    "recent_captures",
    f"""select d.id as document_id, d.original_filename, d.status, d.uploaded_at, d.text[1:300] as transcription_preview,
               array_to_string({duck_tags('upper(text)', VOICE)}, '|') as equipment_tags, {_SEVERITY} as severity_hint,
               (select count(*) from v_inspections i where i.source_document_id = d.id) as inspections_created
        from (select * from v_documents where file_type = 'voice' order by uploaded_at desc, id limit 20) d""",
)
def _(t):
    return ex.recent_captures(t.documents, t.inspections).select(
        "document_id", "original_filename", "status", "uploaded_at", "transcription_preview",
        join_lines(F.col("knowledge.equipment_tags")).alias("equipment_tags"), "knowledge.severity_hint", "inspections_created",
    )


_PAGE = duck_round("avg(conf) filter (conf >= 0)")


@query(
    "ocr_confidence_gate",
    f"""with x_ocr_pages as (select document_id, page_number, avg(conf) filter (conf >= 0) as a from v_ocr_words group by 1, 2),
        x_ocr_rounded as (select document_id, page_number, {duck_round('a')} as c from x_ocr_pages),
        x_ocr_docs as (select document_id, sum(round(c * 100)::bigint)::double / (100 * count(c)) as a from x_ocr_rounded group by 1)
        select document_id, page_number::int as page_number, c as confidence, cast(null as boolean) as low_confidence from x_ocr_rounded
        union all select document_id, 0, {duck_round('a')}, coalesce({duck_round('a')} < 55.0, false) from x_ocr_docs""",
)
def _(t):
    pages, docs = ex.ocr_confidence(t.ocr_words)
    return pages.select(
        "document_id", F.col("page_number").cast("int").alias("page_number"), F.col("ocr_confidence").alias("confidence"),
        F.lit(None).cast("boolean").alias("low_confidence"),
    ).unionByName(
        docs.select("document_id", F.lit(0).alias("page_number"), F.col("ocr_average_confidence").alias("confidence"), "low_confidence")
    )
