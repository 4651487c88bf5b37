"""Named operational queries and their check SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millwright.operators import operations as op
from millwright.operators import reliability as rel
from millwright.plans.registry import query
from millwright.plans.reliability import as_of
from millwright.plans.views import AS_OF, CHECK_FRAGMENTS, duck_round
from millwright.sources import stores

CHECK_FRAGMENTS.update(
    x_latest_stage="""
        select * exclude (r) from (select *, row_number() over (partition by document_id, stage order by updated_at desc, message desc) as r
                                   from v_stage_events) where r = 1""",
)


@query(
    "document_stats",
    f"""select count(*) as total_documents, {", ".join(f"count(*) filter (status = '{s}') as {s}" for s in op.STATUSES)},
               coalesce(sum(total_chunks), 0)::bigint as total_chunks from v_documents""",
)
def _(t):
    return op.document_stats(t.documents)


TABLES = ("documents", "equipment", "inspections", "compliance_rules", "compliance_checks", "query_logs")


def six_tables(t, active_only: bool):
    return {
        "documents": t.documents, "equipment": t.equipment, "inspections": t.inspections,
        "compliance_rules": t.rules.where("is_active") if active_only else t.rules,
        "compliance_checks": t.checks, "query_logs": t.query_logs,
    }


_COUNTS = """
    select 'documents' as table_name, count(*) as rows from v_documents union all select 'equipment', count(*) from v_equipment
    union all select 'inspections', count(*) from v_inspections union all select 'compliance_rules', count(*) from v_rules {where}
    union all select 'compliance_checks', count(*) from v_checks union all select 'query_logs', count(*) from v_query_logs"""


@query(
    "admin_table_counts",
    _COUNTS.format(where="where is_active")
    + " union all select 'graph_nodes', count(*) from v_nodes union all select 'graph_edges', count(*) from v_edges",
)
def _(t):
    return stores.table_counts({**six_tables(t, True), "graph_nodes": t.nodes, "graph_edges": t.edges})


# The columns each exported table has, in order.
_EXPORTED = {
    "documents": ("v_documents", "id doc_key filename original_filename file_type file_size_bytes status total_chunks error_message "
                  "uploaded_at processed_at lang text"),
    "equipment": ("v_equipment", "id tag name equipment_type location description source_document_id created_at"),
    "inspections": ("v_inspections", "id equipment_tag inspection_date inspector_name inspection_type findings severity "
                    "source_document_id created_at"),
    "compliance_rules": ("v_rules", "id rule_code regulation_body title full_text category is_active created_at"),
    "compliance_checks": ("v_checks", "id rule_id document_id status findings checked_at"),
    "query_logs": ("v_query_logs", "id question language answer sources confidence response_time_ms channel session_id helpful "
                   "feedback_comment created_at"),
}


def _exported(column: str) -> str:
    if not column.endswith(("_at", "_date")):
        return column
    return (f"strftime({column}, '%Y-%m-%dT%H:%M:%S') || case when epoch_us({column}) % 1000000 = 0 then '' "
            f"else '.' || strftime({column}, '%f') end")


def _export_sql() -> str:
    """Per table the md5 of every exported line."""
    return " union all ".join(
        f"select '{name}' as table_name, md5(json_object({', '.join(f"'{c}', {_exported(c)}" for c in columns.split())})::varchar) as digest from {view}"
        for name, (view, columns) in _EXPORTED.items()
    )


@query("export_tables_json", _export_sql())
def _(t):
    parts = [
        stores.rows_as_json(df).select(F.lit(name).alias("table_name"), F.md5(F.col("value").cast("binary")).alias("digest"))
        for name, df in six_tables(t, False).items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "export_rows_json",
    """select '{"id":"' || id || '","rule_id":"' || rule_id || '","document_id":"' || document_id || '","status":"' || status
              || '","findings":"' || findings || '","checked_at":"' || strftime(checked_at, '%Y-%m-%dT%H:%M:%S') || '"}' as value from v_checks""",
)
def _(t):
    return stores.rows_as_json(t.checks)


@query(
    "query_stats",
    f"""select count(*) filter (created_at >= timestamp '{AS_OF}' - interval 7 day) as queries_last_7_days,
               count(*) filter (created_at >= timestamp '{AS_OF}' - interval 30 day) as queries_last_30_days,
               count(*) as queries_all_time, {duck_round('coalesce(avg(response_time_ms), 0)')} as average_response_time_ms
        from v_query_logs""",
)
def _(t):
    return op.query_stats(t.query_logs, as_of())


@query(
    "confidence_distribution",
    """with b as (select case when confidence is null then 'Medium' when confidence >= 0.8 then 'High' when confidence >= 0.5 then 'Medium' else 'Low' end as band from v_query_logs)
       select k.band, (select count(*) from b where b.band = k.band) as n from (values ('High'), ('Medium'), ('Low')) as k(band)""",
)
def _(t):
    return op.confidence_distribution(t.query_logs)


@query("top_questions", "select question, count(*) as n from v_query_logs group by 1 order by n desc, question limit 10")
def _(t):
    return op.top_questions(t.query_logs)


@query("channel_breakdown", "select coalesce(nullif(channel, ''), 'unknown') as channel, count(*) as n from v_query_logs group by 1")
def _(t):
    return op.channel_breakdown(t.query_logs)


@query(
    "pipeline_overview",
    f"""select d.document_id, d.filename, d.updated_at,
               {", ".join(f"coalesce((select s.status from x_latest_stage s where s.document_id = d.document_id and s.stage = '{s}'), 'pending') as {s}" for s in op.STAGES)}
        from (select document_id, max(filename) as filename, max(updated_at) as updated_at from v_stage_events group by 1
              order by updated_at desc, document_id limit 20) d""",
)
def _(t):
    return op.pipeline_overview(t.stage_events)


@query("latest_stages", "select document_id, stage, status, message, filename, updated_at from x_latest_stage")
def _(t):
    return op.latest_stages(t.stage_events)


@query(
    "processing_stats",
    """select count(*) filter (succeeded) as documents_processed, count(*) filter (not succeeded) as documents_failed,
              sum(chunks) filter (succeeded)::bigint as chunks_created, sum(pages) filter (succeeded)::bigint as pages_parsed,
              sum(tags) filter (succeeded)::bigint as equipment_tags_found, sum(low_confidence) filter (succeeded)::bigint as low_confidence_items,
              sum(graph_writes) filter (succeeded)::bigint as graph_writes, sum(recovered)::bigint as failed_jobs_recovered from v_runs""",
)
def _(t):
    return op.processing_stats(t.runs)


@query(
    "processing_status",
    """select r.document_id, coalesce(d.status, 'not_found') as status, coalesce(d.total_chunks, 0) as total_chunks,
              case when d.id is null then 'Document not found' else d.error_message end as error_message, d.processed_at
       from (select distinct document_id from v_runs) r left join v_documents d on d.id = r.document_id""",
)
def _(t):
    return op.processing_status(t.runs, t.documents)


@query(
    "status_and_risk_text",
    """select 'status' as kind, 'Plant Status' || chr(10) || 'Documents: ' || (select count(*) from v_documents) || chr(10)
              || 'Graph nodes: ' || (select count(*) from v_nodes) as text
       union all
       select 'risk', 'Risk Summary' || chr(10) || 'Overall: ' || overall_risk_level || chr(10) || 'Failure clusters: '
              || (select least(count(*), 5) from x_clusters) || chr(10) || 'Overdue inspections: ' || (select count(*) from x_overdue) || chr(10)
              || 'Critical overdue: ' || (select count(*) from x_high_overdue) || chr(10) || 'Co-occurrence patterns: ' || (select count(*) from x_top_pairs)
         from x_level""",
)
def _(t):
    status = op.status_text(t.documents, t.nodes).select(F.lit("status").alias("kind"), "text")
    risk = op.risk_text(rel.risk_summary(t.inspections, t.equipment, as_of()))
    return status.unionByName(risk.select(F.lit("risk").alias("kind"), "text"))
