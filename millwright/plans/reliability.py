"""Named reliability queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions.common import contains_any, join_lines
from millwright.operators import reliability as rel
from millwright.plans.registry import CHECKS, query
from millwright.plans.views import AS_OF, CHECK_FRAGMENTS, duck_round

DAY = 86400000000

CHECK_FRAGMENTS.update(
    x_failures="""
        select id, equipment_tag, coalesce(inspection_date, created_at) as happened, severity, findings
        from v_inspections where severity in ('major', 'critical')""",
    x_cluster_sums="""
        select equipment_tag, count(*) as occurrence_count,
               count(*) filter (severity = 'major') as major_count,
               count(*) filter (severity = 'critical') as critical_count,
               min(happened) as first_seen, max(happened) as last_seen,
               greatest(floor((epoch_us(max(happened)) - epoch_us(min(happened))) / 86400000000.0) / 30.0, 1.0)::double as months
        from x_failures group by equipment_tag having count(*) >= 2""",
    x_clusters=f"""
        select * exclude (months),
               {duck_round('occurrence_count / months')} as frequency_per_month,
               {duck_round('occurrence_count * (major_count + 2 * critical_count) / months')} as risk_score
        from x_cluster_sums""",
    x_overdue=f"""
        select l.equipment_tag, case when e.tag is null then '' else e.name end as equipment_name,
               case when e.tag is null then '' else e.equipment_type end as equipment_type,
               l.happened as last_inspection_date, l.days as days_since_last_inspection, l.days - 180 as overdue_by_days,
               case when l.days > 365 then 'high' else 'medium' end as risk_level
        from (select equipment_tag, max(coalesce(inspection_date, created_at)) as happened,
                     floor((epoch_us(timestamp '{AS_OF}') - epoch_us(max(coalesce(inspection_date, created_at)))) / 86400000000.0)::bigint as days
              from v_inspections group by equipment_tag) l
        left join v_equipment e on e.tag = l.equipment_tag
        where l.days > 180""",
    x_pair_sums="""
        select least(a.equipment_tag, b.equipment_tag) as tag_a, greatest(a.equipment_tag, b.equipment_tag) as tag_b,
               count(*) as co_occurrence_count,
               sum(((epoch_us(b.happened) - epoch_us(a.happened)) // 86400000000)::double) / count(*) as gap,
               max(b.happened) as last_occurrence
        from x_failures a join x_failures b
          on (a.happened < b.happened or (a.happened = b.happened and a.id < b.id))
         and epoch_us(b.happened) - epoch_us(a.happened) < 31 * 86400000000
         and a.equipment_tag <> b.equipment_tag
        group by 1, 2""",
    x_pairs=f"""
        select * exclude (gap), {duck_round('gap')} as typical_gap_days from x_pair_sums""",
    x_top_pairs="select * from x_pairs order by co_occurrence_count desc, tag_a, tag_b limit 3",
    x_top_clusters="select * from x_clusters order by risk_score desc, equipment_tag limit 3",
    x_level="""
        select case when (select max(days_since_last_inspection) from x_overdue) > 365
                     and (select max(risk_score) from x_clusters) > 10 then 'Critical'
                    when (select max(days_since_last_inspection) from x_overdue) > 365 then 'High'
                    when (select max(days_since_last_inspection) from x_overdue) > 180 then 'Medium'
                    else 'Low' end as overall_risk_level""",
    x_high_overdue="select * from x_overdue where risk_level = 'high'",
    x_top_high="select * from x_high_overdue order by days_since_last_inspection desc, equipment_tag limit 3",
    x_loto="""
        select * from v_inspections
        where regexp_matches(lower(coalesce(findings, '')), 'loto|lockout|tagout|isolation')""",
    x_warnings="""
        select 'cluster-' || equipment_tag as id, equipment_tag as tag,
               case when critical_count > 0 then 'critical' else 'high' end as severity,
               'Recurring failure pattern on ' || equipment_tag as title,
               occurrence_count || ' major/critical records; risk score ' || risk_score as "trigger",
               'Repeated high-severity findings detected in inspection history.' as evidence,
               '""" + rel.ADVICE["cluster"] + """' as recommended_action,
               'incident_reports + inspection_history' as source_type
          from x_top_clusters
        union all
        select 'overdue-' || equipment_tag, equipment_tag, 'high', 'Inspection review overdue for ' || equipment_tag,
               days_since_last_inspection || ' days since last inspection',
               'Inspection is overdue by ' || overdue_by_days || ' days against the active review threshold.',
               '""" + rel.ADVICE["overdue"] + """',
               'qms_review_cycle'
          from x_top_high""",
    x_linked_warnings="""
        select w.id, w.severity, w.title, w."trigger", w.evidence, w.recommended_action, w.source_type,
               list_concat([w.tag], coalesce((select list(distinct related_tag order by related_tag)
                                              from v_asset_links k where k.tag = w.tag and related_tag <> w.tag), [])) as related
          from x_warnings w
        union all
        select 'procedure-drift-loto', 'critical', 'Isolation procedure drift detected',
               'LOTO / isolation language appeared in high-risk maintenance evidence.',
               (select findings from x_loto order by created_at, id limit 1), '""" + rel.ADVICE["drift"] + """', 'near_miss + compliance_gap',
               (select list(t order by t) from (select distinct equipment_tag as t from x_loto order by t limit 6))
         where exists (select 1 from x_loto)""",
)


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query("failure_records", "select id, equipment_tag, happened as inspection_date, severity, findings from x_failures")
def _(t):
    return rel.failure_records(t.inspections)


@query("failure_clusters", "select * from x_clusters")
def _(t):
    return rel.ranked_clusters(t.inspections)


@query("overdue_inspections", "select * from x_overdue")
def _(t):
    return rel.overdue_inspections(t.inspections, t.equipment, as_of()).orderBy(
        F.desc("days_since_last_inspection"), "equipment_tag"
    )


@query(
    "overdue_inspections_filtered",
    "select * from x_overdue where risk_level = 'medium' and lower(equipment_type) = 'machinery'",
)
def _(t):
    return rel.overdue_inspections(t.inspections, t.equipment, as_of(), risk_level="medium", equipment_type="Machinery")


@query("failure_cooccurrence", "select * from x_pairs order by co_occurrence_count desc, tag_a, tag_b limit 10")
def _(t):
    return rel.failure_cooccurrence(t.inspections)


@query("cooccurrence_pairs", "select * from x_pairs")
def _(t):
    return rel.cooccurrence_pairs(t.inspections)


@query("overall_risk", "select * from x_level")
def _(t):
    return rel.overall_risk(
        rel.failure_clusters(t.inspections), rel.overdue_inspections(t.inspections, t.equipment, as_of())
    ).select("overall_risk_level")


@query(
    "risk_summary",
    """select 'level' as part, 1 as rank, overall_risk_level, (select count(*) from x_overdue) as overdue_inspections_count from x_level
       union all by name select 'cluster' as part, row_number() over (order by risk_score desc, equipment_tag)::int as rank, *
         from (select * from x_clusters order by risk_score desc, equipment_tag limit 5)
       union all by name select 'pair' as part, row_number() over (order by co_occurrence_count desc, tag_a, tag_b)::int as rank, * from x_top_pairs
       union all by name select 'critical_overdue' as part, * from x_high_overdue""",
)
def _(t):
    return rel.risk_summary(t.inspections, t.equipment, as_of())


@query(
    "proactive_warnings",
    """select id, severity, title, "trigger", evidence, recommended_action, source_type, array_to_string(related, '|') as related_assets
       from x_linked_warnings""",
)
def _(t):
    return rel.proactive_warnings(t.inspections, t.equipment, t.asset_links, as_of()).withColumn(
        "related_assets", join_lines(F.col("related_assets"))
    )


@query(
    "systemic_patterns",
    """select pattern, assets, evidence, lesson from (
         select 0 as part, -co_occurrence_count::double as k, 'Cross-asset failure recurrence' as pattern,
                tag_a || ',' || tag_b as assets,
                co_occurrence_count || ' co-occurrences within a typical ' || typical_gap_days || ' day gap' as evidence,
                'Inspect connected assets together instead of treating each event as isolated.' as lesson
           from x_top_pairs
         union all
         select 1, -risk_score, 'Repeated defect on same equipment', equipment_tag,
                'Frequency ' || frequency_per_month || ' events/month',
                'Create a preventive maintenance action or engineering review trigger for this asset class.'
           from x_top_clusters)
       order by part, k, assets limit 5""",
)
def _(t):
    return rel.systemic_patterns(t.inspections)


@query(
    "qms_signals",
    """with x_audit as (select * from v_inspections
           where regexp_matches(lower(inspection_type), 'audit|statutory')
              or regexp_matches(lower(coalesce(findings, '')), 'audit|non-conformance|nonconformance|ncr')),
       x_rev as (select * from v_inspections
           where regexp_matches(lower(coalesce(findings, '')), 'supersede|revision|rev |outdated'))
       select 'Review-cycle non-conformance' as signal, 'open' as status,
              n || ' high-risk assets exceeded inspection review interval.' as evidence, 'Maintenance / QMS' as owner
         from (select count(*) as n from x_high_overdue) where n > 0
       union all
       select 'Audit finding linked to asset reliability', 'needs_review',
              (select coalesce(findings, '') from x_audit order by created_at, id limit 1), 'QMS / Reliability'
        where exists (select 1 from x_audit)
       union all
       select 'Document revision conflict', 'trust_gate_required',
              'Maintenance evidence references revision or supersession language.', 'Document control'
        where exists (select 1 from x_rev)""",
)
def _(t):
    return rel.qms_signals(t.inspections, t.equipment, as_of())


@query(
    "source_coverage",
    """select count(*) filter (severity in ('major', 'critical')) as incident_reports_reviewed,
              count(*) filter (regexp_matches(lower(coalesce(findings, '')), 'near miss|near-miss|almost|unsafe')) as near_miss_records_reviewed,
              count(*) filter (regexp_matches(lower(inspection_type), 'audit|statutory')) as audit_findings_reviewed,
              count(*) filter (regexp_matches(lower(coalesce(findings, '')), 'non-conformance|nonconformance|ncr|deviation')) as quality_non_conformances_reviewed,
              count(distinct equipment_tag) as equipment_tags_detected
       from v_inspections""",
)
def _(t):
    return rel.source_coverage(t.inspections)


@query(
    "validation_metrics",
    """select 'Entity extraction accuracy proxy' as name, count(distinct equipment_tag) || ' equipment tags' as value,
              'measured' as status from v_inspections
       union all select 'Knowledge graph linkage completeness',
              (select count(distinct a) from (select unnest(related) as a from x_linked_warnings)) || ' linked assets', 'live'
       union all select 'Compliance gap detection', (select count(*) from x_high_overdue) || ' high-risk gaps', 'live'
       union all select 'Cross-functional discovery', (select count(*) from x_linked_warnings) || ' proactive warnings', 'live'""",
)
def _(t):
    return rel.validation_metrics(t.inspections, t.equipment, t.asset_links, as_of())


@query(
    "needle_flags",
    """select id, regexp_matches(lower(coalesce(findings, '')), 'loto|lockout|tagout|isolation') as loto,
              regexp_matches(lower(coalesce(findings, '')), 'near miss|near-miss|almost|unsafe') as near_miss,
              regexp_matches(lower(coalesce(inspection_type, '')), 'audit|statutory') as audit_type,
              regexp_matches(lower(coalesce(findings, '')), 'audit|non-conformance|nonconformance|ncr') as audit_text,
              regexp_matches(lower(coalesce(findings, '')), 'non-conformance|nonconformance|ncr|deviation') as non_conformance,
              regexp_matches(lower(coalesce(findings, '')), 'supersede|revision|rev |outdated') as revision
       from v_inspections""",
)
def _(t):
    field = {"audit_type": "inspection_type"}
    return t.inspections.select(
        "id", *[contains_any(F.col(field.get(k, "findings")), words).alias(k) for k, words in rel.NEEDLES.items()]
    )


# ---- the same without cuts --------------------------------------------------
CHECK_FRAGMENTS["x_every_warning"] = CHECK_FRAGMENTS["x_warnings"].replace("x_top_clusters", "x_clusters").replace("x_top_high", "x_high_overdue")


@query("proactive_warnings_all", CHECKS["proactive_warnings"].replace("x_linked_warnings", "(" + CHECK_FRAGMENTS["x_linked_warnings"].replace(
    "from x_warnings", "from x_every_warning") + ")"))
def _(t):
    found = rel.proactive_warnings(t.inspections, t.equipment, t.asset_links, as_of(), None, None)
    return found.withColumn("related_assets", join_lines(F.col("related_assets")))


@query("systemic_patterns_all", CHECKS["systemic_patterns"].replace("x_top_pairs", "x_pairs").replace("x_top_clusters", "x_clusters").replace(
    "order by part, k, assets limit 5", ""))
def _(t):
    return rel.systemic_patterns(t.inspections, None, None, None)


@query(
    "risk_summary_all",
    """select 'level' as part, 1 as rank, overall_risk_level, (select count(*) from x_overdue) as overdue_inspections_count from x_level
       union all by name select 'cluster' as part, * from x_clusters
       union all by name select 'pair' as part, * from x_pairs
       union all by name select 'critical_overdue' as part, * from x_high_overdue""",
)
def _(t):
    return rel.risk_summary(t.inspections, t.equipment, as_of(), None, None)
