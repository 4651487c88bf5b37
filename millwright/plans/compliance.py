"""Named compliance queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions.common import join_lines
from millwright.operators import chunking as ch
from millwright.operators import compliance as cp
from millwright.plans.registry import query
from millwright.plans.text import WIDE, duck_field, duck_strip, duck_tags
from millwright.plans.views import CHECK_FRAGMENTS
from millwright.sources import stores


def evidence_sql(text: str, k: int, separator: str) -> str:
    weights = cp.query_weights(text)
    rows = ", ".join(f"({i}, {w})" for i, w in weights.items())
    norm = sum(w * w for w in weights.values()) ** 0.5
    return f"""
        select document_id, string_agg(text, {separator} order by distance, chunk_index) as procedure_text from (
          select *, row_number() over (partition by document_id order by distance, chunk_index) as rank from (
            select c.document_id, c.chunk_index, c.text, round(1 - coalesce(s.dot / (s.norm * {norm!r}::double), 0), 9) as distance
            from x_doc_chunks c left join (
              select e.document_id, e.chunk_index, coalesce(sum(e.weight * w.w), 0) as dot, sqrt(sum(e.weight * e.weight)) as norm
              from x_chunk_entries e left join (values {rows}) as w(idx, w) on w.idx = e.idx group by all) s
            on s.document_id = c.document_id and s.chunk_index = c.chunk_index))
        where rank <= {k} group by 1 having trim(string_agg(text, ' ')) <> ''"""


CHECK_FRAGMENTS.update(
    x_evidence=evidence_sql(cp.CHECK_QUERY, 10, "chr(10) || chr(10)"),
    x_scan_evidence=evidence_sql(cp.SCAN_QUERY, 3, "' '"),
)


def chunks(t):
    docs = t.spread.documents.where("status = 'completed'").select(F.col("id").alias("document_id"), "text")
    return ch.document_chunks(docs, offsets=False)


_WORK = """select e.document_id, r.rule_code, r.id as rule_id, md5(e.procedure_text) as digest, length(e.procedure_text) as n
       from (select * from x_evidence where document_id in (select id from v_documents where status = 'completed')) e,
            (select * from v_rules where is_active {most}) r"""


def _work(t, most):
    evidence = cp.document_evidence(chunks(t), cp.CHECK_QUERY, 10, "\n\n").select(
        "document_id", F.md5(F.col("procedure_text").cast("binary")).alias("digest"), F.length("procedure_text").cast("long").alias("n")
    )
    return cp.compliance_work(evidence, t.rules, most).select("document_id", "rule_code", "rule_id", "digest", "n")


@query("compliance_work", _WORK.format(most="order by rule_code limit 10"))
def _(t):
    return _work(t, 10)


@query("compliance_work_all", _WORK.format(most=""))
def _(t):
    return _work(t, None)


_SCAN = """select e.document_id, r.rule_code, md5(e.procedure_text) as digest
       from (select * from x_scan_evidence where document_id in (select id from v_documents where status = 'completed' {documents})) e,
            (select * from v_rules where is_active {rules}) r"""


def scan(t, *most):
    return cp.compliance_scan(t.documents, chunks(t), t.rules, *most).select("document_id", "rule_code", "digest")


@query("compliance_scan", _SCAN.format(documents="order by id limit 5", rules="order by rule_code limit 3"))
def _(t):
    return scan(t, 5, 3)


@query("compliance_scan_all", _SCAN.format(documents="", rules=""))
def _(t):
    return scan(t, None, None)


_STATUS = duck_field("STATUS", "INSUFFICIENT_INFORMATION")
_FINDINGS = duck_strip(f"({duck_field('FINDINGS', '')} || chr(10) || chr(10) || 'RECOMMENDATION: ' || {duck_field('RECOMMENDATION', '')})")


@query(
    "record_checks",
    f"""select rule_id, document_id, {_STATUS} as status, {_FINDINGS} as findings,
               array_to_string({duck_tags('verdict_text', WIDE)}, '|') as equipment_tags, checked_at from v_verdicts""",
)
def _(t):
    verdicts = t.verdicts.withColumn("procedure_text", F.col("verdict_text"))
    return cp.record_checks(verdicts).withColumn("equipment_tags", join_lines(F.col("equipment_tags")))


@query(
    "document_checks",
    """select c.document_id, r.rule_code, c.status, c.findings, c.checked_at from v_checks c join v_rules r on r.id = c.rule_id""",
)
def _(t):
    return cp.document_checks(t.checks, t.rules).orderBy("document_id", F.desc("checked_at"))


def _summary(status: str) -> str:
    return f"""select c.document_id, count(*) filter ({status} = 'COMPLIANT') as compliant, count(*) filter ({status} = 'NON_COMPLIANT') as non_compliant,
               count(*) filter ({status} = 'PARTIAL') as partial from v_checks c join v_rules r on r.id = c.rule_id group by 1"""


@query("check_summary", _summary("status"))
def _(t):
    return cp.check_summary(cp.document_checks(t.checks, t.rules))


@query("check_summary_normalized", _summary("upper(status)"))
def _(t):
    return cp.check_summary(cp.document_checks(t.checks, t.rules), normalize=True)


@query(
    "check_groups_ui",
    """select count(*) filter (status ilike '%compliant%' and status not ilike '%non%') as compliant,
              count(*) filter (status ilike '%partial%') as partial, count(*) filter (status ilike '%non%') as non_compliant from v_checks""",
)
def _(t):
    return cp.check_groups(t.checks)


_INCOMING = """select case when category in ('safety', 'fire') then ' ' || rule_code || ' ' else 'NEW-' || id end as rule_code, title from v_rules"""


def incoming(t):
    old = F.col("category").isin("safety", "fire")
    return t.rules.select(
        F.when(old, F.concat(F.lit(" "), "rule_code", F.lit(" "))).otherwise(F.concat(F.lit("NEW-"), "id")).alias("rule_code"), "title"
    )


@query(
    "rule_upsert_guard",
    f"""select trim(i.rule_code) as rule_code, i.title, trim(i.rule_code) not in (select rule_code from v_rules) as accepted from ({_INCOMING}) i""",
)
def _(t):
    return cp.rule_upsert_guard(t.rules, incoming(t))


@query("rule_seed", f"select rule_code, title from ({_INCOMING}) where rule_code not in (select rule_code from v_rules where is_active)")
def _(t):
    return stores.seed_rules(t.rules.where("is_active"), incoming(t))
