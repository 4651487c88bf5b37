"""Named listing and lookup queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions.common import join_lines
from millwright.operators import lookup as lk
from millwright.plans.registry import query

DOC_COLUMNS = "id, original_filename, status, total_chunks, uploaded_at"


@query(
    "list_documents",
    f"""select {DOC_COLUMNS}, (select count(*) from v_documents where status = 'completed') as total
        from v_documents where status = 'completed' order by uploaded_at desc, id limit 100 offset 25""",
)
def _(t):
    return lk.list_documents(t.documents, "completed", 25, 100).select(
        "id", "original_filename", "status", "total_chunks", "uploaded_at", "total"
    )


@query(
    "query_history",
    """select id, question, channel, created_at, (select count(*) from v_query_logs) as total
       from v_query_logs order by created_at desc, id limit 50 offset 10""",
)
def _(t):
    return lk.query_history(t.query_logs, None, 10, 50).select("id", "question", "channel", "created_at", "total")


@query(
    "query_history_session",
    """select id, session_id, created_at, (select count(*) from v_query_logs where session_id = 'S-2') as total
       from v_query_logs where session_id = 'S-2' order by created_at desc, id limit 20""",
)
def _(t):
    return lk.query_history(t.query_logs, "S-2").select("id", "session_id", "created_at", "total")


@query(
    "query_detail",
    """select id, question, answer, case when sources is not null and json_valid(sources)
              then array_to_string(from_json(sources, '["VARCHAR"]'), '|') else '' end as sources from v_query_logs""",
)
def _(t):
    return lk.with_source_list(t.query_logs).select("id", "question", "answer", join_lines(F.col("sources")).alias("sources"))


@query(
    "list_rules",
    """select rule_code, title, category, (select count(*) from v_rules where is_active and regulation_body = 'OISD') as total
       from v_rules where is_active and regulation_body = 'OISD' order by rule_code limit 20 offset 2""",
)
def _(t):
    return lk.list_rules(t.rules, True, "OISD", None, 2, 20).select("rule_code", "title", "category", "total")


@query(
    "rules_for_check",
    """select 'all' as request, rule_code, greatest((select count(*) from v_rules where is_active) - 10, 0) as skipped
         from (select * from v_rules where is_active order by rule_code limit 10)
       union all
       select 'named', rule_code, 0 from v_rules where is_active and rule_code in ('OISD-103', 'PESO-101', 'FA-102', 'OISD-100')""",
)
def _(t):
    every = lk.rules_for_check(t.rules).select(F.lit("all").alias("request"), "rule_code", "skipped")
    named = lk.rules_for_check(t.rules, [" OISD-103 ", "PESO-101", "FA-102", "OISD-100", ""])
    return every.unionByName(named.select(F.lit("named").alias("request"), "rule_code", "skipped"))


@query("rules_for_check_all", "select rule_code, 0::bigint as skipped from v_rules where is_active")
def _(t):
    return lk.rules_for_check(t.rules, most=None).select("rule_code", "skipped")


@query("get_rule", "select id, rule_code, regulation_body, title, full_text, category, is_active, created_at from v_rules where rule_code = 'PESO-101'")
def _(t):
    return lk.get_rule(t.rules, " PESO-101 ")


@query(
    "list_equipment",
    """select n.id as tag, n.name, n.type as equipment_type,
              (select count(*) from v_edges e where e.src = n.id) + (select count(*) from v_edges e where e.dst = n.id) as neighbor_count
       from (select * from v_nodes where label = 'Equipment' and lower(coalesce(type, '')) = 'o' order by id limit 500) n""",
)
def _(t):
    return lk.list_equipment(t.nodes, t.edges, "O")


@query(
    "list_equipment_all",
    """select n.id as tag, n.name, n.type as equipment_type, coalesce(d.n, 0) as neighbor_count
       from v_nodes n left join (select id, count(*) as n from (select src as id from v_edges union all select dst from v_edges) group by 1) d on d.id = n.id
       where n.label = 'Equipment'""",
)
def _(t):
    return lk.list_equipment(t.nodes, t.edges, most=None)


@query(
    "equipment_detail",
    """select a.id as tag, a.name, a.type as equipment_type, x.rel as relationship, x.dst as neighbor_tag, x.label as neighbor_label, x.nname as neighbor_name
       from v_nodes a left join (select e.src, e.rel, e.dst, n.label, n.name as nname from v_edges e join v_nodes n on n.id = e.dst) x on x.src = a.id
       where a.label = 'Equipment'""",
)
def _(t):
    return lk.equipment_detail(t.nodes, t.edges)


@query(
    "record_feedback",
    """select l.id, case when f.id is null then l.helpful else f.helpful end as helpful,
              case when f.id is null then l.feedback_comment else f.note end as feedback_comment
       from v_query_logs l left join (select question_id as id, response_time_ms > 500 as helpful, 'took ' || response_time_ms as note
                                      from v_answers where contains(answer, 'Confidence')) f on f.id = l.id""",
)
def _(t):
    feedback = t.answers.where(F.contains("answer", F.lit("Confidence"))).select(
        F.col("question_id").alias("id"), (F.col("response_time_ms") > 500).alias("helpful"),
        F.concat(F.lit("took "), F.col("response_time_ms").cast("string")).alias("comment"),
    )
    return lk.record_feedback(t.query_logs, feedback).select("id", "helpful", "feedback_comment")


@query(
    "soft_delete_rule",
    """select rule_code, is_active and id not in (select rule_id from v_checks where status = 'PARTIAL') as is_active from v_rules""",
)
def _(t):
    rules = t.rules
    partial = t.checks.where("status = 'PARTIAL'").select(F.col("rule_id").alias("id"))
    codes = rules.join(partial, "id", "left_semi").select(F.concat(F.lit(" "), "rule_code").alias("rule_code"))
    return lk.soft_delete_rules(rules, codes).select("rule_code", "is_active")


@query(
    "reset_for_reprocess",
    """select id, 'pending' as status, 0 as total_chunks, cast(null as varchar) as error_message, cast(null as timestamp) as processed_at
       from v_documents where status in ('failed', 'cancelled')""",
)
def _(t):
    docs = t.documents
    return lk.reset_for_reprocess(docs, docs.where("status in ('failed', 'cancelled')")).select(
        "id", "status", "total_chunks", "error_message", "processed_at"
    )


DUCK_NODE_JSON = """'{' || array_to_string(list_filter([
    case when type is not null then '"type":"' || type || '"' end, case when name is not null then '"name":"' || name || '"' end,
    case when confidence is not null then '"confidence":"' || confidence || '"' end], lambda x: x is not null), ',') || '}'"""


@query(
    "node_search",
    f"""with x_shown as (select id, label from v_nodes where contains(lower(id || ' ' || label || ' ' || {DUCK_NODE_JSON}), 'nation') order by id limit 90)
        select 'node' as part, id as a, label as rel, '' as b from x_shown
        union all
        select * from (select 'edge', src, rel, dst from v_edges where src in (select id from x_shown) and dst in (select id from x_shown) order by src, rel, dst limit 140)""",
)
def _(t):
    found = lk.node_search(t.nodes, "Nation")
    edges = lk.induced_edges(found, t.edges)
    return found.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("label").alias("rel"), F.lit("").alias("b")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("a"), "rel", F.col("dst").alias("b"))
    )


@query(
    "node_search_all",
    f"""with x_shown as (select id, label from v_nodes where contains(lower(id || ' ' || label || ' ' || {DUCK_NODE_JSON}), 'nation'))
        select 'node' as part, id as a, label as rel, '' as b from x_shown
        union all select 'edge', src, rel, dst from v_edges where src in (select id from x_shown) and dst in (select id from x_shown)""",
)
def _(t):
    found = lk.node_search(t.nodes, "Nation", most=None)
    edges = lk.induced_edges(found, t.edges, None)
    return found.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("label").alias("rel"), F.lit("").alias("b")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("a"), "rel", F.col("dst").alias("b"))
    )


@query(
    "node_kind",
    """select id, case label when 'Valve' then 'Valve' when 'Instrument' then 'Instrument' when 'Zone' then 'Zone' else 'Equipment' end as kind from v_nodes
       union all select id, case when label in ('MaintenanceEvent', 'Document', 'Equipment') then label
                        when regexp_full_match(upper(id), '[A-Z]{1,3}-\\d{3,4}[A-Z]?') then 'Equipment' else 'Node' end from v_rule_nodes""",
)
def _(t):
    both = t.nodes.select("id", "label").unionByName(t.rule_nodes.select("id", "label"))
    return both.select("id", lk.node_kind(F.col("label"), F.col("id")).alias("kind"))


@query(
    "equipment_search",
    """select tag, name from v_equipment where contains(lower(concat_ws(' ', coalesce(tag, ''), coalesce(name, ''), coalesce(equipment_type, ''), coalesce(location, ''))), 'building zone 1')""",
)
def _(t):
    return lk.equipment_search(t.equipment, "Building Zone 1").select("tag", "name")


@query(
    "chunk_documents_lookup",
    """select id, original_filename from v_documents
       where id in (select coalesce(nullif(document_id, ''), nullif(doc_id, '')) from v_retrieved)""",
)
def _(t):
    return lk.cited_documents(t.documents, t.retrieved).select("id", "original_filename")
