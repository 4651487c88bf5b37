"""Domain views over the driver's tables.

The tables are generic (orders, events, documents ...), so each domain table is
a deterministic projection of them.  A view is SQL text written once and
rendered for the engine that runs it: Spark, or DuckDB as the check engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import deal, spread

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Checks of one document that meet its tags in one task, about.
CHECKS_PER_CELL = 512

# Every "now" in the reports is this instant, so results do not drift.
AS_OF = "2025-01-29 12:00:00"


class SparkDialect:
    """Renders view text for ``spark.sql(text, **tables)``."""

    open_brace, close_brace = "{{", "}}"

    def table(self, name: str) -> str:
        return "{" + name + "}"

    def ts(self, text: str) -> str:
        return f"timestamp_ntz'{text}'"

    def plus_days(self, base: str, n: str) -> str:
        return f"({base} + make_dt_interval(cast({n} as int)))"

    def plus_minutes(self, base: str, n: str) -> str:
        return f"({base} + make_dt_interval(0, 0, cast({n} as int)))"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def series(self, lo: int, hi: int, name: str) -> str:
        return f"lateral view explode(sequence({lo}, {hi})) s_{name} as {name}"

    def words(self, text: str) -> str:
        return f"lateral view posexplode(split({text}, ' ')) s_w as word_index, word"

    def bytes_of(self, text: str) -> str:
        return f"cast({text} as binary)"

    def hexbytes(self, digits: str) -> str:
        return f"unhex('{digits}')"


class DuckDialect:
    """Renders view text for DuckDB, where the raw tables are views already."""

    open_brace, close_brace = "{", "}"

    def table(self, name: str) -> str:
        return name

    def ts(self, text: str) -> str:
        return f"timestamp '{text}'"

    def plus_days(self, base: str, n: str) -> str:
        return f"({base} + to_days(cast({n} as int)))"

    def plus_minutes(self, base: str, n: str) -> str:
        return f"({base} + to_minutes(cast({n} as bigint)))"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def series(self, lo: int, hi: int, name: str) -> str:
        return f", unnest(range({lo}, {hi} + 1)) as s_{name}({name})"

    def words(self, text: str) -> str:
        return (
            f", (select unnest(w) as word, unnest(range(0, len(w))) as word_index"
            f" from (select string_split({text}, ' ') as w)) as s_w"
        )

    def bytes_of(self, text: str) -> str:
        return f"encode({text})"

    def hexbytes(self, digits: str) -> str:
        return f"unhex('{digits}')"


def _inspections(d):
    return f"""
    select concat('INS-', event_id) as id,
           concat('P-', 100 + user_id) as equipment_tag,
           case when event_id % 17 = 0 then null else ts end as inspection_date,
           concat('inspector-', event_id % 9) as inspector_name,
           case event_id % 4 when 0 then 'routine' when 1 then 'internal audit'
                             when 2 then 'Statutory' else 'near_miss' end as inspection_type,
           case event_id % 7
                when 0 then concat('LOTO tag missing during isolation of line ', event_id % 23)
                when 1 then 'Near-miss: unsafe lift, load almost dropped'
                when 2 then 'NCR raised, non-conformance against checklist'
                when 3 then 'Drawing revision outdated, superseded sheet in use'
                when 4 then 'Seal leak found, deviation recorded'
                when 5 then null
                else 'No abnormality' end as findings,
           case event_type when 'error' then 'critical' when 'purchase' then 'major'
                           when 'signup' then 'minor' when 'view' then 'ok'
                           else 'routine' end as severity,
           concat('DOC-', event_id % 997) as source_document_id,
           ts as created_at
    from {d.table('events')}"""


def _equipment(d):
    # Customers in debit play assets missing from the register.
    return f"""
    select concat('EQ-', c_custkey) as id,
           concat('P-', 100 + c_custkey) as tag,
           c_name as name,
           case when c_custkey % 11 = 0 then null else lower(c_mktsegment) end as equipment_type,
           concat('Zone ', c_nationkey) as location,
           case when c_custkey % 7 = 0 then null else concat('Unit ', c_custkey, ' of ', c_mktsegment) end as description,
           concat('DOC-', c_custkey % 997) as source_document_id,
           {d.plus_days(d.ts('2023-01-01 00:00:00'), 'c_custkey % 300')} as created_at
    from {d.table('customer')}
    where c_acctbal >= 0"""


def _asset_links(d):
    return f"""
    select distinct concat('P-', 100 + o_custkey) as tag, concat('V-', 100 + l_suppkey) as related_tag
    from {d.table('orders')} join {d.table('lineitem')} on l_orderkey = o_orderkey"""


_MONTH = (
    "case month(rd) when 1 then 'Jan' when 2 then 'Feb' when 3 then 'March' when 4 then 'Apr' when 5 then 'May'"
    " when 6 then 'June' when 7 then 'Jul' when 8 then 'Aug' when 9 then 'Sept' when 10 then 'Oct'"
    " when 11 then 'November' else 'Dec' end"
)


def _documents(d):
    review = f"""case doc_id % 5
        when 0 then concat(year(rd), '-', month(rd), '-', day(rd))
        when 1 then concat(day(rd), '/', month(rd), '/', year(rd))
        when 2 then concat({_MONTH}, ' ', year(rd))
        when 3 then concat(case when month(rd) < 10 then '0' else '' end, month(rd), '/',
                           case when day(rd) < 10 then '0' else '' end, day(rd), '/', year(rd) % 100)
        else concat('', year(rd)) end"""
    return f"""
    select concat('DOC-', doc_id) as id,
           doc_id as doc_key,
           concat('f', doc_id, '.bin') as filename,
           case doc_id % 6 when 0 then concat('OISD standard ', doc_id, '.pdf')
                           when 1 then concat('p&id sheet ', doc_id, '.png')
                           when 2 then concat('shift log ', doc_id, '.txt')
                           when 3 then concat('OEM manual ', doc_id, '.docx')
                           when 4 then concat('sop_', doc_id, '.eml')
                           else concat('note-', doc_id, '.wav') end as original_filename,
           case doc_id % 6 when 0 then 'pdf' when 1 then 'image' when 2 then 'txt' when 3 then 'docx'
                           when 4 then 'eml' else 'voice' end as file_type,
           n_chars as file_size_bytes,
           case when doc_id % 10 < 6 then 'completed' when doc_id % 10 = 6 then 'failed'
                when doc_id % 10 = 7 then 'processing' when doc_id % 10 = 8 then 'cancelled'
                else 'pending' end as status,
           case when doc_id % 10 < 6 then {d.idiv('n_chars', '800')} + 1 else 0 end as total_chunks,
           case when doc_id % 10 = 6 then 'Failed to parse' else null end as error_message,
           {d.plus_days(d.ts('2024-01-01 00:00:00'), 'doc_id % 400')} as uploaded_at,
           case when doc_id % 10 < 6 and doc_id % 4 <> 1
                then {d.plus_minutes(d.plus_days(d.ts('2024-01-01 00:00:00'), 'doc_id % 400'), 'doc_id % 90')}
                else null end as processed_at,
           lang,
           concat(case when doc_id % 3 <> 0 then concat('Last reviewed: ', {review}, '.
') else '' end,
                  text,
                  case when doc_id % 2 = 0 then concat('
Pump P-', 100 + doc_id % 150, ' inspected, found wear near valve V-', 200 + doc_id % 50,
                       '. Check P-', 100 + doc_id % 97, ' and p-', 300 + doc_id % 40,
                       ' then XVZ-', 1000 + doc_id % 9, 'A, P-', 100 + doc_id % 97, ' again! Call the engineer.')
                  else '' end) as text
    from (select *, {d.plus_days(d.ts('2022-01-01 00:00:00'), 'doc_id * 37 % 1100')} as rd
          from {d.table('documents')}) x"""


def _sectioned(d):
    # Long-form variants with headings: the body is cut at its own line breaks by the headings.
    return f"""
    select id, concat('Cover page of ', original_filename, '
',
           case when doc_key % 4 = 3 then '' else concat('## Scope
', text, '
2.1 Steps for P-', 100 + doc_key % 150, '
', text, '
') end,
           case when doc_key % 4 = 2 then '' else concat('SAFETY NOTES: ', text) end) as text
    from v_documents"""


def _pages(d):
    return f"""
    select concat('CONV-', conv_id) as document_id, turn + 1 as page_number, text
    from {d.table('conversations')}"""


def _ocr_words(d):
    return f"""
    select document_id, page_number, word, cast((length(word) * 17 + word_index * 7) % 112 - 8 as double) as conf
    from v_pages {d.words('text')}"""


def _files(d):
    magic = {
        0: "25504446", 1: "89504e470d0a1a0a", 2: "ffd8ff", 3: "49492a00", 4: "424d",
        5: "41433130", 6: "d0cf11e0a1b11ae1",
    }
    arms = " ".join(f"when {k} then {d.hexbytes(v)}" for k, v in magic.items())
    sniff = """case doc_key % 11 when 7 then '0
SECTION
2
HEADER
' when 8 then 'Subject: shift note
MIME-Version: 1.0

' else '' end"""
    return f"""
    select original_filename as path_name,
           case doc_key % 5 when 0 then concat(replace(original_filename, '.wav', '.zip'))
                            when 1 then concat('scan ', doc_key, '.TIF')
                            when 2 then concat('dir/a b_', doc_key, '.xls')
                            when 3 then concat('no_extension_', doc_key)
                            else concat('mail#', doc_key, '.eml') end as name,
           cast(file_size_bytes as bigint) * 4000 as size_bytes,
           doc_key % 11 as flavour,
           {sniff} as sniff_text,
           case doc_key % 11 {arms}
                else {d.bytes_of(f"concat({sniff}, text)")} end as content
    from v_documents"""


def _query_logs(d):
    return f"""
    select concat('Q-', u.conv_id, '-', u.turn) as id,
           u.text as question,
           case when u.conv_id % 3 = 0 then 'hi' else 'en' end as language,
           a.text as answer,
           case u.conv_id % 4 when 0 then concat('["f', u.conv_id, '.pdf","f', u.turn, '.txt"]')
                              when 1 then '[]' when 2 then 'not json' else null end as sources,
           cast(case u.conv_id % 5 when 0 then 0.9 when 1 then 0.6 when 2 then 0.3 when 3 then 0.8
                              else null end as double) as confidence,
           cast(length(u.text) as int) as response_time_ms,
           case u.conv_id % 4 when 0 then 'web' when 1 then 'whatsapp' when 2 then '' else null end as channel,
           case when u.conv_id % 2 = 0 then concat('S-', u.conv_id) else null end as session_id,
           cast(null as boolean) as helpful,
           cast(null as string) as feedback_comment,
           {d.plus_minutes(d.plus_days(d.ts('2024-11-01 00:00:00'), 'u.conv_id % 85'), 'u.turn')} as created_at
    from {d.table('conversations')} u
    left join {d.table('conversations')} a on a.conv_id = u.conv_id and a.turn = u.turn + 1
    where u.role = 'user'"""


def _rules(d):
    return f"""
    select concat('RID-', item_id) as id,
           concat(case item_id % 3 when 0 then 'OISD' when 1 then 'PESO' else 'FA' end, '-', 100 + item_id) as rule_code,
           case item_id % 3 when 0 then 'OISD' when 1 then 'PESO' else 'Factory_Act' end as regulation_body,
           concat('Rule ', item_id, case when item_id % 2 = 0 then ' on pressure vessels' else ' on hot work' end) as title,
           text as full_text,
           case item_id % 4 when 0 then 'safety' when 1 then 'inspection' when 2 then 'storage' else 'fire' end as category,
           item_id % 11 <> 0 as is_active,
           {d.plus_days(d.ts('2023-06-01 00:00:00'), 'item_id')} as created_at
    from {d.table('benchmark')}"""


def _checks(d):
    return f"""
    select concat('CHK-', doc_id) as id,
           concat('RID-', doc_id % 43) as rule_id,
           concat('DOC-', doc_id % 211) as document_id,
           case when quality = 1 and toxic = 0 then case when doc_id % 4 = 0 then 'compliant' else 'COMPLIANT' end
                when toxic = 1 then case when doc_id % 2 = 0 then 'NON_COMPLIANT' else 'non_compliant' end
                else 'PARTIAL' end as status,
           concat('Findings for document ', doc_id) as findings,
           {d.plus_minutes(d.ts('2024-06-01 00:00:00'), 'doc_id * 60')} as checked_at
    from {d.table('labels')}"""


def _nodes(d):
    return f"""
    select concat('O-', o_orderkey) as id, 'Equipment' as label, lower(o_orderstatus) as type, o_orderpriority as name,
           case when o_orderkey % 9 = 0 then 'low' else 'high' end as confidence
      from {d.table('orders')}
    union all select concat('C-', c_custkey), 'Valve', lower(c_mktsegment), c_name, 'high' from {d.table('customer')}
    union all select concat('S-', s_suppkey), 'Instrument', 'supplier', s_name, 'medium' from {d.table('supplier')}
    union all select concat('N-', n_nationkey), 'Zone', 'nation', n_name, null from {d.table('nation')}
    union all select concat('R-', r_regionkey), 'Zone', null, r_name, null from {d.table('region')}"""


def _edges(d):
    return f"""
    select concat('O-', o_orderkey) as src, 'feeds_into' as rel, concat('C-', o_custkey) as dst from {d.table('orders')}
    union all select concat('C-', c_custkey), 'part_of', concat('N-', c_nationkey) from {d.table('customer')}
    union all select concat('S-', s_suppkey), 'part_of', concat('N-', s_nationkey) from {d.table('supplier')}
    union all select concat('N-', n_nationkey), 'part_of', concat('R-', n_regionkey) from {d.table('nation')}
    union all select distinct concat('O-', l_orderkey), 'connected_to', concat('S-', l_suppkey) from {d.table('lineitem')}"""


def _rule_nodes(d):
    return """
    select rule_code as id, 'ComplianceRule' as label, title as name from v_rules
    union all select distinct regulation_body, 'RegulationBody', cast(null as string) from v_rules
    union all select distinct category, 'ComplianceCategory', cast(null as string) from v_rules
    union all select id, 'ComplianceCheck', status from v_checks
    union all select distinct document_id, 'Document', cast(null as string) from v_checks
    union all select id, 'MaintenanceEvent', findings from v_inspections
    union all select distinct equipment_tag, 'Equipment', cast(null as string) from v_inspections"""


def _rule_edges(d):
    return """
    select regulation_body as src, 'ISSUES' as rel, rule_code as dst from v_rules
    union all select rule_code, 'APPLIES_TO_CATEGORY', category from v_rules
    union all select c.id, 'EVALUATES', r.rule_code from v_checks c join v_rules r on r.id = c.rule_id
    union all select document_id, 'HAS_COMPLIANCE_CHECK', id from v_checks
    union all select equipment_tag, 'HAD_EVENT', id from v_inspections
    union all select distinct i.equipment_tag, 'HAS_COMPLIANCE_CHECK', c.id
      from v_inspections i join v_checks c on c.document_id = i.source_document_id
    union all select distinct i.equipment_tag, 'SUBJECT_TO', r.rule_code
      from v_inspections i join v_checks c on c.document_id = i.source_document_id join v_rules r on r.id = c.rule_id"""


def _pid_payloads(d):
    o, c = d.open_brace, d.close_brace
    return f"""
    select concat('PID-', p_partkey) as document_id,
           p_size % 13 = 0 as document_low_confidence,
           {d.plus_minutes(d.ts('2024-03-01 00:00:00'), 'p_partkey')} as received_at,
           concat('{o}"zone":', case when p_partkey % 6 = 0 then 'null' else concat('"Z-', p_size % 10, '"') end,
             ',"equipment":[{o}"id":" e-', p_partkey, '","type":"', lower(p_type), '","confidence":"', conf_a, '"{c},',
             '{o}"id":', case when p_partkey % 19 = 0 then 'null' else concat('"E-', p_partkey + 1, '"') end,
             ',"type":"tank","confidence":"', conf_b, '"{c}]',
             ',"valves":[{o}"valve_id":"xv-', p_partkey, '","valve_type":"gate","connects_from":"E-', p_partkey,
             '","connects_to":', case when p_partkey % 17 = 0 then '""' else concat('"e-', p_partkey + 1, '"') end,
             ',"confidence":"', conf_b, '"{c}]',
             ',"instruments":[{o}"tag":"PT-', p_partkey, '","attached_to_line_between":["E-', p_partkey, '"',
             case when p_partkey % 5 = 0 then '' else concat(',"e-', p_partkey + 2, '"') end,
             '],"confidence":"', conf_a, '"{c}]',
             ',"confidence_flags":[', case when p_partkey % 8 = 0 then concat('"blurred tag ', p_partkey, '"') else '' end,
             ']', case when p_partkey % 29 = 0 then '' else '{c}' end) as payload
    from (select *, case p_size % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as conf_a,
                    case p_size % 4 when 0 then 'low' else 'high' end as conf_b
          from {d.table('part')}) x"""


def _log_payloads(d):
    o, c = d.open_brace, d.close_brace
    return f"""
    select concat('LOG-', event_id) as document_id,
           event_id % 31 = 0 as document_low_confidence,
           {d.plus_minutes(d.ts('2024-03-01 00:00:30'), 'event_id')} as received_at,
           concat('{o}"entries":[{o}"Asset_ID":" p-', 100 + user_id, '","Failure_Mode":"', event_type, '","Date":',
             case event_id % 3 when 0 then concat('"', cast(cast(ts as date) as string), '"')
                               when 1 then 'null' else '"05/01/2024"' end,
             ',"Technician_Notes":', case when event_id % 5 = 0 then '""' else concat('"note ', event_id, '"') end,
             ',"confidence":"', case when event_id % 4 = 0 then 'low' else 'high' end, '"{c},',
             '{o}"Asset_ID":', case when event_id % 7 = 0 then 'null' else concat('"T-', 100 + event_id % 50, '"') end,
             ',"Failure_Mode":"leak","Date":"2024-02-0', 1 + event_id % 9, '","Technician_Notes":null,"confidence":"medium"{c}]',
             ',"confidence_flags":[', case when event_id % 16 = 0 then '"page 2 unreadable"' else '' end, ']{c}') as payload
    from {d.table('events')}"""


def _node_updates(d):
    return f"""
    select concat(' c-', o_custkey * 2) as tag, o_orderkey as seq,
           case when o_orderkey % 3 = 0 then null else o_orderpriority end as name,
           case when o_orderkey % 4 = 0 then null else lower(o_orderstatus) end as type,
           case when o_orderkey % 5 = 0 then concat('DOC-', o_orderkey) else null end as source_document_id
    from {d.table('orders')}"""


def _known_equipment(d):
    return f"select concat('E-', s_suppkey * 3) as id from {d.table('supplier')}"


def _edge_updates(d):
    return f"""
    select concat('c-', o_custkey, ' ') as src,
           case o_orderkey % 4 when 0 then 'controls' when 1 then 'feeds_into' when 2 then 'part_of' else 'weird' end as rel,
           concat('S-', o_orderkey % 1201) as dst,
           case when o_orderkey % 2 = 0 then 'manual' else 'import' end as source,
           case when o_orderkey % 3 = 0 then 'high' else null end as confidence, o_orderkey as seq
    from {d.table('orders')}"""


def _requests(d):
    return f"select concat('client-', user_id) as client, event_id as request_id, ts from {d.table('events')}"


def _stage_events(d):
    return f"""
    select concat('DOC-', user_id) as document_id,
           concat('file-', user_id, '.pdf') as filename,
           case event_id % 9 when 0 then 'upload_received' when 1 then 'file_parsed'
                when 2 then 'structured_extraction' when 3 then 'json_validation'
                when 4 then 'confidence_scoring' when 5 then 'graph_merge'
                when 6 then 'vector_index_update' when 7 then 'review_queue' else 'query_readiness' end as stage,
           case event_type when 'error' then 'failed' when 'click' then 'skipped' when 'view' then 'running'
                           else 'completed' end as status,
           concat('event ', event_id) as message,
           ts as updated_at
    from {d.table('events')}"""


def _runs(d):
    return f"""
    select concat('DOC-', event_id) as document_id, event_type <> 'error' as succeeded,
           event_id % 40 as chunks, event_id % 12 as pages, event_id % 5 as tags,
           event_id % 3 as low_confidence, cast(event_id % 13 = 0 as int) as recovered,
           event_id % 7 as graph_writes
    from {d.table('events')}"""


def _questions(d):
    return f"""
    select concat('Q-', conv_id, '-', turn) as question_id, conv_id, turn,
           concat('Is pump P-', 100 + conv_id % 150, ' safe near OISD tank ', turn, '? ', text) as question,
           case when conv_id % 2 = 0 then 'Medium' when conv_id % 3 = 0 then 'high' else 'LOW' end as answer_confidence
    from {d.table('conversations')}
    where role = 'user'"""


def _retrieved(d):
    # One fifth of the pick range lies past the last document, so some questions retrieve nothing.
    n = f"(select count(*) from {d.table('documents')})"
    return f"""
    select q.question_id, q.rank as rank, case when q.rank % 2 = 0 then concat('Follow-up reading. ', x.text) else x.text end as text, cast(q.rank as double) / 10 as distance,
           case when x.doc_key % 7 = 0 or x.doc_key % 11 = 0 then null else x.id end as document_id,
           case when x.doc_key % 11 = 0 then null else x.id end as doc_id,
           x.original_filename as filename,
           q.rank - 1 as chunk_index,
           case when x.doc_key % 3 = 0 then null else x.doc_key % 20 end as page_number,
           case when x.doc_key % 4 = 0 then 'Scope' else null end as section_header,
           case when x.doc_key % 13 = 0 then '2024-06-15' when x.doc_key % 17 = 0 then 'unknown' else null end as last_reviewed,
           case when x.doc_key % 19 = 0 then '03/04/2023' else null end as review_date
    from (select question_id, rank,
                 (conv_id * 31 + turn * 7 + {d.idiv('rank', '2')} * 13) % ({n} + {d.idiv(n, '4')}) as pick
          from v_questions {d.series(1, 5, 'rank')}) q
    join v_documents x on x.doc_key = q.pick"""


def _graph_context(d):
    return f"""
    select question_id, hop as item,
           case when hop = 1 then concat('V-', 200 + conv_id % 50) else null end as tag,
           case when hop = 2 then concat('p-', 100 + conv_id % 150) else null end as source,
           case when hop > 1 then concat('HE-', 300 + turn % 20) else null end as target,
           case when hop = 3 then concat('P-', 100 + conv_id % 150, ' -[:CONNECTED_TO]- XV-', 200 + turn) else null end as path,
           case when hop = 1 then 'connected_to' else 'feeds_into' end as relationship,
           hop as depth,
           case when hop = 2 then concat('near tk-', 40 + conv_id % 9) else null end as attribute_text
    from v_questions {d.series(1, 3, 'hop')}
    where conv_id % 6 <> 5"""


def _answers(d):
    return f"""
    select concat('Q-', u.conv_id, '-', u.turn) as question_id,
           concat(coalesce(a.text, ''), case u.conv_id % 4 when 0 then '
[Confidence: High]' when 1 then ' [confidence:low]' when 2 then ' [Confidence: Medium]' else '' end,
             case when u.conv_id % 7 = 0 then ' See P-777 and v-204.' else '' end) as answer,
           u.conv_id % 900 + 100 as response_time_ms
    from {d.table('conversations')} u
    left join {d.table('conversations')} a on a.conv_id = u.conv_id and a.turn = u.turn + 1
    where u.role = 'user'"""


def _verdicts(d):
    return f"""
    select concat('RID-', l.doc_id % 43) as rule_id, concat('DOC-', l.doc_id) as document_id,
           concat(case when l.doc_id % 9 = 0 then '' else concat('STATUS: ',
                    case when l.quality = 1 then '[COMPLIANT]' when l.toxic = 1 then ' NON_COMPLIANT ' else 'partial' end) end,
                  '
FINDINGS: ', case when l.doc_id % 6 = 0 then '[]' else concat('matches rule
and line ', l.doc_id) end,
                  case when l.doc_id % 5 = 0 then '' else concat('
Recommendation: [update P-', 100 + l.doc_id % 150, ']') end) as verdict_text,
           {d.plus_minutes(d.ts('2024-07-01 00:00:00'), 'l.doc_id')} as checked_at
    from {d.table('labels')} l"""


def _captures(d):
    """Typed technician notes: user turns with an optional asset and severity."""
    return f"""
    select concat('CAP-', conv_id, '-', turn) as capture_id,
           concat(case conv_id % 5 when 0 then 'URGENT leak on p-' when 1 then 'Monitor vibration at P-'
                    when 2 then 'कंपन और रिसाव P-' when 3 then 'Should replace seal, check P-' else 'All fine near ' end,
                  100 + conv_id % 150, case when turn % 2 = 0 then 'B and TK-4011. ' else '. ' end, text) as text,
           case when conv_id % 3 = 0 then '' else concat(' p-', 100 + conv_id % 150, ' ') end as equipment_tag,
           case when turn % 2 = 0 then 'Major' else 'ROUTINE' end as severity,
           concat('tech-', conv_id % 12) as inspector_name,
           concat('DOC-', conv_id) as document_id
    from {d.table('conversations')}
    where role = 'user'"""


VIEWS: dict[str, Callable] = {
    "v_inspections": _inspections,
    "v_equipment": _equipment,
    "v_asset_links": _asset_links,
    "v_documents": _documents,
    "v_sectioned": _sectioned,
    "v_pages": _pages,
    "v_ocr_words": _ocr_words,
    "v_files": _files,
    "v_query_logs": _query_logs,
    "v_rules": _rules,
    "v_checks": _checks,
    "v_nodes": _nodes,
    "v_edges": _edges,
    "v_rule_nodes": _rule_nodes,
    "v_rule_edges": _rule_edges,
    "v_pid_payloads": _pid_payloads,
    "v_log_payloads": _log_payloads,
    "v_node_updates": _node_updates,
    "v_edge_updates": _edge_updates,
    "v_known_equipment": _known_equipment,
    "v_requests": _requests,
    "v_stage_events": _stage_events,
    "v_runs": _runs,
    "v_questions": _questions,
    "v_retrieved": _retrieved,
    "v_graph_context": _graph_context,
    "v_answers": _answers,
    "v_verdicts": _verdicts,
    "v_captures": _captures,
}

# Views and named fragments an operator's check query may mention; the check
# modules add theirs.
CHECK_FRAGMENTS: dict[str, str] = {}

def duck_round(x: str, digits: int = 2) -> str:
    """The check engine's text for rounding a double half-even on its binary value."""
    scale = f"{10**digits}::double"
    x = f"({x})::double"
    error = (
        f"((({x} * 134217729::double) - (({x} * 134217729::double) - {x})) * {scale} - {x} * {scale})"
        f" + ({x} - (({x} * 134217729::double) - (({x} * 134217729::double) - {x}))) * {scale}"
    )
    half = f"({x} * {scale} - floor({x} * {scale}))"
    up = f"({half} > 0.5 or ({half} = 0.5 and (({error}) > 0 or (({error}) = 0 and floor({x} * {scale}) % 2 <> 0))))"
    return f"((floor({x} * {scale}) + case when {up} then 1::double else 0::double end) / {scale})"


_NAME = re.compile(r"\b(?:v|x)_[a-z_0-9]+\b")


def _closure(text: str, render: Callable[[str], str | None]) -> list[tuple[str, str]]:
    """Named fragments ``text`` needs, dependencies first."""
    ordered: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in ordered:
            return
        body = render(name)
        if body is None:
            return
        for inner in dict.fromkeys(_NAME.findall(body)):
            if inner != name:
                visit(inner)
        ordered[name] = body

    for name in dict.fromkeys(_NAME.findall(text)):
        visit(name)
    return list(ordered.items())


def duck_sql(text: str) -> str:
    """Check SQL with the definitions of every ``v_*``/``x_*`` name it mentions prepended."""
    dialect = DuckDialect()

    def render(name: str) -> str | None:
        if name in CHECK_FRAGMENTS:
            return CHECK_FRAGMENTS[name]
        return VIEWS[name](dialect) if name in VIEWS else None

    ctes = ",\n".join(f"{name} as ({body})" for name, body in _closure(text, render))
    stripped = text.strip()
    if not ctes:
        return stripped
    if stripped.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{stripped[len('with recursive'):]}"
    if stripped.lower().startswith("with"):
        return f"with recursive {ctes},\n{stripped[len('with'):]}"
    return f"with recursive {ctes}\n{stripped}"


class Tables:
    """Raw tables by ``raw(name)``, domain views by attribute, of one data directory."""

    def __init__(self, spark: SparkSession, folder: str, spread_scans: bool = False):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.spread_scans = spread_scans
        self.replaced: dict[str, DataFrame] = {}

    def replacing(self, **tables: DataFrame) -> Tables:
        """The same views with some raw tables given, such as a micro-batch."""
        other = Tables(self.spark, self.folder, self.spread_scans)
        other.replaced = {**self.replaced, **tables}
        return other

    def raw(self, name: str) -> DataFrame:
        if name in self.replaced:
            return self.replaced[name]
        scan = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(scan) if self.spread_scans else scan

    @property
    def spread(self) -> Tables:
        """The same tables for row-wise heavy work, see ``session.spread``."""
        other = Tables(self.spark, self.folder, spread_scans=True)
        other.replaced = dict(self.replaced)
        return other

    @property
    def edges(self) -> DataFrame:
        """The rows of ``v_edges``, with lines of an order and supplier told apart by their keys, which are shorter than names."""
        name = lambda letter, key: F.concat(F.lit(f"{letter}-"), key)
        edge = lambda df, src, rel, dst: df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
        supplied = self.raw("lineitem").select("l_orderkey", "l_suppkey").distinct()
        parts = [
            edge(self.raw("orders"), name("O", "o_orderkey"), "feeds_into", name("C", "o_custkey")),
            edge(self.raw("customer"), name("C", "c_custkey"), "part_of", name("N", "c_nationkey")),
            edge(self.raw("supplier"), name("S", "s_suppkey"), "part_of", name("N", "s_nationkey")),
            edge(self.raw("nation"), name("N", "n_nationkey"), "part_of", name("R", "n_regionkey")),
            edge(supplied, name("O", "l_orderkey"), "connected_to", name("S", "l_suppkey")),
        ]
        return reduce(DataFrame.unionByName, parts)

    @property
    def rule_edges(self) -> DataFrame:
        """The rows of ``v_rule_edges``, with repeats dropped ahead of its joins: tags of a document meet its checks only once."""
        rules, checks, seen = self.rules, self.checks, self.inspections
        edge = lambda df, src, rel, dst: df.select(F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(dst).alias("dst"))
        judged = checks.join(rules.select(F.col("id").alias("rule_id"), "rule_code"), "rule_id")
        handled = seen.select("equipment_tag", F.col("source_document_id").alias("document_id")).distinct()
        documents = checks.groupBy("id").agg(F.collect_set("document_id").alias("documents"))
        # only checks of several documents can meet a tag more than once
        of_one = documents.where(F.size("documents") == 1).select("id", F.col("documents")[0].alias("document_id"))
        of_many = documents.where(F.size("documents") > 1).select("id", F.explode("documents").alias("document_id"))
        # few documents can hold most pairs: the checks of one are dealt into cells, so that its pairs are made by many tasks
        cells = of_one.groupBy("document_id").agg(F.ceil(F.count("*") / CHECKS_PER_CELL).alias("cells"))
        asked = handled.join(cells.select("document_id", F.explode(F.sequence(F.lit(1), "cells")).alias("cell")), "document_id")
        dealt = of_one.join(cells, "document_id").select("id", "document_id", (F.pmod(F.xxhash64("id"), "cells") + 1).alias("cell"))
        at = ["document_id", "cell"]
        checked = deal(asked, *at).join(deal(dealt, *at), at).select("equipment_tag", "id").unionByName(
            handled.join(of_many, "document_id").select("equipment_tag", "id").distinct()
        )
        subject = handled.join(judged.select("document_id", "rule_code").distinct(), "document_id").select("equipment_tag", "rule_code").distinct()
        parts = [
            edge(rules, "regulation_body", "ISSUES", "rule_code"),
            edge(rules, "rule_code", "APPLIES_TO_CATEGORY", "category"),
            edge(judged, "id", "EVALUATES", "rule_code"),
            edge(checks, "document_id", "HAS_COMPLIANCE_CHECK", "id"),
            edge(seen, "equipment_tag", "HAD_EVENT", "id"),
            edge(checked, "equipment_tag", "HAS_COMPLIANCE_CHECK", "id"),
            edge(subject, "equipment_tag", "SUBJECT_TO", "rule_code"),
        ]
        return reduce(DataFrame.unionByName, parts)

    def __getattr__(self, name: str) -> DataFrame:
        key = f"v_{name}"
        if key not in VIEWS:
            raise AttributeError(name)
        dialect = SparkDialect()
        parts = _closure(key, lambda n: VIEWS[n](dialect) if n in VIEWS else None)
        ctes = ", ".join(f"{n} as ({body})" for n, body in parts)
        text = f"with {ctes} select * from {key}"
        used = {n: self.raw(n) for n in RAW_TABLES if "{" + n + "}" in text}
        # a micro-batch lives in a session of its own
        session = next((df.sparkSession for n, df in used.items() if n in self.replaced), self.spark)
        return session.sql(text, **used)
