"""Named trust and answer queries and their check SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millwright.functions import scoring
from millwright.functions import text as tx
from millwright.functions.common import join_lines
from millwright.operators import graph_walk as gw
from millwright.operators import trust as tr
from millwright.plans.registry import CHECKS, query
from millwright.plans.reliability import as_of
from millwright.plans.text import DUCK_CONFIDENCE, STRICT, WIDE, contains_case, duck_date, duck_review_date, duck_sentences, duck_strip, duck_tags
from millwright.plans.views import AS_OF, CHECK_FRAGMENTS

_KEY = "coalesce(nullif(document_id, ''), nullif(doc_id, ''), nullif(filename, ''), 'unknown')"
_GATE = "case risk " + " ".join(f"when '{k}' then '{v}'" for k, v in scoring.GATES.items()) + " end"
_ADVICE = "case risk " + " ".join(f"when '{k}' then '{v}'" for k, v in scoring.RECOMMENDATIONS.items()) + " end"
_LABEL = "case when {0} >= 85 then 'High' when {0} >= 60 then 'Moderate Risk' when {0} >= 40 then 'High Risk' else 'Expired' end"
_DOCRISK = "case when {0} >= 85 then 'Low' when {0} >= 60 then 'Moderate' when {0} >= 40 then 'High' else 'Critical' end"
_INTERVAL = "case document_type " + " ".join(f"when '{k}' then {v}" for k, v in tr.REVIEW_INTERVALS.items()) + " end"

CHECK_FRAGMENTS.update(
    x_ret_groups=f"""
        select question_id, {_KEY} as key, min(rank) as position, count(*) as chunks, arg_min({{'f': filename, 'l': last_reviewed, 'r': review_date}}, rank) as m,
               string_agg(text, chr(10) order by rank) as text from v_retrieved group by 1, 2""",
    x_ret_named="""
        select g.*, coalesce(nullif(d.original_filename, ''), nullif(g.m.f, ''), 'Unknown') as filename, coalesce(d.processed_at, d.uploaded_at) as upload
        from x_ret_groups g left join v_documents d on d.id = g.key""",
    x_ret_dated=f"""
        select *, {contains_case("lower(filename || ' ' || text[1:1000])", tx.DOCUMENT_TYPES, "document")} as document_type,
               {duck_date('(m.l)')} as d1, {duck_date('(m.r)')} as d2, {duck_review_date('text')} as d3 from x_ret_named""",
    x_ret_aged=f"""
        select *, coalesce(d1, d2, d3, upload) as review,
               case when d1 is not null then 'last_reviewed' when d2 is not null then 'review_date' when d3 is not null then 'content'
                    when upload is not null then 'upload_or_processed_date' else 'missing' end as src,
               {_INTERVAL} as span,
               greatest(0, floor((epoch_us(timestamp '{AS_OF}') - epoch_us(coalesce(d1, d2, d3, upload))) / 86400000000.0))::bigint as age from x_ret_dated""",
    x_scores=f"""
        select question_id, key, position, chunks, filename, document_type, strftime(review, '%Y-%m-%d') as last_reviewed, src, age, span,
               case when review is null then 50 else greatest(0, least(100, round_even(100 - ((age::double / span) * 100), 0)))::int end as score
        from (select * replace (case when review is null then null else age end as age) from x_ret_aged)""",
    x_assets=f"""
        select question_id, count(distinct asset) as graph_assets from (
          select question_id, upper(coalesce(nullif(tag, ''), nullif(source, ''), nullif(target, ''))) as asset from v_graph_context
          union all select question_id, unnest({duck_tags('question', WIDE)}) from v_questions) where asset <> '' group by 1""",
    x_doc_lists="""
        select question_id, list({'p': position, 'f': filename, 's': score, 'src': src, 'l': last_reviewed} order by position) as docs, sum(chunks)::bigint as sources from x_scores group by 1""",
    x_trust_base="""
        select q.question_id, q.answer_confidence, d.docs is not null as has_sources, coalesce(d.sources, 0) as sources, coalesce(a.graph_assets, 0) as graph_assets,
               coalesce(d.docs, [{'p': 0, 'f': 'No retrieved source', 's': 0, 'src': 'missing', 'l': null}]) as docs
        from v_questions q left join x_doc_lists d using (question_id) left join x_assets a using (question_id)""",
    x_trust_measured="""
        select *, list_min(list_transform(docs, lambda d: d.s)) as score,
               case when has_sources then p else least(p, 35) end as confidence
        from (select *, case when lower(answer_confidence) like '%high%' then 96 when lower(answer_confidence) like '%low%' then 45 else 72 end as p from x_trust_base)""",
    x_trust_risk="""
        select *, list_filter(docs, lambda d: d.s = score)[1].f as limiting,
               case when not has_sources then 'Critical' when score < 40 or confidence < 50 then 'Critical' when score < 60 or confidence < 70 then 'High'
                    when score < 85 then 'Moderate' else 'Low' end as risk from x_trust_measured""",
    x_trust=f"""
        select *, 100 - score as decay, {_LABEL.format('score')} as freshness, {_GATE} as gate, {_ADVICE} as advice,
               case when risk in ('High', 'Critical') then limiting || ' is the limiting source with freshness ' || score || '%; trust gate requires review before execution.'
                    else 'Freshness gate passed using ' || len(docs) || ' source document(s); limiting source is ' || limiting || ' at ' || score || '%.' end as reason
        from x_trust_risk""",
)


def assets(t):
    asked = t.questions.select("question_id", tx.wide_tags(F.col("question")).alias("equipment_tags"))
    return tr.graph_asset_count(asked, t.graph_context)


def scores(t, type_chars=1000):
    return tr.document_freshness(t.retrieved, t.documents, as_of(), type_chars)


def summary(t, type_chars=1000):
    return tr.trust_summary(t.questions.select("question_id", "answer_confidence"), scores(t, type_chars), assets(t))


# The same steps with the document type read off whole texts.
_TYPED = "x_ret_dated x_ret_aged x_scores x_doc_lists x_trust_base x_trust_measured x_trust_risk x_trust".split()


def _whole(sql: str) -> str:
    return re.sub(r"\bx_\w+\b", lambda m: f"{m[0]}_whole" if m[0] in _TYPED else m[0], sql)


CHECK_FRAGMENTS.update({f"{step}_whole": _whole(CHECK_FRAGMENTS[step]).replace("text[1:1000]", "text") for step in _TYPED})


_FRESHNESS = (
    "question_id", "document_id", "position", "chunks", "filename", "document_type", "last_reviewed", "review_date_source",
    "document_age_days", "expected_review_interval_days", "freshness_score",
)


@query(
    "document_freshness",
    f"""select question_id, key as document_id, position, chunks, filename, document_type, last_reviewed, src as review_date_source, age as document_age_days,
               span as expected_review_interval_days, score as freshness_score from x_scores""",
)
def _(t):
    return scores(t).select(*_FRESHNESS)


@query("document_freshness_whole", _whole(CHECKS["document_freshness"]))
def _(t):
    return scores(t, None).select(*_FRESHNESS)


@query(
    "freshness_bands",
    f"""select question_id, key as document_id, 100 - score as knowledge_decay, {_LABEL.format('score')} as freshness_status, {_DOCRISK.format('score')} as risk_level,
               case src when 'missing' then '{tr.NO_DATE}' when 'upload_or_processed_date' then '{tr.UPLOAD_DATE}'
                    else case when score >= 85 then 'Document is within expected review interval.' when score >= 60 then 'Document is aging and should be reviewed soon.'
                              else 'Document has exceeded or is near the expected review interval.' end end as reason from x_scores""",
)
def _(t):
    return scores(t).select("question_id", "document_id", "knowledge_decay", "freshness_status", "risk_level", "reason")


_SUMMARY = (
    "question_id", "knowledge_decay", "freshness_score", "freshness", "confidence", "risk", "sources", "source_documents",
    "graph_assets", "trust_gate", "recommendation", "reason",
)


@query(
    "trust_summary",
    """select question_id, decay as knowledge_decay, score as freshness_score, freshness, confidence, risk, sources, len(docs)::int as source_documents,
              graph_assets, gate as trust_gate, advice as recommendation, reason from x_trust""",
)
def _(t):
    return summary(t).select(*_SUMMARY)


@query("trust_summary_whole", _whole(CHECKS["trust_summary"]))
def _(t):
    return summary(t, None).select(*_SUMMARY)


@query(
    "trust_flags",
    f"""select question_id, limiting as limiting_document, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i)[1:8], '|') as confidence_flags
        from (select *, list_concat(list_concat(case when has_sources then [] else ['{tr.NO_SOURCES_FLAG}'] end,
                     flatten(list_transform(docs, lambda d: list_concat(case when d.src = 'missing' then [d.f || ' has no explicit review date metadata.'] else [] end,
                                                                        case when d.s < 60 then [d.f || ' is stale or expired.'] else [] end)))),
                     case when risk in ('High', 'Critical') then ['{tr.ESCALATED_FLAG}'] else [] end) as f from x_trust)""",
)
def _(t):
    return summary(t).select("question_id", "limiting_document", join_lines(F.col("confidence_flags")).alias("confidence_flags"))


@query("graph_asset_count", "select q.question_id, coalesce(a.graph_assets, 0) as graph_assets from v_questions q left join x_assets a using (question_id)")
def _(t):
    return assets(t)


CHECK_FRAGMENTS.update(
    x_citations="""
        select r.question_id, r.rank, coalesce(nullif(r.filename, ''), 'Unknown') as filename, coalesce(r.chunk_index, 0) as chunk_index, r.text[1:300] as text_preview,
               nullif(r.page_number, 0) as page_number, coalesce(r.section_header, '') as section, coalesce(nullif(r.document_id, ''), nullif(r.doc_id, '')) as document_id,
               coalesce(a.score, b.score) as freshness_score, case when a.key is not null then a.last_reviewed else b.last_reviewed end as last_reviewed
        from v_retrieved r
        left join x_scores a on a.question_id = r.question_id and a.key = coalesce(nullif(r.document_id, ''), nullif(r.doc_id, ''))
        left join (select question_id, lower(filename) as name, arg_max(score, position) as score, arg_max(last_reviewed, position) as last_reviewed from x_scores group by 1, 2) b
          on b.question_id = r.question_id and b.name = lower(r.filename)""",
)


@query("citations", "select * from x_citations")
def _(t):
    return tr.citations(t.retrieved, scores(t)).select(
        "question_id", "rank", "filename", "chunk_index", "text_preview", "page_number", "section", "document_id", "freshness_score", "last_reviewed"
    )


_FLAT = duck_strip("replace(text, chr(10), ' ')")
CHECK_FRAGMENTS.update(
    x_said=f"""
        select question_id, rank, unnest(s) as sentence, unnest(range(0, len(s))) as place from (
          select question_id, rank, {duck_sentences(_FLAT)} as s from v_retrieved where rank <= 5)""",
    x_asked="""
        select question_id, list_filter(list_distinct(list_transform(regexp_extract_all(question, '[A-Za-z0-9-]+'), lambda x: lower(x))), lambda x: length(x) > 2) as asked from v_questions""",
    x_picked_sentences="""
        select question_id, sentence, row_number() over (partition by question_id order by score desc, rank, place) as n from (
          select question_id, sentence, score, rank, place, row_number() over (partition by question_id, sentence order by rank, place) as copy from (
            select s.*, len(list_intersect(a.asked, list_distinct(list_transform(regexp_extract_all(s.sentence, '[A-Za-z0-9-]+'), lambda x: lower(x))))) as score
            from x_said s join x_asked a using (question_id))) where copy = 1""",
    x_answers_extracted=f"""
        select q.question_id, case when s.source is null then '{tr.NO_MATCH}' else 'Based on ' || s.source || ': ' || coalesce(e.evidence, '') || chr(10) || chr(10) || '{tr.FALLBACK_NOTE}' end as answer
        from v_questions q left join (select question_id, arg_min(filename, rank) as source from v_retrieved group by 1) s using (question_id)
        left join (select question_id, (string_agg(sentence, ' ' order by n))[1:1200] as evidence from x_picked_sentences where n <= 4 group by 1) e using (question_id)""",
)


@query("extractive_answer", "select * from x_answers_extracted")
def _(t):
    return tr.extractive_answer(t.questions, t.retrieved)


@query(
    "prompt_context",
    """select q.question_id, coalesce(d.digest, md5('No retrieved document context.')) as document_digest,
              coalesce(g.bullets, 'No equipment graph context provided.') as graph_context,
              'Knowledge Decay=' || t.decay || '; Freshness=' || t.freshness || '; Risk=' || t.risk || '; Trust Gate=' || t.gate || '; Recommendation=' || t.advice as trust_context
       from v_questions q join x_trust t using (question_id)
       left join (select question_id, md5(string_agg('Source: ' || filename || ' | Section: chunk ' || (chunk_index + 1) || chr(10) || text || chr(10) || '---', chr(10) order by rank)) as digest
                  from v_retrieved group by 1) d using (question_id)
       left join (select question_id, string_agg(case when path is not null then '- Graph path: ' || path
                    else '- ' || coalesce(tag, 'Unknown') || ': relationship=' || relationship || ', depth=' || depth end, chr(10) order by item) as bullets
                  from v_graph_context group by 1) g using (question_id)""",
)
def _(t):
    return tr.prompt_context(t.questions, t.retrieved, t.graph_context, summary(t)).select(
        "question_id", F.md5(F.col("document_context").cast("binary")).alias("document_digest"), "graph_context", "trust_context"
    )


_EVIDENCE = (
    "array_to_string(list_transform(docs[1:4], lambda d: '- ' || d.f || ': ' || d.s || '% fresh, last reviewed ' || coalesce(d.l, 'unknown review date') || ', risk ' || "
    "case when d.s >= 85 then 'Low' when d.s >= 60 then 'Moderate' when d.s >= 40 then 'High' else 'Critical' end), chr(10))"
)
CHECK_FRAGMENTS.update(
    x_rendered=f"""
        select question_id, 'Trust Summary' || chr(10) || 'Knowledge Decay: ' || decay || '%' || chr(10) || 'Freshness: ' || freshness || chr(10) || 'Confidence: ' || confidence || '%'
               || chr(10) || 'Risk: ' || risk || chr(10) || 'Sources: ' || sources || chr(10) || 'Graph Assets: ' || graph_assets || chr(10) || 'Trust Gate: ' || gate
               || chr(10) || chr(10) || 'Reason:' || chr(10) || reason || chr(10) || chr(10) || 'Freshness Evidence:' || chr(10) || {_EVIDENCE}
               || chr(10) || chr(10) || 'Recommendation:' || chr(10) || advice as trust from x_trust""",
    x_given_answers="""
        select question_id, case when answer = '' then '' when response_time_ms % 5 = 0 then ' Trust summary: ' || answer else answer end as answer from v_answers""",
)


@query(
    "render_trust",
    f"""select question_id, case when starts_with(lower(a), 'trust summary') then a when a = '' then trust else trust || chr(10) || chr(10) || 'Answer' || chr(10) || a end as answer
        from (select r.question_id, r.trust, {duck_strip('g.answer')} as a from x_rendered r join x_given_answers g using (question_id))""",
)
def _(t):
    given = t.answers.select(
        "question_id",
        F.when(F.col("answer") == "", "").when(F.col("response_time_ms") % 5 == 0, F.concat(F.lit(" Trust summary: "), "answer"))
        .otherwise(F.col("answer")).alias("answer"),
    )
    return tr.decorated_answers(given, summary(t))


@query(
    "answer_log_append",
    f"""select q.question_id as id, q.question, 'en' as language, a.answer, coalesce(s.sources, '[]') as sources,
               case {DUCK_CONFIDENCE.replace('answer', 'a.answer')} when 'High' then 0.9::double when 'Low' then 0.3::double else 0.6::double end as confidence,
               a.response_time_ms, 'web' as channel, timestamp '{AS_OF}' as created_at
        from v_questions q join v_answers a using (question_id)
        left join (select question_id, '[' || string_agg('"' || filename || '"', ',' order by rank) || ']' as sources from v_retrieved group by 1) s using (question_id)""",
)
def _(t):
    return tr.answer_log(t.questions.select("question_id", "question"), t.answers, t.retrieved, "web", as_of())


CHECK_FRAGMENTS.update(
    x_answered=f"""
        select question_id, list(tag order by place) as tags from (
          select question_id, unnest(g) as tag, unnest(range(0, len(g))) as place from (select question_id, {duck_tags('answer', STRICT)} as g from v_answers))
        where tag in (select equipment_tag from v_inspections union select tag from v_equipment) group by 1""",
    x_mentioned=f"""
        select question_id, list_filter(l, lambda x, i: list_position(l, x) = i) as equipment from (
          select q.question_id, list_concat(list_concat({duck_tags('q.question', WIDE)}, coalesce(c.graph_tags, [])), coalesce(a.tags, [])) as l
          from v_questions q left join x_context_tags c using (question_id) left join x_answered a using (question_id))""",
)


def mentioned(t):
    nodes = t.inspections.select(F.col("equipment_tag").alias("id")).union(t.equipment.select("tag")).distinct()
    return tr.mentioned_equipment(t.questions, gw.context_tags(t.graph_context, t.questions), t.answers, nodes)


@query("mentioned_equipment", "select question_id, array_to_string(equipment, '|') as equipment from x_mentioned")
def _(t):
    return mentioned(t).withColumn("equipment", join_lines(F.col("equipment")))


@query(
    "answer_cards",
    """with x_first as (select question_id, arg_min({'f': filename, 'p': page_number, 'c': chunk_index}, rank) as s from x_citations group by 1),
            x_rows as (select t.*, a.answer, coalesce(m.equipment, []) as eq, f.s as s from x_trust t join v_answers a using (question_id)
                       left join x_mentioned m using (question_id) left join x_first f using (question_id))
       select question_id, 'procedure' as card, case when s is not null then 'Source cited' else 'Evidence missing' end as status,
              'Primary source: ' || coalesce(s.f, 'No citation returned') || '|Page / chunk: ' || case when s.p is not null then 'Page ' || s.p when s is not null then 'Chunk ' || (s.c + 1) else 'Not returned' end
              || '|Answer length: ' || case when answer = '' then 'No answer text' else length(answer) || ' chars' end as lines,
              case when s is null then 'No source citation returned. Treat as insufficient evidence until documents are indexed.' end as caveat from x_rows
       union all
       select question_id, 'graph', case when len(eq) > 0 then len(eq) || ' asset tags' else 'No tags returned' end,
              'Connected assets: ' || case when len(eq) > 0 then array_to_string(eq[1:5], ', ') else 'None returned' end || '|Graph assets: ' || graph_assets,
              case when len(eq) = 0 then 'No equipment tags were returned by the backend for this answer.' end from x_rows
       union all
       select question_id, 'confidence', gate, 'Knowledge Decay: ' || decay || '%|Freshness: ' || freshness || '|Risk: ' || risk || '|Sources: ' || sources, advice from x_rows""",
)
def _(t):
    cited = tr.citations(t.retrieved, scores(t))
    return tr.answer_cards(summary(t), cited, mentioned(t), t.answers).withColumn("lines", join_lines(F.col("lines")))
