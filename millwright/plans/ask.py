"""The ask pipeline as one named query; its check SQL reuses that of the single steps."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millwright.operators import ask
from millwright.operators import chunking as ch
from millwright.plans import chunking, graph_walk, trust, vectors  # noqa: F401  their fragments are used here
from millwright.plans.graph_walk import WALKS
from millwright.plans.registry import query
from millwright.plans.reliability import as_of
from millwright.plans.vectors import duck_hash_entries
from millwright.plans.views import AS_OF, CHECK_FRAGMENTS

# Steps of the trust checks that are repeated over what the search and the walk really found.
_STEPS = """x_ret_groups x_ret_named x_ret_dated x_ret_aged x_scores x_doc_lists x_trust_base x_trust_measured x_trust_risk x_trust
            x_rendered x_said x_picked_sentences x_answers_extracted x_context_tags x_answered x_mentioned x_assets""".split()
_RENAMED = {step: f"{step}_ask" for step in _STEPS} | {
    "v_retrieved": "x_ask_retrieved", "v_graph_context": "x_ask_context", "v_answers": "x_answers_extracted_ask",
    "x_chunk_entries": "x_ask_entries", "x_chunk_norms": "x_ask_norms",
}


def _again(sql: str) -> str:
    return re.sub(r"\b[xv]_\w+\b", lambda m: _RENAMED.get(m[0], m[0]), sql)


CHECK_FRAGMENTS.update(
    x_ask_entries=duck_hash_entries("x_doc_chunks", "document_id, chunk_index", "text", ""),
    x_ask_norms="select document_id, chunk_index, sqrt(sum(weight * weight)) as norm from x_ask_entries group by all",
    x_ask_found=_again(CHECK_FRAGMENTS["x_found"]),
    x_ask_retrieved="""
        select f.question_id, f.rank, c.text, f.document_id, null::varchar as doc_id, d.original_filename as filename, f.chunk_index::bigint as chunk_index,
               null::bigint as page_number, null::varchar as section_header, null::varchar as last_reviewed, null::varchar as review_date
        from x_ask_found f join x_doc_chunks c on c.document_id = f.document_id and c.chunk_index = f.chunk_index
        join v_documents d on d.id = f.document_id where f.rank <= 5""",
    x_ask_context=WALKS + """
        select question_id, row_number() over (partition by question_id order by depth, path) as item, node as tag, null::varchar as source, null::varchar as target,
               path, null::varchar as relationship, depth, null::varchar as attribute_text from (
          select *, row_number() over (partition by question_id order by depth, s, used) as r from (select * from x_w1 union all select * from x_w2)) where r <= 30""",
    **{_RENAMED[step]: _again(CHECK_FRAGMENTS[step]) for step in _STEPS},
)
CHECK_FRAGMENTS["x_assets_ask"] = """
    select question_id, count(distinct asset) as graph_assets from (
      select question_id, upper(coalesce(nullif(tag, ''), nullif(source, ''), nullif(target, ''))) as asset from x_ask_context
      union all select question_id, upper(unnest(equipment)) from x_mentioned_ask) where asset <> '' group by 1"""
CHECK_FRAGMENTS["x_trust_base_ask"] = CHECK_FRAGMENTS["x_trust_base_ask"].replace("q.answer_confidence", "'Medium' as answer_confidence")


@query(
    "ask_questions",
    f"""select q.question_id as id, q.question, 'en' as language, md5(r.trust || chr(10) || chr(10) || 'Answer' || chr(10) || a.answer) as digest,
               coalesce(s.sources, '[]') as sources, 0.6::double as confidence, timestamp '{AS_OF}' as created_at
        from v_questions q join x_rendered_ask r using (question_id) join x_answers_extracted_ask a using (question_id)
        left join (select question_id, '[' || string_agg('"' || filename || '"', ',' order by rank) || ']' as sources from x_ask_retrieved group by 1) s using (question_id)""",
)
def _(t):
    """Every question against the chunks of all documents and the graph of assets and rules, down to the log rows."""
    chunks = ch.document_chunks(t.spread.documents.select(F.col("id").alias("document_id"), "text"), offsets=False)
    nodes = t.inspections.select(F.col("equipment_tag").alias("id")).union(t.equipment.select("tag")).distinct()
    logged = ask.ask_questions(t.questions, chunks, t.documents, nodes, t.rule_edges, as_of())
    return logged.select(
        "id", "question", "language", F.md5(F.col("answer").cast("binary")).alias("digest"), "sources", "confidence", "created_at"
    )
