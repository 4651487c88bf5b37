"""Named chunking queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions.common import strip, unnest
from millwright.functions.text import CHUNK_SENTENCE_ENDS
from millwright.operators import chunking as ch
from millwright.plans.registry import query
from millwright.plans.text import duck_sentences, duck_strip
from millwright.plans.views import CHECK_FRAGMENTS

HEADER = r"(?m)^(#{1,3}|\d+\.\d*|[A-Z][A-Z\s]{3,}:)\s"


def packing(source: str, prefix: str, size: int = 800, overlap: int = 100) -> dict[str, str]:
    """Recursive packing of ``source(key, body)`` into numbered packs, as fragments."""
    tail = f"{duck_strip(f'pack[-{overlap}:]')}"
    return {
        f"x_{prefix}_sentences": f"""
            select key, s[i] as sentence, i, body from (
              select key, body, {duck_sentences('body', CHUNK_SENTENCE_ENDS)} as s from {source}), unnest(range(1, len(s) + 1)) as u(i)""",
        f"x_{prefix}_fold": f"""
            select key, i, sentence as pack, 0 as no, cast(null as varchar) as flushed
              from x_{prefix}_sentences where i = 1
            union all
            select f.key, s.i,
                   case when length(pack) + 1 + length(s.sentence) > {size}
                        then case when {tail} = '' then '' else {tail} || ' ' end || s.sentence
                        else pack || ' ' || s.sentence end,
                   case when length(pack) + 1 + length(s.sentence) > {size} then no + 1 else no end,
                   case when length(pack) + 1 + length(s.sentence) > {size} then pack end
              from x_{prefix}_fold f join x_{prefix}_sentences s on s.key = f.key and s.i = f.i + 1""",
        f"x_{prefix}_packs": f"""
            select key, no - 1 as no, flushed as text from x_{prefix}_fold where flushed is not null
            union all
            select key, no, pack from (select key, no, pack, row_number() over (partition by key order by i desc) as r from x_{prefix}_fold) where r = 1""",
    }


CHECK_FRAGMENTS.update(x_doc_bodies=f"select id as key, {duck_strip('text')} as body from v_documents")
CHECK_FRAGMENTS.update(packing("x_doc_bodies", "doc"))
CHECK_FRAGMENTS.update(packing("x_doc_bodies", "tight", 200, 30))
CHECK_FRAGMENTS.update(
    x_doc_chunks="""
        select key as document_id, text, row_number() over (partition by key order by no) - 1 as chunk_index,
               count(*) over (partition by key) as total_chunks
        from x_doc_packs where length(text) >= 50""",
    x_page_bodies=f"select document_id || '~' || page_number as key, {duck_strip('text')} as body from v_pages",
    x_section_parts=f"""
        select id, string_split(regexp_replace({duck_strip('text')}, '{HEADER}', chr(1) || '\\0', 'g'), chr(1)) as parts, text
        from v_sectioned""",
    x_sections=f"""
        select id, n, i, b as body, {duck_strip("regexp_extract(b, '^([^\\n]*)', 1)")} as header
        from (select id, len(parts) - 1 as n, i, {duck_strip('parts[i + 1]')} as b
              from x_section_parts, unnest(range(1, len(parts))) as u(i))""",
    x_section_bodies=f"""
        select id || '~' || i as key, body from x_sections where n >= 2
        union all
        select id || '~0', {duck_strip('text')} from x_section_parts where len(parts) < 3""",
)
CHECK_FRAGMENTS.update(packing("x_page_bodies", "page"))
CHECK_FRAGMENTS.update(packing("x_section_bodies", "sec"))
CHECK_FRAGMENTS.update(
    x_sec_texts="""
        select string_split(p.key, '~')[1] as id, string_split(p.key, '~')[2]::int as i, p.no, s.header,
               case when s.header is not null and s.header <> '' and not starts_with(p.text, s.header)
                    then s.header || chr(10) || p.text else p.text end as text
        from x_sec_packs p left join x_sections s on s.n >= 2 and s.id || '~' || s.i = p.key""",
)


def documents(t):
    return t.spread.documents.select(F.col("id").alias("document_id"), "text", "original_filename")


def digest(column="text"):
    return F.md5(F.col(column).cast("binary"))


@query(
    "chunk_sentences",
    "select key as document_id, no as chunk_index, md5(text) as digest, length(text) as n from x_doc_packs",
)
def _(t):
    docs = documents(t)
    chunks = ch.sentence_chunks(strip(F.col("text")))
    rows = unnest(docs, ["document_id"], chunks, "c", "chunk_index")
    return rows.select(
        "document_id", F.col("chunk_index").cast("long").alias("chunk_index"),
        F.md5(F.col("c.text").cast("binary")).alias("digest"), F.length("c.text").cast("long").alias("n"),
    )


@query(
    "chunk_sentences_small",
    "select key as document_id, no as chunk_index, md5(text) as digest, length(text) as n from x_tight_packs",
)
def _(t):
    docs = documents(t)
    chunks = ch.sentence_chunks(strip(F.col("text")), 200, 30)
    rows = unnest(docs, ["document_id"], chunks, "c", "chunk_index")
    return rows.select(
        "document_id", F.col("chunk_index").cast("long").alias("chunk_index"),
        F.md5(F.col("c.text").cast("binary")).alias("digest"), F.length("c.text").cast("long").alias("n"),
    )


@query(
    "chunk_offsets",
    """with ordered as (select p.key, p.no, p.text, b.body from x_doc_packs p join x_doc_bodies b on b.key = p.key),
       placed as (
         select key, no, text, body, case when position(text in body) > 0 then position(text in body) - 1 else 0 end as char_start,
                case when position(text in body) > 0 then position(text in body) - 1 + length(text) else 0 end as next_offset
           from ordered where no = 0
         union all
         select o.key, o.no, o.text, o.body,
                case when position(o.text in o.body[p.next_offset + 1:]) > 0 then p.next_offset + position(o.text in o.body[p.next_offset + 1:]) - 1 else p.next_offset end,
                case when position(o.text in o.body[p.next_offset + 1:]) > 0 then p.next_offset + position(o.text in o.body[p.next_offset + 1:]) - 1 + length(o.text) else p.next_offset end
           from placed p join ordered o on o.key = p.key and o.no = p.no + 1)
       select key as document_id, no as chunk_index, char_start, char_start + length(text) as char_end from placed""",
)
def _(t):
    rows = unnest(documents(t), ["document_id"], ch.sentence_chunks(strip(F.col("text"))), "c", "chunk_index")
    return rows.select("document_id", "chunk_index", "c.char_start", "c.char_end")


@query(
    "chunk_sections",
    """select id as document_id, row_number() over (partition by id order by i, no) - 1 as chunk_index, header as section_header,
              md5(text) as digest, length(text) as n from x_sec_texts""",
)
def _(t):
    docs = t.spread.sectioned.select(F.col("id").alias("document_id"), F.col("text").alias("body"))
    rows = ch.explode_chunks(docs, ch.section_chunks(strip(F.col("body"))))
    return rows.select(
        "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "section_header", digest().alias("digest"),
        F.length("text").cast("long").alias("n"),
    )


@query(
    "smart_chunk",
    """select document_id, row_number() over (partition by document_id order by i, no) - 1 as chunk_index,
              count(*) over (partition by document_id) as total_chunks, section_header, digest
       from (select id as document_id, i, no, header as section_header, md5(text) as digest from x_sec_texts where length(text) >= 50)""",
)
def _(t):
    docs = t.spread.sectioned.select(F.col("id").alias("document_id"), F.col("text").alias("body"))
    return ch.explode_chunks(docs, ch.smart_chunks(F.col("body"))).select(
        "document_id", F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("total_chunks").cast("long").alias("total_chunks"), "section_header", digest().alias("digest"),
    )


@query(
    "paged_chunks",
    """select string_split(key, '~')[1] as document_id, string_split(key, '~')[2]::int as page_number,
              row_number() over (partition by string_split(key, '~')[1] order by string_split(key, '~')[2]::int, no) - 1 as chunk_index,
              count(*) over (partition by string_split(key, '~')[1]) as total_chunks, md5(text) as digest
       from x_page_packs where length(text) >= 50""",
)
def _(t):
    return ch.paged_chunks(t.spread.pages).select(
        "document_id", F.col("page_number").cast("int").alias("page_number"), "chunk_index", "total_chunks", digest().alias("digest")
    )


@query(
    "chunk_context",
    """select c.document_id, c.chunk_index, sha256(c.document_id || '|' || c.chunk_index) as chunk_id,
              md5('Document: ' || d.original_filename || chr(10) || c.text) as digest,
              'doc_id=' || c.document_id || ';doc_name=' || d.original_filename || ';document_id=' || c.document_id || ';filename=' || d.original_filename as metadata
       from x_doc_chunks c join v_documents d on d.id = c.document_id""",
)
def _(t):
    docs = documents(t).select("document_id", F.col("text").alias("body"), "original_filename")
    chunks = ch.explode_chunks(docs, ch.smart_chunks(F.col("body")))
    named = ch.with_context(chunks, F.col("original_filename"))
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return named.select(
        "document_id", F.col("chunk_index").cast("long").alias("chunk_index"),
        ch.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), digest().alias("digest"),
        F.array_join(pairs, ";").alias("metadata"),
    )



