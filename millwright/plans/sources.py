"""Named source and sink queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions.text import EXTENSION_FORMATS
from millwright.operators import chunking as ch
from millwright.plans.registry import query
from millwright.plans.text import DUCK_SUFFIX, duck_clean
from millwright.plans.views import CHECK_FRAGMENTS
from millwright.session import cut_lineage, new_folder
from millwright.sources import files as fl
from millwright.sources import payloads as pl
from millwright.sources import stores

_MAGIC = " ".join(f"when starts_with(hex(content), '{digits}') then '{kind}'" for digits, kind in fl.MAGIC)
CHECK_FRAGMENTS.update(
    x_formats=f"""
        select *, case {_MAGIC}
             when starts_with(hex(content), '{fl.OLE_MAGIC}') then case when e in ('doc', 'xls', 'msg') then e else 'doc' end
             when contains(hex(content)[1:2048], hex('SECTION')) and contains(hex(content)[1:2048], hex('HEADER')) then 'dxf'
             when contains(hex(content)[1:8192], hex('Subject:')) and contains(hex(content)[1:8192], hex('MIME-Version:')) then 'eml'
             else 'txt' end as format
        from (select *, case {" ".join(f"when s = '{k}' then '{v}'" for k, v in EXTENSION_FORMATS.items())} else 'unknown' end as e
              from (select *, {DUCK_SUFFIX} as s from v_files))""",
)


@query("detect_format", "select name, format, e <> 'unknown' and format <> e as mismatch from x_formats")
def _(t):
    return fl.detect_formats(t.files)


@query(
    "decode_text",
    f"""select name, md5({duck_clean('decode(content)')}) as digest, 'utf-8' as encoding
        from (select * from x_formats where flavour > 6) where format = 'txt'""",
)
def _(t):
    by_name = F.lit("unknown")
    plain = t.files.where(fl.sniffed_format(F.col("content"), by_name) == "txt")
    decoded = plain.select("name", fl.decode_text(F.col("content")).alias("d"))
    return decoded.select("name", F.md5(F.col("d.text").cast("binary")).alias("digest"), "d.encoding")


# MIME parsing has no SQL form; tests compare it with hand-written messages.
@query("email_text")
def _(t):
    mails = t.files.where(fl.sniffed_format(F.col("content"), F.lit("unknown")) == "eml")
    return fl.email_text(mails).select("name", "subject", F.length("text").alias("n"))


@query(
    "extraction_json_scan",
    """select document_id, 'pid' as kind, json_valid(payload) as readable,
              case when json_valid(payload) then json_extract_string(payload, '$.zone') end as zone,
              case when json_valid(payload) then json_array_length(payload, '$.equipment')::int end as objects,
              case when json_valid(payload) then json_array_length(payload, '$.confidence_flags')::int end as flags from v_pid_payloads
       union all
       select document_id, 'maintenance_log', json_valid(payload), null, json_array_length(payload, '$.entries')::int,
              json_array_length(payload, '$.confidence_flags')::int from v_log_payloads""",
)
def _(t):
    def rows(payloads, schema, kind, zone, array):
        good, bad = pl.scan_payloads(payloads, schema)
        kept = good.select(
            "document_id", F.lit(kind).alias("kind"), F.lit(True).alias("readable"), zone.alias("zone"),
            F.size(f"data.{array}").alias("objects"), F.size("data.confidence_flags").alias("flags"),
        )
        aside = bad.select("document_id", F.lit(kind).alias("kind"), F.lit(False).alias("readable"))
        return kept.unionByName(aside, allowMissingColumns=True)

    pid = rows(t.pid_payloads, pl.PID_SCHEMA, "pid", F.col("data.zone"), "equipment")
    return pid.unionByName(rows(t.log_payloads, pl.LOG_SCHEMA, "maintenance_log", F.lit(None).cast("string"), "entries"))


@query(
    "low_confidence_count",
    """select document_id, sum(c)::int as low_confidence from (
         select document_id, (select count(*) from (select unnest(json_extract_string(payload, ['$.equipment[0].confidence', '$.equipment[1].confidence',
                  '$.valves[0].confidence', '$.instruments[0].confidence'])) as u) where u = 'low') + json_array_length(payload, '$.confidence_flags') as c
           from v_pid_payloads where json_valid(payload)
         union all
         select document_id, (select count(*) from (select unnest(json_extract_string(payload, ['$.entries[0].confidence', '$.entries[1].confidence'])) as u)
                  where u = 'low') + json_array_length(payload, '$.confidence_flags') from v_log_payloads) group by 1""",
)
def _(t):
    pid, _ = pl.scan_payloads(t.pid_payloads, pl.PID_SCHEMA)
    log, _ = pl.scan_payloads(t.log_payloads, pl.LOG_SCHEMA)
    return pid.select(
        "document_id", pl.low_confidence_count(F.col("data"), ("equipment", "valves", "instruments")).alias("low_confidence")
    ).unionByName(log.select("document_id", pl.low_confidence_count(F.col("data"), ("entries",)).alias("low_confidence")))


def _chunks(t):
    docs = t.spread.documents.select(F.col("id").alias("document_id"), "text", "status")
    return ch.document_chunks(docs, offsets=False).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text"), docs


@query(
    "chunk_store_upsert",
    """select c.document_id, c.chunk_index, md5(case when d.status = 'processing' then upper(c.document_id) || c.text else c.text end) as digest
       from x_doc_chunks c join v_documents d on d.id = c.document_id
       union all select id, 100000, md5('added') from v_documents where status = 'processing'""",
)
def _(t):
    fresh, docs = _chunks(t)
    store = stores.ChunkStore(t.spark, new_folder(t.spark, "chunks"))
    store.write(fresh)
    old = store.read()
    redone = docs.where("status = 'processing'")
    new = old.join(redone.select("document_id"), "document_id", "left_semi").withColumn(
        "text", F.concat(F.upper("document_id"), "text")
    )
    added = redone.select("document_id", F.lit(100000).cast("long").alias("chunk_index"), F.lit("added").alias("text"))
    store.upsert(new.unionByName(added), ["document_id", "chunk_index"])
    return store.read().select("document_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "delete_document_cascade",
    """select 'kept' as part, document_id, count(*) as n from x_doc_chunks where document_id not in (select id from v_documents where status = 'cancelled') group by 2
       union all
       select 'deleted', d.id, (select count(*) from x_doc_chunks c where c.document_id = d.id) from v_documents d where d.status = 'cancelled'""",
)
def _(t):
    rows, docs = _chunks(t)
    gone = docs.where("status = 'cancelled'").select(F.col("document_id").alias("id"))
    store = stores.ChunkStore(t.spark, new_folder(t.spark, "chunks"))
    store.write(rows)
    lost = cut_lineage(stores.deleted_counts(store.read(), gone))
    store.delete(gone)
    kept = store.read().groupBy("document_id").agg(F.count("*").alias("n"))
    return kept.select(F.lit("kept").alias("part"), "document_id", "n").unionByName(
        lost.select(F.lit("deleted").alias("part"), "document_id", F.col("deleted").alias("n"))
    )


_EXPORT_GRAPH = """with x_picked as ({picked})
       select 'node' as part, json_object('id', id, 'label', label, 'type', type, 'name', name, 'confidence', confidence)::varchar as value from x_picked
       union all select 'edge', json_object('src', src, 'rel', rel, 'dst', dst)::varchar
         from (select distinct src, rel, dst from v_edges where src in (select id from x_picked))"""


def _exported_graph(nodes, edges):
    lines = lambda part, rows: stores.rows_as_json(rows).select(F.lit(part).alias("part"), "value")
    return lines("node", nodes).unionByName(lines("edge", edges.select("src", "rel", "dst")))


@query(
    "export_graph",
    _EXPORT_GRAPH.format(picked="select * from v_nodes order by id limit 500"),
)
def _(t):
    return _exported_graph(*stores.export_graph(t.nodes, t.edges))


@query("export_graph_all", _EXPORT_GRAPH.format(picked="select * from v_nodes"))
def _(t):
    return _exported_graph(*stores.export_graph(t.nodes, t.edges, None))


@query(
    "sanitize_metadata",
    """select question_id, rank, array_to_string(list_filter([
            'char_end=' || length(text), 'char_start=0', 'chunk_index=' || coalesce(chunk_index, 0),
            case when document_id is not null then 'document_id=' || document_id end, 'filename=' || filename,
            case when page_number is not null then 'page_number=' || page_number end,
            case when section_header is not null then 'section_header=' || section_header end], lambda x: x is not null), ';') as metadata from v_retrieved""",
)
def _(t):
    own = F.create_map(
        F.lit("filename"), F.col("filename"), F.lit("page_number"), F.col("page_number").cast("string"),
        F.lit("section_header"), F.col("section_header"), F.lit("document_id"), F.col("document_id"),
    )
    stored = stores.sanitized_metadata(F.lit("base"), F.col("chunk_index"), F.lit(0), F.length("text"), own)
    pairs = F.transform(F.array_sort(F.map_entries(stored)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.retrieved.select("question_id", "rank", F.array_join(pairs, ";").alias("metadata"))
