"""Named streaming and request-limit queries and their check SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millwright.operators import rate_limit as rl
from millwright.operators import reliability as rel
from millwright.plans import compliance, extraction  # noqa: F401  their check SQL is part of that of streams
from millwright.plans.registry import CHECKS, query
from millwright.plans.reliability import as_of
from millwright.plans.text import STRICT, duck_tags
from millwright.plans.vectors import duck_hash_entries
from millwright.session import new_folder
from millwright.sources.stores import BatchTables
from millwright.streaming import jobs

WINDOW, LIMIT = 21600, 2


def arriving(t, name: str):
    """One of the driver's tables as a stream of its files."""
    static = t.spark.read.parquet(f"{t.folder}/{name}.parquet")
    return t.spark.readStream.schema(static.schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


# Documents in one file, so that files are fewer than documents and none of them is large.
BUNDLE = 100


def bundled_files(documents, folder: str) -> None:
    """``documents(id, text)`` as files of up to BUNDLE lines, a document as JSON in each."""
    lines = documents.select(F.to_json(F.struct("id", F.coalesce("text", F.lit("")).alias("text"))).alias("value"))
    lines.write.option("maxRecordsPerFile", BUNDLE).text(folder)


def bundled_documents(files):
    """The documents (document_id, text) of ``files(content)`` that ``bundled_files`` wrote."""
    lines = files.select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    return lines.select(F.from_json("line", "id string, text string").alias("d")).select(F.col("d.id").alias("document_id"), "d.text")


@query(
    "stream_ingest",
    f"""with x_again as (select id from v_documents where doc_key % 3 = 0),
            x_sizes as (select document_id, count(*)::int as n from x_doc_chunks group by 1)
        select 'chunks' as part, document_id, chunk_index || '/' || total_chunks as name, md5(text) as value
          from x_doc_chunks where document_id not in (select id from x_again)
        union all select 'vectors', document_id, chunk_index || ':' || idx, weight::varchar from (
          {duck_hash_entries("x_doc_chunks", "document_id, chunk_index", "text", "")}) where document_id not in (select id from x_again)
        union all select 'tags', id, tag, '' from x_named_tags where id not in (select id from x_again)
        union all select 'inspections', source_document_id, equipment_tag, md5(findings) from ({CHECKS["inspection_events_from_text"]})
          where source_document_id not in (select id from x_again)
        union all select distinct 'edges', id, src || '>' || dst, '' from (
          select id, g[i] as src, g[i + 1] as dst from (select id, {duck_tags('s', STRICT)} as g from x_spoken), unnest(range(1, len(g))) as u(i))
          where id not in (select id from x_again)
        union all select 'documents', d.id, case when n > 0 and d.id not in (select id from x_again) then 'completed' else 'failed' end,
               (case when d.id in (select id from x_again) then 0 else coalesce(n, 0) end)::varchar
          from v_documents d left join x_sizes s on s.document_id = d.id""",
)
def _(t):
    """The documents written out as files and taken in by a stream of files, then every third document once more with a
    text that gives nothing; what is stored must equal the batch results of the other documents."""
    folder = new_folder(t.spark, "run")
    bundled_files(t.spread.documents, f"{folder}/files")
    dated = t.documents.select(F.col("id").alias("document_id"), "uploaded_at")

    def to_documents(files):
        return bundled_documents(files.repartition(t.spark.sparkContext.defaultParallelism)).join(dated, "document_id")

    jobs.start_intake(jobs.arriving_files(t.spark, f"{folder}/files"), to_documents, folder, f"{folder}/checkpoint").awaitTermination()
    again = t.documents.where("doc_key % 3 = 0").select(F.col("id").alias("document_id"), F.lit("Short.").alias("text"), "uploaded_at")
    jobs.ingest_documents(again, folder, 1)
    stored = lambda name: BatchTables(t.spark, folder).read(name)
    nothing = F.lit("")
    rows = lambda part, df, name, value: df.select(
        F.lit(part).alias("part"), "document_id", name.alias("name"), value.alias("value")
    )
    entries = stored("chunk_vectors").select("document_id", "chunk_index", F.inline("entries"))
    parts = [
        rows("chunks", stored("chunks"), F.concat_ws("/", F.col("chunk_index").cast("string"), F.col("total_chunks").cast("string")),
             F.md5(F.col("text").cast("binary"))),
        rows("vectors", entries, F.concat_ws(":", F.col("chunk_index").cast("string"), F.col("idx").cast("string")), F.col("weight").cast("string")),
        rows("tags", stored("document_tags"), F.col("tag"), nothing),
        rows("inspections", stored("inspections"), F.col("equipment_tag"), F.md5(F.col("findings").cast("binary"))),
        rows("edges", stored("edges"), F.concat_ws(">", "src", "dst"), nothing),
        rows("documents", stored("documents"), F.col("status"), F.col("total_chunks").cast("string")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("stream_stage_status", "select document_id, stage, status, message, filename, updated_at from x_latest_stage")
def _(t):
    folder = new_folder(t.spark, "run")
    events = t.replacing(events=arriving(t, "events")).stage_events
    jobs.start_stage_board(events, f"{folder}/board", f"{folder}/checkpoint").awaitTermination()
    return jobs.stage_board(t.spark, f"{folder}/board")


_EXACT = f"""
    with recursive x_seq as (select client, request_id, epoch_us(ts) as us, row_number() over (partition by client order by ts, request_id) as n from v_requests),
    x_run as (
      select client, request_id, us, n, [us] as taken, true as accepted, cast(null as int) as retry_after_seconds, {LIMIT} - 1 as remaining from x_seq where n = 1
      union all
      select client, request_id, us, n, case when len(live) < {LIMIT} then list_append(live, us) else live end, len(live) < {LIMIT},
             case when len(live) >= {LIMIT} then floor(({WINDOW}::bigint * 1000000 - (us - live[1])) / 1000000.0)::int end,
             case when len(live) < {LIMIT} then {LIMIT} - len(live) - 1 end::int
      from (select s.client, s.request_id, s.us, s.n, list_filter(r.taken, lambda x: s.us - x < {WINDOW}::bigint * 1000000) as live
            from x_run r join x_seq s on s.client = r.client and s.n = r.n + 1))
    select client, request_id, accepted, retry_after_seconds, remaining from x_run"""


@query("rate_limit_audit", _EXACT)
def _(t):
    return rl.rate_limit_audit(t.requests, LIMIT, WINDOW).select("client", "request_id", "accepted", "retry_after_seconds", "remaining")


IDLE = 86400


@query(
    "idle_key_eviction",
    _EXACT.replace("select client, request_id, accepted, retry_after_seconds, remaining from x_run", f"""
    select 'verdict' as kind, client, request_id, us, accepted, remaining from x_run
    union all select 'evicted', client, null, max(epoch_us(ts)), null, null from v_requests group by client
    having max(epoch_us(ts)) // 1000 + {IDLE * 1000} <= (select max(epoch_us(ts)) // 1000 from v_requests)"""),
)
def _(t):
    """Requests as a stream, with the clients whose state is dropped on the way."""
    folder = new_folder(t.spark, "run")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key)
    jobs.prepare_state(t.spark)
    try:
        watched = jobs.watched_requests(t.replacing(events=arriving(t, "events")).requests, LIMIT, WINDOW, IDLE)
        watched.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(
            f"{folder}/rows").awaitTermination()
    finally:
        t.spark.conf.set(key, before)
    return t.spark.read.schema(watched.schema).parquet(f"{folder}/rows")


@query(
    "request_pressure",
    f"""select a.client, a.request_id, (select count(*) from v_requests b where b.client = a.client and b.ts <= a.ts and epoch_us(a.ts) - epoch_us(b.ts) < {WINDOW}::bigint * 1000000) as in_window
        from v_requests a""",
)
def _(t):
    return rl.request_pressure(t.requests, WINDOW)


@query(
    "risk_alerts",
    "select overall_risk_level, (select count(*) from x_overdue) as overdue_inspections_count from x_level where overall_risk_level in ('High', 'Critical')",
)
def _(t):
    return _alerts(t)


def _alerts(t):
    level = rel.overall_risk(rel.failure_clusters(t.inspections), rel.overdue_inspections(t.inspections, t.equipment, as_of()))
    return jobs.risk_alerts(level)


@query(
    "periodic_rescan",
    f"""select 'compliance' as leg, document_id as subject, rule_code as item, digest as value from ({CHECKS["compliance_scan"]})
        union all select 'risk', overall_risk_level, 'overdue', overdue_inspections_count::varchar from ({CHECKS["risk_alerts"]})""",
)
def _(t):
    """Both legs of the periodic job, each run once."""
    folder = new_folder(t.spark, "run")
    scans = {
        "compliance": lambda: compliance.scan(t, 5, 3).select(
            F.col("document_id").alias("subject"), F.col("rule_code").alias("item"), F.col("digest").alias("value")),
        "risk": lambda: _alerts(t).select(
            F.col("overall_risk_level").alias("subject"), F.lit("overdue").alias("item"), F.col("overdue_inspections_count").cast("string").alias("value")),
    }
    for run in jobs.start_rescans(t.spark, scans, f"{folder}/scans", f"{folder}/checkpoint", once=True).values():
        run.awaitTermination()
    rows = t.spark.read.schema("subject string, item string, value string")
    legs = [rows.parquet(f"{folder}/scans/{leg}").select(F.lit(leg).alias("leg"), "subject", "item", "value") for leg in scans]
    return reduce(lambda a, b: a.unionByName(b), legs)
