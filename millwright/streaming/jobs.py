"""Continuous intake, stage boards, request limits and periodic risk scans.

A micro-batch writes partitions of its own, so one that is replayed leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millwright.functions.common import micros
from millwright.functions.text import strict_tags
from millwright.operators.chunking import document_chunks
from millwright.operators.extraction import document_edges, inspection_events
from millwright.operators.rate_limit import Limiter
from millwright.operators.vectors import hash_entries
from millwright.sources import files as fl
from millwright.sources.stores import BatchTables


# ---- document intake --------------------------------------------------------
def readable_documents(files: DataFrame) -> DataFrame:
    """Accepted text files of ``files(name, size_bytes, content)`` as ``(document_id, text, uploaded_at)``."""
    by_name = F.lit("unknown")
    plain = files.where(fl.sniffed_format(F.col("content"), by_name) == "txt")
    wanted = fl.manifest(plain).where("accepted").select("name")
    return plain.join(wanted, "name", "left_semi").select(
        F.sha2(F.col("name").cast("binary"), 256).alias("document_id"),
        fl.decode_text(F.col("content"))["text"].alias("text"),
        F.current_timestamp().alias("uploaded_at"),
    )


# What intake writes, by document: each table's rows of a document are replaced as a whole.
INTAKE_TABLES = ("chunks", "chunk_vectors", "document_tags", "inspections", "edges", "stages", "documents")


def ingest_documents(documents: DataFrame, folder: str, batch: int) -> None:
    """Take in one batch of ``documents(document_id, text, uploaded_at)`` under its number; all tables show it at once.

    A document that has been stored before loses everything its new text no longer gives.
    Documents without a chunk end as failed.
    """
    tables = BatchTables(documents.sparkSession, folder)
    documents = documents.persist()
    put = lambda table, rows: tables.put(table, rows, batch)
    chunks = put("chunks", document_chunks(documents))
    put("chunk_vectors", chunks.select("document_id", "chunk_index", hash_entries(F.col("text"), None).alias("entries")))
    put("document_tags", documents.select("document_id", F.explode(strict_tags(F.col("text"))).alias("tag")))
    put("inspections", inspection_events(documents).withColumnRenamed("source_document_id", "document_id"))
    put("edges", document_edges(documents))
    counts = chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("total_chunks"))
    state = documents.join(counts, "document_id", "left").select(
        "document_id", "uploaded_at", F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
        F.when(F.col("total_chunks") > 0, "completed").otherwise("failed").alias("status"),
        F.when(F.col("total_chunks").isNull(), "No text chunks could be made").alias("error_message"),
        F.current_timestamp().alias("processed_at"),
    )
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), done.alias("status")) for s, done in (
        ("file_parsed", F.lit("completed")), ("vector_index_update", F.col("status")), ("graph_merge", F.col("status")),
    )])
    put("stages", state.select("document_id", F.inline(stages)))
    put("documents", state)
    tables.commit(documents, batch)
    documents.unpersist()


def register_of(spark: SparkSession, folder: str, equipment: DataFrame) -> DataFrame:
    """Equipment that stored documents name and the register lacks, with the first document naming each."""
    tags = BatchTables(spark, folder).read("document_tags")
    dated = tags.join(BatchTables(spark, folder).read("documents").select("document_id", "uploaded_at"), "document_id")
    first = dated.groupBy("tag").agg(F.min_by("document_id", F.struct("uploaded_at", "document_id")).alias("source_document_id"))
    return first.join(equipment.select("tag"), "tag", "left_anti")


def links_of(spark: SparkSession, folder: str) -> DataFrame:
    """The stored links, each once; the last document that names a link keeps it."""
    edges = BatchTables(spark, folder).read("edges")
    last = F.max_by("document_id", F.struct("uploaded_at", "document_id"))
    return edges.groupBy("src", "dst").agg(last.alias("source_document_id")).withColumn("rel", F.lit("connected_to"))


def start_intake(arriving: DataFrame, to_documents: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Ingest everything that has arrived, then stop; run again for what arrives later.

    Batch numbers come from the checkpoint, so a store has one checkpoint for life.
    """
    return (
        arriving.writeStream.foreachBatch(lambda batch, number: ingest_documents(to_documents(batch), folder, number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    layout = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(layout).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("name"), F.col("length").alias("size_bytes"), "content")


# ---- stage board ------------------------------------------------------------
STAGE_KEYS = ("document_id", "stage")


def start_stage_board(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest status of every (document, stage) of a stream of stage events.

    The state is one row per stage, which a later event replaces, so late events change nothing; with many stages
    it belongs in RocksDB (``prepare_state``). A micro-batch writes the stages it changed as a partition of its own, the same again
    when it is replayed.
    """
    newest = F.max_by(F.struct("status", "message", "filename", "updated_at"), F.struct("updated_at", "message"))
    latest = events.groupBy(*STAGE_KEYS).agg(newest.alias("s")).select(*STAGE_KEYS, "s.*")
    return (
        latest.writeStream.outputMode("update")
        .foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/batch={number}"))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stage_board(spark: SparkSession, folder: str) -> DataFrame:
    """The board as it stands: of every stage the row of the last micro-batch that changed it."""
    rows = spark.read.parquet(folder)
    value = F.struct(*[c for c in rows.columns if c not in (*STAGE_KEYS, "batch")])
    return rows.groupBy(*STAGE_KEYS).agg(F.max_by(value, "batch").alias("s")).select(*STAGE_KEYS, "s.*")


# ---- request limits ---------------------------------------------------------
VERDICTS = "client string, request_id long, us long, accepted boolean, remaining int"


def limited_requests(requests: DataFrame, limit: int = 60, window_seconds: int = 60, idle_seconds: int = 120) -> DataFrame:
    """Verdicts on a stream of ``requests(client, request_id, ts)``.

    A client's state is its accepted times within the window, dropped once it has
    been idle.  Requests of one micro-batch are taken in time order.
    """
    window_us = window_seconds * 1_000_000

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = Limiter(limit, window_us, list(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["us", "request_id"])
        verdicts = [limiter.ask(us) for us in rows["us"]]
        state.update((list(limiter.accepted),))
        state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame({
            "client": key[0], "request_id": rows["request_id"].to_numpy(), "us": rows["us"].to_numpy(),
            "accepted": [v[0] for v in verdicts], "remaining": pd.array([v[2] for v in verdicts], dtype="Int32"),
        })

    return (
        requests.select("client", "request_id", micros("ts").alias("us")).groupBy("client")
        .applyInPandasWithState(decide, VERDICTS, "accepted array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
    )


class _RequestLimits(StatefulProcessor):
    """Accepted times and last request of a client; an event-time timer drops both when the client has been idle."""

    def __init__(self, limit: int, window_seconds: int, idle_seconds: int):
        self.limit, self.window_us, self.idle_ms = limit, window_seconds * 1_000_000, idle_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "us long")
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues):
        arrived = pd.concat(list(rows)).sort_values(["us", "request_id"])
        limiter = Limiter(self.limit, self.window_us, [us for (us,) in self.accepted.get()] if self.accepted.exists() else None)
        verdicts = [limiter.ask(us) for us in arrived["us"].tolist()]
        self.accepted.put([(us,) for us in limiter.accepted])
        known = self.last.get()[0] if self.last.exists() else None
        latest = int(arrived["us"].max()) if known is None else max(known, int(arrived["us"].max()))
        if latest != known:
            if known is not None:
                self.handle.deleteTimer(self._due(known))
            self.last.update((latest,))
            self.handle.registerTimer(self._due(latest))
        yield pd.DataFrame({
            "kind": "verdict", "client": key[0], "request_id": arrived["request_id"].to_numpy(), "us": arrived["us"].to_numpy(),
            "accepted": [v[0] for v in verdicts], "remaining": pd.array([v[2] for v in verdicts], dtype="Int32"),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = self.last.get()[0]
        self.accepted.clear()
        self.last.clear()
        yield pd.DataFrame({
            "kind": ["evicted"], "client": [key[0]], "request_id": pd.array([None], dtype="Int64"), "us": [last],
            "accepted": pd.array([None], dtype="boolean"), "remaining": pd.array([None], dtype="Int32"),
        })

    def close(self) -> None:
        pass

    def _due(self, us: int) -> int:
        return us // 1000 + self.idle_ms


def watched_requests(
    requests: DataFrame, limit: int = 60, window_seconds: int = 60, idle_seconds: int = 120, late: str = "0 seconds"
) -> DataFrame:
    """Verdicts on a stream of ``requests(client, request_id, ts)``, and a row for every client whose state is dropped.

    (kind, client, request_id, us, accepted, remaining): 'verdict' rows as in ``limited_requests``; an 'evicted' row, with the
    client's last request, once the watermark is ``idle_seconds`` past it. Idleness is measured by the requests' own times and not by
    the clock, so a replay evicts the same clients. Needs the RocksDB state store (``prepare_state``).
    """
    timed = requests.select("client", "request_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.select("client", "request_id", "ts", micros("ts").alias("us")).groupBy("client").transformWithStateInPandas(
        _RequestLimits(limit, window_seconds, idle_seconds), f"kind string, {VERDICTS}", "Append", "EventTime"
    )


def prepare_state(spark: SparkSession) -> SparkSession:
    """State in RocksDB, which processors with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


# ---- periodic scans ---------------------------------------------------------
def risk_alerts(level: DataFrame) -> DataFrame:
    """Rows of ``reliability.overall_risk`` that call for attention."""
    return level.where(F.col("overall_risk_level").isin("High", "Critical"))


def start_rescan(
    spark: SparkSession, scan: Callable[[], DataFrame], folder: str, checkpoint: str, every: str = "12 hours", once: bool = False
) -> StreamingQuery:
    """Run ``scan`` at a fixed pace, or once, and append its rows, stamped with the run, to a table."""

    def run(_: DataFrame, batch_id: int) -> None:
        rows = scan().withColumn("run", F.lit(batch_id)).withColumn("scanned_at", F.current_timestamp())
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(folder)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    pace = {"availableNow": True} if once else {"processingTime": every}
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**pace).start()


# The legs of the periodic job: what runs how often.
PERIODS = {"compliance": "6 hours", "risk": "12 hours"}


def start_rescans(
    spark: SparkSession, scans: dict[str, Callable[[], DataFrame]], folder: str, checkpoint: str, once: bool = False
) -> dict[str, StreamingQuery]:
    """Every leg of ``scans`` at its own pace (PERIODS), each with a table and a checkpoint of its own.

    A run that is repeated after a failure replaces its own rows, so each leg can be restarted by itself.
    """
    return {
        leg: start_rescan(spark, scan, f"{folder}/{leg}", f"{checkpoint}/{leg}", PERIODS[leg], once) for leg, scan in scans.items()
    }
