"""Operational counts, histories and status boards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.common import exact_round, micros
from millwright.functions.scoring import history_bucket

# Fixed values.
STATUSES = ("pending", "processing", "completed", "failed", "cancelled")
STAGES = (
    "upload_received", "file_parsed", "structured_extraction", "json_validation", "confidence_scoring",
    "graph_merge", "vector_index_update", "review_queue", "query_readiness",
)


def document_stats(documents: DataFrame) -> DataFrame:
    """Document totals per status and chunk total, in one pass."""
    return documents.agg(
        F.count("*").alias("total_documents"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("total_chunks"),
    )


def query_stats(logs: DataFrame, as_of: Column) -> DataFrame:
    """Questions of the last 7 and 30 days and overall, and the mean answer time."""
    age = micros(as_of) - micros("created_at")
    day = 86_400_000_000
    return logs.agg(
        F.count_if(age <= 7 * day).alias("queries_last_7_days"),
        F.count_if(age <= 30 * day).alias("queries_last_30_days"),
        F.count("*").alias("queries_all_time"),
        exact_round(F.coalesce(F.avg("response_time_ms"), F.lit(0.0))).alias("average_response_time_ms"),
    )


def confidence_distribution(logs: DataFrame) -> DataFrame:
    """High, Medium and Low counts, empty bands kept."""
    band = history_bucket(F.col("confidence"))
    totals = logs.agg(*[F.count_if(band == b).alias(b) for b in ("High", "Medium", "Low")])
    return totals.unpivot([], ["High", "Medium", "Low"], "band", "n")


def top_questions(logs: DataFrame, n: int = 10) -> DataFrame:
    return logs.groupBy("question").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "question").limit(n)


def channel_breakdown(logs: DataFrame) -> DataFrame:
    channel = F.coalesce(F.nullif("channel", F.lit("")), F.lit("unknown"))
    return logs.groupBy(channel.alias("channel")).agg(F.count("*").alias("n"))


def latest_stages(events: DataFrame) -> DataFrame:
    """The latest status of every (document, stage)."""
    return events.groupBy("document_id", "stage").agg(
        F.max_by(F.struct("status", "message", "filename"), F.struct("updated_at", "message")).alias("s"),
        F.max("updated_at").alias("updated_at"),
    ).select("document_id", "stage", "s.status", "s.message", "s.filename", "updated_at")


def pipeline_overview(events: DataFrame, most: int | None = 20) -> DataFrame:
    """The most recently touched documents (None: all) with the latest status of each stage."""
    newest = F.struct("updated_at", "message")
    stages = [
        F.coalesce(F.max_by("status", F.when(F.col("stage") == s, newest)), F.lit("pending")).alias(s) for s in STAGES
    ]
    runs = events.groupBy("document_id").agg(
        F.max("filename").alias("filename"), F.max("updated_at").alias("updated_at"), *stages
    )
    return runs if most is None else runs.orderBy(F.desc("updated_at"), "document_id").limit(most)


def processing_stats(runs: DataFrame) -> DataFrame:
    """Totals over ``runs(succeeded, chunks, pages, tags, low_confidence, recovered, graph_writes)``."""
    return runs.agg(
        F.count_if("succeeded").alias("documents_processed"),
        F.count_if(~F.col("succeeded")).alias("documents_failed"),
        *[
            F.coalesce(F.sum(F.when(F.col("succeeded"), F.col(c))), F.lit(0)).alias(name)
            for c, name in (
                ("chunks", "chunks_created"), ("pages", "pages_parsed"), ("tags", "equipment_tags_found"),
                ("low_confidence", "low_confidence_items"), ("graph_writes", "graph_writes"),
            )
        ],
        F.coalesce(F.sum("recovered"), F.lit(0)).alias("failed_jobs_recovered"),
    )


def processing_status(requested: DataFrame, documents: DataFrame) -> DataFrame:
    """Status of each requested document; unknown ones answer ``not_found``."""
    known = documents.select(F.col("id").alias("document_id"), "status", "total_chunks", "error_message", "processed_at")
    return requested.select("document_id").distinct().join(known, "document_id", "left").select(
        "document_id",
        F.coalesce("status", F.lit("not_found")).alias("status"),
        F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
        F.when(F.col("status").isNull(), "Document not found").otherwise(F.col("error_message")).alias("error_message"),
        "processed_at",
    )


def text_lines(title: str, lines: list[tuple[str, Column]]) -> Column:
    parts = [F.lit(title)] + [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in lines]
    return F.array_join(F.array(*parts), "\n")


def status_text(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    counts = [
        documents.agg(F.count("*").alias("n")).select(F.lit("documents").alias("what"), "n"),
        nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n"),
    ]
    both = reduce(DataFrame.unionByName, counts)
    pick = lambda what: F.max(F.when(F.col("what") == what, F.col("n")))
    return both.agg(
        text_lines("Plant Status", [("Documents", pick("documents")), ("Graph nodes", pick("nodes"))]).alias("text")
    )


def risk_text(summary: DataFrame) -> DataFrame:
    """The rows of the risk summary as a chat reply."""
    rows = lambda part: F.count_if(F.col("part") == part)
    return summary.agg(
        text_lines(
            "Risk Summary",
            [
                ("Overall", F.max("overall_risk_level")),
                ("Failure clusters", rows("cluster")),
                ("Overdue inspections", F.max("overdue_inspections_count")),
                ("Critical overdue", rows("critical_overdue")),
                ("Co-occurrence patterns", rows("pair")),
            ],
        ).alias("text")
    )
