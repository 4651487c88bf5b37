"""Compliance work lists, recorded checks and their summaries."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.functions import text as tx
from millwright.functions.common import let, strip
from millwright.operators.vectors import DIMENSION, distance_to, hash_entries

# What evidence is looked up with.
CHECK_QUERY = "procedure compliance safety operating requirements"
SCAN_QUERY = "safety procedure compliance"


def query_weights(query: str) -> dict[int, int]:
    """Hashed vector of one short fixed query, as it is for chunks."""
    weights: dict[int, int] = {}
    for token in re.findall(r"[a-z0-9-]+", query.lower()):
        digest = hashlib.sha256(token.encode()).digest()
        idx = int.from_bytes(digest[:4], "big") % DIMENSION
        weights[idx] = weights.get(idx, 0) + (1 if digest[4] % 2 == 0 else -1)
    return weights


def document_evidence(chunks: DataFrame, query: str, k: int, separator: str, max_chars: int | None = None) -> DataFrame:
    """Per document, the k chunks nearest to a fixed query joined in rank order.

    ``chunks(document_id, chunk_index, text)``.  Chunks are scored in their rows, whole or by their
    first ``max_chars`` characters; only the k nearest of each document and task are shuffled.
    """
    weights = query_weights(query)
    scored = chunks.select(
        "document_id", "chunk_index", "text",
        let(hash_entries(F.col("text"), max_chars), lambda e: distance_to(e, weights)).alias("distance"),
    )
    nearest = W.partitionBy("document_id").orderBy("distance", "chunk_index")
    ranked = scored.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), separator)
    return ranked.groupBy("document_id").agg(joined.alias("procedure_text")).where(strip(F.col("procedure_text")) != "")


def compliance_work(evidence: DataFrame, rules: DataFrame, most_rules: int | None = 10) -> DataFrame:
    """One row per document with evidence and active rule, rules by code up to the limit (all: None).

    Every document meets every rule: that is the work list. It names rules by id and carries whatever columns
    ``evidence(document_id, ...)`` has, so give it ids or digests and join texts to the part that is worked on.
    """
    active = rules.where("is_active").select("rule_code", F.col("id").alias("rule_id"))
    if most_rules is not None:
        active = active.orderBy("rule_code").limit(most_rules)
    return evidence.crossJoin(active)


def compliance_scan(
    documents: DataFrame, chunks: DataFrame, rules: DataFrame, most_documents: int | None = 5, most_rules: int | None = 3
) -> DataFrame:
    """The scheduled work list over completed documents by id, with a digest of each document's evidence; None lifts a limit."""
    due = documents.where("status = 'completed'").select(F.col("id").alias("document_id"))
    if most_documents is not None:
        due = due.orderBy("document_id").limit(most_documents)
    evidence = document_evidence(chunks.join(due, "document_id", "left_semi"), SCAN_QUERY, 3, " ")
    digests = evidence.select("document_id", F.md5(F.col("procedure_text").cast("binary")).alias("digest"))
    return compliance_work(digests, rules, most_rules)


def record_checks(verdicts: DataFrame, lower_status: bool = False) -> DataFrame:
    """Check rows from verdict texts ``(rule_id, document_id, verdict_text, procedure_text, checked_at)``."""
    text = F.col("verdict_text")
    status = tx.labeled_field(text, "STATUS", "INSUFFICIENT_INFORMATION")
    findings = tx.labeled_field(text, "FINDINGS", "")
    advice = tx.labeled_field(text, "RECOMMENDATION", "")
    return verdicts.select(
        "rule_id",
        "document_id",
        (F.lower(status) if lower_status else status).alias("status"),
        strip(F.concat(findings, F.lit("\n\nRECOMMENDATION: "), advice)).alias("findings"),
        tx.wide_tags(F.col("procedure_text")).alias("equipment_tags"),
        "checked_at",
    )


def document_checks(checks: DataFrame, rules: DataFrame, document_id: str | None = None) -> DataFrame:
    """Checks with the rule they evaluate, newest first; checks of unknown rules are left out."""
    chosen = checks if document_id is None else checks.where(F.col("document_id") == document_id)
    named = rules.select(F.col("id").alias("rule_id"), "rule_code")
    return chosen.join(named, "rule_id").select("document_id", "rule_code", "status", "findings", "checked_at")


def check_summary(checked: DataFrame, normalize: bool = False) -> DataFrame:
    """Status counts per document.  Stored lower-case statuses count only when normalised."""
    status: Column = F.upper("status") if normalize else F.col("status")
    return checked.groupBy("document_id").agg(
        F.count_if(status == "COMPLIANT").alias("compliant"),
        F.count_if(status == "NON_COMPLIANT").alias("non_compliant"),
        F.count_if(status == "PARTIAL").alias("partial"),
    )


def check_groups(checked: DataFrame) -> DataFrame:
    """Display groups, by words in the status whatever its case."""
    status = F.lower(F.coalesce("status", F.lit("")))
    return checked.agg(
        F.count_if(status.contains("compliant") & ~status.contains("non")).alias("compliant"),
        F.count_if(status.contains("partial")).alias("partial"),
        F.count_if(status.contains("non")).alias("non_compliant"),
    )


def rule_upsert_guard(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rules with ``accepted`` false where the trimmed code exists already."""
    trimmed = incoming.withColumn("rule_code", strip(F.col("rule_code")))
    known = existing.select("rule_code").distinct().withColumn("_known", F.lit(True))
    return trimmed.join(known, "rule_code", "left").withColumn("accepted", F.col("_known").isNull()).drop("_known")
