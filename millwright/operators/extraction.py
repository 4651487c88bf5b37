"""Tags, events and relationships taken out of text and extraction payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions import text as tx
from millwright.functions.common import exact_round, strip, unnest
from millwright.functions.dates import iso_date
from millwright.functions.text import INSPECTION_WORDS


def store_new_equipment(documents: DataFrame, equipment: DataFrame) -> DataFrame:
    """Tags in ``documents(document_id, text, uploaded_at)`` the register lacks, with the first document naming each."""
    tags = unnest(documents, ["document_id", "uploaded_at"], tx.strict_tags(F.col("text")), "tag")
    first = tags.groupBy("tag").agg(F.min_by("document_id", F.struct("uploaded_at", "document_id")).alias("source_document_id"))
    return first.join(equipment.select("tag"), "tag", "left_anti")


def inspection_events(documents: DataFrame) -> DataFrame:
    """One inspection per tag occurrence in sentences that speak of inspecting."""
    said = unnest(documents, ["document_id"], tx.sentences(F.col("text")), "findings")
    lowered = F.lower("findings")
    spoken = F.lit(False)
    for word in INSPECTION_WORDS:
        spoken = spoken | lowered.contains(word)
    return unnest(
        said.where(spoken),
        [
            "findings", F.col("document_id").alias("source_document_id"), F.lit("auto_extracted").alias("inspection_type"),
            F.lit(None).cast("string").alias("severity"),
        ],
        tx.tag_occurrences(F.col("findings")),
        "equipment_tag",
    )


def log_events(logs: DataFrame) -> DataFrame:
    """Inspections from parsed maintenance logs ``(document_id, data)``."""
    entries = unnest(logs, ["document_id"], F.col("data.entries"), "e")
    tag = F.upper(strip(F.coalesce("e.Asset_ID", F.lit(""))))
    return entries.where(tag != "").select(
        tag.alias("equipment_tag"),
        iso_date(F.nullif("e.Date", F.lit(""))).alias("inspection_date"),
        F.coalesce(F.nullif("e.Technician_Notes", F.lit("")), F.col("e.Failure_Mode")).alias("findings"),
        F.when(F.col("e.confidence") == "low", "low").otherwise("routine").alias("severity"),
        F.col("document_id").alias("source_document_id"),
        F.lit("maintenance_log_extracted").alias("inspection_type"),
    )


def _ids(items: Column, field: str) -> Column:
    named = F.transform(F.coalesce(items, F.array()), lambda x: F.upper(strip(F.coalesce(x[field], F.lit("")))))
    return F.filter(named, lambda x: x != "")


def structured_tags(text: Column, data: Column, kind: str) -> Column:
    """Tags of the text, then those of the payload, each once in that order."""
    if kind == "pid":
        found = F.concat(_ids(data["equipment"], "id"), _ids(data["valves"], "valve_id"))
    else:
        found = _ids(data["entries"], "Asset_ID")
    return F.array_distinct(F.concat(tx.strict_tags(text), found))


def document_edges(documents: DataFrame) -> DataFrame:
    """Directed links between tags that follow one another in a sentence, once per document.

    ``documents(document_id, text, uploaded_at)``.
    """
    said = unnest(documents, ["document_id", "uploaded_at"], tx.sentences(F.col("text")), "sentence").select("document_id", "uploaded_at", tx.strict_tags(F.col("sentence")).alias("tags"))
    following = F.when(
        F.size("tags") > 1,
        F.arrays_zip(F.slice("tags", 1, F.size("tags") - 1).alias("src"), F.slice("tags", 2, F.size("tags") - 1).alias("dst")),
    )
    pairs = unnest(said, ["document_id", "uploaded_at"], following, "p")
    return pairs.select("document_id", "uploaded_at", "p.src", "p.dst").distinct()


def sentence_edges(documents: DataFrame) -> DataFrame:
    """The links of ``document_edges``, each once; the last document keeps a link."""
    return document_edges(documents).groupBy("src", "dst").agg(
        F.max_by("document_id", F.struct("uploaded_at", "document_id")).alias("source_document_id")
    ).withColumn("rel", F.lit("connected_to"))


def voice_inspections(notes: DataFrame, recorded_at: Column) -> DataFrame:
    """An inspection of the first tag of every note ``(document_id, text)`` that is not routine."""
    known = notes.withColumn("k", tx.voice_knowledge(F.col("text")))
    return known.where((F.col("k.severity_hint") != "routine") & (F.size("k.equipment_tags") > 0)).select(
        F.element_at("k.equipment_tags", 1).alias("equipment_tag"),
        recorded_at.alias("inspection_date"),
        F.lit("voice_note").alias("inspector_name"),
        F.lit("voice_auto_extracted").alias("inspection_type"),
        F.col("text").alias("findings"),
        F.col("k.severity_hint").alias("severity"),
        F.col("document_id").alias("source_document_id"),
    )


def typed_captures(notes: DataFrame, kind: str = "text_manual_capture") -> DataFrame:
    """Inspections from typed notes ``(text, equipment_tag, severity, inspector_name)`` that name an asset."""
    tag = tx.normal_tag(F.col("equipment_tag"))
    return notes.where(tag != "").select(
        tag.alias("equipment_tag"), "inspector_name", F.lit(kind).alias("inspection_type"),
        F.col("text").alias("findings"), F.lower("severity").alias("severity"),
    )


def manual_inspections(rows: DataFrame) -> DataFrame:
    """Inspections entered by hand: the tag trimmed and upper-cased, the severity lower-cased."""
    return rows.withColumn("equipment_tag", tx.normal_tag(F.col("equipment_tag"))).withColumn("severity", F.lower("severity"))


def recent_captures(documents: DataFrame, inspections: DataFrame, most: int | None = 20) -> DataFrame:
    """The newest voice documents (None: all) with what was taken from them."""
    newest = documents.where("file_type = 'voice'")
    if most is not None:
        newest = newest.orderBy(F.desc("uploaded_at"), "id").limit(most)
    made = (
        inspections.join(newest.select(F.col("id").alias("source_document_id")), "source_document_id", "left_semi")
        .groupBy(F.col("source_document_id").alias("id")).agg(F.count("*").alias("n"))
    )
    return newest.join(made, "id", "left").select(
        F.col("id").alias("document_id"), "original_filename", "status", "uploaded_at",
        F.substring("text", 1, 300).alias("transcription_preview"),
        tx.voice_knowledge(F.col("text")).alias("knowledge"),
        F.coalesce("n", F.lit(0)).alias("inspections_created"),
    )


def ocr_confidence(words: DataFrame, threshold: float = 55.0) -> tuple[DataFrame, DataFrame]:
    """(pages, documents) with mean word confidence of ``words(document_id, page_number, word, conf)``.

    Negative confidences mark non-words and do not count.  A document's mean is
    taken over its page means, as pages are read one by one.
    """
    scored = F.when(F.col("conf") >= 0, F.col("conf"))
    pages = words.groupBy("document_id", "page_number").agg(exact_round(F.avg(scored)).alias("ocr_confidence"))
    # Page means have two decimals; summed as whole hundredths the result is the same in any order.
    cents = F.sum(F.rint(F.col("ocr_confidence") * 100).cast("long"))
    documents = pages.groupBy("document_id").agg(
        exact_round(cents / (100 * F.count("ocr_confidence"))).alias("ocr_average_confidence")
    )
    return pages, documents.withColumn(
        "low_confidence", F.coalesce(F.col("ocr_average_confidence") < threshold, F.lit(False))
    )
