"""Listing, paging, point lookups and small upserts over the registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.common import strip


def page(rows: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 20, most: int = 100) -> DataFrame:
    """One page of ``rows`` in the given order, each row carrying the size of the whole list."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).offset(max(offset, 0)).limit(max(1, min(limit, most))).withColumn("total", total)


def list_documents(documents: DataFrame, status: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    chosen = documents if status is None else documents.where(F.col("status") == status)
    return page(chosen, [F.desc("uploaded_at"), "id"], offset, limit)


def query_history(logs: DataFrame, session_id: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    chosen = logs if session_id is None else logs.where(F.col("session_id") == session_id)
    return page(chosen, [F.desc("created_at"), "id"], skip, limit)


def with_source_list(logs: DataFrame) -> DataFrame:
    """Stored source JSON as an array; null, empty or broken JSON gives an empty one."""
    parsed = F.from_json("sources", "array<string>")
    return logs.withColumn("sources", F.coalesce(parsed, F.array().cast("array<string>")))


def query_detail(logs: DataFrame, query_id: str) -> DataFrame:
    return with_source_list(logs.where(F.col("id") == query_id))


def list_rules(
    rules: DataFrame, active: bool | None = True, body: str | None = None, category: str | None = None,
    offset: int = 0, limit: int = 50,
) -> DataFrame:
    for column, wanted in (("is_active", active), ("regulation_body", body), ("category", category)):
        if wanted is not None:
            rules = rules.where(F.col(column) == wanted)
    return page(rules, ["rule_code"], offset, limit)


def _first(rows: DataFrame, order: list[str], most: int | None) -> DataFrame:
    return rows if most is None else rows.orderBy(*order).limit(most)


def rules_for_check(rules: DataFrame, codes: list[str] | None = None, most: int | None = 10) -> DataFrame:
    """The first active rules (None: all), by code, that a check runs, with the number left out."""
    active = rules.where("is_active")
    wanted = [c.strip() for c in codes or [] if c.strip()]
    if wanted:
        active = active.where(F.col("rule_code").isin(*wanted))
    if most is None:
        return active.withColumn("skipped", F.lit(0).cast("long"))
    skipped = active.agg(F.greatest(F.count("*") - most, F.lit(0).cast("long"))).scalar()
    return _first(active, ["rule_code"], most).withColumn("skipped", skipped)


def get_rule(rules: DataFrame, code: str) -> DataFrame:
    return rules.where(F.col("rule_code") == code.strip())


def list_equipment(nodes: DataFrame, edges: DataFrame, equipment_type: str = "", most: int | None = 500) -> DataFrame:
    """Equipment nodes by id (None: all) with the number of relationships on them."""
    chosen = nodes.where("label = 'Equipment'")
    if equipment_type:
        chosen = chosen.where(F.lower(F.coalesce("type", F.lit(""))) == equipment_type.lower())
    listed = _first(chosen, ["id"], most)
    # only edges on listed nodes are counted
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    counts = ends.join(listed.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    return listed.join(counts, "id", "left").select(
        F.col("id").alias("tag"), "name", F.col("type").alias("equipment_type"), F.coalesce("n", F.lit(0)).alias("neighbor_count")
    )


def equipment_detail(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every equipment node with its out-neighbours, one row per neighbour, none as one null row.

    Kept as rows: a node's neighbours are unbounded, so they are not gathered into one value.
    """
    assets = nodes.where("label = 'Equipment'").select(F.col("id").alias("tag"), "name", F.col("type").alias("equipment_type"))
    targets = nodes.select(F.col("id").alias("neighbor_tag"), F.col("label").alias("neighbor_label"), F.col("name").alias("neighbor_name"))
    out = edges.select(F.col("src").alias("tag"), F.col("rel").alias("relationship"), F.col("dst").alias("neighbor_tag"))
    return assets.join(out.join(targets, "neighbor_tag"), "tag", "left").select(
        "tag", "name", "equipment_type", "relationship", "neighbor_tag", "neighbor_label", "neighbor_name"
    )


def record_feedback(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Logs with ``feedback(id, helpful, comment)`` applied where a row has some."""
    given = feedback.select("id", F.col("helpful").alias("_helpful"), F.col("comment").alias("_comment"), F.lit(True).alias("_given"))
    merged = logs.join(given, "id", "left")
    return (
        merged.withColumn("helpful", F.when(F.col("_given"), F.col("_helpful")).otherwise(F.col("helpful")))
        .withColumn("feedback_comment", F.when(F.col("_given"), F.col("_comment")).otherwise(F.col("feedback_comment")))
        .drop("_helpful", "_comment", "_given")
    )


def soft_delete_rules(rules: DataFrame, codes: DataFrame) -> DataFrame:
    """Rules named in ``codes(rule_code)`` become inactive; the rows stay."""
    gone = codes.select(strip(F.col("rule_code")).alias("rule_code")).distinct().withColumn("_gone", F.lit(True))
    return rules.join(gone, "rule_code", "left").withColumn(
        "is_active", F.col("is_active") & F.col("_gone").isNull()
    ).drop("_gone")


def reset_for_reprocess(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Named documents go back to pending with their results cleared."""
    return documents.join(ids.select("id").distinct(), "id", "left_semi").withColumns(
        {
            "status": F.lit("pending"),
            "total_chunks": F.lit(0),
            "error_message": F.lit(None).cast("string"),
            "processed_at": F.lit(None).cast("timestamp_ntz"),
        }
    )


def node_kind(label: Column, node_id: Column) -> Column:
    """Display kind of a node: the first known word in its label, else by the look of its id."""
    lowered = F.lower(F.coalesce(label, F.lit("")))
    kinds = ("PendingReview", "MaintenanceEvent", "Instrument", "Valve", "Document", "Zone", "Equipment")
    kind = F.when(F.upper(node_id).rlike(r"^[A-Z]{1,3}-\d{3,4}[A-Z]?$"), "Equipment").otherwise("Node")
    for name in reversed(kinds):
        kind = F.when(lowered.contains(name.lower()), name).otherwise(kind)
    return kind


def node_search(nodes: DataFrame, text: str = "", kind: str = "all", most: int | None = 90) -> DataFrame:
    """Nodes whose id, label or attributes contain the text, by id (None: all)."""
    body = F.lower(F.concat_ws(" ", "id", "label", F.to_json(F.struct("type", "name", "confidence"))))
    found = nodes.withColumn("kind", node_kind(F.col("label"), F.col("id")))
    if kind != "all":
        found = found.where(F.col("kind") == kind)
    if text.strip():
        found = found.where(F.contains(body, F.lit(text.lower())))
    return _first(found, ["id"], most)


def induced_edges(nodes: DataFrame, edges: DataFrame, most: int | None = 140) -> DataFrame:
    """Edges with both ends among the given nodes (None: all)."""
    seen = nodes.select(F.col("id"))
    inside = edges.join(seen.select(F.col("id").alias("src")), "src", "left_semi").join(
        seen.select(F.col("id").alias("dst")), "dst", "left_semi"
    )
    return _first(inside, ["src", "rel", "dst"], most)


def equipment_search(equipment: DataFrame, text: str) -> DataFrame:
    body = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("tag", "name", "equipment_type", "location")]))
    return equipment.where(F.contains(body, F.lit(text.lower())))


def cited_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Document rows that retrieved chunks cite."""
    cited = chunks.select(
        F.coalesce(F.nullif("document_id", F.lit("")), F.nullif("doc_id", F.lit(""))).alias("id")
    ).where("id is not null")
    return documents.join(cited, "id", "left_semi")
