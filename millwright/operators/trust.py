"""Freshness, trust gates and answer assembly over a table of questions.

``retrieved(question_id, rank, text, document_id, doc_id, filename, ...)`` holds
the chunks found for each question, ``rank`` starting at 1 and bounded by the
search's top-k, so gathering one question's chunks is bounded as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.functions import dates, scoring
from millwright.functions import text as tx
from millwright.functions.common import strip, unnest, whole_days

# ---- fixed values -----------------------------------------------------------
REVIEW_INTERVALS = {
    "standard": 365, "procedure": 730, "drawing": 365, "maintenance_log": 365, "manual": 1095, "document": 730,
}
METADATA_DATES = ("last_reviewed", "review_date", "revision_date", "last_validated", "validated_at")
NO_DATE = "No explicit review date found; route source for metadata cleanup."
UPLOAD_DATE = "No explicit review metadata found; using upload/processing date as fallback freshness evidence."
NO_SOURCES_FLAG = "No retrieved source chunks; answer must not be used operationally."
ESCALATED_FLAG = "Trust gate escalated because one or more sources are stale, missing, or low confidence."
FALLBACK_NOTE = "[Local retrieval fallback]"
NO_MATCH = "No matching information was found in the uploaded documents."


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def source_key() -> Column:
    return F.coalesce(_filled("document_id"), _filled("doc_id"), _filled("filename"), F.lit("unknown"))


def document_freshness(retrieved: DataFrame, documents: DataFrame, as_of: Column, type_chars: int | None = 1000) -> DataFrame:
    """One row per question and source document with its review date and freshness score.

    The document's type is read off its first ``type_chars`` characters (None: all).
    """
    stated = [c for c in METADATA_DATES if c in retrieved.columns]
    first = F.min_by(F.struct("filename", *stated), "rank")
    grouped = retrieved.groupBy("question_id", source_key().alias("key")).agg(
        F.min("rank").alias("position"), F.count("*").alias("chunks"), first.alias("m"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"),
    )
    register = documents.select(F.col("id").alias("key"), "original_filename", "processed_at", "uploaded_at")
    named = grouped.join(register, "key", "left").withColumn(
        "filename", F.coalesce(_filled("original_filename"), F.nullif("m.filename", F.lit("")), F.lit("Unknown"))
    )
    dated = named.withColumns(
        {
            "document_type": tx.document_type(F.col("filename"), F.col("text"), type_chars),
            **{f"_{c}": dates.parse_date(F.col(f"m.{c}")) for c in stated},
            "_content": dates.stated_review_date(F.col("text")),
            "_upload": F.coalesce("processed_at", "uploaded_at").cast("timestamp"),
        }
    )
    sources = [(f"_{c}", c) for c in stated] + [("_content", "content"), ("_upload", "upload_or_processed_date")]
    chosen = dated.withColumns(
        {
            "review_date": F.coalesce(*[c for c, _ in sources]),
            "review_date_source": F.coalesce(*[F.when(F.col(c).isNotNull(), label) for c, label in sources], F.lit("missing")),
            "interval": F.element_at(F.create_map(*[F.lit(x) for p in REVIEW_INTERVALS.items() for x in p]), F.col("document_type")),
        }
    )
    aged = chosen.withColumn(
        "age", F.when(F.col("review_date").isNotNull(), F.greatest(F.lit(0), whole_days(as_of, F.col("review_date"))))
    )
    share = F.rint(100 - ((F.col("age") / F.col("interval")) * 100))
    scored = aged.withColumn(
        "score", F.when(F.col("age").isNull(), 50).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), share))).cast("int")
    )
    score, source = F.col("score"), F.col("review_date_source")
    reason = (
        F.when(source == "missing", NO_DATE).when(source == "upload_or_processed_date", UPLOAD_DATE)
        .when(score >= 85, "Document is within expected review interval.")
        .when(score >= 60, "Document is aging and should be reviewed soon.")
        .otherwise("Document has exceeded or is near the expected review interval.")
    )
    return scored.select(
        "question_id", F.col("key").alias("document_id"), "position", "chunks", "filename", "document_type",
        F.date_format("review_date", "yyyy-MM-dd").alias("last_reviewed"), "review_date_source",
        F.col("age").cast("long").alias("document_age_days"), F.col("interval").alias("expected_review_interval_days"),
        score.alias("freshness_score"), (100 - score).alias("knowledge_decay"),
        scoring.freshness_label(score).alias("freshness_status"), scoring.document_risk(score).alias("risk_level"), reason.alias("reason"),
    )


DOCUMENT_FIELDS = ("position", "filename", "freshness_score", "review_date_source", "last_reviewed", "risk_level")


def trust_summary(questions: DataFrame, scores: DataFrame, graph_assets: DataFrame, most_flags: int | None = 8) -> DataFrame:
    """Trust gate of every question, those without sources included, with its first flags (None: all).

    ``questions(question_id, answer_confidence)``, ``graph_assets(question_id, graph_assets)``.
    """
    documents = scores.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct(*DOCUMENT_FIELDS))).alias("documents"), F.sum("chunks").alias("sources")
    )
    nothing = F.array(
        F.struct(
            F.lit(0).cast("long").alias("position"), F.lit("No retrieved source").alias("filename"), F.lit(0).alias("freshness_score"),
            F.lit("missing").alias("review_date_source"), F.lit(None).cast("string").alias("last_reviewed"), F.lit("Critical").alias("risk_level"),
        )
    )
    joined = (
        questions.join(documents, "question_id", "left").join(graph_assets, "question_id", "left")
        .withColumns({
            "has_sources": F.col("documents").isNotNull(),
            "documents": F.coalesce("documents", nothing.cast("array<struct<position:bigint,filename:string,freshness_score:int,review_date_source:string,last_reviewed:string,risk_level:string>>")),
            "sources": F.coalesce("sources", F.lit(0)),
            "graph_assets": F.coalesce("graph_assets", F.lit(0)),
        })
    )
    # Documents are in order of first appearance; the first of the lowest scores limits the answer.
    lowest = F.array_min(F.transform("documents", lambda d: d["freshness_score"]))
    measured = joined.withColumns(
        {
            "freshness_score": lowest,
            "confidence": scoring.percent_of_label(F.col("answer_confidence"), F.col("has_sources")),
        }
    ).withColumns(
        {
            "limiting": F.element_at(F.filter("documents", lambda d: d["freshness_score"] == F.col("freshness_score")), 1),
            "risk": scoring.answer_risk(F.col("freshness_score"), F.col("confidence"), F.col("has_sources")),
        }
    )
    risky = F.col("risk").isin("High", "Critical")
    per_document = F.flatten(
        F.transform(
            "documents",
            lambda d: F.concat(
                F.when(d["review_date_source"] == "missing", F.array(F.concat(d["filename"], F.lit(" has no explicit review date metadata.")))).otherwise(_none()),
                F.when(d["freshness_score"] < 60, F.array(F.concat(d["filename"], F.lit(" is stale or expired.")))).otherwise(_none()),
            ),
        )
    )
    flags = F.concat(
        F.when(F.col("has_sources"), _none()).otherwise(F.array(F.lit(NO_SOURCES_FLAG))), per_document,
        F.when(risky, F.array(F.lit(ESCALATED_FLAG))).otherwise(_none()),
    )
    limit = F.concat(F.col("limiting.filename"), F.lit(" is the limiting source with freshness "), F.col("freshness_score").cast("string"),
                     F.lit("%; trust gate requires review before execution."))
    passed = F.concat(F.lit("Freshness gate passed using "), F.size("documents").cast("string"), F.lit(" source document(s); limiting source is "),
                      F.col("limiting.filename"), F.lit(" at "), F.col("freshness_score").cast("string"), F.lit("%."))
    return measured.select(
        "question_id",
        (100 - F.col("freshness_score")).alias("knowledge_decay"), "freshness_score",
        scoring.freshness_label(F.col("freshness_score")).alias("freshness"), "confidence", "risk", "sources",
        F.size("documents").alias("source_documents"), "graph_assets",
        scoring.trust_gate(F.col("risk")).alias("trust_gate"), scoring.recommendation(F.col("risk")).alias("recommendation"),
        F.when(risky, limit).otherwise(passed).alias("reason"),
        _first_of(F.array_distinct(flags), most_flags).alias("confidence_flags"),
        F.col("limiting.filename").alias("limiting_document"), "documents",
    )


def _first_of(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


def _none() -> Column:
    return F.array().cast("array<string>")


def graph_asset_count(questions: DataFrame, context: DataFrame) -> DataFrame:
    """Distinct assets of ``questions(question_id, equipment_tags)`` and of their context rows."""
    met = context.select("question_id", F.upper(F.coalesce(_filled("tag"), _filled("source"), _filled("target"))).alias("asset"))
    named = questions.select("question_id", F.explode(F.transform("equipment_tags", lambda x: F.upper(x))).alias("asset"))
    counts = met.unionByName(named).where("asset <> ''").distinct().groupBy("question_id").agg(F.count("*").alias("graph_assets"))
    return questions.select("question_id").join(counts, "question_id", "left").select(
        "question_id", F.coalesce("graph_assets", F.lit(0)).alias("graph_assets")
    )


def citations(retrieved: DataFrame, scores: DataFrame, preview_chars: int | None = 300) -> DataFrame:
    """Every retrieved chunk as a source line, with its document's freshness by id, else by file name."""
    values = F.struct("freshness_score", "knowledge_decay", "freshness_status", "risk_level", "last_reviewed")
    by_id = scores.select("question_id", F.col("document_id").alias("cited"), values.alias("by_id"))
    by_name = scores.groupBy("question_id", F.lower("filename").alias("name")).agg(F.max_by(values, "position").alias("by_name"))
    lines = retrieved.withColumns({
        "cited": F.coalesce(_filled("document_id"), _filled("doc_id")),
        "filename": F.coalesce(_filled("filename"), F.lit("Unknown")),
    }).withColumn("name", F.lower("filename"))
    found = lines.join(by_id, ["question_id", "cited"], "left").join(by_name, ["question_id", "name"], "left")
    return found.withColumn("f", F.coalesce("by_id", "by_name")).select(
        "question_id", "rank", "filename", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"),
        (F.col("text") if preview_chars is None else F.substring("text", 1, preview_chars)).alias("text_preview"), F.nullif("page_number", F.lit(0)).alias("page_number"),
        F.coalesce("section_header", F.lit("")).alias("section"), F.col("cited").alias("document_id"), "f.*",
    )


def _terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9-]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def extractive_answer(
    questions: DataFrame, retrieved: DataFrame, chunks: int = 5, sentences: int = 4, most_chars: int | None = 1200
) -> DataFrame:
    """Answer made of the retrieved sentences that share most words with the question.

    A chunk goes to its question's words once, is split and scored in its row and hands on the first ``sentences`` of its own: a sentence
    that as many of its first chunk are ahead of is not among the question's. So no sentence is shuffled.
    """
    asked = questions.select("question_id", F.filter(_terms(F.col("question")), lambda x: F.length(x) > 2).alias("asked"))
    top = retrieved.where(F.col("rank") <= chunks)
    flat = strip(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    said = F.array_distinct(tx.sentences(flat))
    scored = F.transform(said, lambda x, i: F.struct((-F.size(F.array_intersect("asked", _terms(x)))).alias("behind"), i.alias("place"), x.alias("sentence")))
    first = F.slice(F.array_sort(scored), 1, sentences)
    found = unnest(top.join(asked, "question_id"), ["question_id", "rank"], first, "s")
    once = found.groupBy("question_id", F.col("s.sentence").alias("sentence")).agg(
        F.max(-F.col("s.behind")).alias("score"), F.min(F.struct("rank", "s.place")).alias("at")
    )
    best = W.partitionBy("question_id").orderBy(F.desc("score"), "at")
    chosen = once.withColumn("n", F.row_number().over(best)).where(F.col("n") <= sentences)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]), " ")
    evidence = chosen.groupBy("question_id").agg((joined if most_chars is None else F.substring(joined, 1, most_chars)).alias("evidence"))
    source = top.groupBy("question_id").agg(F.min_by(F.coalesce("filename", F.lit("uploaded document")), "rank").alias("source"))
    answer = F.concat(F.lit("Based on "), "source", F.lit(": "), F.coalesce("evidence", F.lit("")), F.lit("\n\n" + FALLBACK_NOTE))
    return questions.select("question_id").join(source, "question_id", "left").join(evidence, "question_id", "left").select(
        "question_id", F.coalesce(answer, F.lit(NO_MATCH)).alias("answer")
    )


def prompt_context(questions: DataFrame, retrieved: DataFrame, context: DataFrame, summary: DataFrame) -> DataFrame:
    """Source blocks, graph bullets and trust line of every question, as an outside model reads them."""
    block = F.concat(
        F.lit("Source: "), F.coalesce("filename", F.lit("Unknown")), F.lit(" | Section: chunk "),
        (F.coalesce("chunk_index", F.lit(0)) + 1).cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n---"),
    )
    bullet = F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.lit("- Graph path: "), "path")).otherwise(
        F.concat(F.lit("- "), F.coalesce("tag", F.lit("Unknown")), F.lit(": relationship="), F.coalesce("relationship", F.lit("connected_to")),
                 F.lit(", depth="), F.coalesce("depth", F.lit(0)).cast("string"))
    )

    def joined(order: str, value: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), "\n")

    sources = retrieved.groupBy("question_id").agg(joined("rank", block).alias("document_context"))
    graph = context.groupBy("question_id").agg(joined("item", bullet).alias("graph_context"))
    trust = summary.select("question_id", F.concat(
        F.lit("Knowledge Decay="), F.col("knowledge_decay").cast("string"), F.lit("; Freshness="), "freshness", F.lit("; Risk="), "risk",
        F.lit("; Trust Gate="), "trust_gate", F.lit("; Recommendation="), "recommendation",
    ).alias("trust_context"))
    return (
        questions.select("question_id", "question").join(sources, "question_id", "left").join(graph, "question_id", "left")
        .join(trust, "question_id", "left").select(
            "question_id", "question",
            F.coalesce("document_context", F.lit("No retrieved document context.")).alias("document_context"),
            F.coalesce("graph_context", F.lit("No equipment graph context provided.")).alias("graph_context"),
            F.coalesce("trust_context", F.lit("No knowledge decay summary was computed. Treat the answer as requiring review.")).alias("trust_context"),
        )
    )


def rendered_trust(most_documents: int | None = 4) -> Column:
    """The summary row as the text shown above an answer, with its first documents (None: all)."""
    pair = lambda name, column, unit="": F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit(unit))
    evidence = F.transform(
        _first_of(F.col("documents"), most_documents),
        lambda d: F.concat(F.lit("- "), d["filename"], F.lit(": "), d["freshness_score"].cast("string"), F.lit("% fresh, last reviewed "),
                           F.coalesce(d["last_reviewed"], F.lit("unknown review date")), F.lit(", risk "), d["risk_level"]),
    )
    return F.array_join(
        F.concat(
            F.array(
                F.lit("Trust Summary"), pair("Knowledge Decay", "knowledge_decay", "%"), pair("Freshness", "freshness"),
                pair("Confidence", "confidence", "%"), pair("Risk", "risk"), pair("Sources", "sources"),
                pair("Graph Assets", "graph_assets"), pair("Trust Gate", "trust_gate"),
                F.lit(""), F.lit("Reason:"), F.col("reason"), F.lit(""), F.lit("Freshness Evidence:"),
            ),
            evidence,
            F.array(F.lit(""), F.lit("Recommendation:"), F.col("recommendation")),
        ),
        "\n",
    )


def decorated_answers(answers: DataFrame, summary: DataFrame) -> DataFrame:
    """``answers(question_id, answer)`` under their trust summary, unless they start with one."""
    clean = strip(F.coalesce("answer", F.lit("")))
    shown = answers.join(summary, "question_id").select("question_id", clean.alias("clean"), rendered_trust().alias("trust"))
    return shown.select(
        "question_id",
        F.when(F.startswith(F.lower("clean"), F.lit("trust summary")), F.col("clean"))
        .when(F.col("clean") == "", F.col("trust"))
        .otherwise(F.concat("trust", F.lit("\n\nAnswer\n"), "clean")).alias("answer"),
    )


def answer_log(questions: DataFrame, answers: DataFrame, retrieved: DataFrame, channel: str, asked_at: Column) -> DataFrame:
    """Rows to append to the question log; source names are kept as JSON in rank order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "filename"))), lambda x: x["filename"])
    sources = retrieved.groupBy("question_id").agg(F.to_json(names).alias("sources"))
    return questions.join(answers, "question_id").join(sources, "question_id", "left").select(
        F.col("question_id").alias("id"), "question", tx.language(F.col("question")).alias("language"), "answer",
        F.coalesce("sources", F.lit("[]")).alias("sources"),
        scoring.stored_confidence(tx.stated_confidence(F.col("answer"))).alias("confidence"), "response_time_ms",
        F.lit(channel).alias("channel"), asked_at.alias("created_at"),
    )


def mentioned_equipment(questions: DataFrame, tags: DataFrame, answers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tags of the question, its graph context and its answer (known ones only), each once in that order.

    ``tags(question_id, asked, graph_tags)`` as from ``context_tags``.
    """
    said = answers.select("question_id", F.posexplode(tx.strict_tags(F.col("answer"))).alias("place", "tag"))
    known = said.join(nodes.select(F.col("id").alias("tag")), "tag", "left_semi").groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]).alias("answered")
    )
    return questions.select("question_id").join(tags, "question_id", "left").join(known, "question_id", "left").select(
        "question_id",
        F.array_distinct(F.concat(F.coalesce("asked", _none()), F.coalesce("graph_tags", _none()), F.coalesce("answered", _none()))).alias("equipment"),
    )


def answer_cards(summary: DataFrame, cited: DataFrame, mentioned: DataFrame, answers: DataFrame) -> DataFrame:
    """Three cards per answer: procedure, graph and trust gate."""
    first = cited.groupBy("question_id").agg(F.min_by(F.struct("filename", "page_number", "chunk_index"), "rank").alias("source"))
    rows = (
        summary.join(answers.select("question_id", "answer"), "question_id").join(mentioned, "question_id", "left")
        .join(first, "question_id", "left")
        .withColumn("equipment", F.coalesce("equipment", _none()))
    )
    sourced, tagged = F.col("source").isNotNull(), F.size("equipment") > 0
    text = lambda c: F.col(c).cast("string")
    place = (
        F.when(F.col("source.page_number").isNotNull(), F.concat(F.lit("Page "), text("source.page_number")))
        .when(sourced, F.concat(F.lit("Chunk "), (F.col("source.chunk_index") + 1).cast("string"))).otherwise("Not returned")
    )
    length = F.when(F.coalesce("answer", F.lit("")) == "", "No answer text").otherwise(F.concat(F.length("answer").cast("string"), F.lit(" chars")))

    def card(name: str, status: Column, lines: list[tuple[str, Column]], caveat: Column) -> Column:
        shown = F.array(*[F.concat(F.lit(f"{k}: "), v) for k, v in lines])
        return F.struct(F.lit(name).alias("card"), status.alias("status"), shown.alias("lines"), caveat.alias("caveat"))

    cards = F.array(
        card("procedure", F.when(sourced, "Source cited").otherwise("Evidence missing"),
             [("Primary source", F.coalesce("source.filename", F.lit("No citation returned"))), ("Page / chunk", place), ("Answer length", length)],
             F.when(~sourced, "No source citation returned. Treat as insufficient evidence until documents are indexed.")),
        card("graph", F.when(tagged, F.concat(F.size("equipment").cast("string"), F.lit(" asset tags"))).otherwise("No tags returned"),
             [("Connected assets", F.when(tagged, F.array_join(F.slice("equipment", 1, 5), ", ")).otherwise("None returned")), ("Graph assets", text("graph_assets"))],
             F.when(~tagged, "No equipment tags were returned by the backend for this answer.")),
        card("confidence", F.col("trust_gate"),
             [("Knowledge Decay", F.concat(text("knowledge_decay"), F.lit("%"))), ("Freshness", F.col("freshness")), ("Risk", F.col("risk")), ("Sources", text("sources"))],
             F.col("recommendation")),
    )
    return rows.select("question_id", F.explode(cards).alias("c")).select("question_id", "c.*")
