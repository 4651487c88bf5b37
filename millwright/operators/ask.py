"""From a table of questions to logged, trust-gated answers in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.functions import text as tx
from millwright.operators import graph_walk as gw
from millwright.operators import trust as tr
from millwright.operators import vectors as vec
from millwright.session import cut_lineage


def retrieve(questions: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """The k chunks nearest to each question, with their text and file name, as ``trust`` reads them.

    ``chunks(document_id, chunk_index, text)``; both sides are embedded whole by token hashes.
    """
    keyed = chunks.withColumn("key", F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")))
    stored = vec.hash_vectors(keyed, "key", F.col("text"), None)
    asked = vec.hash_vectors(questions, "question_id", F.col("question"), None)
    found = vec.vector_topk(stored, asked, k, id_col="key", vec_col="entries", query_id_col="question_id").select(
        F.col("query_id").alias("question_id"), F.col("id").alias("key"), F.col("rank").cast("long").alias("rank")
    )
    names = documents.select(F.col("id").alias("document_id"), F.col("original_filename").alias("filename"))
    nothing = lambda kind: F.lit(None).cast(kind)
    return found.join(keyed, "key").join(names, "document_id", "left").select(
        "question_id", "rank", "text", "document_id", nothing("string").alias("doc_id"), "filename",
        F.col("chunk_index").cast("long").alias("chunk_index"), nothing("long").alias("page_number"), nothing("string").alias("section_header"),
    )


def graph_context(questions: DataFrame, edges: DataFrame, depth: int = 2, cap: int | None = 30) -> DataFrame:
    """Paths around the tags of each question as context rows; ``tag`` is where a path ends."""
    seeds = questions.select("question_id", F.explode(tx.wide_tags(F.col("question"))).alias("tag"))
    paths = gw.rag_paths(edges, seeds, depth, cap)
    nothing = F.lit(None).cast("string")
    return paths.select(
        "question_id", F.row_number().over(W.partitionBy("question_id").orderBy("depth", "path")).alias("item"),
        F.element_at("nodes", -1).alias("tag"), nothing.alias("source"), nothing.alias("target"), "path",
        nothing.alias("relationship"), "depth", nothing.alias("attribute_text"),
    )


def ask_questions(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: Column,
    k: int = 5, depth: int = 2, cap: int | None = 30, channel: str = "web",
) -> DataFrame:
    """Log rows of ``questions(question_id, question)``: search, graph context, extractive answer, trust gate, decorated answer.

    A question without sources is answered too, behind a closed gate.
    """
    questions = questions.select("question_id", "question")
    retrieved = cut_lineage(retrieve(questions, chunks, documents, k))
    context = cut_lineage(graph_context(questions, edges, depth, cap))
    answers = cut_lineage(tr.extractive_answer(questions, retrieved))
    mentioned = tr.mentioned_equipment(questions, gw.context_tags(context, questions), answers, nodes)
    assets = tr.graph_asset_count(mentioned.withColumnRenamed("equipment", "equipment_tags"), context)
    judged = answers.select("question_id", tx.stated_confidence(F.col("answer")).alias("answer_confidence"))
    summary = tr.trust_summary(judged, tr.document_freshness(retrieved, documents, as_of), assets)
    shown = tr.decorated_answers(answers, summary).withColumn("response_time_ms", F.lit(0).cast("long"))
    return tr.answer_log(questions, shown, retrieved, channel, as_of)
