"""Named vector queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import chunking as ch
from millwright.operators import vectors as vec
from millwright.plans.registry import query
from millwright.plans.text import duck_strip
from millwright.plans.views import CHECK_FRAGMENTS


def duck_hash_entries(source: str, key: str, text: str, limit: str = "[1:5000]") -> str:
    flat = f"replace({duck_strip(text)}, chr(10), ' '){limit}"
    return f"""
        select {key}, idx, sum(sign)::bigint as weight from (
          select {key}, (('0x' || h[1:8])::bigint % 384)::int as idx, case when ('0x' || h[9:10])::int % 2 = 0 then 1 else -1 end as sign
          from (select {key}, sha256(unnest(regexp_extract_all(lower({flat}), '[a-z0-9-]+'))) as h from {source}))
        group by all having sum(sign) <> 0"""


CHECK_FRAGMENTS.update(
    x_chunk_entries=duck_hash_entries("x_doc_chunks", "document_id, chunk_index", "text", ""),
    x_unit="select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings",
    x_distances="""
        select q.vec_id as query_id, q.label as query_label, d.vec_id as id, d.label as label, round(list_cosine_distance(q.v, d.v), 9) as distance
        from x_unit q, x_unit d""",
)


@query(
    "hash_embedding",
    """with x_norms as (select document_id, chunk_index, sqrt(sum(weight * weight)) as norm from x_chunk_entries group by all)
       select e.document_id, e.chunk_index, e.idx, round(e.weight / n.norm, 6) as value
       from x_chunk_entries e join x_norms n using (document_id, chunk_index)""",
)
def _(t):
    docs = t.spread.documents.select(F.col("id").alias("document_id"), "text")
    chunks = ch.document_chunks(docs, offsets=False).withColumn("key", F.struct("document_id", F.col("chunk_index").cast("long").alias("chunk_index")))
    return vec.hash_embedding_long(chunks, "key", F.col("text"), None).select(
        "key.document_id", "key.chunk_index", "idx", F.round("value", 6).alias("value")
    )


_ENTRIES = """with x_whole as ({entries}),
    x_norms as (select document_id, chunk_index, sqrt(sum(weight * weight)) as norm from x_whole group by all)
    select e.document_id, e.chunk_index, e.idx, round(e.weight / n.norm, 6) as value from x_whole e join x_norms n using (document_id, chunk_index)"""


@query("hash_embedding_whole", _ENTRIES.format(entries=duck_hash_entries("x_doc_chunks", "document_id, chunk_index", "text", "")))
def _(t):
    docs = t.spread.documents.select(F.col("id").alias("document_id"), "text")
    chunks = ch.document_chunks(docs, offsets=False).withColumn("key", F.struct("document_id", F.col("chunk_index").cast("long").alias("chunk_index")))
    return vec.hash_embedding_long(chunks, "key", F.col("text"), None).select(
        "key.document_id", "key.chunk_index", "idx", F.round("value", 6).alias("value")
    )


@query(
    "vector_topk",
    """select query_id, rank, id, round(distance, 6) as distance
       from (select *, row_number() over (partition by query_id order by distance, id) as rank from x_distances) where rank <= 5""",
)
def _(t):
    rows = t.raw("embeddings")
    return vec.vector_topk(rows, rows, 5).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("distance", 6).alias("distance")
    )


@query(
    "vector_topk_filtered",
    """select query_id, rank, id, round(distance, 6) as distance
       from (select *, row_number() over (partition by query_id order by distance, id) as rank from x_distances where label = query_label) where rank <= 10""",
)
def _(t):
    rows = t.raw("embeddings")
    return vec.vector_topk(rows, rows, 10, group_col="label", query_group_col="label").select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("distance", 6).alias("distance")
    )


CHECK_FRAGMENTS.update(
    x_chunk_norms="select document_id, chunk_index, sqrt(sum(weight * weight)) as norm from x_chunk_entries group by all",
    x_question_entries=duck_hash_entries("v_questions", "question_id", "question", ""),
    x_question_norms="select question_id, sqrt(sum(weight * weight)) as norm from x_question_entries group by 1",
    x_found="""
        select question_id, document_id, chunk_index, distance, row_number() over (partition by question_id order by distance, document_id || '#' || chunk_index) as rank from (
          select q.question_id, c.document_id, c.chunk_index, round(1 - sum(q.weight * c.weight) / (any_value(qn.norm) * any_value(cn.norm)), 9) as distance
          from x_question_entries q join x_chunk_entries c on c.idx = q.idx join x_question_norms qn on qn.question_id = q.question_id
          join x_chunk_norms cn on cn.document_id = c.document_id and cn.chunk_index = c.chunk_index group by 1, 2, 3)""",
)


@query(
    "question_retrieval",
    "select question_id, rank, document_id, chunk_index, round(distance, 6) as distance from x_found where rank <= 5",
)
def _(t):
    """Every question against the whole chunk store, both embedded by token hashes."""
    docs = t.spread.documents.select(F.col("id").alias("document_id"), "text")
    chunks = ch.document_chunks(docs, offsets=False).withColumn("key", F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")))
    stored = vec.hash_vectors(chunks, "key", F.col("text"), None)
    asked = vec.hash_vectors(t.questions, "question_id", F.col("question"), None)
    found = vec.vector_topk(stored, asked, 5, id_col="key", vec_col="entries", query_id_col="question_id")
    return found.select(
        F.col("query_id").alias("question_id"), F.col("rank").cast("long").alias("rank"),
        F.substring_index("id", "#", 1).alias("document_id"), F.substring_index("id", "#", -1).cast("long").alias("chunk_index"),
        F.round("distance", 6).alias("distance"),
    )


# The filing under pivots is deterministic, so it can be repeated row by row; tests measure the recall.
@query(
    "vector_topk_approx",
    """with x_many as (select greatest(1, round(sqrt(count(*))))::int as lists from x_unit),
            x_pivots as (select row_number() over (order by md5(vec_id::varchar), vec_id) as list, v from x_unit
                         qualify list <= (select lists from x_many)),
            x_close as (select u.vec_id, p.list, row_number() over (partition by u.vec_id order by round(list_cosine_similarity(u.v, p.v), 12) desc, p.list) as r
                        from x_unit u, x_pivots p),
            x_probed as (select q.vec_id as query_id, d.vec_id as id from x_close q join x_close d on d.list = q.list and d.r = 1
                         where q.r <= (select ceil(3 * lists / 8.0) from x_many))
       select query_id, rank, id, round(distance, 6) as distance from (
         select query_id, id, distance, row_number() over (partition by query_id order by distance, id) as rank
         from x_distances join x_probed using (query_id, id)) where rank <= 5""",
)
def _(t):
    rows = t.raw("embeddings")
    return vec.vector_topk_approx(rows, rows, 5).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("distance", 6).alias("distance")
    )


@query(
    "chunk_store_stats",
    """select document_id, count(*) as chunks, sum(length(text))::bigint as characters from x_doc_chunks group by 1
       union all select 'all', count(*), sum(length(text))::bigint from x_doc_chunks""",
)
def _(t):
    docs = t.spread.documents.select(F.col("id").alias("document_id"), "text")
    per_document = ch.document_chunks(docs, offsets=False).groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters")
    )
    total = per_document.agg(F.sum("chunks").alias("chunks"), F.sum("characters").alias("characters"))
    return per_document.unionByName(total.select(F.lit("all").alias("document_id"), "chunks", "characters"))
