"""Hashed token vectors and nearest-neighbour search."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.common import strip, unnest
from millwright.session import cut_lineage, deal

DIMENSION = 384
# A query block is shipped to every task only up to this size.
BROADCAST_BYTES = 64 * 1024 * 1024


# ---- hashed vectors ---------------------------------------------------------
def flat_text(text: Column, max_chars: int | None = 5000) -> Column:
    """The text as the hash embedding reads it: its tokens are the runs of a-z, 0-9 and hyphens.

    Stored chunks are embedded up to ``max_chars`` characters, questions whole
    (``max_chars=None``).
    """
    flat = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    if max_chars is not None:
        flat = F.substring(flat, 1, max_chars)
    return F.lower(flat)


TOKEN = re.compile("[a-z0-9-]+")
ENTRIES = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("weight", T.IntegerType())]))
# Codes of tokens met before, up to so many in a Python worker.
KNOWN_TOKENS = 200_000


@lru_cache(KNOWN_TOKENS)
def _token_code(token: str) -> int:
    """Twice the token's position, plus one for a negative sign."""
    digest = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(digest[:4], "big") % DIMENSION * 2 + digest[4] % 2


def _entries_of(texts: pa.Array) -> pa.Array:
    sizes, codes = [], []
    for text in texts.to_pylist():
        found = [_token_code(t) for t in TOKEN.findall(text)] if text else []
        sizes.append(len(found))
        codes += found
    codes = np.array(codes, dtype=np.int64)
    place = np.repeat(np.arange(len(sizes)), sizes) * DIMENSION + codes // 2
    places, at = np.unique(place, return_inverse=True)
    weights = np.bincount(at, weights=1 - 2 * (codes % 2), minlength=len(places)).astype(np.int32)
    places, weights = places[weights != 0], weights[weights != 0]
    starts = np.searchsorted(places, np.arange(len(sizes) + 1) * DIMENSION).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array((places % DIMENSION).astype(np.int32)), pa.array(weights)], ["idx", "weight"])
    return pa.ListArray.from_arrays(pa.array(starts), entries, mask=texts.is_null())


def hash_entries(text: Column, max_chars: int | None = 5000) -> Column:
    """Non-zero (idx, weight) entries of the text's hashed vector, by position.

    Worked out a batch of rows at a time, so embedding a store shuffles nothing; a token met before is not hashed again.
    """
    return F.arrow_udf(_entries_of, ENTRIES)(flat_text(text, max_chars))


def entries_norm(entries: Column) -> Column:
    return F.sqrt(F.aggregate(entries, F.lit(0).cast("long"), lambda acc, e: acc + e["weight"] * e["weight"]).cast("double"))


def hash_vectors(texts: DataFrame, key: str, text: Column, max_chars: int | None = 5000) -> DataFrame:
    """One sparse vector per row: ``entries`` and their length ``norm``; no tokens, no entries."""
    return texts.select(key, hash_entries(text, max_chars).alias("entries")).withColumn("norm", entries_norm(F.col("entries")))


def hash_embedding_long(texts: DataFrame, key: str, text: Column, max_chars: int | None = 5000) -> DataFrame:
    """L2-normalised long form: (key, idx, value)."""
    vectors = hash_vectors(texts, key, text, max_chars)
    return unnest(vectors, [key, "norm"], F.col("entries"), "e").select(
        key, "e.idx", (F.col("e.weight") / F.col("norm")).alias("value")
    )


def distance_to(entries: Column, weights: dict[int, int]) -> Column:
    """Cosine distance of sparse entries to one small fixed vector; a zero vector is at distance 1."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    length = sum(w * w for w in weights.values()) ** 0.5
    dot = F.aggregate(
        entries, F.lit(0).cast("long"),
        lambda acc, e: acc + e["weight"] * F.coalesce(F.try_element_at(table, e["idx"]), F.lit(0)),
    )
    return F.round(1 - F.coalesce(F.try_divide(dot, entries_norm(entries) * length), F.lit(0.0)), 9)


# ---- exact search -----------------------------------------------------------
class _SparseRows:
    """Unit vectors that are kept as positions and weights; a slice of them is made dense when it is asked for.

    A row lists its positions, then their weights.
    """

    def __init__(self, column: pd.Series):
        rows = [np.asarray(v, dtype=np.int64) for v in column]
        sizes = np.array([len(r) // 2 for r in rows], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.at = np.concatenate([r[: len(r) // 2] for r in rows] or [np.empty(0)]).astype(np.int16)
        weights = np.concatenate([r[len(r) // 2:] for r in rows] or [np.empty(0)]).astype(np.float64)
        row = np.repeat(np.arange(len(rows)), sizes)
        norm = np.sqrt(np.bincount(row, weights=weights * weights, minlength=len(rows)))[row]
        self.weights = np.divide(weights, norm, out=np.zeros_like(weights), where=norm > 0)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, rows: slice) -> np.ndarray:
        starts = self.starts[rows.start:rows.stop + 1]
        entries = slice(starts[0], starts[-1])
        dense = np.zeros((len(starts) - 1, DIMENSION))
        dense[np.repeat(np.arange(len(dense)), np.diff(starts)), self.at[entries]] = self.weights[entries]
        return dense


def _matrix(column: pd.Series, sparse: bool = False) -> np.ndarray:
    """Rows as unit vectors; a zero vector stays zero.

    Dense rows are arrays; sparse rows list their positions, then their weights.
    """
    if sparse:
        return _SparseRows(column)[0:len(column)]
    dense = np.array([np.asarray(v, dtype=np.float64) for v in column])
    norm = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
    return np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)


# Rows of queries and of vectors that are compared at once: their products stay in a core's cache.
QUERY_TILE, VECTOR_TILE = 512, 2048


def _nearest(queries: np.ndarray | _SparseRows, q_filter, vectors: np.ndarray, v_group, ids: np.ndarray, k: int, bound: np.ndarray | None = None):
    """(query position, id, distance) of each query's k nearest rows; ties go to the lower id.

    Rows farther than a query's ``bound`` may be left out.  Every tile of vectors tightens the bounds for the next one.
    """
    order = np.argsort(ids, kind="stable")
    order = order[np.isfinite(vectors).all(axis=1)[order]]
    vectors, ids = vectors[order], ids[order]
    v_group = None if v_group is None else v_group[order]
    coarse_vectors = vectors.astype(np.float32)
    # twice the most that a product of unit vectors can be off by on either side
    slack = 4 * vectors.shape[1] * np.finfo(np.float32).eps
    out = []
    for lo in range(0, len(queries), QUERY_TILE):
        block = queries[lo:lo + QUERY_TILE]
        coarse_block = block.astype(np.float32)
        limit = np.full(len(block), np.inf) if bound is None else bound[lo:lo + QUERY_TILE].astype(np.float64)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for start in range(0, len(vectors), VECTOR_TILE):
            # single precision tells which rows can be among the nearest, double precision orders those
            near = coarse_block @ coarse_vectors[start:start + VECTOR_TILE].T
            if q_filter is not None:
                wanted = q_filter[lo:lo + QUERY_TILE]
                free = np.array([w is None for w in wanted])
                near[~free[:, None] & (wanted[:, None] != v_group[None, start:start + VECTOR_TILE])] = -np.inf
            width = near.shape[1]
            if width >= k and not np.isfinite(limit).all():
                limit = np.minimum(limit, 1.0 - np.partition(near, width - k, axis=1)[:, width - k])
            hits = np.flatnonzero(near >= (1.0 - limit - slack).astype(np.float32)[:, None])
            hits = hits[np.isfinite(near.ravel()[hits])]
            if not len(hits):
                continue
            q, row = hits // width, start + hits % width
            distance = np.empty(len(q))
            for at in range(0, len(q), 16384):
                part = slice(at, at + 16384)
                distance[part] = np.round(1.0 - np.einsum("ij,ij->i", block[q[part]], vectors[row[part]]), 9)
            q, row, distance = (np.concatenate(x) for x in zip(best, (q, row, distance)))
            nearest = np.lexsort((row, distance, q))
            q, row, distance = q[nearest], row[nearest], distance[nearest]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == k - 1
            limit[q[last]] = np.minimum(limit[q[last]], distance[last])
            best = tuple(x[place < k] for x in (q, row, distance))
        out.append((best[0] + lo, ids[best[1]], best[2]))
    if not out:
        return np.empty(0, np.int64), ids[:0], np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _merged(best, new, k: int, bound: np.ndarray):
    """The k nearest of each query among the rows found before and the new ones; ``bound`` is brought up to date.

    Ids are compared only where distances tie.
    """
    if best is not None:
        # queries without new rows keep theirs unsorted
        asked = np.zeros(len(bound), bool)
        asked[new[0]] = True
        again = asked[best[0]]
        idle, new = tuple(x[~again] for x in best), tuple(np.concatenate([x[again], y]) for x, y in zip(best, new))
    at, ids, distance = new
    order = np.lexsort((distance, at))
    same = (np.diff(at[order]) == 0) & (np.diff(distance[order]) == 0)
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(order) else order
    if len(tied):
        among = order[tied]
        order[tied] = among[np.lexsort((np.unique(ids[among], return_inverse=True)[1], distance[among], at[among]))]
    at, ids, distance = at[order], ids[order], distance[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    bound[at[place == k - 1]] = distance[place == k - 1]
    kept = tuple(x[place < k] for x in (at, ids, distance))
    return kept if best is None else tuple(np.concatenate(x) for x in zip(idle, kept))


def _rank(candidates: DataFrame, k: int) -> DataFrame:
    # row_number with a bound becomes a top-k per task ahead of the shuffle
    by_query = W.partitionBy("query_id").orderBy("distance", "id")
    return candidates.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def _is_sparse(df: DataFrame, vec_col: str) -> bool:
    return isinstance(df.schema[vec_col].dataType.elementType, T.StructType)


def _columns(df: DataFrame, id_col: str, vec_col: str, group_col: str | None) -> DataFrame:
    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    vec = F.col(vec_col)
    if _is_sparse(df, vec_col):
        vec = F.concat(F.transform(vec, lambda e: e["idx"]), F.transform(vec, lambda e: e["weight"]))
    return df.select(F.col(id_col).alias("id"), vec.alias("vec"), group.alias("grp"))


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_id_col: str = "vec_id",
    group_col: str | None = None,
    query_group_col: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact k nearest vectors of every query by cosine distance.

    ``query_group_col`` restricts a query to vectors of the same ``group_col``
    (null: no restriction).  Queries travel to the tasks in blocks of up to
    ``broadcast_bytes``, sparse ones as their entries; each block takes one plain scan of the vectors, which are
    never shuffled, and a task hands on k rows per query at its end.
    """
    v = _columns(vectors, id_col, vec_col, group_col)
    q = _columns(queries, query_id_col, vec_col, query_group_col)
    schema = f"query_id {q.schema['id'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, distance double"
    filtered = query_group_col is not None
    sparse = _is_sparse(vectors, vec_col)
    size = q.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"), F.sum(F.size("vec")).alias("items")).first()
    if not size["n"]:
        return _rank(q.sparkSession.createDataFrame([], schema), k)
    # a sparse query takes ten bytes an entry, which is two items, and a task holds its nearest rows
    bytes_of_all = size["items"] * 5 + size["n"] * (8 + 24 * k) if sparse else size["n"] * max(size["width"], DIMENSION) * 8
    blocks = -(-bytes_of_all // broadcast_bytes)
    if blocks == 1:
        return _rank(_scan_block(v, q, k, schema, filtered, sparse)[0], k)
    found = []
    if sparse:
        # hashed vectors come from texts, which are not hashed anew for every block
        v, q = cut_lineage(v), cut_lineage(q)
    for number in range(blocks):
        block = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number)
        rows, shipped = _scan_block(v, block, k, schema, filtered, sparse)
        found.append(cut_lineage(_rank(rows, k)))
        shipped.destroy()
    return reduce(DataFrame.unionByName, found)


def _scan_block(v: DataFrame, q: DataFrame, k: int, schema: str, filtered: bool, sparse: bool):
    """(k rows per query and task, the broadcast queries) of one block of queries."""
    block = q.toArrow().to_pandas()
    rows = _SparseRows(block["vec"]) if sparse else _matrix(block["vec"])
    shipped = q.sparkSession.sparkContext.broadcast((block["id"].to_numpy(), rows, block["grp"].to_numpy() if filtered else None))

    def scan(batches):
        q_ids, q_matrix, q_filter = shipped.value
        if not len(q_ids):
            return
        best, bound = None, np.full(len(q_ids), np.inf)
        for batch in batches:
            if len(batch):
                new = _nearest(
                    q_matrix, q_filter, _matrix(batch["vec"], sparse), batch["grp"].to_numpy() if filtered else None,
                    batch["id"].to_numpy(), k, bound,
                )
                best = _merged(best, new, k, bound)
        if best is not None:
            yield pd.DataFrame({"query_id": q_ids[best[0]], "id": best[1], "distance": best[2]})

    return v.mapInPandas(scan, schema), shipped


# ---- approximate search -----------------------------------------------------
def vector_topk_approx(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    lists: int | None = None,
    probes: int | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_id_col: str = "vec_id",
    rows_per_cell: int = 20_000,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Approximate k nearest: vectors are filed under their nearest pivot, queries probe a few lists.

    There are about as many lists as the square root of the rows, but no more than fit a block that is shipped to
    every task, and three eighths of them are probed, unless told otherwise.  Pivots are the first rows by the md5 of their id.
    Vectors are dealt by list, a crowded list over cells of about ``rows_per_cell``, and stay there. Queries are not sent to
    their lists one by one, which would copy each as often as it probes: they travel in blocks of up to ``broadcast_bytes``, and a
    task hands on k rows per query at its end.
    """
    v = _columns(vectors, id_col, vec_col, None)
    q = _columns(queries, query_id_col, vec_col, None)
    schema = f"query_id {q.schema['id'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, distance double"
    if lists is None:
        lists = max(1, min(round(v.count() ** 0.5), BROADCAST_BYTES // (DIMENSION * 8)))
    if probes is None:
        probes = -(-3 * lists // 8)
    if lists * DIMENSION * 8 > BROADCAST_BYTES:
        raise ValueError(f"{lists} pivots do not fit {BROADCAST_BYTES} bytes; ask for fewer lists")
    pivots = v.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(lists).toPandas()
    shipped = v.sparkSession.sparkContext.broadcast(_matrix(pivots["vec"]))

    def nearest_lists(n: int):
        def run(batches):
            for batch in batches:
                if len(batch):
                    closeness = _matrix(batch["vec"]) @ shipped.value.T
                    best = np.argsort(-closeness, axis=1, kind="stable")[:, :n]
                    batch["lists"] = best.astype(np.int64).tolist()
                    yield batch
        return run

    def filed(df: DataFrame, n: int) -> DataFrame:
        layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(nearest_lists(n), f"{layout}, lists array<long>").withColumn("list", F.explode("lists")).drop("lists")

    v_filed = filed(v, 1)
    parts = v_filed.groupBy("list").agg(F.ceil(F.count("*") / rows_per_cell).cast("int").alias("parts"))
    celled = v_filed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    cells = cut_lineage(deal(celled, "list", "part").sortWithinPartitions("list", "part").select("id", "vec", "list"))
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema.fields)
    probing = cut_lineage(q.mapInPandas(nearest_lists(probes), f"{layout}, lists array<long>"))
    size = probing.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    # a query takes its vector and a mark per list
    blocks = max(1, -(-size["n"] * (max(size["width"] or 0, DIMENSION) * 8 + lists) // broadcast_bytes))
    found = []
    for number in range(blocks):
        block = probing if blocks == 1 else probing.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number)
        rows, sent = _scan_lists(cells, block, k, schema, lists)
        found.append(_rank(rows, k) if blocks == 1 else cut_lineage(_rank(rows, k)))
        if blocks > 1:
            sent.destroy()
    return reduce(DataFrame.unionByName, found)


def _scan_lists(cells: DataFrame, q: DataFrame, k: int, schema: str, lists: int):
    """(k rows per query and task, the broadcast queries) of one block of queries, each against the lists it probes."""
    block = q.toPandas()
    probed = np.zeros((lists, len(block)), bool)
    for at, own in enumerate(block["lists"]):
        probed[np.asarray(own, dtype=np.int64), at] = True
    ids = block["id"].to_numpy()
    shipped = q.sparkSession.sparkContext.broadcast((ids, _matrix(block["vec"]) if len(block) else None, probed))

    def scan(batches):
        q_ids, q_matrix, probed = shipped.value
        if not len(q_ids):
            return
        best, bound = None, np.full(len(q_ids), np.inf)
        for batch in batches:
            for number, rows in batch.groupby("list"):
                asking = np.flatnonzero(probed[number])
                if len(asking):
                    pos, ids, dist = _nearest(q_matrix[asking], None, _matrix(rows["vec"]), None, rows["id"].to_numpy(), k, bound[asking])
                    best = _merged(best, (asking[pos], ids, dist), k, bound)
        if best is not None:
            yield pd.DataFrame({"query_id": q_ids[best[0]], "id": best[1], "distance": best[2]})

    return cells.mapInPandas(scan, schema), shipped
