"""Near copies by exact shingle similarity.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is THRESHOLD or
more. Candidates are complete: in any one order of all shingles, two such sets share one of the first
n - ceil(THRESHOLD * n) + 1 shingles of each. Shingles that many documents of a sample hold come last in that order, so a
common passage brings nobody together. Candidates are confirmed on the whole sets. Each shared shingle first offers its
members one partner only; all pairs are looked at just where that left its members in different components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import bounded_batches, by_slices, cut_lineage, free_name, text_buffers
from millwright.llm.components import components
from millwright.llm.hashing import BASE, bounds, mixed, range_hashes

SHINGLE = 5
THRESHOLD = 0.8
SAMPLE = 16  # common shingles are looked for in one of so many texts
COMMON_ROWS = 100_000  # most common shingles that are put last

# Blanks that part words, and lower case, as in simhash.
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_NONE = np.zeros(0, np.uint64)


def _shingles(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted hashes of every text's distinct shingles; fewer than ``size`` words form one, no words none."""
    data, offsets = text_buffers(texts)
    data = _LOWER[data]
    starts, ends = bounds(~_BLANK[data], offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    words = range_hashes(data, starts, ends)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    with np.errstate(over="ignore"):
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = words[first:last]
            n = min(size, len(own))
            hashes = np.full(len(own) - n + 1 if n else 0, n, np.uint64)
            for j in range(n):
                hashes = hashes * np.uint64(BASE) + own[j : j + len(hashes)]
            out.append(np.unique(mixed(hashes)))
    return out


def shingle_set(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the distinct shingles of a text as an array of longs."""

    def work(texts: pa.Array) -> pa.Array:
        return pa.array([x.view(np.int64) for x in by_slices(texts, lambda part: _shingles(part, size))], pa.list_(pa.int64()))

    return F.arrow_udf(work, "array<long>")(text.cast("string"))


def _prefixes(text: Column, size: int, permille: int, common: np.ndarray) -> Column:
    """struct<set_id, n, prefix>: digest and size of the shingle set, and its first shingles, common ones last."""

    def one_slice(texts):
        found = []
        for own in _shingles(texts, size):
            most = len(own) + permille * len(own) // -1000 + 1 if len(own) else 0  # n - ceil(t n) + 1
            last = np.isin(own, common)
            order = np.r_[own[~last], own[last]]
            digest = np.uint64(xxhash.xxh64_intdigest(own.tobytes())).astype(np.int64)
            found.append({"set_id": int(digest), "n": len(own), "prefix": order[:most].view(np.int64)})
        return found

    kind = pa.struct([("set_id", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def work(texts: pa.Array) -> pa.Array:
        return pa.array(list(by_slices(texts, one_slice)), kind)

    return F.arrow_udf(work, "struct<set_id: long, n: int, prefix: array<long>>")(text.cast("string"))


def common_shingles(docs: DataFrame, text: str, size: int = SHINGLE) -> np.ndarray:
    """Shingles that four or more texts of a sample hold, the most common COMMON_ROWS of them."""
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0)
    counts = some.select(F.explode(shingle_set(F.col(text), size)).alias("x")).groupBy("x").count().where("count >= 4")
    rows = counts.orderBy(F.desc("count"), "x").limit(COMMON_ROWS).collect()
    return np.sort(np.array([r.x for r in rows], np.int64).view(np.uint64)) if rows else _NONE


def near_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document that has words: its id column, ``set_id`` and ``component_id``.

    ``component_id`` is the smallest id reachable over pairs of similarity ``threshold`` or more, null only where no id of
    the group is known. Repeated rows stay. Texts without words have no shingles and are left out.
    """
    permille = round(threshold * 1000)
    docs = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = _prefixes(F.col("text"), size, permille, common_shingles(docs, "text", size))
    rows = cut_lineage(docs.select("doc_id", found.alias("s")).select("doc_id", "s.*").where("n > 0"))
    sets = rows.groupBy("set_id").agg(F.min("doc_id").alias("least"))
    tokens = rows.select("set_id", "n", "prefix").dropDuplicates(["set_id"])
    tokens = tokens.select("set_id", "n", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("held"), F.min("set_id").alias("other")).where("held > 1")
    members = cut_lineage(tokens.join(shared, "token").select("token", "set_id", "n", "other"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of set ids whose whole sets are similar enough."""
        pairs = cut_lineage(pairs.distinct())
        asked = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        whose = cut_lineage(asked.join(sets, "set_id"))
        ids = whose.select(F.col("least").alias("asked")).distinct()
        texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("asked")), "left_semi")
        whole = texts.select(shingle_set(F.col("text"), size).alias("x"), _prefixes(F.col("text"), size, permille, _NONE)["set_id"].alias("set_id"))
        whole = cut_lineage(whole.join(asked, "set_id", "left_semi").dropDuplicates(["set_id"]))
        left, right = (whole.select(F.col("set_id").alias(k), F.col("x").alias(f"{k}_x")) for k in "ab")
        both = F.size(F.array_intersect("a_x", "b_x"))
        either = F.size("a_x") + F.size("b_x") - both
        return cut_lineage(pairs.join(left, "a").join(right, "b").where(1000 * both >= permille * either).select("a", "b"))

    # set sizes of a similar pair are no further apart than the threshold
    near = 1000 * F.least("n", "m") >= permille * F.greatest("n", "m")
    offered = members.join(rows.select(F.col("set_id").alias("other"), F.col("n").alias("m")).distinct(), "other")
    links = confirmed(offered.where((F.col("set_id") != F.col("other")) & near).select(F.col("other").alias("a"), F.col("set_id").alias("b")))
    roots = cut_lineage(components(links))
    placed = members.join(roots, members.set_id == roots.node, "left").select(
        "token", "set_id", "n", F.coalesce("root", "set_id").alias("root")
    )
    split = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    placed = cut_lineage(placed.join(split.select("token"), "token"))
    others = placed.select("token", F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("root").alias("b_root"))
    met = placed.withColumnRenamed("set_id", "a").join(others, "token").where((F.col("a") < F.col("b")) & (F.col("root") != F.col("b_root")) & near)
    roots = cut_lineage(components(links.union(confirmed(met.select("a", "b")))))
    rooted = cut_lineage(sets.join(roots, sets.set_id == roots.node, "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, "root").select("set_id", "component_id")
    return rows.join(labels, "set_id").select(F.col("doc_id").alias(doc_id), "set_id", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay: of each group of near copies the rows with its smallest id; rows with a null id stay."""
    groups = near_copies(docs, text, doc_id, threshold=threshold)
    mark = free_name(docs, "dropped")
    dropped = groups.where(F.col(doc_id) != F.col("component_id")).select(F.col(doc_id).alias(mark)).distinct()
    return docs.join(dropped, docs[doc_id] == F.col(mark), "left_anti")
