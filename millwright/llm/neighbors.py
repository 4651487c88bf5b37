"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform and
hashed to the signed axis it then lies nearest to; ``hashes`` such axes make a bucket, and there
are ``tables`` independent ones. A vector is stored in one bucket per table; a query looks into the
``probes`` buckets of a table that are nearest to it. How many of each is measured: the exact neighbours of up to PILOT
queries are found by one scan, and of the plans in PLANS that bring back TARGET of them the cheapest is taken. So buckets
get finer and fewer rows are compared as a table grows and neighbours lie closer. Members and queries of a bucket
meet in blocks of bounded size, so a bucket that holds much of the table is worked on by many
tasks. In a block exact cosines are worked out and the k best kept per query.

Equal vectors are one entry that carries its smallest ids; more of them could not be
among the k nearest. Queries that find fewer than k neighbours are searched once more against all.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm.common import bounded_batches, cut_lineage, deal, grouped_runs

# Plans that are tried, (tables, hashes, probes), and the share of a pilot's neighbours that a plan must find.
PLANS = [(tables, hashes, 1 << p) for hashes in (1, 2, 3) for tables in (4, 8) for p in range(1, 9)]
TARGET = 0.95
PILOT, SAMPLE = 128, 1024  # queries a pilot asks; entries that tell which share of all a plan compares
COPY_COST = 250  # comparisons that cost as much as sending a vector to a bucket
PROBE_CELLS = 1 << 22  # probe codes worked out at a time
MEMBERS, QUERIES_AT_ONCE = 4096, 1024  # rows of a block
_KEYS = ["space", "bucket", "mblock", "qblock"]
_ROWS = "space long, bucket long, mblock int, qblock int, asks boolean, id long, ids array<long>, vector "


class Hashing:
    """Pseudo-rotations for vectors of one length, drawn from a seed."""

    def __init__(self, dim: int, tables: int, hashes: int, seed: int):
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.tables, self.hashes = tables, hashes
        rng = np.random.default_rng([seed, dim])
        self.signs = rng.choice([-1.0, 1.0], (tables, hashes, 3, self.size))

    def rotated(self, x: np.ndarray, table: int, number: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for signs in self.signs[table, number]:
            y = _hadamard(y * signs)
        return y

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row: per hash 2 * axis, plus 1 for its negative end."""
        code = np.zeros(len(x), np.int64)
        for number in range(self.hashes):
            y = self.rotated(x, table, number)
            axis = np.abs(y).argmax(1)
            code = code * 2 * self.size + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return code

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` buckets nearest to each row: largest sums of the turned vector along the axes."""
        step = max(1, PROBE_CELLS // (count * min(count, 2 * self.size) if self.hashes > 1 else 2 * self.size))
        if len(x) > step:
            return np.concatenate([self.probes(x[i : i + step], table, count) for i in range(0, len(x), step)])
        code, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for number in range(self.hashes):
            y = self.rotated(x, table, number)
            ends = np.stack([y, -y], 2).reshape(len(y), -1)
            best = np.argsort(-ends, axis=1, kind="stable")[:, :count]
            code = (code[:, :, None] * 2 * self.size + best[:, None, :]).reshape(len(x), -1)
            score = (score[:, :, None] + np.take_along_axis(ends, best, 1)[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(-score, axis=1, kind="stable")[:, :count]
            code, score = np.take_along_axis(code, keep, 1), np.take_along_axis(score, keep, 1)
        return code


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers and not all of them zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
    plan: tuple[int, int, int] | None = None, seed: int = 7,
    members: int = MEMBERS, queries: int = QUERIES_AT_ONCE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest rows of every query by cosine, ties to the smaller id.

    Rows with a null id or a vector that is null, empty, zero or not finite take no part; vectors of different lengths
    are never neighbours. A query's own id is no candidate. Repeated rows of an id count once. Fewer than k come back
    only where there are fewer candidates. An empty table, or one without queries, gives no rows. ``plan`` (tables, hashes,
    probes) is chosen by a pilot unless it is given.
    """
    floats = vectors.schema[vector].dataType.simpleString() == "array<float>"  # these travel as they are
    rows = bounded_batches(vectors).where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<float>" if floats else "array<double>").alias("vector"), is_query.alias("asks")
    )
    of_vector = W.partitionBy("vector").orderBy("id")
    ids = rows.select("id", "vector").distinct().withColumn("n", F.row_number().over(of_vector)).where(F.col("n") <= k + 1)
    entries = cut_lineage(ids.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    asking = cut_lineage(rows.where("asks").select("id", "vector").distinct())
    if plan is None:
        plan = chosen_plan(entries, asking, k, seed)[0]
    found = cut_lineage(_search(entries, asking, k, (*plan, seed), members, queries))
    short = asking.select("id").distinct().join(
        found.groupBy("query_id").count().where(F.col("count") >= k), F.col("id") == F.col("query_id"), "left_anti"
    )
    if not short.isEmpty():
        again = asking.join(short, "id", "left_semi")
        rest = _search(entries, again, k, None, members, queries)
        found = found.join(rest.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest)
    return found


def chosen_plan(entries: DataFrame, asking: DataFrame, k: int, seed: int) -> tuple[tuple[int, int, int], float, float]:
    """The plan to search with, the share of the pilot's neighbours that it finds, and the share of all entries that it compares.

    The driver holds PILOT queries, SAMPLE entries and the pilot's k neighbours. Where no plan reaches TARGET, the
    one that finds most is taken.
    """
    first = lambda df, n: df.orderBy(F.xxhash64("vector")).limit(n).collect()
    asked = first(asking, PILOT)
    if not asked:
        return PLANS[0], 1.0, 0.0
    by_length: dict[int, list] = {}
    for row in asked:
        by_length.setdefault(len(row["vector"]), []).append(row)
    pilots = {dim: (np.array([r["id"] for r in rows]), _units(np.array([r["vector"] for r in rows]))) for dim, rows in by_length.items()}
    sample = [r["vector"] for r in first(entries.select("vector"), SAMPLE)]
    near: dict[tuple[int, int], list] = {}
    for row in _pilot_neighbours(entries, pilots, k).collect():
        near.setdefault((row["dim"], row["query"]), []).append(row["vector"])
    sides = {}
    for dim, (_, queries) in pilots.items():
        pairs = [(q, v) for q in range(len(queries)) for v in near.get((dim, q), [])]
        others = [v for v in sample if len(v) == dim]
        sides[dim] = (queries, np.array([q for q, _ in pairs], np.int64), _units(np.array([v for _, v in pairs]).reshape(-1, dim)),
                      _units(np.array(others).reshape(-1, dim)))
    n_queries, n_entries = asking.count(), max(entries.count(), 1)
    tried = []
    for hashes in sorted({p[1] for p in PLANS}):
        for tables in sorted({p[0] for p in PLANS if p[1] == hashes}):
            counts = sorted({p[2] for p in PLANS if p[:2] == (tables, hashes)})
            found, compared = _found_by(sides, tables, hashes, counts, seed)
            for count, recall, share in zip(counts, found, compared, strict=True):
                cost = tables + tables * count * n_queries / n_entries + share * n_queries / COPY_COST
                tried.append((recall < TARGET, cost if recall >= TARGET else -recall, (tables, hashes, count), recall, share))
    return min(tried)[2:]


def _found_by(sides: dict, tables: int, hashes: int, counts: list[int], seed: int) -> tuple[list[float], list[float]]:
    """Per number of probes: the share of known neighbours found, and of sampled entries looked at."""
    hits, seen = np.zeros((2, len(counts))), np.zeros(2)
    for dim, (queries, owner, neighbours, others) in sides.items():
        hashing = Hashing(dim, tables, hashes, seed)
        met, looked = np.zeros((len(counts), len(owner)), bool), np.zeros((len(counts), len(queries), len(others)), bool)
        for table in range(tables):
            probes = hashing.probes(queries, table, counts[-1])
            codes, other_codes = hashing.buckets(neighbours, table), hashing.buckets(others, table)
            for i, count in enumerate(counts):
                met[i] |= (probes[owner, :count] == codes[:, None]).any(1)
                looked[i] |= np.array([np.isin(other_codes, row[:count]) for row in probes]).reshape(looked[i].shape)
        hits += np.stack([met.sum(1), looked.sum((1, 2))])
        seen += len(owner), len(queries) * len(others)
    shares = hits / np.maximum(seen, 1)[:, None]
    return np.where(seen[0], shares[0], 1.0).tolist(), shares[1].tolist()


def _pilot_neighbours(entries: DataFrame, pilots: dict, k: int) -> DataFrame:
    """(dim, query, score, vector) of the k exact neighbours of every pilot query, by one scan that shuffles k rows a task and query."""
    shipped = entries.sparkSession.sparkContext.broadcast(pilots)

    def scan(batches):
        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            owners, vectors = batch.column(0), batch.column(1)
            offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
            lengths = np.diff(offsets)
            for dim, (ids, queries) in shipped.value.items():
                rows = np.flatnonzero(lengths == dim)
                if not len(rows):
                    continue
                raw = flat[offsets[rows][:, None] + np.arange(dim)]
                scores = queries @ _units(raw).T
                want = min(k + 1, len(rows))
                for q, at in enumerate(np.argpartition(-scores, want - 1, axis=1)[:, :want]):
                    mine = [(float(scores[q, j]), raw[j].tolist()) for j in at if owners[int(rows[j])].as_py() != [ids[q]]]
                    best[dim, q] = sorted(best.get((dim, q), []) + mine, reverse=True)[:k]
        for (dim, q), found in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * len(found), pa.int32()), pa.array([q] * len(found), pa.int32()), pa.array([x for x, _ in found], pa.float64()),
                 pa.array([v for _, v in found], pa.list_(pa.float64()))], ["dim", "query", "score", "vector"])

    met = entries.select("ids", "vector").mapInArrow(scan, "dim int, query int, score double, vector array<double>")
    order = W.partitionBy("dim", "query").orderBy(F.desc("score"), "vector")
    return met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def _search(entries: DataFrame, asking: DataFrame, k: int, plan: tuple | None, members: int, queries: int) -> DataFrame:
    """Best k of the entries that share a bucket with each query; without a plan all entries share one."""
    spark = entries.sparkSession
    both = entries.select(F.lit(False).alias("asks"), F.lit(None).cast("long").alias("id"), "ids", "vector")
    both = both.unionByName(asking.select(F.lit(True).alias("asks"), "id", F.lit(None).cast("array<long>").alias("ids"), "vector"))

    def places(batches):
        """Per batch: row numbers, spaces (table and vector length) and buckets of all its places."""
        hashing = {}
        for batch in batches:
            lists = batch.column(3)
            asks = batch.column(0).to_numpy(zero_copy_only=False)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
            found = []
            for dim in np.unique(lengths).tolist():
                if plan is None:
                    found.append((np.flatnonzero(lengths == dim), np.full((lengths == dim).sum(), dim), 0))
                    continue
                tables, hashes, probes, seed = plan
                if dim not in hashing:
                    hashing[dim] = Hashing(dim, tables, hashes, seed)
                for side in (False, True):
                    at = np.flatnonzero((lengths == dim) & (asks == side))
                    if not len(at):
                        continue
                    x = flat[starts[at][:, None] + np.arange(dim)]
                    x = _units(x)
                    for table in range(tables):
                        space = table * (1 << 32) + dim
                        if side:
                            codes = hashing[dim].probes(x, table, probes)
                            found.append((np.repeat(at, codes.shape[1]), np.full(codes.size, space), codes.ravel()))
                        else:
                            found.append((at, np.full(len(at), space), hashing[dim].buckets(x, table)))
            if found:
                yield batch, *(np.concatenate([np.broadcast_to(f[i], f[0].shape) for f in found]) for i in range(3))

    def count(batches):
        for batch, at, space, bucket in places(batches):
            asks = batch.column(0).to_numpy(zero_copy_only=False)[at]
            keys, back = np.unique(np.stack([space, bucket]), axis=1, return_inverse=True)
            n = np.bincount(back.ravel(), weights=~asks, minlength=keys.shape[1]), np.bincount(back.ravel(), weights=asks, minlength=keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[0]), pa.array(keys[1]), *(pa.array(x.astype(np.int64)) for x in n)], ["space", "bucket", "members", "queries"]
            )

    # the buckets of all tables: their number is bounded by the hashing, only crowded ones come back
    sizes = both.mapInArrow(count, "space long, bucket long, members long, queries long").groupBy("space", "bucket")
    sizes = sizes.agg(F.sum("members").alias("members"), F.sum("queries").alias("queries"))
    crowded = sizes.where((F.col("members") > members) | (F.col("queries") > queries)).where("members > 0 and queries > 0")
    blocks = spark.sparkContext.broadcast({
        (r.space, r.bucket): (-(-r.members // members), -(-r.queries // queries)) for r in crowded.collect()
    })

    def firsts(lists: pa.Array) -> np.ndarray:
        return pc.list_element(lists.fill_null([0]), 0).to_numpy()

    def deal_out(batches):
        for batch, at, space, bucket in places(batches):
            asks = batch.column(0).to_numpy(zero_copy_only=False)[at]
            keys, back = np.unique(np.stack([space, bucket]), axis=1, return_inverse=True)
            split = np.array([blocks.value.get(tuple(key), (1, 1)) for key in keys.T.tolist()], np.int64)[back.ravel()]
            own_split, other_split = np.where(asks, split[:, 1], split[:, 0]), np.where(asks, split[:, 0], split[:, 1])
            name = np.where(asks, batch.column(1).fill_null(0).to_numpy()[at], firsts(batch.column(2))[at])
            own = ((name.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % own_split
            picked = np.repeat(np.arange(len(at)), other_split)
            other = np.arange(len(picked)) - np.repeat(np.cumsum(other_split) - other_split, other_split)
            mblock = np.where(asks[picked], other, own[picked]).astype(np.int32)
            qblock = np.where(asks[picked], own[picked], other).astype(np.int32)
            rows = pa.array(at[picked])
            arrays = [pa.array(space[picked].astype(np.int64)), pa.array(bucket[picked]), pa.array(mblock), pa.array(qblock)]
            for start in range(0, len(rows), 8192):
                part = slice(start, start + 8192)
                yield pa.RecordBatch.from_arrays(
                    [a[part] for a in arrays] + [batch.column(i).take(rows[part]) for i in range(4)],
                    [*_KEYS, "asks", "id", "ids", "vector"],
                )

    def rank(batches):
        for table in grouped_runs(batches, _KEYS, 20_000):
            yield from _best_of_groups(table, k)

    placed = deal(both.mapInArrow(deal_out, _ROWS + entries.schema["vector"].dataType.simpleString()), *_KEYS).sortWithinPartitions(*_KEYS)
    met = placed.mapInArrow(rank, "query_id long, vec_id long, score double")
    met = met.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best_of_groups(table: pa.Table, k: int):
    """(query_id, vec_id, score) of the k best entries of each query inside its block."""
    table = table.combine_chunks()
    keys = [table.column(n).to_numpy() for n in _KEYS]
    asks = table.column("asks").to_numpy()
    changed = np.zeros(len(asks), bool)
    for column in keys:
        changed[1:] |= column[1:] != column[:-1]
    edges = [0, *np.flatnonzero(changed).tolist(), len(asks)]
    ids, owners = table.column("id").to_numpy(), table.column("ids")
    vectors = table.column("vector").combine_chunks()
    offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy()
    for start, end in itertools.pairwise(edges):
        rows = np.arange(start, end)
        query, member = rows[asks[start:end]], rows[~asks[start:end]]
        if not len(query) or not len(member):
            continue
        dim = int(offsets[start + 1] - offsets[start])
        q, m = (_scaled(flat[offsets[r][:, None] + np.arange(dim)]) for r in (query, member))
        scores = (q / _norms(q)[:, None]) @ (m / _norms(m)[:, None]).T
        want = min(k + 1, len(member))
        edge = -np.partition(-scores, want - 1, axis=1)[:, want - 1]
        i, j = np.nonzero(scores >= edge[:, None] - 1e-9)
        exact = (q[i] * m[j]).sum(1) / (_norms(q)[i] * _norms(m)[j])  # the same for a pair in whatever block
        lists = [owners[int(r)].as_py() for r in member[j]]
        n = [len(x) for x in lists]
        found = np.array([x for own in lists for x in own], np.int64)
        asked, exact = np.repeat(ids[query[i]], n).astype(np.int64), np.repeat(exact, n)
        other = asked != found
        yield pa.RecordBatch.from_arrays(
            [pa.array(asked[other]), pa.array(found[other]), pa.array(exact[other])], ["query_id", "vec_id", "score"]
        )


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; cosines stay bit for bit."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _units(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x.astype(np.float64)
    x = _scaled(x)
    return x / _norms(x)[:, None]
