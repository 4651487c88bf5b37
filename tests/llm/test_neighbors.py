"""Recall against an exact search, exact scores and ties, and odd vectors."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millwright.llm import neighbors
from millwright.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, ids string, n int"


def exact(vectors, k=5, every=50):
    out = {}
    for i, a in vectors.items():
        if i % every:
            continue
        scores = [((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), j) for j, b in vectors.items() if j != i and len(a) == len(b)]
        out[i] = [(j, s) for s, j in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def test_recall_of_the_query(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()}
    want = exact(vectors)
    got = {}
    for r in QUERIES["op3_cross_polytope"](spark, MIDDLE).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    hits = 0
    for query, rows in got.items():
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        for r in rows:
            a, b = vectors[query], vectors[r.vec_id]
            assert abs(r.score - (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())) < 1e-12
        hits += len({r.vec_id for r in rows} & {j for j, _ in want[query]})
    assert hits / (5 * len(want)) >= 0.9


@pytest.mark.parametrize("members, queries, plan", [(4096, 1024, None), (16, 4, (16, 1, 6)), (4096, 1024, (16, 2, 6))])
def test_hot_vector_and_blocks(spark, members, queries, plan):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).astype(np.float32)
    rows = {i: hot if i % 3 == 0 else (hot + rng.normal(size=8) * 0.05).astype(np.float32) for i in range(600)}
    frame = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in rows.items()], SCHEMA).repartition(4)
    got = neighbors.nearest(frame, F.col("vec_id") % 50 == 0, members=members, queries=queries, plan=plan)
    want = exact({i: v.astype(float) for i, v in rows.items()})
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    for i in range(0, 600, 150):
        assert found[i] == [j for j, _ in want[i]]
    assert sum(len(set(found[i]) & {j for j, _ in w}) for i, w in want.items()) >= 0.9 * 5 * len(want)


def clustered(spark, path, n, width=64):
    """n vectors of a few hundred topics, 100 vectors each however many there are of them."""
    rng = np.random.default_rng(n)
    topics = rng.normal(size=(max(1, n // 100), width))
    x = (topics[rng.integers(0, len(topics), n)] + rng.normal(size=(n, width)) * 0.6).astype(np.float32)
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": column}), path, row_group_size=4096)
    return spark.read.parquet(str(path)), x.astype(float)


def test_buckets_get_finer_with_the_table(spark, tmp_path):
    shares = []
    for n in (1_000, 30_000):
        frame, x = clustered(spark, tmp_path / f"{n}.parquet", n)
        rows = frame.select(F.array("vec_id").alias("ids"), F.col("embedding").alias("vector"), F.col("vec_id").alias("id"))
        plan, recall, share = neighbors.chosen_plan(rows, rows.where("id % 50 = 0"), 5, 7)
        assert recall >= neighbors.TARGET
        shares.append(share)
        found = {}
        for r in neighbors.nearest(frame, F.col("vec_id") % 50 == 0).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        x /= np.sqrt((x * x).sum(1))[:, None]
        asked = np.arange(0, n, 50)
        scores = x[asked] @ x.T
        scores[np.arange(len(asked)), asked] = -2
        best = np.argsort(-scores, axis=1)[:, :5]
        hits = sum(len(found[q] & set(b)) for q, b in zip(asked.tolist(), best.tolist(), strict=True))
        assert hits / best.size >= 0.9
    assert shares[1] < shares[0]


def test_pilot_of_odd_tables(spark):
    layout = "id long, ids array<long>, vector array<double>"
    rows = spark.createDataFrame([(1, [1], [1.0, 0.0]), (2, [2], [0.0, 1.0, 0.0])], layout)
    assert neighbors.chosen_plan(rows.limit(0), rows.limit(0), 5, 7)[0] in neighbors.PLANS
    assert neighbors.chosen_plan(rows, rows, 5, 7)[0] in neighbors.PLANS  # no query has a neighbour


def test_odd_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, None), (7, []), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [float("inf"), 1.0]), (10, [2.0, 2.0]), (50, [3.0]), (100, [1e30, 1e30])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbors.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 10), (0, 3, 100), (0, 4, 2), (100, 1, 1), (100, 2, 10), (100, 3, 0), (100, 4, 2)]
    assert neighbors.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert neighbors.nearest(frame, F.lit(False)).collect() == []
