"""The classifier's accuracy on labelled documents, exact sampling, and odd inputs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millwright.llm import quality
from millwright.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"


def test_good_documents_stay_and_bad_ones_go(spark):
    kept = {r.doc_id for r in QUERIES["op7_importance_resampling"](spark, MIDDLE).collect()}
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1 and not r.toxic]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    toxic = [r.doc_id in kept for r in labels if r.quality == 1 and r.toxic]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1 and np.mean(toxic) < 0.35


def test_fit_equals_plain_counts(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, 30)) + (" rude" if i % 5 == 0 else "") for i in range(200)] + [None, "", "rude rude"]
    marks = [quality.UNWANTED if i % 5 == 0 else quality.FIT if i % 5 == 1 else quality.HELD_OUT if i % 5 == 2 else 0 for i in range(203)]
    docs = spark.createDataFrame([*zip(texts, marks)], "text string, m int").repartition(3)
    model = quality.fit(docs, "m")
    buckets, owners = quality.hashed_ngrams(pa.array(texts))
    raw = np.bincount(buckets, minlength=1 << quality.BUCKET_BITS)
    good = np.bincount(buckets[np.array(marks)[owners] == quality.FIT], minlength=len(raw))
    assert np.allclose(model.ratios, np.log((good + 10) / (raw * (good.sum() / raw.sum()) + 10)))
    rude = np.flatnonzero(model.warnings)
    holders = sum(m == quality.UNWANTED and "rude" in (t or "") for t, m in zip(texts, marks))
    n_good, n_bad = marks.count(quality.FIT), marks.count(quality.UNWANTED)
    assert len(rude) == 1 and np.isclose(model.warnings[rude[0]], np.log(holders / (n_bad / (n_good + 1))))
    weight = lambda t: docs.sparkSession.createDataFrame([(t,)], "t string").select(quality.log_weight(F.col("t"), *model)).first()[0]
    long = " ".join(rng.choice(words, 5000))
    assert weight(long + " rude rude") < weight(long) - 1.9 * model.warnings[rude[0]]


def test_unwanted_ids_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (2, "c", 8), (None, "d", 9)], "doc_id long, text string, target int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    marked = quality.with_target(docs, ids(1, 2), "mark", unwanted=ids(2, 5))
    got = sorted(((r.doc_id or 0), r.target, r.mark) for r in marked.collect())
    part = got[1][2]
    assert part in (quality.FIT, quality.HELD_OUT)
    assert got == [(0, 9, 0), (1, 7, part), (1, 7, part), (2, 8, quality.UNWANTED)]
    kept = quality.sampled(marked, "mark", k=4)
    assert kept.columns == docs.columns and kept.count() == 4


def test_kth_largest(spark):
    values = np.random.default_rng(1).normal(size=30_000).round(3).tolist() + [None, 5e300, -5e300]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted((v for v in values if v is not None), reverse=True)
    for k in (1, 2, 15_000, 29_999, 30_002):
        assert quality.kth_largest(rows, "x", k) == ordered[k - 1]
    assert quality.kth_largest(rows, "x", 30_003) is None
    same = spark.range(20_000).select(F.lit(2.5).alias("x"))
    assert quality.kth_largest(same, "x", 700) == 2.5


def test_fixed_size_sample_and_odd_texts(spark):
    texts = [None, "", " \n", "word " * 100_000, *["plain words here and there"] * 20, *["A!! B!! C!!"] * 20]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, sample_key string")
    target = spark.createDataFrame([(i,) for i in range(4, 24)], "doc_id long")
    marked = quality.with_target(docs, target, "target")
    got = quality.sampled(marked, "target", k=10)
    assert got.columns == docs.columns and got.count() == 10
    _, least, scored = quality.resample(marked, "target", k=10)
    keys = sorted((r.sample_key for r in scored.collect()), reverse=True)
    assert least == keys[9] and len(keys) == len(texts)
    weights = {r.doc_id: r.log_weight for r in scored.collect()}
    assert weights[0] == weights[1] == weights[2] == 0.0 and weights[5] > weights[30]
    assert quality.sampled(marked.limit(0), "target").collect() == []


def test_weight_equals_plain_ratio(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    ratios = np.random.default_rng(0).normal(size=1 << quality.BUCKET_BITS)
    for row in docs.select("text", quality.log_weight(F.col("text"), ratios).alias("w")).collect():
        buckets, owners = quality.hashed_ngrams(pa.array(["x y z", row.text]))
        assert abs(row.w - ratios[buckets[owners == 1]].sum()) < 1e-9
    buckets, _ = quality.hashed_ngrams(pa.array(["a b a"]))
    assert len(buckets) == 3 + 2 + 3 + 2 + 1
