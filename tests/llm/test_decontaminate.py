"""Winnowing against a plain search for every window."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from millwright.llm import decontaminate
from millwright.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    spans = {}
    for item, text in items:
        words = words_of(text)
        t = min(window, len(words))
        for i in range(len(words) - t + 1 if words else 0):
            spans.setdefault(tuple(words[i : i + t]), set()).add(item)
    lengths = {len(s) for s in spans}
    out = []
    for _, text in docs:
        words, hit, found = words_of(text), set(), set()
        for t in lengths:
            for i in range(len(words) - t + 1):
                owners = spans.get(tuple(words[i : i + t]))
                if owners is not None:
                    hit |= set(range(i, i + t))
                    found |= {str(x) for x in owners if x is not None}
        out.append((len(words), len(hit), len(found), sorted(found)))
    return out


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "uid long, text string, n long").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b, {"n": F.col("n"), "uid_": F.col("uid")}, **options).orderBy("n").collect()
    return [(r.n_words, r.n_hit, r.n_items, list(r["items"])) for r in got]


def test_query_equals_plain_search(spark):
    read = lambda name: [tuple(r)[:2] for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()]
    docs = read("documents")
    want = {
        d[0]: (w, h, n, hashlib.sha256(",".join(items).encode()).hexdigest(), h > 0)
        for d, (w, h, n, items) in zip(docs, plain(docs, read("benchmark")))
    }
    rows = QUERIES["op4_winnowing"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)


def test_random_texts_over_few_words(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(rng.choice(["a", "b", "É9"], n))
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(12)] + [(None, text(11)), (3, text(14)), (50, "a  B."), (51, "a b")]
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(60)] + [(1, None), (1, ""), (None, "!?"), (7, "x" * 300_000 + " a B")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, items, window=4) == plain(docs, items, 4)


def test_no_items_no_documents(spark):
    docs = [(1, "a b c"), (1, "a b c")]
    assert run(spark, docs, [(1, None), (2, "..")]) == [(3, 0, 0, [])] * 2
    assert run(spark, [], [(1, "a")]) == []


def test_drop_contaminated(spark):
    shared = " ".join(f"w{i}" for i in range(12))
    rows = [(1, "pre " + shared + " post"), (1, "pre " + shared + " post"), (2, "clean text"), (None, shared.upper()), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "d") for i, t in rows], "doc_id long, text string, digest string")
    items = spark.createDataFrame([(1, shared)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
