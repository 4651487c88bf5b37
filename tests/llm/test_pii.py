"""Base spans against the patterns as they stand, and what the field adds."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.llm import pii
from millwright.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        if not 13 <= len(digits) <= 19:
            return False
        total = 0
        for i, d in enumerate(map(int, reversed(digits))):
            total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
        return total % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if passes(k, m[0])]


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_on_random_texts(seed):
    rng = np.random.default_rng(seed)
    parts = list("a@.+-_%() 019é\n") + ["4111 1111 1111 1111", "1.2.3.4", "+1 (743) 555-3824", "x@y.z", "256", "@a.b"]
    for _ in range(40):
        text = "".join(rng.choice(parts, 40))
        assert pii.base_spans(text) == plain(text)


def test_query_keeps_every_base_span(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_skip_chain_pii"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    some = 0
    for d in docs:
        base, row = plain(d.text), rows[d.doc_id]
        counts = [sum(k == kind for k, _, _ in base) for kind in range(4)]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        assert row.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        found = [tuple(x.split(":")) for x in row.spans.split(",") if x]
        assert {(pii.KINDS[k], str(s), str(e)) for k, s, e in base} <= set(found)
        assert found == sorted(found, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))
        some += len(base)
    assert some


def test_repeats_written_differently_are_found(spark):
    phones = [f"call +1 (743) 555-{n:04d} now. or 743-555-{n:04d} later" for n in range(1000, 1040)]
    twice = [f"call +1 (743) 555-{n:04d} now. +1 (743) 555-{n:04d}" for n in range(2000, 2100)]
    texts = [*phones, *twice, "room 12 and 743-555-9999", None, "", "1" * 5000 + " " + "x@" * 3000, *["item 15 of 20"] * 50]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, nodes string")
    got = pii.personal_data(docs, {"doc_id": F.col("doc_id"), "nodes_": F.col("nodes")}).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(len(texts)))
    for r in got[:40]:
        at = texts[r.doc_id].index("743-555")
        assert (3, at, at + 12) in [tuple(s) for s in r.spans] and len(r.base) == 1
    for r in got[140:]:
        assert r.spans == r.base == []
    assert pii.personal_data(docs.limit(0), {"doc_id": F.col("doc_id")}).collect() == []


def random_field(rng, loops):
    """A field of 2 to 6 nodes with random weights; without ``loops`` no node repeats an earlier one."""
    n = int(rng.integers(2, 7))
    names = [str(x) for x in (rng.integers(0, 3, n) if loops else range(n))]
    document = [
        {"label": int(rng.choice([pii.OTHER, pii.OTHER, rng.integers(0, 4)])), "code": int(rng.integers(0, 21)), "start": i, "end": i + 1, "same": x, "near": None}
        for i, x in enumerate(names)
    ]
    pair = lambda scale: (lambda x: (x + x.T) / 2)(rng.normal(0, scale, (5, 5)))
    return document, pii.Field(rng.normal(0, 1, (pii._FEATURES, 5)), pair(1.0), pair(0.7) + 1.5 * np.eye(5))


def marginals(document, model):
    """Share of every label at every node over all labellings."""
    chain = [(i, i + 1) for i in range(len(document) - 1)]
    skip, last = [], {}
    for i, node in enumerate(document):
        if node["same"] in last:
            skip.append((last[node["same"]], i))
        last[node["same"]] = i
    total = np.zeros((len(document), 5))
    for labels in itertools.product(range(5), repeat=len(document)):
        if any(n["label"] not in (pii.OTHER, x) for n, x in zip(document, labels)):
            continue
        score = sum(model.unary[n["code"], x] + model.unary[-1, x] for n, x in zip(document, labels) if n["label"] == pii.OTHER)
        score += sum(model.chain[labels[i], labels[j]] for i, j in chain) + sum(model.skip[labels[i], labels[j]] for i, j in skip)
        total[range(len(document)), labels] += math.exp(score)
    return total / total.sum(1, keepdims=True)


def shares(document, model):
    found = np.exp(pii.beliefs([document], model))
    return found / found.sum(1, keepdims=True)


def test_beliefs_equal_enumeration_without_loops():
    rng = np.random.default_rng(5)
    for _ in range(25):
        document, model = random_field(rng, loops=False)
        assert np.abs(shares(document, model) - marginals(document, model)).max() < 1e-3


def test_labels_with_loops_mostly_equal_enumeration():
    rng = np.random.default_rng(6)
    same = []
    for _ in range(40):
        document, model = random_field(rng, loops=True)
        same += (shares(document, model).argmax(1) == marginals(document, model).argmax(1)).tolist()
    assert np.mean(same) >= 0.95


def test_labels_do_not_depend_on_the_batch():
    rng = np.random.default_rng(7)
    _, model = random_field(rng, loops=True)
    documents = [random_field(rng, loops=True)[0] for _ in range(60)] + [[]]
    together = pii.infer(documents, model)
    assert together.tolist() == [x for d in documents for x in pii.infer([d], model).tolist()]
    assert np.array_equal(pii.beliefs(documents, model), np.concatenate([pii.beliefs([d], model) for d in documents if d]))


def test_influence_reaches_far_repeats():
    """A base span speaks for a repeat 400 links on, through repeats that say nothing themselves."""
    skip = 6.0 * (2 * np.eye(5) - 1)
    model = pii.Field(np.zeros((pii._FEATURES, 5)), np.zeros((5, 5)), skip)
    document = [{"label": pii.OTHER, "code": 10, "start": i, "end": i + 1, "same": "x", "near": None} for i in range(401)]
    document[0]["label"] = 3
    assert pii.infer([document], model).tolist() == [3] * 401


def test_precision_and_recall_of_added_spans(spark):
    """Phones given again without their plus are personal data; order numbers of as many digits are not."""
    rng = np.random.default_rng(8)
    docs, truth = [], set()
    for i in range(400):
        area, mid, last, order = rng.integers(200, 999), rng.integers(200, 999), rng.integers(1000, 9999), rng.integers(10**9, 10**10)
        text = f"call +1 ({area}) {mid}-{last} about order {order}. "
        if i % 2:
            again = f"{area}-{mid}-{last}"
            truth.add((i, len(text), len(text) + len(again)))
            text += again + " is the same line"
        else:
            text += f"+1 {area} {mid} {last} works too, quote {order}"
        docs.append((i, text))
    rows = pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string"), {"doc_id": F.col("doc_id")}).collect()
    added = {(r.doc_id, s.start, s.end) for r in rows for s in set(r.spans) - set(r.base)}
    assert len(added & truth) / len(truth) >= 0.9
    assert len(added & truth) / max(1, len(added)) >= 0.9, (len(added), len(truth))
