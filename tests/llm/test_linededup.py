"""Line dedup against a plain count, both ways of removal, and reversible updates."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from millwright.llm import linededup

COLUMNS = "doc_id long, text string, lines int"


def plain(texts, limit):
    keys = [[re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n")] for t in texts]
    count = Counter(k for own in keys for k in set(own) if k)
    out = []
    for t, own in zip(texts, keys):
        kept = [x for x, k in zip((t or "").split("\n"), own) if count[k] < limit]
        text = "\n".join(kept)
        out.append((len(own), len(own) - len(kept), text, hashlib.sha256(text.encode()).hexdigest()))
    return out


def texts():
    rng = np.random.default_rng(5)
    pool = [f"line {i} É{'x' * (i % 7)}" for i in range(60)] + ["", "  ", "OK\x85", "\tOk\x85 "]
    made = ["\n".join(rng.choice(pool, rng.integers(1, 9))) for _ in range(150)]
    return made + [None, "", "\n\n", " LINE 1 Éx\r", "z" * 400_000 + "\nline 3 Éxxx", *["same\nagain"] * 12]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], COLUMNS).repartition(5)


def result(docs, index, **options):
    got = linededup.drop_common_lines(docs, index, **options)
    assert got.columns == ["doc_id", "text", "lines", "lines_"]
    return [tuple(r.lines_) for r in got.orderBy("doc_id").collect()]


@pytest.mark.parametrize("filter_bytes", [linededup.FILTER_BYTES, -1])
def test_equals_plain_count(spark, filter_bytes):
    rows = texts()
    docs = frame(spark, rows)
    assert result(docs, linededup.build_index(docs, min_docs=10), filter_bytes=filter_bytes) == plain(rows, 10)


def test_insertions_and_deletions_are_reversible(spark):
    rows = texts()
    first, second = frame(spark, rows[:100]), frame(spark, rows[100:])
    alone = linededup.build_index(first, min_docs=10, shards=4)
    grown = linededup.insert_documents(alone, second)
    whole = linededup.build_index(frame(spark, rows), min_docs=10, shards=4)
    assert sorted(grown.counts.collect()) == sorted(whole.counts.collect())
    assert result(first, grown) == plain(rows, 10)[:100]
    back = linededup.delete_documents(grown, second)
    assert sorted(back.counts.collect()) == sorted(alone.counts.collect())
    assert result(first, back) == plain(rows[:100], 10)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string")
    assert linededup.drop_common_lines(docs, linededup.build_index(docs)).collect() == []


def test_cuckoo_filter_forgets_only_what_was_deleted():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-(2**63), 2**63 - 1, (2, 4000))
    cuckoo = linededup._filled(hi, lo)
    assert cuckoo.contains(hi, lo).all()
    other = rng.integers(-(2**63), 2**63 - 1, (2, 4000))
    assert cuckoo.contains(*other).sum() < 5
    cuckoo.delete(hi[:1000], lo[:1000])
    assert cuckoo.contains(hi[1000:], lo[1000:]).all() and cuckoo.contains(hi[:1000], lo[:1000]).sum() < 5


def test_line_lengths_below_the_minimum_stay(spark):
    docs = frame(spark, ["éé\nabc"] * 4)
    index = linededup.build_index(docs, min_docs=2, min_chars=3)
    assert {r.lines_.kept for r in linededup.drop_common_lines(docs, index).collect()} == {"éé"}
