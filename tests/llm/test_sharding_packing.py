"""Scheduling and packing against item-by-item versions."""

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.llm import packing, sharding
from millwright.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_shards_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op6_lpt_shards"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    of_text, loads, slots, sizes = {}, Counter(), defaultdict(list), Counter()
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert of_text.setdefault(raw, r.shard) == r.shard
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        sizes[raw] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    plain = [0] * 8
    for size in sorted(sizes.values(), reverse=True):
        heapq.heapreplace(plain, plain[0] + size)
    assert max(loads.values()) - min(loads.values()) <= max(plain) - min(plain) + 64


def test_bundles_stay_near_equal_and_groups_whole(spark):
    rows = [(i, "x" * (i % 97)) for i in range(3000)] + [(None, None), (1, None), (2, ""), (3, "hot" * 50_000), (3, "hot" * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, task_ int").repartition(7)
    got = sharding.shard_documents(docs, {"doc_id": F.col("doc_id"), "text": F.col("text")}, 5, single_parts=10, bundles=64).collect()
    assert len(got) == len(rows)
    assert all(len({r.shard for r in got if r.text == t}) == 1 for t in {t for _, t in rows})
    for shard in range(5):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    assert sharding.shard_documents(docs.limit(0), {"doc_id": F.col("doc_id")}).collect() == []


def plain_pack(lengths, sizes, cost):
    """Best-fit decreasing, one piece after another, with the operator's rule for opening a bin."""
    left = Counter(lengths)
    bins = []
    for length in sorted(lengths, reverse=True):
        fitting = [b for b in bins if b[0] - b[1] >= length]
        if fitting:
            b = min(fitting, key=lambda b: b[0] - b[1])
        else:
            b = [packing._cheapest(length, left, sorted(left), sorted(sizes), cost), 0]
            bins.append(b)
        b[1] += length
        left[length] -= 1
        if not left[length]:
            del left[length]
    return sorted((min(s for s in sizes if s >= used), used) for _, used in bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_valid_and_as_good_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    sizes = (16, 32, 64)
    lengths = rng.integers(1, 65, int(rng.integers(1, 400))).tolist()
    plan = packing.plan_bins(Counter(lengths), sizes)
    used = Counter()
    for n, (length, first, each, bin_id, _) in enumerate(plan.runs):
        last = plan.runs[n + 1][1] if n + 1 < len(plan.runs) and plan.runs[n + 1][0] == length else Counter(lengths)[length]
        for number in range(first, last):
            used[bin_id + (number - first) // each] += length
    closed = {g.first + i: (g.size, g.used) for g in plan.bins for i in range(g.count)}
    assert {b: u for b, (_, u) in closed.items()} == dict(used)
    assert all(s == min(x for x in sizes if x >= u) for s, u in closed.values())
    mine = sum(packing.sequence_cost(s) for s, _ in closed.values())
    plain = sum(packing.sequence_cost(s) for s, _ in plain_pack(lengths, sizes, packing.sequence_cost))
    assert mine <= plain * 1.1 + packing.sequence_cost(64)


def test_packing_covers_every_token_once(spark):
    rows = [(i, int(n)) for i, n in enumerate(np.random.default_rng(3).integers(1, 300, 500))]
    rows += [(900, 1000), (901, 64), (902, 0), (903, None), (904, -5), (905, 128), (905, 128), (None, 7)]
    docs = spark.createDataFrame([(i, n, "x") for i, n in rows], "doc_id long, n int, piece string").repartition(6)
    got = packing.pack(docs, F.col("n"), {"doc_id": F.col("doc_id")}, sizes=(32, 64, 128)).collect()
    total = Counter()
    by_bin = defaultdict(list)
    for r in got:
        if r.length:
            total[r.doc_id] += r.length
            by_bin[r.bin_id].append(r)
        else:
            assert r.bin_id is None
    want = Counter()
    for i, n in rows:
        want[i] += max(0, n or 0)
    assert total == +want
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert {r.bin_size for r in pieces} == {min(s for s in (32, 64, 128) if s >= at)}
    assert packing.pack(docs.limit(0), F.col("n"), {"doc_id": F.col("doc_id")}).collect() == []


def test_word_count(spark):
    docs = spark.createDataFrame([("a b\n c",), (None,), ("",), ("é" * 10,)], "text string")
    assert [r[0] for r in docs.select(packing.word_count("text")).collect()] == [4, 1, 1, 2]
