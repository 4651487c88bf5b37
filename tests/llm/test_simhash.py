"""SimHash groups against a plain pairwise version."""

import re

import numpy as np
import xxhash

from millwright.llm import components, simhash
from millwright.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    pieces = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(fps):
    """Smallest index reachable over links of at most three bits."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    roots = plain_groups(fps)
    want = {d.doc_id: (f"{fp:016x}", docs[r].doc_id) for d, fp, r in zip(docs, fps, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, SMALL).collect()}
    assert got == want
    assert len({c for _, c in got.values()}) < len(got)


def test_blocks_of_a_hot_key_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**63))
    fps = {centre}
    while len(fps) < 500:
        flips = rng.choice(64, int(rng.integers(1, 6)), replace=False)
        fps.add(centre ^ sum(1 << int(b) for b in flips))
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block in (8, 100, 4096):
        links = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(frame, 3, block).collect()]
        parent = {x: x for x in fps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        assert [root(x) for x in fps] == [fps[i] for i in plain_groups(fps)]


def test_edges_of_the_input(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d"), (7, "A b C d"), (7, "A b C d"), (4, "x"), (9, long), (8, long)]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, fp string, dropped int")
    got = sorted((r.doc_id or -1, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect())
    want = sorted(
        (i or -1, (plain_fingerprint(t) + 2**63) % 2**64 - 2**63, {1: 1, 2: 1, 3: 1, None: 7, 7: 7, 4: 4, 9: 8, 8: 8}[i])
        for i, t in rows
    )
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 4, 7, 7, 8]
    empty = spark.createDataFrame([], TEXT)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(1000, 1300)]
    hub = [(5, i) for i in range(10, 400)]
    odd = [(None, 3), (7, 7), (2, 1), (1, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain + hub + odd, "a long, b long")).collect()}
    want = {i: 1000 for i in range(1000, 1301)} | {i: 5 for i in range(10, 400)} | {5: 5, 1: 1, 2: 1}
    assert got == want


def test_components_plan_their_links_once_and_end_at_stars(spark, monkeypatch):
    plans, rounds, write, star = [], [], components.cut_lineage, components._large_star

    def written(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(components, "cut_lineage", written)
    monkeypatch.setattr(components, "_large_star", lambda edges: rounds.append(1) or star(edges))
    for links, want, most in (
        ([(1, 2), (3, 1), (4, 5)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}, 0),
        ([(1, 2), (2, 3), (5, 4)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}, 1),
    ):
        del plans[:], rounds[:]
        made = spark.createDataFrame(links, "a long, b long").mapInArrow(lambda batches: batches, "a long, b long")
        got = {r.node: r.root for r in components.components(made).collect()}
        assert got == want
        assert sum(plan.count("MapInArrow") for plan in plans) == 1
        assert len(rounds) == most
