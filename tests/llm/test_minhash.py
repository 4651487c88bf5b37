"""MinHash groups against brute-force Jaccard similarity, and the sequential test against its rule."""

import random
import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from millwright.llm import minhash


def plain_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def plain_roots(texts, size, threshold=0.8):
    """Smallest key reachable over pairs of similarity 0.8 or more."""
    sets = {k: plain_set(t, size) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 1000 * both >= round(1000 * threshold) * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}


def grown_texts(seed, families, copies):
    """Families of drifting copies; every third family shares a long passage with the others of its kind."""
    rng = random.Random(seed)
    texts = {}
    for family in range(families):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice((1, 2, 5, 60, 250)))]
        if family % 3 == 0:
            words += [f"shared{i}" for i in range(120)]
        for _ in range(copies):
            texts[len(texts)] = " ".join(words)
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = f"V{rng.randrange(900)}"
    return texts


@pytest.mark.parametrize("size,block", [(2, 512), (5, 4)])
def test_groups_equal_brute_force(spark, size, block):
    texts = grown_texts(size, 15, 14) | {1000: None, 1001: "", 1002: " \n\t", 1003: "", 1004: "alone", 1005: "ALONE"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, size=size, block=block).collect()}
    roots = plain_roots(texts, size)
    assert got == {k: (len(plain_set(t, size)), roots[k]) for k, t in texts.items()}
    assert 30 < len(set(roots.values())) < len(texts) - 30


def test_a_chain_in_one_band_is_followed_to_its_end(spark):
    """Neighbours are similar, ends are not; the common passage brings most sets together in crowded bands."""
    common = [f"c{i}" for i in range(400)]
    texts = {n: " ".join(common + [f"x{(n + i) % 331}" for i in range(100)]) for n in range(0, 331, 9)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    for block in (3, 512):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, size=1, block=block, threshold=0.9).collect()}
        assert got == plain_roots(texts, 1, 0.9)


def test_edges_of_the_input(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "a b c d e"), (7, "A b C d e"), (7, "A b C d e"), (9, long), (8, long), (8, "other words here"),
            (None, "none knows me"), (None, "none knows me"), (None, None)]
    docs = spark.createDataFrame([(i, t, "z", 1, b"") for i, t in rows], "doc_id long, text string, set_id string, n int, sig binary")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in minhash.near_duplicates(docs, size=2).collect())
    n = len(plain_set(long, 2))
    assert got == sorted([(1, 0, 1), (2, 0, 2), (-1, 4, 7), (7, 4, 7), (7, 4, 7), (9, n, 8), (8, n, 8), (8, 2, 8), (-1, 2, -1), (-1, 2, -1), (-1, 0, -1)])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, -1, -1, 1, 2, 7, 7, 8, 8]
    assert minhash.near_duplicates(docs.limit(0)).collect() == [] == minhash.keep_one(docs.limit(0)).collect()


def test_fewest_matches_follow_the_posterior():
    for threshold, miss in ((0.8, 1e-6), (0.5, 1e-3)):
        for batch, least in enumerate(minhash.least_matches(threshold, miss), 1):
            n = batch * minhash.BATCH
            tail = lambda m: sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
            assert tail(least) >= miss and (least == 0 or tail(least - 1) < miss)


def test_signatures_estimate_similarity_and_batches_prune():
    rng = np.random.default_rng(2)
    words = [f"t{i}" for i in rng.integers(0, 10**6, 3000)]
    texts = [" ".join(words[:2000]), " ".join(words[200:2200]), " ".join(words[1500:3000]), "", None]
    sets = minhash.shingle_hashes(pa.array(texts), 1)
    sigs = minhash._signatures(sets)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        true = len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
        assert abs((sigs[a] == sigs[b]).mean() - true) < 0.13
    assert not sigs[3].any() and not sigs[4].any()
    alive, matches = minhash.survivors(sigs[[0, 0, 0]], sigs[[0, 1, 2]], minhash.least_matches())
    assert alive.tolist() == [0, 1] and matches[0] == minhash.HASHES


def test_components_are_not_worked_out_again_without_new_links(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base, "x"]), " ".join([*base, "y"]), " ".join(f"v{i}" for i in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    calls, whole = [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda links: calls.append(1) or whole(links))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}
    assert len(calls) == 1
