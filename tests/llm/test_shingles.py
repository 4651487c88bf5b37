"""Near copies against brute-force Jaccard similarity of five-word shingles."""

import random
import re

import corpus_pipeline
from millwright.llm import shingles

MIDDLE = "/root/testdata/sf0.01"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_pairs(texts):
    """Pairs of keys whose sets have similarity 0.8 or more."""
    sets = {k: s for k, s in ((k, plain_set(t)) for k, t in sorted(texts.items())) if s}
    pairs, keys = [], list(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            x, y = len(sets[a]), len(sets[b])
            if 5 * min(x, y) >= 4 * max(x, y) and 5 * (both := len(sets[a] & sets[b])) >= 4 * (x + y - both):
                pairs.append((b, a))
    return pairs


def plain_roots(texts):
    parent = {k: k for k in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in plain_pairs(texts):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in texts}


def test_stage_leaves_no_near_copy(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, MIDDLE)
    assert plain_pairs({r.doc_id: r.text for r in docs.collect()}) != []
    assert plain_pairs({r.doc_id: r.text for r in kept.collect()}) == []


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for base in range(12):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice((3, 7, 60, 300)))]
        if base % 3 == 0:
            words = words + [f"shared{i}" for i in range(40)]
        for _ in range(10):
            texts[len(texts)] = " ".join(words)
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(900)}"
    texts |= {200: None, 201: "", 202: " \n"}
    docs = spark.createDataFrame([*texts.items(), (None, texts[0]), (0, texts[0])], "doc_id long, text string")
    roots = plain_roots(texts)
    got = {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect() if r.doc_id is not None}
    assert got == {k: r for k, r in roots.items() if plain_set(texts[k])}
    assert len(set(got.values())) < len(got)
    stay = sorted(r.doc_id if r.doc_id is not None else -1 for r in shingles.keep_one(docs).collect())
    assert stay == sorted([-1, 0, *{k for k, r in roots.items() if k == r}])
    assert shingles.keep_one(docs.limit(0)).collect() == []
