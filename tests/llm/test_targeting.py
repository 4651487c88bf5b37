"""Target resampling against a plain version that sorts everything."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millwright.llm import targeting

LAYOUT = "doc_id long, text string, score string, rank int, n_words string"


def plain(docs, target, longest, buckets, share, least_words, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for x in found for b in x[2]), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, n, own in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    places = {id(r): place for place, r in enumerate(order[: len(order) * share // 100], 1)}
    return [(*r, places.get(id(r))) for r in rows]


def shown(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


@pytest.mark.parametrize("longest,buckets,share,least_words", [(1, 10_000, 10, 20), (3, 50, 35, 0), (2, 1, 100, 3)])
def test_equals_plain_version(spark, longest, buckets, share, least_words):
    rng = random.Random(longest)
    words = [f"W{i}" for i in range(60)] + ["naïve", "x9", "straße", "ДОМ"]
    texts = [" ".join(rng.choices(words, k=rng.choice((0, 3, 19, 20, 80)))).replace(" ", rng.choice((" ", "-", "\n"))) for _ in range(300)]
    docs = [(n, t) for n, t in enumerate(texts)] + [(500, None), (501, ""), (502, "?!"), (None, texts[7]), (None, "a " * 30), (3, texts[3]), (3, texts[3])]
    docs += [(503, "long " * 50_000), (504, "y" * 100_000)]
    target = ["W1 W2 W3 naïve naïve", None, "", "W1"]
    frame = spark.createDataFrame([(i, t, "x", 1, None) for i, t in docs], LAYOUT)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = targeting.resampled(frame, aims, longest=longest, buckets=buckets, share=share, least_words=least_words)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert shown(map(tuple, got.collect())) == shown(plain(docs, target, longest, buckets, share, least_words, 2024))


def test_cutoff_among_ties(spark):
    scored = spark.range(2000).select((F.col("id") * 7 - 900).alias("doc_id"), (F.col("id") % 3 * 10**12).alias("score")).union(
        spark.range(5).select(F.lit(None).cast("long"), F.lit(10**12)))
    rows = sorted(scored.collect(), key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0))
    for k in (1, 2, 665, 666, 667, 1000, 1332, 2000, 2005):
        picked = scored.where(targeting.drawn(scored, k))
        assert shown(map(tuple, picked.collect())) == shown(map(tuple, rows[: max(k, 1338) if 1332 < k < 1338 else k]))
        places = targeting.ranked(picked).collect()
        assert sorted(r.rank for r in places) == list(range(1, len(places) + 1))
        assert all((rows[r.rank - 1].score, rows[r.rank - 1].doc_id) == (r.score, r.doc_id) for r in places)
    assert targeting.drawn(scored, 0) is None


def test_empty_tables_and_carried_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, "w")], LAYOUT)
    none = spark.createDataFrame([], "text string")
    got = targeting.resampled(docs, none, {"score": F.col("score"), "id": F.col("doc_id")}, least_words=0, share=100).collect()
    assert [(r[0], r["id"], r.rank, r.n_words) for r in got] == [("s", 1, 1, 2)]
    assert targeting.resampled(docs.limit(0), none).collect() == []
    assert [r.rank for r in targeting.resampled(docs, none).collect()] == [None]
