"""The source audit against a plain version, and skybands against counting dominators."""

import random
import re
from collections import Counter, defaultdict

from millwright.llm import divergence

LAYOUT = "text string, lang string, source string, n string, docs int, term int"


def plain(rows, least_docs, top):
    counts, holders, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        holders[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in holders[lang].items() if n >= least_docs]
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))
        p = {s: {t: share(counts[lang, s], t) for t in kept} for s in sources}
        q = {t: share(whole, t) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(order, 1)]
    return sorted(out)


def made_rows(seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["élan", "ÉLAN", "Дом", "Z"]
    rows = []
    for n in range(500):
        source = rng.choice(("hot", "hot", "hot", "b", "c", None, "é"))
        some = words[:60] if source == "b" else words
        rows.append((rng.choice((" ", "-", "9")).join(rng.choices(some, k=rng.choice((0, 4, 40)))), rng.choice(("en", "de", None)), source))
    return rows + [(None, "en", "empty"), ("", "xx", "only"), ("word " * 30_000, "en", "c"), ("q" * 50_000, "en", "c"), rows[0], rows[0]]


def test_audit_equals_plain_version(spark):
    rows = made_rows(1)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], LAYOUT).repartition(5)
    for least_docs, top in ((30, 50), (2, 7), (10_000, 50)):
        got = divergence.audit(docs, least_docs=least_docs, top=top)
        assert sorted(map(tuple, got.collect())) == plain(rows, least_docs, top)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_skyband_holds_what_fewer_than_k_dominate(spark):
    rng = random.Random(4)
    rows = [("g" if i % 3 else "h", f"t{rng.randrange(10**6):06}", rng.randrange(30), rng.randrange(30)) for i in range(900)]
    frame = spark.createDataFrame(rows, "g string, term string, n long, n_lang long").coalesce(1)
    for k in (1, 3, 50):
        got = sorted(map(tuple, divergence.skyband(frame, k, ("g",)).collect()))
        above = lambda a, b: a is not b and a[0] == b[0] and a[2] >= b[2] and a[3] <= b[3] and a[1] <= b[1]
        assert got == sorted(r for r in rows if sum(above(x, r) for x in rows) < k)
