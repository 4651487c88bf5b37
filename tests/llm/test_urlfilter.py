"""Temporal URL filters against a plain evaluation of the list history."""

import datetime as dt
import random
from urllib.parse import urlsplit

from millwright.llm import urlfilter

DAY0 = dt.datetime(2024, 1, 1)
ENTRY = "list string, kind string, pattern string, action string, dated timestamp_ntz, url string"
CAPTURE = "n int, url string, fetched_at timestamp_ntz, verdict string, found_url int"


def plain(captures, entries):
    rules = {}
    for list_, kind, pattern, action, dated in entries:
        if None in (list_, kind, pattern, action, dated):
            continue
        host, slash, path = pattern.partition("/")
        rules.setdefault((list_, kind, (host.lower() + slash + path).rstrip("/")), {}).setdefault(dated, set()).add(action)
    out = []
    for url, at in captures:
        try:
            parts = urlsplit(url or "")
            host = (parts.hostname or "").rstrip(".") if parts.scheme else ""
        except ValueError:
            host = ""
        if not host:
            out.append(("no host", 0, None, None, None))
            continue
        met = []
        for (list_, kind, pattern), history in rules.items():
            covers = host == pattern or host.endswith("." + pattern) or ("/" in pattern and (host + parts.path + "/").startswith(pattern + "/"))
            if not covers or at is None:
                continue
            on, since = False, None
            for when in sorted(history):
                if when <= at:
                    new = history[when] == {"add"}
                    since = when if new and not on else since
                    on = new
            if on:
                met.append((-len(pattern), kind, list_, pattern, since))
        if met:
            _, kind, list_, pattern, since = min(met)
            out.append((kind, len(met), list_, pattern, since))
        else:
            out.append(("none", 0, None, None, None))
    return out


def run(spark, captures, entries, **options):
    c = spark.createDataFrame([(n, u, a, "v", 1) for n, (u, a) in enumerate(captures)], CAPTURE).repartition(3)
    e = spark.createDataFrame([(*x, "u") for x in entries], ENTRY)
    got = urlfilter.judge(c, e, **options)
    assert got.columns == [*c.columns, "verdict_"]
    rows = [r.verdict_ for r in got.orderBy("n").collect()]
    assert len(rows) == len(captures)
    return [(r.decision, r.n_active, r["list"], r.pattern, r.since) for r in rows]


def test_random_histories(spark):
    rnd = random.Random(3)
    hosts = ["a.com", "b.a.com", "x.b.a.com", "c.org", "hot.net"]
    paths = ["", "/", "/en", "/en/1", "/en/1/", "/De/2"]
    entries = []
    for _ in range(150):
        pattern = rnd.choice(hosts) + rnd.choice(["", "", "/en", "/en/1/", "/De"])
        pattern = pattern.upper() if rnd.random() < 0.1 and "/" not in pattern else pattern
        entries.append((rnd.choice("pq"), rnd.choice(["block", "allow"]), pattern, rnd.choice(["add", "remove"]), DAY0 + dt.timedelta(days=rnd.randrange(90))))
    entries += [(None, "block", "a.com", "add", DAY0), ("p", "block", None, "add", DAY0), ("p", "block", "c.org", "add", None)]
    captures = [
        (rnd.choice(["http://", "HTTPS://u:p@"]) + rnd.choice(hosts + ["www.a.com", "nota.com"]) + rnd.choice(["", ":80"]) + rnd.choice(paths) + rnd.choice(["", "?q=/en", "#f"]),
         DAY0 + dt.timedelta(hours=rnd.randrange(24 * 95)))
        for _ in range(400)
    ]
    captures += [captures[0]] * 3 + [("http://hot.net/en", DAY0 + dt.timedelta(days=i % 90)) for i in range(300)]
    captures += [(None, DAY0), ("", DAY0), ("no url", DAY0), ("http:///x", DAY0), ("http://a.com/en", None), ("http://a.com./en", DAY0 + dt.timedelta(days=40)),
                 ("http://a.com/" + "en/" * 20_000, DAY0 + dt.timedelta(days=50))]
    assert run(spark, captures, entries) == plain(captures, entries)
    assert run(spark, captures, entries, slice_days=1) == plain(captures, entries)


def test_empty_sides(spark):
    captures = [("http://a.com/", DAY0), (None, None)]
    assert run(spark, captures, []) == [("none", 0, None, None, None), ("no host", 0, None, None, None)]
    assert run(spark, [], [("p", "block", "a.com", "add", DAY0)]) == []
    assert run(spark, [("http://a.com/", None)], [("p", "block", "a.com", "add", DAY0)]) == [("none", 0, None, None, None)]


