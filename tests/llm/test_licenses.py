"""Cosines and inheritance against plain versions."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millwright.llm import licenses
from millwright.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(files, min_cosine=licenses.MIN_COSINE):
    """files: (path, text); returns (license, score, origin, source_path) per file."""
    templates = [(n, Counter(words_of(t))) for n, ts in sorted(licenses.TEMPLATES.items()) for t in ts]
    seen = Counter(w for _, t in files for w in set(words_of(t)))
    idf = lambda w: math.log((1 + len(files)) / (1 + seen[w])) + 1

    def vector(words):
        return {w: n * idf(w) for w, n in Counter(words).items()}

    def cosine(own, other):
        norm = math.sqrt(sum(x * x for x in own.values()) * sum(x * x for x in other.values()))
        return sum(x * other.get(w, 0.0) for w, x in own.items()) / norm if norm else 0.0

    templates = [(n, vector(c)) for n, c in templates]

    own = []
    for _, text in files:
        lines = (text or "").split("\n")
        paragraphs, current = [], []
        for line in lines:
            if words_of(line):
                current.append(line)
            elif current:
                paragraphs.append(" ".join(current))
                current = []
        best = (0.0, None)
        for segment in [*lines, *paragraphs, " ".join(current), " ".join(lines)]:
            own_vector = vector(words_of(segment))
            for name, other in templates:
                score = cosine(own_vector, other)
                if score > best[0] + 1e-12:
                    best = (score, name)
        own.append(best if best[0] >= min_cosine else None)
    given = {}
    for (path, _), found in zip(files, own):
        if found and path and re.search(r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$", path):
            home = path.rpartition("/")[0]
            key = (-round(found[0], 9), path)
            if home not in given or key < given[home][0]:
                given[home] = (key, found[1], found[0], path)
    out = []
    for (path, _), found in zip(files, own):
        if found:
            out.append((found[1], found[0], "own", None))
            continue
        home, result = (path or "").rpartition("/")[0] if path else None, None
        while home is not None:
            if home in given:
                result = (given[home][1], given[home][2], "inherited", given[home][3])
                break
            home = home.rpartition("/")[0] if home else None
        out.append(result or (None, None, "none", None))
    return out


def same(rows, want):
    assert len(rows) == len(want)
    for r, w in zip(rows, want):
        assert (r.license, r.origin, r.source_path) == (w[0], w[2], w[3])
        assert (r.score is None) == (w[1] is None) and (r.score is None or abs(r.score - w[1]) < 1e-9)


FILES = [
    ("a/LICENSE", "Intro line here\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software\n"
     "and associated documentation files, to deal in the Software without restriction"),
    ("a/b/c/x.py", "print(1)"), ("a/b/LICENSE.txt", "nothing of the kind"), ("a/b/c/COPYING", "Licensed under the Apache License, Version 2.0."),
    ("a/b/c/d/y.py", "def f(): pass\n# All rights reserved."), ("a/b/c/d/z.py", None), ("top.py", ""), ("q/w.py", "text"), (None, "text"),
    (None, "Released under the MIT License."), ("a/b/c/d/z.py", None), ("a/license-2", "RELEASED UNDER THE MIT LICENSE!"),
    ("/abs/LICENSE", "Released under the BSD 3-Clause License."), ("/abs/deep/er/f", "é " * 200_000), ("q/n.py", "die das und\n" * 30),
]


def test_equals_plain_version(spark):
    frame = spark.createDataFrame([(i, p, t, "z") for i, (p, t) in enumerate(FILES)], "n int, path string, text string, own string").repartition(3)
    same(licenses.scan(frame, carry=("n",)).orderBy("n").collect(), plain(FILES))
    assert licenses.scan(frame.limit(0), carry=("n",)).collect() == []
    bare = frame.where("path not like '%/LICENSE' and path not like '%COPYING' and path not like '%license%'")
    assert {r.origin for r in licenses.scan(bare, carry=("n",)).collect()} == {"own", "none"}


def test_query_equals_plain_version(spark):
    rows = QUERIES["op10_license_scan"](spark, SMALL).orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    same(rows, plain([(r.path, texts[r.doc_id]) for r in rows]))
    assert {r.origin for r in rows} >= {"own", "none"}


WORDINGS = [
    ("Licensed under the GNU Affero GPL version 3.", "AGPL-3.0"), ("This code is licensed under the GPL version 2", "GPL-2.0"),
    ("Released under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Released under the ISC License.", "ISC"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later\nint main;", "GPL-2.0-or-later"), ("# SPDX-License-Identifier: Acme-1.0", "Acme-1.0"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"), ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
     "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("Copyright 2020 X\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met:\n\n1. Redistributions of source code must retain the notice.", "BSD-2-Clause"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
     "are met:\n\n3. Neither the name of Acme nor its staff may be used to endorse\nor promote products derived from this software.", "BSD-3-Clause"),
]


def test_wordings_outside_the_tables(spark):
    frame = spark.createDataFrame([(f"{i}/f", t) for i, (t, _) in enumerate(WORDINGS)], "path string, text string")
    got = {r.path: r.license for r in licenses.scan(frame).collect()}
    assert [(t, got[f"{i}/f"]) for i, (t, _) in enumerate(WORDINGS)] == WORDINGS


def test_notice_among_other_words_does_not_depend_on_table_size(spark):
    texts = ["This file is released under the MIT License by Acme of Ohio with thanks to many helpful volunteers.",
             "Copyright 2024 Acme Holdings Incorporated Ohio. All rights reserved."]
    for size in (0, 5000):
        rows = [(f"{i}/f", t) for i, t in enumerate(texts)] + [(f"z{i}/f", "plain words") for i in range(size)]
        got = licenses.scan(spark.createDataFrame(rows, "path string, text string")).where("origin = 'own'").collect()
        assert {r.path: r.license for r in got} == {"0/f": "MIT", "1/f": "Proprietary"}


def test_repeated_and_common_words_weigh_by_their_own_counts(spark):
    """The same notice beside a word of all files, and beside a word of its own given often."""
    rows = [("a", "released under the mit license zzz"), ("b", "released under the mit license " + "qqq " * 9)]
    rows += [(f"c{i}", "zzz") for i in range(300)]
    frame = spark.createDataFrame(rows, "path string, text string")
    templates = {"MIT": ("Released under the MIT License.",)}
    got = {r.path: r for r in licenses.scan(frame, templates=templates, min_cosine=0.2).where("origin = 'own'").collect()}
    seen, n = Counter(w for _, t in rows for w in set(words_of(t))), len(rows)
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in seen.items()}
    inside = sum(idf[w] ** 2 for w in words_of(templates["MIT"][0]))
    assert abs(got["a"].score - math.sqrt(inside / (inside + idf["zzz"] ** 2))) < 1e-9 and got["a"].score > 0.99
    assert abs(got["b"].score - math.sqrt(inside / (inside + (9 * idf["qqq"]) ** 2))) < 1e-9 and got["b"].score < 0.5


def test_inherited_rows_of_the_query(spark):
    rows = QUERIES["op10_license_scan"](spark, "/root/testdata/sf0.1").select("path", "license", "score", "origin", "source_path").collect()
    given = {r.path: r for r in rows if r.origin == "own" and r.path.rpartition("/")[2].startswith("LICENSE-")}
    homes = {p.rpartition("/")[0] for p in given}
    inherited = [r for r in rows if r.origin == "inherited"]
    assert len(inherited) > 50
    for r in inherited:
        source = given[r.source_path]
        home = r.source_path.rpartition("/")[0]
        assert (r.license, r.score) == (source.license, source.score) and r.path.startswith(home + "/")
        between = r.path.rpartition("/")[0]
        while between != home:
            assert between not in homes
            between = between.rpartition("/")[0]
