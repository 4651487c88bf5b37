"""License scan: TF-IDF cosine to templates, and inheritance down the directory tree.

Every text is read whole: each line, each paragraph (lines up to a blank one) and the text itself are a
header or notice of its own, compared with the templates by the cosine of their
TF-IDF vectors. Weights come from the document counts of all words over all texts. Words of the templates are few, so their
weights travel to the texts; a segment that could reach the threshold if all its other words weighed the least they
can is kept with those words, which then meet their own counts in a join. A file without a license of its own takes that of the nearest directory above it that
holds a license file with one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import bounded_batches, by_slices, cut_lineage, forget, free_name, text_buffers
from millwright.llm.hashing import BASE, Words

MIN_COSINE = 0.6

# Headers and first paragraphs of public licenses by SPDX name.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software",
    ),
    "Proprietary": ("All rights reserved.", "Confidential and proprietary. All rights reserved."),
}

# Names, ways to give notice and beginnings of texts by SPDX name, looked for as words in a row. What differs by one word is another run.
_NOTICES = ("under {}", "under the {}", "under a {}", "under an {}", "under the terms of {}", "under the terms of the {}", "under the terms and conditions of the {}", "subject to the {}", "subject to the terms of the {}")
_NAMES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License"),
    "AFL-3.0": ("Academic Free License, version 3.0",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero GPL version 3", "GNU AGPL version 3", "GNU AGPLv3", "AGPL version 3", "AGPLv3"),
    "Apache-1.0": ("Apache License, Version 1.0",),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache Software License, Version 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License, Version 2.0"),
    "Artistic-1.0": ("Artistic License 1.0",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "Original BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal"),
    "CDDL-1.0": ("Common Development and Distribution License, Version 1.0", "CDDL 1.0"),
    "CDDL-1.1": ("Common Development and Distribution License, Version 1.1", "CDDL 1.1"),
    "ECL-2.0": ("Educational Community License, Version 2.0",),
    "EPL-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "EPL 1.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "EPL 2.0"),
    "EUPL-1.1": ("European Union Public Licence, Version 1.1", "EUPL 1.1"),
    "EUPL-1.2": ("European Union Public Licence, Version 1.2", "EUPL 1.2"),
    "GFDL-1.2": ("GNU Free Documentation License, Version 1.2",),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3",),
    "ISC": ("ISC License", "ISC Licence"),
    "MIT": ("MIT License", "MIT Licence", "Expat License"),
    "MIT-0": ("MIT No Attribution License", "MIT-0 License"),
    "MPL-1.0": ("Mozilla Public License, Version 1.0", "MPL 1.0"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License, v. 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"),
    "MS-PL": ("Microsoft Public License",),
    "NCSA": ("University of Illinois NCSA Open Source License",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "OSL-3.0": ("Open Software License, version 3.0",),
    "PostgreSQL": ("PostgreSQL License",),
    "PSF-2.0": ("Python Software Foundation License Version 2",),
    "UPL-1.0": ("Universal Permissive License, Version 1.0",),
    "Unlicense": ("Unlicense", "Unlicense License"),
    "WTFPL": ("Do What The Fuck You Want To Public License", "WTFPL"),
    "Zlib": ("zlib License",),
}
for _name, _versions in (("", ("1.0", "2.0", "3.0")), ("Lesser ", ("2.1", "3.0")), ("Library ", ("2.0",))):
    for _version in _versions:
        _short = "LGPL" if _name else "GPL"
        for _v in dict.fromkeys((_version.removesuffix(".0"), _version)):
            _NAMES[f"{_short}-{_version}"] = _NAMES.get(f"{_short}-{_version}", ()) + (
                f"GNU {_name}General Public License, version {_v}", f"GNU {_name}General Public License v{_v}",
                f"GNU {_short} version {_v}", f"{_short} version {_v}", f"GNU {_short}v{_v}", f"{_short}v{_v}", f"{_short} {_v}",
            )
for _short, _long in (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for _version, _port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _NAMES[f"CC-{_short}-{_version}"] = (f"CC {_short} {_version}", f"Creative Commons {_long} {_version} {_port} License")

_GNU = "under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met"
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
_TEXTS = {
    "0BSD": (_ISC + ".",),
    "AGPL-3.0": (_GNU.format(name="Affero General Public License", version="3"),),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-2-Clause": (_BSD,),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and "
        "transmit the Software, and to prepare derivative works of the Software",
    ),
    "GPL-2.0": (_GNU.format(name="General Public License", version="2"),),
    "GPL-3.0": (_GNU.format(name="General Public License", version="3"),),
    "ISC": (_ISC + ", provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.0": (_GNU.format(name="Library General Public License", version="2"),),
    "LGPL-2.1": (_GNU.format(name="Lesser General Public License", version="2.1"),),
    "LGPL-3.0": (_GNU.format(name="Lesser General Public License", version="3"),),
    "MIT": (
        _MIT,
        _MIT + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MIT-0": (_MIT + ", and to permit persons to whom the Software is furnished to do so.",),
    "MPL-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file "
        "except in compliance with the License.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software.",
    ),
}
# Licenses whose text begins like another's: the other name, where the text also holds these words.
REFINED = {
    "BSD-2-Clause": (
        ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
        ("BSD-3-Clause", "may be used to endorse or promote products derived from this software"),
    ),
    "BSD-3-Clause": (("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),),
    "0BSD": (("ISC", "provided that the above copyright notice and this permission notice appear in all copies"),),
    "MIT-0": (("MIT", "copyright notice and this permission notice shall be included in all copies"),),
}
_TAG = re.compile(rb"spdx-license-identifier:[ \t]*([a-z0-9.+\-]+(?:[ \t]+(?:and|or|with)[ \t]+[a-z0-9.+\-]+)*)", re.IGNORECASE)
_ANCHOR = 3


class Vocabulary:
    """The templates' words as sorted hashes, and the templates as counts over them."""

    def __init__(self, templates: dict[str, tuple[str, ...]], catalogue: bool = True):
        pairs = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
        self.names = [name for name, _ in pairs]
        words = Words(pa.array([text for _, text in pairs]))
        self.hashes = np.unique(words.hashes)
        self.counts = np.zeros((len(pairs), len(self.hashes)))
        np.add.at(self.counts, (words.doc, np.searchsorted(self.hashes, words.hashes)), 1)
        said = [(n, f.format(x)) for n, names in _NAMES.items() for x in names for f in _NOTICES] + [(n, x) for n, xs in _TEXTS.items() for x in xs]
        said = [(n, x, True) for n, x in said if catalogue] + [(n, x, False) for n, x in pairs]
        found = Words(pa.array([x for _, x, _ in said]))
        self.runs: dict[tuple, list[tuple]] = {}  # by their first words, word runs with their license and whether they go before a cosine
        for k, (name, _, strict) in enumerate(said):
            run = tuple(found.hashes[found.first[k] : found.first[k] + found.counts[k]].tolist())
            if len(run) >= _ANCHOR:
                self.runs.setdefault(run[:_ANCHOR], []).append((run, name, strict))
        self.anchors = np.unique(np.array([_anchor(np.array(x, np.uint64))[0] for x in self.runs], np.uint64))

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word hash; -1 outside the vocabulary."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _anchor(hashes: np.ndarray) -> np.ndarray:
    """A hash of every _ANCHOR words in a row."""
    out = np.zeros(max(0, len(hashes) - _ANCHOR + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(_ANCHOR):
            out = out * np.uint64(BASE) + hashes[j : j + len(out)]
    return out


def _contained(words: Words, vocabulary: Vocabulary) -> dict[int, tuple[bool, str]]:
    """By text number, whether it goes before a cosine, and the license of the longest run whose words stand in the text in a row."""
    best: dict[int, tuple] = {}
    for at in np.flatnonzero(np.isin(_anchor(words.hashes), vocabulary.anchors)).tolist():
        doc = int(words.doc[at])
        end = int(words.first[doc] + words.counts[doc])
        for run, name, strict in vocabulary.runs.get(tuple(words.hashes[at : at + _ANCHOR].tolist()), ()):
            if at + len(run) <= end and tuple(words.hashes[at : at + len(run)].tolist()) == run:
                best[doc] = min(best.get(doc, (True, 1, "")), (not strict, -len(run), name))
    return {doc: (not loose, name) for doc, (loose, _, name) in best.items()}


def _tags(texts: pa.Array) -> dict[int, str]:
    """By text number, the first SPDX tag of the text as it is written."""
    data, offsets = text_buffers(texts)
    data, found = data.tobytes(), {}
    for start in re.finditer(rb"(?i)spdx-license-identifier:", data):
        doc = int(np.searchsorted(offsets, start.start(), "right")) - 1
        if hit := _TAG.match(data, start.start(), int(offsets[doc + 1])):
            found.setdefault(doc, hit[1].decode().rstrip("."))
    return found


def _refine(name: str, own: str) -> str:
    """``name``, or the license that the other words of the text make it."""
    return next((other for other, said in REFINED.get(name, ()) if said.lower() in own), name)


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hash, n): in how many rows every word stands."""

    def count(batches):
        for batch in batches:
            for hashes, n in by_slices(batch.column(0), one_slice):
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n)], ["hash", "n"])

    def one_slice(texts):
        words = Words(texts)
        order = np.lexsort((words.doc, words.hashes))
        hashes, doc = words.hashes[order], words.doc[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        found, n = np.unique(hashes[fresh], return_counts=True)
        return [(found.view(np.int64), n.astype(np.int64))]

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _weight(documents: int, n: Column) -> Column:
    return F.log((1 + documents) / (1 + n)) + 1


def term_weights(counts: DataFrame, documents: int, vocabulary: Vocabulary) -> np.ndarray:
    """Inverse document frequency of every term of the vocabulary, and last that of a word in no document."""
    wanted = vocabulary.hashes.view(np.int64).tolist()  # words of the templates, a few hundred
    found = np.zeros(len(wanted) + 1)
    place = {h: i for i, h in enumerate(wanted)}
    for row in counts.where(F.col("hash").isin(wanted)).collect():
        found[place[row.hash]] = row.n
    return np.log((1 + documents) / (1 + found)) + 1


_FOUND = (
    "struct<tag: string, strict: boolean, run: string, refined: array<struct<license: string, other: string>>, "
    "near: array<struct<license: string, dot: double, inside: double, words: array<struct<hash: long, n: long>>>>>"
)


def evidence(text: Column, vocabulary: Vocabulary, weights: np.ndarray, min_cosine: float = MIN_COSINE) -> Column:
    """What a text holds: its SPDX tag, the license of its longest known run, and the segments that may reach ``min_cosine``.

    ``near`` has each such segment's best template, the dot product with it, the squared weights of its template words,
    and its other words, counted. ``refined`` names the licenses that other words of the text turn others into.
    """
    templates = vocabulary.counts * weights[:-1]
    templates /= np.sqrt((templates * templates).sum(1, keepdims=True))
    kinds = pa.struct([
        ("tag", pa.string()), ("strict", pa.bool_()), ("run", pa.string()),
        ("refined", pa.list_(pa.struct([("license", pa.string()), ("other", pa.string())]))),
        ("near", pa.list_(pa.struct([
            ("license", pa.string()), ("dot", pa.float64()), ("inside", pa.float64()),
            ("words", pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())]))),
        ]))),
    ])

    def work(texts: pa.Array) -> pa.Array:
        return pa.array(list(by_slices(texts, one_slice)), kinds)

    def one_slice(texts):
        words = Words(texts)
        terms = vocabulary.terms(words.hashes)
        near: dict[int, dict[tuple, dict]] = {}
        for part in _segments(words):
            for doc, start, end, dot, inside, which in _possible(part, words.doc, terms, templates, weights, min_cosine):
                others, n = np.unique(words.hashes[start:end][terms[start:end] < 0], return_counts=True)
                item = {
                    "license": vocabulary.names[which], "dot": dot, "inside": inside,
                    "words": [{"hash": h, "n": c} for h, c in zip(others.view(np.int64).tolist(), n.tolist())],
                }
                near.setdefault(doc, {})[start, end] = item  # a line that is a paragraph too counts once
        contained, tags = _contained(words, vocabulary), _tags(texts)
        out = []
        for k in range(len(texts)):
            strict, run = contained.get(k, (False, None))
            items = list(near.get(k, {}).values())
            named = {x["license"] for x in items} | {run}
            refined = []
            if named & REFINED.keys():
                own = " ".join(words.strings(int(words.first[k]), int(words.first[k] + words.counts[k])))
                refined = [{"license": x, "other": _refine(x, own)} for x in sorted(named & REFINED.keys())]
            out.append({"tag": tags.get(k), "strict": strict, "run": run, "refined": refined, "near": items})
        return out

    return F.arrow_udf(work, _FOUND)(text.cast("string"))


def own_licenses(rows: DataFrame, counts: DataFrame, documents: int, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``rows`` (key, found, ...) with ``own``, struct<license, score>: the best template of any segment; null below ``min_cosine``.

    Equal scores, to twelve places, go to the license that sorts first. An SPDX tag goes first, then the longest notice or
    text of the catalogue whose words stand in the text in a row, with score 1 where the cosine finds another
    license or none. Where neither is there and no cosine reaches ``min_cosine``, a template's own words in a row
    count the same way.
    """
    segments = rows.select("key", F.posexplode_outer("found.near").alias("at", "near")).where("near is not null")
    segments = segments.select("key", "at", "near.*")
    asked = segments.select("key", "at", F.explode_outer("words").alias("word")).where("word is not null").select("key", "at", "word.*")
    weighed = asked.join(counts.withColumnRenamed("n", "documents"), "hash")
    outside = weighed.groupBy("key", "at").agg(
        F.sum(F.pow(F.col("n") * _weight(documents, F.col("documents")), F.lit(2))).alias("outside")
    )
    norm = F.sqrt(F.col("inside") + F.coalesce("outside", F.lit(0.0)))
    scored = segments.drop("words").join(outside, ["key", "at"], "left").withColumn("score", F.round(F.col("dot") / norm, 12))
    best = scored.where(F.col("score") >= min_cosine).groupBy("key").agg(
        F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license"))).alias("best")
    )
    run, exact = F.col("found.run"), lambda name: F.struct(name.alias("license"), F.lit(1.0).alias("score"))
    by_run = run.isNotNull() & (F.col("best").isNull() | (F.col("found.strict") & (F.col("best.license") != run)))
    own = F.when(by_run, exact(run)).otherwise(F.col("best"))
    other = F.get(F.filter("found.refined", lambda x: x["license"] == F.col("own.license")), F.lit(0))["other"]
    joined = rows.join(best, "key", "left").withColumn("own", own)
    refined = F.struct(F.coalesce(other, F.col("own.license")).alias("license"), F.col("own.score").alias("score"))
    tag = F.col("found.tag")
    return joined.withColumn("own", F.when(tag.isNotNull(), exact(tag)).when(F.col("own").isNotNull(), refined)).drop("best")


def _segments(words: Words):
    """Numbers (rising from 0 without gaps) of the segment every word lies in: lines, paragraphs, texts."""
    if not len(words.starts):
        return
    breaks = np.flatnonzero(words.data == 10)
    line = np.searchsorted(breaks, words.starts)
    # a paragraph ends where a blank line, one without words, lies between two words
    skipped = np.zeros(len(line), bool)
    skipped[1:] = line[1:] - line[:-1] > 1
    for own in (np.r_[0, np.diff(line)] > 0, skipped, np.zeros(len(line), bool)):
        new = own.copy()
        new[1:] |= words.doc[1:] != words.doc[:-1]
        new[0] = False
        yield np.cumsum(new)


def _possible(part: np.ndarray, doc: np.ndarray, terms: np.ndarray, templates: np.ndarray, weights: np.ndarray, min_cosine: float):
    """Segments whose cosine reaches ``min_cosine`` if every other word weighs as little as a word of all documents, which is 1.

    Per segment: text number, first word, end, dot product with the best template, squared weights of the template words,
    template number. The template does not depend on the other words, as they lengthen a segment's vector for all alike.
    """
    n, size = int(part[-1]) + 1, templates.shape[1]
    outside = np.bincount(part[terms < 0], minlength=n)  # squared counts sum up to this or more
    inside = np.flatnonzero(terms >= 0)
    for start in range(0, n, 4096):
        own = inside[np.searchsorted(part[inside], start) : np.searchsorted(part[inside], start + 4096)]
        if not len(own):
            continue
        end = min(n, start + 4096)
        counts = np.bincount((part[own] - start) * size + terms[own], minlength=(end - start) * size).reshape(-1, size)
        vectors = counts * weights[:-1]
        squares = (vectors * vectors).sum(1)
        dots = vectors @ templates.T
        most = dots.max(1)
        for k in np.flatnonzero((most > 0) & (most >= (min_cosine - 1e-9) * np.sqrt(squares + outside[start:end]))).tolist():
            first, last = np.searchsorted(part, [start + k, start + k + 1]).tolist()
            which = int(np.flatnonzero(dots[k] >= most[k] - 1e-12 * most[k])[0])
            yield int(doc[first]), first, last, float(most[k]), float(squares[k]), which


def scan(
    files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES,
    license_file: str = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$", min_cosine: float = MIN_COSINE, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``files``: path, the carried columns, license, score, origin and source_path.

    ``origin`` is 'own' (found in the text), 'inherited' (from a license file, named in ``source_path``, of the nearest directory
    above) or 'none'. Of several license files of a directory the best score decides, then the smallest path. A license file
    also speaks for its own directory. Null and empty texts have no license of their own; a null path inherits
    nothing. Texts of any length count whole. Repeated rows stay. An empty table gives no rows.
    """
    vocabulary = Vocabulary(templates, templates is TEMPLATES)
    files = bounded_batches(files)
    counts, documents = cut_lineage(document_counts(files, text)), files.count()
    found = evidence(F.col(text), vocabulary, term_weights(counts, documents, vocabulary), min_cosine)
    held = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([*carry, path])]).alias("carried")
    read = cut_lineage(files.select(held, found.alias("found")).withColumn("key", F.monotonically_increasing_id()))
    own = own_licenses(read, counts, documents, min_cosine)
    rows = cut_lineage(own.select(*[F.col(f"carried.c{i}").alias(c) for i, c in enumerate([*carry, "path"])], "own"))
    forget(counts, read)
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    given = rows.where(F.col("own").isNotNull() & F.col("path").rlike(license_file)).groupBy(directory.alias("dir")).agg(
        F.min_by(F.struct(F.col("own.license").alias("license"), F.col("own.score").alias("score"), F.col("path").alias("from")),
                 F.struct(-F.col("own.score"), "path")).alias("given")
    )
    # directories of files without a license, each with all directories above it; only as deep as license files lie
    deepest = given.agg(F.max(F.size(F.split("dir", "/")))).first()[0] or 0
    home = free_name(rows, "home")
    wanted = rows.where("own is null and path is not null").select(directory.alias(home)).distinct()
    parts = F.split(home, "/")
    above = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts), F.lit(deepest))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir"))
    )
    met = wanted.select(home, F.inline(above)).join(given, "dir")
    nearest = met.groupBy(home).agg(F.max_by("given", "depth").alias("given"))
    out = rows.withColumn(home, F.when(F.col("own").isNull(), directory)).join(nearest, home, "left")
    return out.select(
        *carry, "path",
        F.coalesce("own.license", "given.license").alias("license"), F.coalesce("own.score", "given.score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("given.from")).alias("source_path"),
    )
