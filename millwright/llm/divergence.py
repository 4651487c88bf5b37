"""Audit of how the sources of a language differ in their words.

For every (language, source) group two lists: its distance from each other source of the language over all kept
terms, and the terms that it uses more than the language as a whole does.

The second list never sorts a group's vocabulary. A term's excess grows with its count in the group and falls with
its count in the language, so a term that is no better in either count and no earlier in UTF-8 than k others cannot be among the
first k. Every partition keeps its skyband, the terms that fewer than k others dominate in that sense; skybands are
merged, and only what is left is ranked exactly. A term outside is dominated by k members of the
skyband, so comparing with members is enough.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm.common import bounded_batches, cut_lineage, text_buffers

LEAST_DOCS = 30  # documents of a language a kept term is found in
TOP = 50
SCALE, PSEUDO = 1_000_000_000, 5
MERGES = 16  # parts a group's skybands are merged in before they meet
_HELD, _HELD_BYTES = 200_000, 16 << 20  # counts a task holds before it hands them on

# Letters and everything outside ASCII; A-Z are lower-cased, the rest parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in a group, and documents of the group that hold it.

    Tasks count what they read and hand on sums; nulls count as ''.
    """

    def count(batches):
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = size = 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            data = data.tobytes().translate(_TERMS)
            for row, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                terms = data[offsets[row] : offsets[row + 1]].split()
                if not terms:
                    continue
                uses, holders = counts.setdefault(key, (Counter(), Counter()))
                before, distinct = len(uses), set(terms)
                uses.update(terms)
                holders.update(distinct)
                held += len(uses) - before
                size += sum(map(len, distinct)) if len(uses) > before else 0
                if held > _HELD or size > _HELD_BYTES:
                    yield from listed(counts)
                    counts, held, size = {}, 0, 0
        yield from listed(counts)

    def listed(counts):
        for (lang_, source_), (uses, holders) in counts.items():
            terms = list(uses)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang_] * len(terms), pa.string()), pa.array([source_] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()), pa.array([uses[t] for t in terms], pa.int64()),
                    pa.array([holders[t] for t in terms], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))]
    rows = bounded_batches(docs).select(*named).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, n_lang, first): counts of terms that ``least_docs`` documents of the language hold.

    ``n_lang`` is the count in the language; ``first`` marks one row of each of its terms.
    """
    whole = W.partitionBy("lang", "term")
    rows = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(whole).alias("n_lang"), F.sum("docs").over(whole).alias("docs"),
        (F.col("source") == F.min("source").over(whole)).alias("first"),
    )
    return rows.where(F.col("docs") >= least_docs).drop("docs")


def group_sizes(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, total, total_lang, terms): kept occurrences and kept terms, for every group that occurs."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source))]
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    rows = docs.select(*named).distinct().join(sums, ["lang", "source"], "left")
    zero, whole = F.lit(0), W.partitionBy("lang")
    return rows.select(
        "lang", "source", F.coalesce("total", zero).alias("total"),
        F.sum(F.coalesce("total", zero)).over(whole).alias("total_lang"), F.sum(F.coalesce("firsts", zero)).over(whole).alias("terms"),
    )


def share(n: Column, total: Column, terms: Column, scale: int = SCALE, pseudo: int = PSEUDO) -> Column:
    """1 + floor(scale (n + pseudo) / (total + pseudo terms)), in exact whole numbers."""
    wide = F.lit(scale).cast("decimal(12, 0)") * (n + pseudo).cast("decimal(20, 0)")
    return F.call_function("div", wide, (total + pseudo * terms).cast("decimal(20, 0)")) + 1


def skyband(rows: DataFrame, k: int = TOP, group: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """What every partition of ``rows`` holds of its groups' k-skybands: rows that fewer than k others there dominate.

    A row dominates another of its group if its ``n`` is no lower, its ``n_lang`` no higher and its ``term`` earlier.
    Read in the order n falling, n_lang rising, term rising, a row is dominated by rows before it only; a task holds
    the counts and terms of one group's skyband. Moves no rows.
    """
    columns = rows.columns
    places = [columns.index(c) for c in group]

    def keep(batches):
        current, terms, counts = None, [], np.zeros(1024, np.int64)
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in places]))
            lows = batch.column(columns.index("n_lang")).to_numpy()
            words = batch.column(columns.index("term")).cast(pa.binary()).to_pylist()
            stay = []
            for row, (key, low, word) in enumerate(zip(keys, lows, words)):
                if key != current:
                    current, terms = key, []
                at = bisect_left(terms, word)
                if at >= k and np.count_nonzero(counts[:at] <= low) >= k:
                    continue
                stay.append(row)
                if len(terms) + 1 > len(counts):
                    counts = np.concatenate([counts, np.zeros_like(counts)])
                counts[at + 1 : len(terms) + 1] = counts[at : len(terms)].copy()
                counts[at] = low
                terms.insert(at, word)
            yield batch.take(pa.array(stay, pa.int64()))

    order = [*group, F.desc("n"), "n_lang", "term"]
    return rows.sortWithinPartitions(*order).mapInArrow(keep, rows.schema)


def excess_terms(kept: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the first ``top`` terms of a group by the surplus of their share over the language's."""
    rows = kept.drop("first").join(sizes, ["lang", "source"])
    own, whole = (share(F.col(n), F.col(t), F.col("terms")) for n, t in (("n", "total"), ("n_lang", "total_lang")))
    rows = rows.select("lang", "source", "term", "n", "n_lang", (own - whole).alias("value")).where("value > 0")
    salt = F.pmod(F.xxhash64("term"), F.lit(MERGES))
    merged = skyband(skyband(rows, top).repartition("lang", "source", salt), top)
    merged = skyband(merged.repartition("lang", "source"), top)
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return merged.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top).select(
        "lang", "source", F.col("term").alias("item"), "value", "rank"
    )


def source_distances(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): distances to every other source of the language, farthest first.

    Shares of all kept terms, those of count 0 too, meet by term; each pair of sources once, summed up ahead of the shuffle.
    """
    terms = kept.where("first").select("lang", "term")
    rows = terms.join(sizes, "lang").join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    p = share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("terms"))
    shares = cut_lineage(rows.select("lang", "term", "source", p.alias("p")))
    other = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    met = shares.join(other, ["lang", "term"]).where(F.col("source") < F.col("item"))
    sums = met.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    groups = sizes.select("lang", "source")
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where(F.col("source") < F.col("item"))
    half = cut_lineage(pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value")))
    both = half.union(half.select("lang", F.col("item"), F.col("source"), "value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(by_value))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank) of both lists, part being 'pair' or 'term'.

    Nulls in ``text``, ``lang`` and ``source`` count as ''. Groups without terms have distances like others, and 0 where their
    language keeps no term. Repeated rows count each. Terms may be of any length; ties go to the item that is earlier in
    UTF-8. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    kept = cut_lineage(kept_terms(term_counts(docs, text, lang, source), least_docs))
    sizes = cut_lineage(group_sizes(docs, kept, lang, source))
    parts = [("pair", source_distances(kept, sizes)), ("term", excess_terms(kept, sizes, top))]
    pair, term = (x.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for name, x in parts)
    return pair.union(term)
