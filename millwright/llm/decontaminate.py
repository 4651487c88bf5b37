"""Benchmark decontamination by winnowing.

A span of ``t`` words that a document shares with a benchmark item must be found. With
k-grams of words and windows of w consecutive k-gram hashes, t = k + w - 1, the minimum of
each window is kept: both texts keep the same k-gram of the shared span, so joining
the kept fingerprints meets every shared span. A hit brings the words around it, and
comparing these with the item's window settles which windows really occur.

Items of fewer than t words are one window each and get a family of fingerprints of
their own length, made only if such items exist. Document fingerprints first pass a
bitmap of the items' fingerprints, of fixed size whatever the tables hold; what it lets through
goes into the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import bounded_batches, by_slices, cut_lineage, free_name
from millwright.llm.hashing import BASE, Words, mixed

WINDOW = 10
BITMAP_BITS = 22  # 2^22 bits: at most 65,536 longs reach the driver
PRINT = "t: int, h: long, at: int, from_word: int, words: array<string>"
def family(t: int) -> tuple[int, int]:
    """(k, w) with k + w - 1 = t."""
    k = (t + 1) // 2
    return k, t - k + 1


def winnow(words: Words, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every span of ``t`` words in one text: first word, hash and place of its kept k-gram.

    The kept k-gram has the smallest hash of the span; among equal ones the last.
    """
    k, w = family(t)
    n = len(words.hashes) - t + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        grams = np.full(n + w - 1, t, np.uint64)
        for j in range(k):
            grams = grams * np.uint64(BASE) + words.hashes[j : j + n + w - 1]
        grams = mixed(grams)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = grams[j : j + n]
        take = other <= best
        best[take] = other[take]
        at[take] = np.flatnonzero(take) + j
    spans = np.flatnonzero(words.doc[:n] == words.doc[t - 1 :])
    return spans, best[spans], at[spans]


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, t, h, off, win): every window of every item, its kept hash, that k-gram's offset, its words.

    ``t`` is ``window``, or the word count of an item that has fewer; items without words have no window.
    """

    def work(texts: pa.Array) -> pa.Array:
        return pa.array(list(by_slices(texts, one_slice)), kind)

    def one_slice(texts):
        words = Words(texts)
        found = [[] for _ in range(len(texts))]
        for t in sorted({min(window, n) for n in words.counts.tolist() if n}):
            spans, hashes, at = winnow(words, t)
            for s, h, p in zip(spans.tolist(), hashes.view(np.int64).tolist(), at.tolist()):
                doc = int(words.doc[s])
                if t == window or words.counts[doc] == t:
                    found[doc].append({"t": t, "h": h, "off": p - s, "win": " ".join(words.strings(s, s + t))})
        return found

    kind = pa.list_(pa.struct([("t", pa.int32()), ("h", pa.int64()), ("off", pa.int32()), ("win", pa.string())]))
    udf = F.arrow_udf(work, "array<struct<t: int, h: long, off: int, win: string>>")
    rows = items.select(F.col(item_id).alias("item_id"), udf(F.col(text).cast("string")).alias("w"))
    return rows.select("item_id", F.inline("w")).distinct()


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Which values the low bits of the windows' hashes take: 2^BITMAP_BITS bits, gathered as at most 2^16 longs."""
    slot = F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    rows = windows.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(h & 63 as int))")).alias("bits")
    )
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for row in rows.collect():
        bitmap[row.word] = row.bits
    return bitmap


def document_prints(docs: DataFrame, windows: DataFrame, carry: dict[str, Column], text: str = "text") -> DataFrame:
    """The carried columns, ``uid``, n_words, and the fingerprints that pass the items' bitmap with the words around them."""
    spark = bounded_batches(docs).sparkSession
    lengths = sorted(r.t for r in windows.select("t").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(windows))

    def work(texts: pa.Array) -> pa.Array:
        return pa.array(list(by_slices(texts, one_slice)), kind)

    def one_slice(texts):
        words = Words(texts)
        prints = [[] for _ in range(len(texts))]
        for t in lengths:
            spans, hashes, at = winnow(words, t)
            low = hashes & np.uint64((1 << BITMAP_BITS) - 1)
            asked = bitmap.value[(low >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (low & np.uint64(63))
            passed = np.flatnonzero(asked & np.uint64(1))
            _, fresh = np.unique(at[passed], return_index=True)
            around = family(t)[1] - 1
            for s in passed[fresh].tolist():
                doc, p = int(words.doc[spans[s]]), int(at[s])
                first, last = int(words.first[doc]), int(words.first[doc] + words.counts[doc])
                start = max(first, p - around)
                prints[doc].append({
                    "t": t, "h": int(hashes[s].view(np.int64)), "at": p - first, "from_word": start - first,
                    "words": words.strings(start, min(last, p + t)),
                })
        return [{"n_words": n, "prints": x} for n, x in zip(words.counts.tolist(), prints)]

    kind = pa.struct([("n_words", pa.int64()), ("prints", pa.list_(pa.struct([
        ("t", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("from_word", pa.int32()), ("words", pa.list_(pa.string()))
    ])))])
    udf = F.arrow_udf(work, f"n_words long, prints array<struct<{PRINT}>>")
    rows = docs.select(*[c.alias(n) for n, c in carry.items()], udf(F.col(text).cast("string")).alias("found"))
    return rows.select(*carry, "found.*").withColumn("uid", F.monotonically_increasing_id())


def occurrences(prints: DataFrame, windows: DataFrame) -> DataFrame:
    """(uid, start, t, win): where a window occurs, words compared."""
    held = prints.where(F.size("prints") > 0).select("uid", F.inline("prints"))
    distinct = windows.select("t", "h", "off", "win").distinct()
    start = F.col("at") - F.col("off")
    skip = start - F.col("from_word")
    met = held.join(distinct, ["t", "h"]).where(skip >= 0)
    same = F.array_join(F.slice("words", skip + 1, F.col("t")), " ") == F.col("win")
    return met.where(same).select("uid", start.alias("start"), "t", "win").distinct()


def contamination(
    docs: DataFrame, items: DataFrame, carry: dict[str, Column], text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Per row of ``docs``: the carried columns, n_words, n_hit (words inside an occurrence of a window),
    n_items (items with occurring windows) and ``items`` (their ids as sorted strings).

    A-Z is lower-cased; words are runs of digits, letters and non-ASCII characters. Null and empty texts have
    no words. A null item id is not listed, its words still hit. Repeated rows stay; repeated items count once per id.
    """
    windows = cut_lineage(item_windows(items, item_id, item_text, window))
    rows = cut_lineage(document_prints(docs, windows, carry, text))
    found = cut_lineage(occurrences(rows, windows))
    ranges = F.array_sort(F.collect_set(F.struct("start", "t")))
    covered = F.aggregate(
        "ranges", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, r: F.struct(
            F.greatest(a["end"], r["start"] + r["t"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), r["start"] + r["t"] - F.greatest(a["end"], r["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    hits = found.groupBy("uid").agg(ranges.alias("ranges")).select("uid", covered.alias("n_hit"))
    owners = windows.select("win", "t", F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = found.select("uid", "win", "t").distinct().join(owners, ["win", "t"]).select("uid", "item_id").distinct()
    listed = listed.groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = rows.drop("prints").join(hits, "uid", "left").join(listed, "uid", "left")
    return out.select(
        *carry, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs; equal texts share their fate."""
    own = F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))
    mark = free_name(docs, "digest")
    bad = contamination(docs, items, {"digest": own}, text, window=window).where("n_hit > 0")
    bad = bad.select(F.col("digest").alias(mark)).distinct()
    return docs.join(bad, own == F.col(mark), "left_anti")
