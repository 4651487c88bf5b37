"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are fitted: one of target text (a bounded
sample of labelled good documents), one of raw text (all documents). A document's log
weight is the log ratio of its likelihoods, the sum over its n-grams; a document of more than
EFFECTIVE n-grams weighs as that many of its average, so that length does not decide. A third model, of documents labelled as
unwanted, gives warnings: words found in clearly more unwanted than good documents. Each use of one takes its log ratio
off the weight, whatever the length of the text, so that a short passage in a long one counts. Gumbel noise
added to the log weights and a top-k draw k documents without replacement, with chances in
proportion to the weights. By default k is the number of documents that weigh about as much as all
but a small share of good documents that were held out of the fit, or more.

n-grams: single words and pairs (lower-cased runs of letters and digits), and one to three
token shapes in a row. A token's shape is its sequence of character classes, and a
token that repeats the one before it has a shape of its own.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import bounded_batches, by_slices, cut_lineage, free_name, text_buffers
from millwright.llm.hashing import BASE, Words, bounds, mixed, range_hashes

BUCKET_BITS = 16
TARGET_ROWS = 20_000  # most labelled documents the target model is fitted on
TARGET_MISS = 0.005  # share of the held-out good documents below the default k's weight
SLACK = 5.0  # how far under their weight a document may lie, as the noise moves keys by a few units
EFFECTIVE = 100
FIT, HELD_OUT, UNWANTED = 1, 2, 3
WORD_BITS = 18  # classes of single words that warnings are counted in
WARNING = 2.0  # least log ratio of a warning
EXACT_ROWS = 10_000  # rows near the k-th key that are sorted on the driver

# Blanks that part tokens, and character classes (the rest of ASCII stands for itself).
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_CLASS = np.array(
    [250 if 48 <= b <= 57 else 251 if 65 <= b <= 90 else 252 if 97 <= b <= 122 else 253 if b >= 0x80 else b for b in range(256)],
    np.uint8,
)


class Model(NamedTuple):
    """Log ratio of target to raw probability of every n-gram bucket, and of unwanted to good for words that warn (0 for others)."""

    ratios: np.ndarray
    warnings: np.ndarray


def _word_classes(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def hashed_ngrams(texts: pa.Array, words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram."""
    words = words or Words(texts)
    grams = [_grams(words.hashes, words.doc, 1, 11), _grams(words.hashes, words.doc, 2, 12)]
    data, offsets = text_buffers(texts)
    starts, ends = bounds(~_BLANK[data], offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    raw = range_hashes(data, starts, ends)
    kind = _CLASS[data]
    turns = np.ones(len(kind), bool)
    turns[1:] = kind[1:] != kind[:-1]
    turns[starts] = True
    place = np.cumsum(turns)
    shapes = range_hashes(kind[turns], place[starts] - 1, place[ends - 1]) if len(starts) else raw
    again = np.zeros(len(raw), bool)
    again[1:] = (raw[1:] == raw[:-1]) & (doc[1:] == doc[:-1])
    shapes[again] = 1
    grams += [_grams(shapes, doc, n, 20 + n) for n in (1, 2, 3)]
    hashes, owners = np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), owners


def _grams(items: np.ndarray, doc: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    size = len(items) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        hashes = np.full(size, salt, np.uint64)
        for j in range(n):
            hashes = hashes * np.uint64(BASE) + items[j : j + size]
        hashes = mixed(hashes)
    whole = doc[:size] == doc[n - 1 :]
    return hashes[whole], doc[:size][whole]


def labelled_target(labels: DataFrame, good: Column, doc_id: str = "doc_id", rows: int = TARGET_ROWS) -> DataFrame:
    """Ids of at most ``rows`` good documents, chosen by a hash of the id."""
    ids = labels.where(good).where(F.col(doc_id).isNotNull()).select(doc_id).distinct()
    return ids.orderBy(F.xxhash64(doc_id), doc_id).limit(rows)


def with_target(docs: DataFrame, target: DataFrame, name: str, doc_id: str = "doc_id", unwanted: DataFrame | None = None) -> DataFrame:
    """``docs`` with an integer column: FIT or (a quarter) HELD_OUT for documents of ``target``, UNWANTED, else 0.

    ``target`` and ``unwanted`` have at most TARGET_ROWS distinct ids each and are handed to every task; an id in both is
    unwanted.
    """
    part = F.when(F.pmod(F.xxhash64(doc_id, F.lit("part")), F.lit(4)) == 0, HELD_OUT).otherwise(FIT)
    marked = target.select(F.col(doc_id), part.alias(name))
    if unwanted is not None:
        marked = marked.union(unwanted.select(F.col(doc_id), F.lit(UNWANTED))).groupBy(doc_id).agg(F.max(name).alias(name))
    return docs.join(F.broadcast(marked), doc_id, "left").select(*docs.columns, F.coalesce(name, F.lit(0)).alias(name))


def fit(docs: DataFrame, target: str, text: str = "text", smoothing: float = 10.0) -> Model:
    """The model of all rows and of those marked in column ``target`` (see with_target).

    The target model is shrunk towards the raw one by ``smoothing`` pseudo-counts per bucket, so that a rare bucket
    which a small target sample happens to miss says little. Counts come from all rows; each task gives one row per bucket
    at most. For warnings the documents of a word are counted, in the marked rows only.
    """
    grams = 1 << BUCKET_BITS

    def count(batches):
        raw, good = np.zeros(grams, np.int64), np.zeros(grams, np.int64)
        held = np.zeros((2, 1 << WORD_BITS), np.int64)  # good and unwanted documents that hold a word
        marked = np.zeros(2, np.int64)

        def one_slice(part):
            words = Words(part)
            return [(*hashed_ngrams(part, words), _word_classes(words), words.doc, len(part))]

        for batch in batches:
            marks = batch.column(1).to_numpy()
            marked += [np.count_nonzero(marks == FIT), np.count_nonzero(marks == UNWANTED)]
            done = 0
            for buckets, owners, classes, holders, n in by_slices(batch.column(0), one_slice):
                own = marks[done : done + n]
                raw += np.bincount(buckets, minlength=grams)
                good += np.bincount(buckets[own[owners] == FIT], minlength=grams)
                for side, mark in enumerate((FIT, UNWANTED)):
                    of = np.flatnonzero(own[holders] == mark)
                    pairs = np.unique((holders[of].astype(np.int64) << WORD_BITS) | classes[of])
                    held[side] += np.bincount(pairs & ((1 << WORD_BITS) - 1), minlength=1 << WORD_BITS)
                done += n
        for kind, (left, right) in enumerate(((raw, good), held, marked.reshape(2, 1))):
            used = np.flatnonzero(left + right)
            columns = [pa.array(np.full(len(used), kind, np.int32)), *(pa.array(x) for x in (used.astype(np.int32), left[used], right[used]))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "x", "y"])

    counts = bounded_batches(docs).select(F.col(text).cast("string"), F.col(target)).mapInArrow(count, "kind int, bucket int, x long, y long")
    tables = [np.zeros((2, grams)), np.zeros((2, 1 << WORD_BITS)), np.zeros((2, 1))]
    sums = counts.groupBy("kind", "bucket").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    found = sums.where("kind <> 1 or y >= 4").toArrow()  # a word in fewer unwanted documents does not warn
    kinds, buckets, x, y = (found.column(c).to_numpy() for c in ("kind", "bucket", "x", "y"))
    for kind, table in enumerate(tables):
        own = kinds == kind
        table[:, buckets[own]] = x[own], y[own]
    (raw, good), (of_good, of_bad), ((n_good,), (n_bad,)) = tables
    expected = raw * (good.sum() / max(raw.sum(), 1.0))
    usual = (of_good + 1) * n_bad / (n_good + 1)  # unwanted documents that would hold the word if they were like good ones
    clear = of_bad >= usual + 4 * np.sqrt(usual) + 3
    warnings = np.where(clear, np.log(np.maximum(of_bad, 1) / np.maximum(usual, 1e-9)), 0.0)
    return Model(np.log((good + smoothing) / (expected + smoothing)), np.where(warnings >= WARNING, warnings, 0.0))


def log_weight(text: Column, ratios: np.ndarray, warnings: np.ndarray | None = None) -> Column:
    """Log of target to raw likelihood of a text, of EFFECTIVE n-grams at most, less its warnings; 0 for null and empty texts."""

    def work(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter(by_slices(texts, one_slice), np.float64, len(texts)))

    def one_slice(texts):
        words = Words(texts)
        buckets, owners = hashed_ngrams(texts, words)
        total = np.bincount(owners, weights=ratios[buckets], minlength=len(texts))
        size = np.bincount(owners, minlength=len(texts))
        total = total * np.minimum(1.0, EFFECTIVE / np.maximum(size, 1))
        if warnings is not None:
            total = total - np.bincount(words.doc, weights=warnings[_word_classes(words)], minlength=len(texts))
        return total.tolist()

    return F.arrow_udf(work, "double")(text.cast("string"))


def gumbel(*keys: Column, seed: int = 0) -> Column:
    """Gumbel noise that the keys and the seed decide."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """Exactly the k-th largest value (null values left out); None if there are fewer.

    Each round counts 1,024 ranges of the values still in question and goes on with one of them, until few
    are left or all are equal.
    """
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    n, low, high = values.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if k < 1 or n < k:
        return None
    while low < high:
        inside = values.where(F.col("x").between(low, high))
        if n <= EXACT_ROWS:
            return sorted((r.x for r in inside.collect()), reverse=True)[k - 1]
        part = F.least(F.lit(1023), F.floor((F.col("x") - low) / F.lit(high - low) * 1024)).alias("part")
        parts = inside.groupBy(part).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for row in sorted(parts.collect(), key=lambda r: -r.part):
            if k <= row.n:
                n, low, high = row.n, row.low, row.high
                break
            k -= row.n
    return low


def resample(
    docs: DataFrame, target: str, text: str = "text", doc_id: str = "doc_id", k: int | None = None,
    miss: float = TARGET_MISS, slack: float = SLACK, seed: int = 0,
) -> tuple[Model, float | None, DataFrame]:
    """(model, least key, scored rows): fit, weigh every row, and find the key that the sample's k-th row has.

    ``target`` names the column of with_target. Scored rows hold doc_id, log_weight, sample_key and target, on disk in the shared
    folder. Rows whose key equals the least key all belong to the sample, so repeated rows, which share their noise, stay or go
    together. Texts of any length count whole. No rows give None.
    """
    model = fit(docs, target, text)
    weight = log_weight(F.col(text), *model)
    scored = docs.select(F.col(doc_id).alias("doc_id"), weight.alias("log_weight"), F.col(target).alias("target"))
    scored = cut_lineage(scored.withColumn("sample_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed=seed)))
    if k is None:
        floor = scored.where(F.col("target") == HELD_OUT).agg(F.percentile_approx("log_weight", miss, 10_000)).first()[0]
        k = scored.count() if floor is None else scored.where(F.col("log_weight") >= floor - slack).count()
    return model, kth_largest(scored, "sample_key", k), scored


def sampled(docs: DataFrame, target: str, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the sample holds, with their columns but without the target mark."""
    model, least, _ = resample(docs, target, text, doc_id, **options)
    if least is None:
        return docs.drop(target).limit(0)
    key = free_name(docs, "sample_key")
    weighed = docs.withColumn(key, log_weight(F.col(text), *model) + gumbel(F.col(doc_id), seed=options.get("seed", 0)))
    return weighed.where(F.col(key) >= least).drop(key, target)
