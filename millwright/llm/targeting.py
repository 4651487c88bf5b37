"""Resampling of a corpus towards the distribution of a target text.

Features are runs of one to ``longest`` words, hashed into buckets. A bucket's gain is the smoothed log ratio
of its shares in the target and in the corpus, in whole thousandths; a document's weight is the sum of its
features' gains, taken from one array that every task holds. Whole-numbered Gumbel noise, which the seed and
the id decide, is added, and the documents with the highest scores are drawn.

No row is sorted to find the cutoff: the scored rows are written once, and exact count jobs over them narrow down first
the score of the last drawn document and then, among rows of that score, its id. Only the drawn
rows are then dealt out by range to get their ranks.
"""

from __future__ import annotations

import math
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm.common import bounded_batches, by_slices, cut_lineage, text_buffers

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 10  # per cent of the documents with LEAST_WORDS words that are drawn
SEED = 2024
PROBES = 31  # thresholds whose rows one job counts
_CACHED, _CACHED_BYTES = 100_000, 64  # words a task remembers the buckets of, and the longest of them

# A word is digits, letters and everything outside ASCII; A-Z are lower-cased, the rest parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


class _Buckets(dict):
    """Bucket of a feature: CRC-32 of its UTF-8 bytes modulo the number of buckets."""

    def __init__(self, count: int):
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.count
        if len(feature) <= _CACHED_BYTES and len(self) < _CACHED:
            self[feature] = bucket
        return bucket


def _features(texts: pa.Array, longest: int, known: _Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features text by text, and every text's numbers of features and of words."""
    data, offsets = text_buffers(texts)
    data = data.tobytes().translate(_WORDS)
    found, features, words = [], [], []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = data[start:end].split()
        runs = [own] + [[b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)] for n in range(2, longest + 1)]
        found += runs
        features.append(sum(map(len, runs)))
        words.append(len(own))
    total = sum(features)
    buckets = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, total)
    return buckets, np.array(features, np.int64), np.array(words, np.int64)


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket, repeats counted; each task gives a bucket one row at most."""

    def count(batches):
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in by_slices(batch.column(0), lambda texts: [_features(texts, longest, known)[0]]):
                total += np.bincount(part, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    rows = bounded_batches(docs).select(F.col(text).cast("string")).mapInArrow(count, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in thousandths: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for B buckets.

    s and t are the bucket's features in corpus and target, S and T all of them.
    """
    counts = np.zeros((2, buckets))
    for side, docs in enumerate((corpus, target)):
        for row in bucket_counts(docs, text, longest, buckets).collect():  # one row a bucket
            counts[side, row.bucket] = row.n
    total = counts.sum(axis=1)
    (s, t), (all_s, all_t) = counts, total
    ratios = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios.tolist()], np.int64)


def weight(text: Column, gain: np.ndarray, longest: int = 1) -> Column:
    """struct<n_words, n_features, weight> of a text; zeros for null texts and texts without words."""
    kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def work(texts: pa.Array) -> pa.Array:
        known = _Buckets(len(gain))

        def one_slice(part):
            buckets, features, words = _features(part, longest, known)
            sums = np.concatenate([[0], np.cumsum(gain[buckets])])
            ends = np.cumsum(features)
            return zip(words.tolist(), features.tolist(), (sums[ends] - sums[ends - features]).tolist())

        rows = list(by_slices(texts, one_slice))
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    return F.arrow_udf(work, "struct<n_words: long, n_features: long, weight: long>")(text.cast("string"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, rounded down, from the first 32 bits of sha256('seed:id')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(unit))).cast("long")


def _least_reaching(rows: DataFrame, value: str, k: int, low: int, high: int) -> tuple[int, int]:
    """(v, n): the least whole v in [low, high] with at least k rows of ``value`` <= v, and their number.

    Each job counts, exactly, the rows under PROBES thresholds; the range between two of them is searched on.
    """
    reached = None
    while low < high or reached is None:
        step = max(1, -(-(high - low) // (PROBES + 1)))
        probes = [*range(low, high, step)][:PROBES] + [high]
        counts = rows.agg(*[F.count_if(F.col(value) <= F.lit(p)) for p in probes]).first()
        first = next(i for i, n in enumerate(counts) if n >= k)
        reached, high = counts[first], probes[first]
        low = probes[first - 1] + 1 if first else low
        if first == 0:
            return high, reached
    return high, reached


def drawn(scored: DataFrame, k: int, score: str = "score", doc_id: str = "doc_id") -> Column | None:
    """Condition for the k rows of highest ``score``, ties to smaller ids, null ids last; None for k = 0.

    ``scored`` should be a written table, as it is counted several times. Rows that repeat the last id and score all meet it.
    """
    if k < 1:
        return None
    span = scored.agg(F.min(score), F.max(score)).first()
    turned = scored.select((-F.col(score)).alias("down"), F.col(doc_id).alias("id"))
    turned_cut, reached = _least_reaching(turned, "down", k, -span[1], -span[0])
    cut = -turned_cut
    above, tied = F.col(score) > cut, F.col(score) == cut
    if reached == k:
        return above | tied
    ties = turned.where(F.col("down") == turned_cut)
    n, known, low, high = ties.agg(F.count("*"), F.count("id"), F.min("id"), F.max("id")).first()
    wanted = k - (reached - n)
    if wanted > known:
        return above | tied
    last, _ = _least_reaching(ties.where("id is not null"), "id", wanted, low, high)
    return above | (tied & (F.coalesce(F.col(doc_id) <= last, F.lit(False))))


def ranked(rows: DataFrame, name: str = "rank", score: str = "score", doc_id: str = "doc_id") -> DataFrame:
    """``rows`` with their rank from 1 by falling score and rising id (nulls last).

    Rows are dealt out by range and numbered within their range; only one count per range is summed up.
    """
    order = [F.desc(score), F.asc_nulls_last(doc_id)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("range_", F.shiftrightunsigned("at_", 33)))
    sizes = placed.groupBy("range_").agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    before = F.coalesce(F.sum("n_").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("range_", (before - F.col("first_") + 1).alias("shift_"))
    return placed.join(F.broadcast(sizes), "range_").select(*rows.columns, (F.col("at_") + F.col("shift_")).alias(name))


def resampled(
    docs: DataFrame, target: DataFrame, carry: dict[str, Column] | None = None, text: str = "text", doc_id: str = "doc_id",
    target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Every row of ``docs``: the ``carry`` columns, n_words, n_features, weight, score and rank (longs).

    Of the N rows with at least ``least_words`` words, floor(share N / 100) with the highest scores are drawn and ranked
    from 1; the others' rank is null. ``doc_id`` is an integer column. Ties go to smaller ids. Null and empty texts have
    no features, weight 0, and are never drawn unless least_words is 0. A null id has the noise of an empty one and comes
    last in ties. Repeated rows are rows of their own, ranked one after another. Texts of any length count whole. An empty
    target leaves weights that follow the corpus alone; an empty table gives an empty result.
    """
    carry = {"doc_id": F.col(doc_id)} if carry is None else carry
    found = gains(docs.select(F.col(text).alias("x")), target.select(F.col(target_text).alias("x")), "x", longest, buckets)
    kept = [c.alias(f"c{i}") for i, c in enumerate(carry.values())]
    rows = bounded_batches(docs).select(*kept, F.col(doc_id).alias("id"), weight(F.col(text), found, longest).alias("w"))
    measures = ("n_words", "n_features", "weight", "score")
    named = [F.col(f"c{i}").alias(name) for i, name in enumerate(carry)]
    rows = cut_lineage(rows.select(*[f"c{i}" for i in range(len(carry))], "id", "w.*", (F.col("w.weight") + noise(F.col("id"), seed)).alias("score")))
    able = rows.where(F.col("n_words") >= least_words)
    k = able.count() * share // 100
    chosen = drawn(able, k, "score", "id")
    none = F.lit(None).cast("long")
    if chosen is None:
        return rows.select(*named, *measures, none.alias("rank"))
    chosen = chosen & (F.col("n_words") >= least_words)
    places = ranked(rows.where(chosen), "rank", "score", "id")
    inside = F.when(F.col("rank") <= k, F.col("rank"))  # repeats of the last row's id and score may go past k
    return places.withColumn("rank", inside).union(rows.where(~chosen).withColumn("rank", none)).select(*named, *measures, "rank")
