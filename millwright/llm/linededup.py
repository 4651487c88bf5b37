"""Reversible line deduplication: exact reference counts with sharded cuckoo filters in front.

The reference-count table holds, for every line key, in how many documents it stands. It
alone decides. Keys that reach the limit are also entered in cuckoo filters, one per
shard of the key space; a pass over the documents asks the filters, whose
total size is checked, and the few rare keys that a filter takes for common ones are
looked up in the counts beforehand, so the pass is exact and shuffles no text. Filters
too large to hand to every task are not used: lines then meet the counts in a join.

Documents can be added and taken away: counts change by the documents' own keys, and
only keys that cross the limit enter or leave their shard's filter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import bounded_batches, by_slices, cut_lineage, free_name, text_buffers

SHARDS = 256
FILTER_BYTES = 32 << 20  # largest total of filters handed to every task
STRAY_KEYS = 500_000  # most rare keys, mistaken by the filters, handed to every task
RESULT = "n_lines long, n_dropped long, kept string, kept_sha256 string"
SLOTS, KICKS = 4, 500


# --- keys -------------------------------------------------------------------------------


def _line_keys(lines: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the 128-bit key of each line; (0, 0) marks a key below ``min_chars`` code points."""
    digests = []
    for line in lines:
        key = line.strip().lower()
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode(errors="replace")) < min_chars):
            digests.append(bytes(16))
        else:
            digests.append(xxhash.xxh3_128_digest(key))
    pairs = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _documents(texts: pa.Array) -> list[list[bytes]]:
    data, offsets = text_buffers(texts)
    data, offsets = data.tobytes(), offsets.tolist()
    return [data[s:e].split(b"\n") for s, e in zip(offsets, offsets[1:])]


def count_lines(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """The reference counts (hi, lo, n): every line key and the number of documents it stands in.

    A key is the line without ASCII blanks at its ends, A-Z lower-cased, hashed to 128 bits. Keys under
    ``min_chars`` code points are not counted. Every row is a document of its own.
    """

    def keys(batches):
        for batch in batches:
            yield from map(_pairs, by_slices(batch.column(0), one_slice))

    def one_slice(texts):
        documents = _documents(texts)
        hi, lo = _line_keys([x for d in documents for x in d], min_chars)
        owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        frame = pd.DataFrame({"owner": owner, "hi": hi, "lo": lo})[(hi != 0) | (lo != 0)].drop_duplicates()
        return [frame.groupby(["hi", "lo"], sort=False).size()]

    def _pairs(sizes):
        hi, lo = sizes.index.get_level_values(0), sizes.index.get_level_values(1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(hi, np.int64)), pa.array(np.asarray(lo, np.int64)), pa.array(sizes.to_numpy(np.int64))],
            ["hi", "lo", "n"],
        )

    found = bounded_batches(docs).select(F.col(text).cast("string")).mapInArrow(keys, "hi long, lo long, n long")
    return found.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("lo"), F.lit(shards)).cast("int")


# --- cuckoo filter ----------------------------------------------------------------------


class CuckooFilter:
    """Set of 128-bit keys as 32-bit prints in buckets of four; answers may be wrongly yes, never wrongly no."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint32).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hi, lo = np.asarray(hi).astype(np.int64).view(np.uint64), np.asarray(lo).astype(np.int64).view(np.uint64)
        prints = np.maximum((hi >> np.uint64(32)).astype(np.uint32), np.uint32(1))
        first = hi.astype(np.uint32) & np.uint32(len(self.table) - 1)
        return prints, first, self._other(first, prints)

    def _other(self, place, prints):
        return place ^ ((prints * np.uint32(0x5BD1E995) >> np.uint32(7)) & np.uint32(len(self.table) - 1))

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(hi, lo)
        return (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)

    def insert(self, hi, lo) -> bool:
        """Enter the keys; False if one found no place (then build a larger filter)."""
        for mark, a, b in zip(*(x.tolist() for x in self._places(hi, lo))):
            if not self._put(mark, a, b):
                return False
        return True

    def _put(self, mark: int, a: int, b: int) -> bool:
        for place in (a, b):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        place = b
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            with np.errstate(over="ignore"):
                place = int(self._other(np.uint32(place), np.uint32(mark)))
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        return False

    def delete(self, hi, lo) -> None:
        for mark, a, b in zip(*(x.tolist() for x in self._places(hi, lo))):
            for place in (a, b):
                held = np.flatnonzero(self.table[place] == mark)
                if len(held):
                    self.table[place, held[0]] = 0
                    break


def _filled(hi, lo) -> CuckooFilter:
    size = len(hi)
    while True:
        found = CuckooFilter.sized(size)
        if found.insert(hi, lo):
            return found
        size = 2 * size + 4


# --- index ------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineIndex:
    """Reference counts (hi, lo, n) and filters (shard, cuckoo) of the keys found in ``min_docs`` documents or more."""

    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int

    def common(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.min_docs)


def build_index(
    docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, shards: int = SHARDS
) -> LineIndex:
    """Counts and filters of ``docs``, written to the shared folder."""
    counts = cut_lineage(count_lines(docs, text, min_chars))
    common = counts.where(F.col("n") >= min_docs).select(shard_of(shards).alias("shard"), "hi", "lo")

    def fill(frame):
        cuckoo = _filled(frame["hi"].to_numpy(), frame["lo"].to_numpy())
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "cuckoo": [cuckoo.dump()]})

    filters = cut_lineage(common.groupBy("shard").applyInPandas(fill, "shard int, cuckoo binary"))
    return LineIndex(counts, filters, min_docs, min_chars, shards)


def insert_documents(index: LineIndex, docs: DataFrame, text: str = "text") -> LineIndex:
    """The index after the documents came in."""
    return _moved(index, count_lines(docs, text, index.min_chars))


def delete_documents(index: LineIndex, docs: DataFrame, text: str = "text") -> LineIndex:
    """The index after the documents, which must have been counted before, went away."""
    gone = count_lines(docs, text, index.min_chars)
    return _moved(index, gone.withColumn("n", -F.col("n")))


def _moved(index: LineIndex, change: DataFrame) -> LineIndex:
    both = index.counts.select("hi", "lo", F.col("n").alias("old"), F.lit(0).cast("long").alias("step"))
    both = both.unionByName(change.select("hi", "lo", F.lit(0).cast("long").alias("old"), F.col("n").alias("step")))
    both = both.groupBy("hi", "lo").agg(F.sum("old").alias("old"), F.sum("step").alias("step"))
    both = cut_lineage(both.withColumn("n", F.col("old") + F.col("step")))
    limit = F.lit(index.min_docs)
    crossed = both.where((F.col("old") >= limit) != (F.col("n") >= limit)).select(
        shard_of(index.shards).alias("shard"), "hi", "lo", (F.col("n") >= limit).alias("enters")
    )
    common = both.where(F.col("n") >= limit).select(shard_of(index.shards).alias("shard"), "hi", "lo")
    touched = common.join(crossed.select("shard").distinct(), "shard", "left_semi")

    def update(key, old, moves):
        cuckoo = CuckooFilter.load(old["cuckoo"].iloc[0]) if len(old) else CuckooFilter.sized(len(moves))
        gone, new = moves[~moves["enters"]], moves[moves["enters"]]
        cuckoo.delete(gone["hi"].to_numpy(), gone["lo"].to_numpy())
        full = not cuckoo.insert(new["hi"].to_numpy(), new["lo"].to_numpy())
        return pd.DataFrame({"shard": [key[0]], "cuckoo": [None if full else cuckoo.dump()]})

    kept = index.filters.groupBy("shard").cogroup(crossed.groupBy("shard"))
    filters = cut_lineage(kept.applyInPandas(update, "shard int, cuckoo binary"))
    overflown = filters.where("cuckoo is null").select("shard")
    if not overflown.isEmpty():

        def refill(frame):
            cuckoo = _filled(frame["hi"].to_numpy(), frame["lo"].to_numpy())
            return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "cuckoo": [cuckoo.dump()]})

        again = touched.join(overflown, "shard", "left_semi").groupBy("shard").applyInPandas(refill, filters.schema)
        filters = cut_lineage(filters.where("cuckoo is not null").unionByName(again))
    return replace(index, counts=both.where("n > 0").select("hi", "lo", "n"), filters=filters)


# --- removal ----------------------------------------------------------------------------


def drop_common_lines(
    docs: DataFrame, index: LineIndex, text: str = "text", name: str = "lines", filter_bytes: int = FILTER_BYTES
) -> DataFrame:
    """``docs`` and a struct column ``name``: n_lines, n_dropped, kept, kept_sha256.

    Lines end at \\n; null and empty texts are one empty line. A line goes where its key stands in
    ``min_docs`` documents or more; the others stay, joined by \\n (an empty text if none stays). The
    column takes the next free name if ``name`` is in use. Rows and other columns are untouched.
    """
    name = free_name(bounded_batches(docs), name)
    spark = docs.sparkSession
    size = index.filters.agg(F.sum(F.octet_length("cuckoo"))).first()[0] or 0
    if size > filter_bytes:
        return _drop_by_join(docs, index, text, name)
    filters = _FilterSet({r.shard: bytes(r.cuckoo) for r in index.filters.collect()}, index.shards)
    sent = spark.sparkContext.broadcast(filters)

    def mistaken(batches):
        for batch in batches:
            hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield batch.filter(pa.array(sent.value.contains(hi, lo)))

    rare = index.counts.where(F.col("n") < index.min_docs).select("hi", "lo")
    strays = rare.mapInArrow(mistaken, "hi long, lo long").limit(STRAY_KEYS + 1).collect() if filters.blobs else []
    if len(strays) > STRAY_KEYS:
        return _drop_by_join(docs, index, text, name)
    stray = spark.sparkContext.broadcast(pd.MultiIndex.from_tuples([(r.hi, r.lo) for r in strays], names=["hi", "lo"]) if strays else None)
    min_chars = index.min_chars

    def work(texts: pa.Array) -> pa.Array:
        return pa.array(list(by_slices(texts, one_slice)), _RESULT_TYPE)

    def one_slice(texts):
        documents = _documents(texts)
        hi, lo = _line_keys([x for d in documents for x in d], min_chars)
        common = ((hi != 0) | (lo != 0)) & sent.value.contains(hi, lo)
        if stray.value is not None and common.any():
            at = np.flatnonzero(common)
            common[at[pd.MultiIndex.from_arrays([hi[at], lo[at]]).isin(stray.value)]] = False
        common, at, out = common.tolist(), 0, []
        for lines in documents:
            out.append(_result(lines, common[at : at + len(lines)]))
            at += len(lines)
        return out

    return docs.withColumn(name, F.arrow_udf(work, RESULT)(F.col(text).cast("string")))


_RESULT_TYPE = pa.struct(
    [("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())]
)


def _result(lines: list[bytes], common: list[bool]) -> dict:
    kept = b"\n".join([x for x, gone in zip(lines, common) if not gone])
    return {
        "n_lines": len(lines), "n_dropped": sum(common), "kept": kept.decode(),
        "kept_sha256": hashlib.sha256(kept).hexdigest(),
    }


class _FilterSet:
    """The filters of all shards, asked as one."""

    def __init__(self, blobs: dict[int, bytes], shards: int):
        self.blobs, self.shards, self.loaded = blobs, shards, {}

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hi), bool)
        shard = np.mod(lo, self.shards)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True]) if len(order) else [0]
        for start, end in zip(edges[:-1], edges[1:]):
            number, rows = int(shard[order[start]]), order[start:end]
            if number in self.blobs:
                if number not in self.loaded:
                    self.loaded[number] = CuckooFilter.load(self.blobs[number])
                out[rows] = self.loaded[number].contains(hi[rows], lo[rows])
        return out


def _drop_by_join(docs: DataFrame, index: LineIndex, text: str, name: str) -> DataFrame:
    """The same without filters: lines meet the counts by key, documents their lines by the digest of the text."""
    min_chars = index.min_chars

    def lines(batches):
        for batch in batches:
            yield from by_slices(batch.column(0), one_slice)

    def one_slice(texts):
        documents = _documents(texts)
        hi, lo = _line_keys([x for d in documents for x in d], min_chars)
        sizes = [len(d) for d in documents]
        place = np.concatenate([np.arange(n) for n in sizes]).astype(np.int64)
        prints = [hashlib.sha256(b"\n".join(d)).digest() for d in documents]
        print_of = pa.array(prints, pa.binary()).take(pa.array(np.repeat(np.arange(len(documents)), sizes)))
        return [pa.RecordBatch.from_arrays([print_of, pa.array(place), pa.array(hi), pa.array(lo)], ["digest", "place", "hi", "lo"])]

    found = docs.select(F.col(text).cast("string")).mapInArrow(lines, "digest binary, place long, hi long, lo long")
    gone = found.where("hi <> 0 or lo <> 0").join(index.common().select("hi", "lo"), ["hi", "lo"])
    gone = gone.groupBy("digest").agg(F.collect_set("place").alias("places"))
    digest, places = free_name(docs, "digest"), free_name(docs, "places")
    gone = gone.select(F.col("digest").alias(digest), F.col("places").alias(places))

    def work(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        out = []
        for lines_of, at in zip(_documents(texts), dropped.to_pylist()):
            at = set(at or ())
            out.append(_result(lines_of, [i in at for i in range(len(lines_of))]))
        return pa.array(out, _RESULT_TYPE)

    own = F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))
    joined = docs.withColumn(digest, own).join(gone, digest, "left")
    return joined.withColumn(name, F.arrow_udf(work, RESULT)(F.col(text).cast("string"), F.col(places))).drop(digest, places)
