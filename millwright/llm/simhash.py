"""Near-duplicate groups by SimHash: bit-sliced comparison inside candidate blocks.

A fingerprint has 64 bits. Four bands of 16 bits, and inside what is left four bands
of 12: two fingerprints that differ in at most 3 bits agree on one band and on one
inner band, so 16 keys of 28 bits bring every such pair together. Equal fingerprints
count once. A key that many fingerprints share is split into blocks, and blocks meet
in pairs, so a task never holds more than two blocks of it.

Inside a block nothing is compared number by number. Bit planes are stored
vertically (bit p of all fingerprints, packed 64 to a word), a shift by d sets every
fingerprint against the d-th one after it, and three bit planes of carry-save
counters add up 64 distances at once. A word whose 64 distances have all passed the
radius is abandoned.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import bounded_batches, by_slices, cut_lineage, deal, free_name, grouped_runs, text_buffers
from millwright.llm.components import components

BLOCK = 2048  # fingerprints of a hot key in one block


def simhash(text: Column | str, shingle: int = 3, seed: int = 42) -> Column:
    """64-bit SimHash of a text as a long (two's complement).

    A-Z lower-cased, words apart at ASCII blanks, ``shingle`` words joined by a space and
    hashed with XXH64, repeats counted; fewer words form one shingle, no words (null,
    empty, blank) give 0. A bit is set where over half of the hashes have it.
    """

    def prints(texts: pa.Array) -> pa.Array:
        found = by_slices(texts, lambda part: _fingerprints(part, shingle, seed))
        return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    return F.arrow_udf(prints, "long")(text)


def _fingerprints(texts: pa.Array, shingle: int, seed: int) -> list:
    data, offsets = text_buffers(texts)
    data = data.tobytes().lower()
    hashes, counts = [], []
    for start, end in itertools.pairwise(offsets.tolist()):
        words = data[start:end].split()
        joined = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
        if len(words) <= shingle:
            pieces = [joined] if words else []
        else:
            starts = [0, *(e + 1 for e in ends[: -shingle])]
            pieces = [joined[s:e] for s, e in zip(starts, ends[shingle - 1 :])]
        hashes.extend([xxhash.xxh64_intdigest(x, seed) for x in pieces])
        counts.append(len(pieces))
    return _majority(np.array(hashes, np.uint64), np.array(counts, np.int64)).tolist()


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per run of ``counts`` hashes, the bits that over half of them have."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), starts).astype(np.int64)
        out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def near_links(prints: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the fingerprints of ``prints`` (distinct longs in column ``fp``).

    The links connect exactly the fingerprints that chains of pairs at ``radius`` or fewer
    differing bits connect; inside a block a spanning forest stands for all its pairs.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the candidate keys hold for a radius of 0 to 3 bits")
    keyed = prints.select("fp", F.explode(_band_keys(F.col("fp"))).alias("key"))
    crowded = keyed.groupBy("key").count().where(F.col("count") > block)
    crowded = crowded.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.col("fp"), F.col("key")), F.col("blocks")).cast("int")
    placed = keyed.join(crowded, "key", "left").withColumn("own", F.coalesce(own, F.lit(0)))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    placed = placed.select(
        "fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    keys = ["key", "i", "j"]

    def compare(batches):
        for table in grouped_runs(batches, keys):
            fps = table.column("fp").to_numpy().view(np.uint64)
            group = _group_numbers([table.column(k).to_numpy() for k in keys])
            a, b = _forest(fps, group, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return deal(placed, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long").distinct()


def _band_keys(fp: Column) -> Column:
    """16 keys: number of the band pair, 16 bits of the band, 12 bits of the inner band."""
    keys = []
    for band in range(4):
        head = F.shiftrightunsigned(fp, 16 * band).bitwiseAND(F.lit(0xFFFF))
        high = F.shiftrightunsigned(fp, 16 * (band + 1)) if band < 3 else F.lit(0).cast("long")
        low = fp.bitwiseAND(F.lit((1 << (16 * band)) - 1)) if band else F.lit(0).cast("long")
        rest = F.shiftleft(high, 16 * band).bitwiseOR(low)
        for inner in range(4):
            tail = F.shiftrightunsigned(rest, 12 * inner).bitwiseAND(F.lit(0xFFF))
            number = F.lit((4 * band + inner) << 28).cast("long")
            keys.append(number.bitwiseOR(F.shiftleft(head, 12)).bitwiseOR(tail))
    return F.array(*keys)


def _group_numbers(columns: list[np.ndarray]) -> np.ndarray:
    changed = np.zeros(len(columns[0]), bool)
    for column in columns:
        changed[1:] |= column[1:] != column[:-1]
    return np.cumsum(changed)


def _forest(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links over positions of the same group at distance ``radius`` or less.

    All groups of the table share one set of planes. Pairs across groups are masked out; once a
    shift is past the small groups, each large one goes on by itself.
    """
    n = len(fps)
    parent = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    many = sizes[(sizes > 1) & (sizes <= 64)]
    if len(many):
        small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 64), sizes))
        planes = _planes(fps[small])
        inside = group[small]
        for shift in range(1, int(many.max())):
            same = inside[:-shift] == inside[shift:]
            hit = np.flatnonzero(same & _within(planes, shift, len(same), radius))
            _unite(parent, small[hit], small[hit + shift])
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        planes = _planes(fps[start : start + size])
        for shift in range(1, size):
            hit = np.flatnonzero(_within(planes, shift, size - shift, radius)) + start
            _unite(parent, hit, hit + shift)
    linked = np.flatnonzero(parent != np.arange(n))
    return fps[linked], fps[parent[linked]]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[k] and b[k]; every node then points at its root."""
    apart = parent[a] != parent[b]
    for x, y in zip(a[apart].tolist(), b[apart].tolist()):
        x, y = _root(parent, x), _root(parent, y)
        parent[max(x, y)] = min(x, y)
    while apart.any():
        up = parent[parent]
        if np.array_equal(up, parent):
            return
        parent[:] = up


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        i = int(parent[i])
    return i


def _planes(values: np.ndarray) -> np.ndarray:
    """64 rows, row p holding bit p of all values packed 64 to a word, and a spare word."""
    words = len(values) // 64 + 2
    square = np.zeros(words * 64, np.uint64)
    square[: len(values)] = values
    bits = np.unpackbits(square.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _within(planes: np.ndarray, shift: int, pairs: int, radius: int) -> np.ndarray:
    """For k < pairs, whether items k and k + shift of the planes differ in at most ``radius`` (0 to 3) bits."""
    words = -(-pairs // 64)
    skip, bits = divmod(shift, 64)
    alive = np.arange(words)
    ones, twos, over = (np.zeros(words, np.uint64) for _ in range(3))
    for first in range(0, 64, 8):
        part = planes[first : first + 8]
        other = part[:, alive + skip] >> np.uint64(bits)
        if bits:
            other |= part[:, alive + skip + 1] << np.uint64(64 - bits)
        for plane in part[:, alive] ^ other:
            carry = ones & plane
            ones ^= plane
            over |= twos & carry
            twos ^= carry
        keep = (over | _above(ones, twos, radius)) != np.uint64(0xFFFFFFFFFFFFFFFF)
        if not keep.all():  # abandon words in which all 64 pairs are past the radius
            alive, ones, twos, over = alive[keep], ones[keep], twos[keep], over[keep]
            if not len(alive):
                break
    near = np.zeros(words, np.uint64)
    near[alive] = ~(over | _above(ones, twos, radius))
    return np.unpackbits(near.view(np.uint8), bitorder="little")[:pairs].astype(bool)


def _above(ones: np.ndarray, twos: np.ndarray, radius: int) -> np.ndarray:
    """Where a two-bit count, itself at most 3, is above the radius."""
    return (ones | twos, twos, ones & twos, np.zeros_like(ones))[radius]


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 3, block: int = BLOCK
) -> DataFrame:
    """One row per document: its id column, ``fp`` (long) and ``component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest id reachable over links, the document itself included.
    Repeated rows stay. A null id never names a group: where a group has no other,
    its ``component_id`` is null. Texts without words share fingerprint 0 and are linked like others.
    Other columns of ``docs`` are not carried. An empty table gives an empty result.
    """
    docs = bounded_batches(docs)
    rows = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text)).alias("fp")))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(cut_lineage(near_links(prints, radius, block)))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    labels = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(F.col("doc_id").alias(doc_id), "fp", "component_id")


def keep_one(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 3, also: DataFrame | None = None
) -> DataFrame:
    """The documents that stay: of each near-duplicate group the rows with its smallest id.

    ``also`` may hold further groups (``doc_id``, component_id), named by their smallest ids; groups that share a document
    are one. Columns as in ``docs``. Rows that repeat an id that stays are all kept, and so are rows with a null id, as
    nothing names them.
    """
    groups = near_duplicates(docs, text, doc_id, radius).select(F.col(doc_id).alias("a"), F.col("component_id").alias("b"))
    if also is not None:
        links = groups.union(also.select(F.col(doc_id), "component_id")).where("a <> b")
        groups = components(links).select(F.col("node").alias("a"), F.col("root").alias("b"))
    mark = free_name(docs, "dropped")
    dropped = groups.where("a <> b").select(F.col("a").alias(mark)).distinct()
    return docs.join(dropped, docs[doc_id] == F.col(mark), "left_anti")
