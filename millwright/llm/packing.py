"""Best-fit packing into training sequences of several permitted lengths.

What decides a packing is how many pieces there are of each length, and lengths are
bounded by the largest permitted sequence. So the packing is worked out on that
histogram, longest pieces first: pieces of one length go into the open bins with the least
room that takes them, all equal bins at once; where none has room, a bin is opened of
the size that costs least per token it can be expected to hold, given what is left to
pack; at the end each bin shrinks to the smallest permitted size for its contents. The
plan is a list of runs (length, first to last piece, bins), bounded by the lengths, and
each task places its own pieces by their numbers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import bounded_batches, by_slices, cut_lineage, number_rows, text_buffers

SIZES = (512, 1024, 2048)


def sequence_cost(size: int) -> float:
    """Default cost of a sequence: linear in tokens, a share that grows with the square, and a fixed part."""
    return size + size * size / 16384 + 16


def word_count(text: Column | str) -> Column:
    """Words apart at ASCII blanks, plus one for the mark that ends a text."""

    def work(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter(by_slices(texts, one_slice), np.int64, len(texts)))

    def one_slice(texts):
        data, offsets = text_buffers(texts)
        data, offsets = data.tobytes(), offsets.tolist()
        return [len(data[s:e].split()) + 1 for s, e in zip(offsets, offsets[1:])]

    return F.arrow_udf(work, "long")(text)


@dataclass
class Bins:
    """Equal bins with consecutive numbers."""

    first: int
    count: int
    size: int
    used: int


@dataclass
class Plan:
    """Runs (length, first piece, pieces per bin, first bin, offset) and closed bins, both in order."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: list[Bins] = field(default_factory=list)


def plan_bins(histogram: dict[int, int], sizes=SIZES, cost: Callable[[int], float] = sequence_cost) -> Plan:
    """Best-fit decreasing over {length: pieces}; every length must fit the largest size."""
    sizes = sorted(sizes)
    left = {length: n for length, n in histogram.items() if n > 0}
    lengths = sorted(left)
    open_bins: dict[int, list[Bins]] = {}
    rooms: list[int] = []  # sorted keys of open_bins
    plan, bins_made = Plan(), 0

    def put(group: Bins) -> None:
        room = group.size - group.used
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append(group)

    while lengths:
        length = lengths[-1]
        todo, done = left[length], 0
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                group = open_bins[room].pop(0)
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                left[length] = todo
                size = _cheapest(length, left, lengths, sizes, cost)
                group = Bins(bins_made, max(1, todo // (size // length)), size, 0)
                bins_made += group.count
            each = min((group.size - group.used) // length, todo)
            full = min(group.count, todo // each)
            plan.runs.append((length, done, each, group.first, group.used))
            put(Bins(group.first, full, group.size, group.used + each * length))
            if full < group.count:
                put(Bins(group.first + full, group.count - full, group.size, group.used))
            done += full * each
            todo -= full * each
        lengths.pop()
        del left[length]
    closed = [g for groups in open_bins.values() for g in groups]
    for group in closed:
        group.size = sizes[bisect_left(sizes, group.used)]
    plan.bins = sorted(closed, key=lambda g: g.first)
    plan.runs.sort()
    return plan


def _cheapest(length: int, left: dict[int, int], lengths: list[int], sizes: list[int], cost) -> int:
    """The size with the least cost per token if what is left to pack filled it greedily; ties to the larger."""
    best = None
    for size in sizes:
        if size < length:
            continue
        room = size
        at = len(lengths)
        while room and at:
            at = bisect_left(lengths, room + 1, 0, at)
            if not at:
                break
            longest = lengths[at - 1]
            n = min(room // longest, left[longest])
            room -= n * longest
            at -= 1
        price = cost(size) / (size - room)
        if best is None or price <= best[0]:
            best = (price, size)
    return best[1]


def pack(
    docs: DataFrame, length: Column, carry: dict[str, Column], sizes=SIZES, cost: Callable[[int], float] = sequence_cost
) -> DataFrame:
    """Pieces of documents in bins: the carried columns, piece, start, length, bin_id, bin_size, bin_offset.

    A document longer than the largest size is cut into pieces of that size and a rest. ``length`` null or
    below 1 gives one piece of length 0 in no bin. Repeated rows are packed like others. An empty table gives no rows.
    """
    most = max(sizes)
    rows = bounded_batches(docs).select(*[c.alias(n) for n, c in carry.items()], F.coalesce(length.cast("long"), F.lit(0)).alias("n_"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_") / F.lit(most))).cast("long")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    rows = rows.withColumn("start", F.col("piece") * most)
    rows = rows.withColumn("length", F.greatest(F.lit(0), F.least(F.lit(most), F.col("n_") - F.col("start"))).cast("int"))
    numbered = cut_lineage(number_rows(rows.drop("n_"), "length", "number_"))
    histogram = {r.length: r["count"] for r in numbered.where("length > 0").groupBy("length").count().collect()}
    plan = plan_bins(histogram, sizes, cost)
    runs = np.array(plan.runs, np.int64).reshape(-1, 5)
    shut = np.array([(g.first, g.size) for g in plan.bins], np.int64).reshape(-1, 2)
    sent = docs.sparkSession.sparkContext.broadcast((runs, shut))

    def place(batches):
        for batch in batches:
            runs, shut = sent.value
            names = batch.schema.names
            size = batch.column(names.index("length")).to_numpy().astype(np.int64)
            number = batch.column(names.index("number_")).to_numpy()
            columns = [c for c, n in zip(batch.columns, names) if n != "number_"]
            if len(runs):
                # runs are in order of (length, first piece): the last one not after the piece holds it
                key, wide = runs[:, 0] * (1 << 44) + runs[:, 1], size * (1 << 44) + number
                run = runs[np.maximum(np.searchsorted(key, wide, "right") - 1, 0)]
                turn = number - run[:, 1]
                bin_id = run[:, 3] + turn // run[:, 2]
                offset = run[:, 4] + turn % run[:, 2] * size
                bin_size = shut[np.searchsorted(shut[:, 0], bin_id, "right") - 1, 1]
            else:
                bin_id = offset = bin_size = np.zeros(len(size), np.int64)
            none = size == 0
            found = [pa.array(x, pa.int64(), mask=none) for x in (bin_id, bin_size, offset)]
            yield pa.RecordBatch.from_arrays([*columns, *found], [*(n for n in names if n != "number_"), "bin_id", "bin_size", "bin_offset"])

    schema = T.StructType(numbered.drop("number_").schema.fields)
    for name in ("bin_id", "bin_size", "bin_offset"):
        schema = schema.add(name, T.LongType())
    return numbered.mapInArrow(place, schema)
