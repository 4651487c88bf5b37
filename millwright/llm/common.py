"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.session import cut_lineage, deal, forget

__all__ = ["SLICE_BYTES", "bounded_batches", "by_slices", "cut_lineage", "deal", "forget", "free_name", "grouped_runs", "hex16", "number_rows", "text_buffers"]

# Texts are worked on in slices of about this many bytes, whatever the size of an Arrow
# batch, so a task's memory does not follow the batch.
SLICE_BYTES = 1 << 19
BATCH_BYTES = 2 << 20  # an Arrow batch is closed at this size; by default only at 64 MB


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session told to send rows to Python in batches of about BATCH_BYTES.

    A smaller limit that the session has already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = df.sparkSession.conf.get(key).rstrip("bB")
    if held.isdigit() and int(held) > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts one after another, and n + 1 offsets into them; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_slices(texts: pa.Array, work: Callable[[pa.Array], list]) -> Iterator:
    """``work`` on runs of rows of about SLICE_BYTES each, results in row order."""
    lengths = pc.binary_length(texts).fill_null(0).to_numpy()
    start = 0
    while start < len(lengths):
        size, end = int(lengths[start]), start + 1
        while end < len(lengths) and size + lengths[end] <= SLICE_BYTES:
            size += int(lengths[end])
            end += 1
        yield from work(texts.slice(start, end - start))
        start = end


def grouped_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 100_000) -> Iterator[pa.Table]:
    """Sorted Arrow batches as tables of whole key groups, each of ``rows`` rows or a little more.

    The caller bounds a group's size; a group is never cut.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        last = table.num_rows - 1
        same = np.ones(table.num_rows, bool)
        for key in keys:
            column = table.column(key).to_numpy()
            same &= column == column[last]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held)


def hex16(value) -> F.Column:
    """A long as 16 lowercase hex digits of its two's complement."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def number_rows(df: DataFrame, key: str, name: str = "number") -> DataFrame:
    """``df`` with a column that numbers the rows of each ``key`` (an integer column) from 0 without gaps.

    Each task counts its own rows per key as it writes them; only (task, key) counts are then
    summed up, so a key that holds most rows is numbered by all tasks.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("task_", T.IntegerType()), T.StructField("place_", T.LongType())])

    def count(batches):
        import pandas as pd

        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            values = pd.Series(batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False))
            place = values.groupby(values).cumcount() + values.map(seen).fillna(0).astype(np.int64)
            for value, n in values.value_counts().items():
                seen[value] = seen.get(value, 0) + n
            columns = [*batch.columns, pa.array(np.full(len(values), task, np.int32)), pa.array(place.to_numpy(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "task_", "place_"])

    placed = cut_lineage(df.mapInArrow(count, schema))
    sums = placed.groupBy("task_", key).count()
    earlier = W.partitionBy(key).orderBy("task_").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("task_", key, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before_"))
    out = placed.join(sums, ["task_", key]).withColumn(name, F.col("before_") + F.col("place_"))
    return out.select(*df.columns, name)
