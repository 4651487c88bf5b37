"""Shards of near equal size by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups sorted by size, largest
first, go to the shard with the least load so far, taken from a heap. A group above a
50,000th of all bytes is scheduled by itself, and there can be no more than 50,000 of those;
the smaller ones are scheduled in 16,384 bundles that a hash of the text deals out. So the
driver's list is bounded whatever the input, and loads differ by about a bundle.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import cut_lineage, number_rows

SINGLE_PARTS = 50_000
BUNDLES = 16_384


def schedule(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Shard of each key: (size, key) pairs, largest first, to the least loaded shard; ties to smaller keys and shards."""
    loads = [(0, s) for s in range(shards)]
    placed = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = loads[0]
        placed[key] = shard
        heapq.heapreplace(loads, (load + size, shard))
    return placed


def shard_documents(
    docs: DataFrame, carry: dict[str, Column], shards: int = 8, text: str = "text",
    single_parts: int = SINGLE_PARTS, bundles: int = BUNDLES,
) -> DataFrame:
    """Per row of ``docs``: the carried columns, size (UTF-8 bytes plus 1), shard, and slot (gapless from 0 in a shard).

    Null texts have no bytes and are a group of their own; empty texts are another. Repeated rows stay, each
    with a slot. An empty table gives an empty result.
    """
    value = F.col(text).cast("string")
    size = (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long")
    digest = F.coalesce(F.unhex(F.sha2(value.cast("binary"), 256)), F.lit(b""))
    rows = docs.select(*[c.alias(n) for n, c in carry.items()], size.alias("size"), digest.alias("digest"))
    rows = cut_lineage(rows.withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("int")))
    groups = cut_lineage(rows.groupBy("digest", "bundle").agg(F.sum("size").alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    single = F.col("size") * single_parts > F.lit(total)
    singles = groups.where(single).select("size", "digest").collect()
    rest = groups.where(~single).groupBy("bundle").agg(F.sum("size").alias("size")).collect()
    placed = schedule(
        [(r["size"], (0, bytes(r.digest))) for r in singles] + [(r["size"], (1, r.bundle)) for r in rest], shards
    )
    own = docs.sparkSession.sparkContext.broadcast({k: s for (kind, k), s in placed.items() if kind == 0})
    bundled = np.full(bundles, -1, np.int32)
    for (kind, key), shard in placed.items():
        if kind == 1:
            bundled[key] = shard

    def assign(batches):
        for batch in batches:
            names = batch.schema.names
            shard = bundled[batch.column(names.index("bundle")).to_numpy()]
            for i, digest in enumerate(batch.column(names.index("digest")).to_pylist()):
                shard[i] = own.value.get(digest, shard[i])
            kept = [i for i, n in enumerate(names) if n not in ("digest", "bundle")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(shard)], [*(names[i] for i in kept), "shard"])

    schema = T.StructType([*rows.drop("digest", "bundle").schema.fields, T.StructField("shard", T.IntegerType())])
    return number_rows(rows.mapInArrow(assign, schema), "shard", "slot")
