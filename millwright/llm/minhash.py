"""Near-duplicate groups by MinHash with sequential Bayesian verification.

A text is the set of its distinct shingles. Its signature is HASHES minima of hashed shingles, 16 bits of each; equal sets
count once. Signatures are cut into bands of ROWS minima, and sets that agree on a whole band are
candidates. A pair at the threshold t shares no band with probability (1 - t^ROWS)^(HASHES / ROWS), 3e-6 at 0.8.

Candidates are compared a batch of minima at a time. With a uniform prior, after m matches out of n the
similarity is at least t with posterior probability P(Binomial(n + 1, t) <= m); as soon as that falls below the miss
probability, the pair is dropped. What passes all batches is verified on the full sets of shingles.

Only components matter to the result, so pairs inside one component are not looked at again. Every set is first verified
against one partner, the first set of one of its bands; next against the first sets of its other bands, where that could still join two
components; last come bands that hold several components: their members are dealt into blocks, blocks meet in
pairs, and a task holds their signatures and full sets. It verifies what passes the batches at once and joins components as it goes, so it
hands on no pair but the links that join two of them.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import bounded_batches, by_slices, cut_lineage, deal, forget, free_name, grouped_runs, text_buffers
from millwright.llm.components import components
from millwright.llm.hashing import BASE, bounds, mixed, range_hashes

SHINGLE, THRESHOLD = 5, 0.8
HASHES, ROWS = 160, 5  # minima of a signature, and of a band
BATCH = 32  # minima compared at a time
MISS = 1e-6  # chosen probability below which a pair is dropped
BLOCK, BLOCK_SHINGLES = 4096, 4 << 20  # sets of a crowded band and shingles in them, or partners of one set, that form a block

# Blanks that part words, and lower case.
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


# ---- sets and signatures ----------------------------------------------------
def shingle_hashes(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of every text's distinct shingles; fewer than ``size`` words form one, no words none."""
    data, offsets = text_buffers(texts)
    data = _LOWER[data]
    starts, ends = bounds(~_BLANK[data], offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    words = range_hashes(data, starts, ends)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    with np.errstate(over="ignore"):
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = words[first:last]
            n = min(size, len(own))
            hashes = np.full(len(own) - n + 1 if n else 0, n, np.uint64)
            for j in range(n):
                hashes = hashes * np.uint64(BASE) + own[j : j + len(hashes)]
            out.append(np.unique(mixed(hashes)))
    return out


@cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and masks of the HASHES hash functions, from a rule."""
    numbers = np.arange(2 * HASHES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        drawn = mixed((numbers + np.uint64(1)) * np.uint64(BASE))
    return drawn[:HASHES] | np.uint64(1), drawn[HASHES:]


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES 16-bit minima per set; empty sets have zeros."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    hashes = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    factors, masks = _factors()
    for i in range(HASHES):
        least = np.minimum.reduceat((hashes ^ masks[i]) * factors[i], starts)
        out[full, i] = mixed(least) >> np.uint64(48)
    return out


def signature(text: Column, size: int = SHINGLE) -> Column:
    """struct<n, set_id, sig> of a text: number of distinct shingles, digest of their set, signature (2 bytes a minimum)."""

    def one_slice(texts):
        sets = shingle_hashes(texts, size)
        sigs = _signatures(sets)
        ids = [np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64) for s in sets]
        return [(len(s), int(i), sig.tobytes()) for s, i, sig in zip(sets, ids, sigs)]

    kind = pa.struct([("n", pa.int64()), ("set_id", pa.int64()), ("sig", pa.binary())])

    def work(texts: pa.Array) -> pa.Array:
        n, ids, sigs = zip(*by_slices(texts, one_slice)) if len(texts) else ((), (), ())
        columns = [pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(sigs, pa.binary())]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    return F.arrow_udf(work, "struct<n: long, set_id: long, sig: binary>")(text.cast("string"))


def _shingle_set(text: Column, size: int) -> Column:
    """The sorted hashes of a text's distinct shingles as an array of longs."""

    def one_slice(texts):
        return [np.sort(own.view(np.int64)) for own in shingle_hashes(texts, size)]

    def work(texts: pa.Array) -> pa.Array:
        return pa.array(list(by_slices(texts, one_slice)), pa.list_(pa.int64()))

    return F.arrow_udf(work, "array<long>")(text)


# ---- sequential verification ------------------------------------------------
@cache
def least_matches(threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, ...]:
    """For every whole number of batches, the fewest matches with which a pair goes on.

    After m of n matches P(similarity >= t) = P(Binomial(n + 1, t) <= m); below ``miss`` the pair is dropped.
    """
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = (1 - threshold) ** (n + 1), 0
        while below < miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return tuple(found)


def survivors(left: np.ndarray, right: np.ndarray, needed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two equally long tables of signatures that pass every batch, and their matches."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for batch, least in enumerate(needed):
        part = slice(batch * BATCH, (batch + 1) * BATCH)
        matches += (left[alive, part] == right[alive, part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive, matches


def _table(column: pa.ChunkedArray) -> np.ndarray:
    """Signatures of a binary column as rows of 16-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _sizes_allow(n: str, m: str, permille: int) -> Column:
    """Sets whose sizes are further apart than the threshold cannot be similar."""
    return 1000 * F.least(n, m) >= permille * F.greatest(n, m)


def _pruned(pairs: DataFrame, sets: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures leave the threshold possible."""
    permille, needed = round(threshold * 1000), least_matches(threshold, miss)
    for k in "ab":
        pairs = pairs.join(sets.select(F.col("set_id").alias(k), F.col("n").alias(f"{k}_n"), F.col("sig").alias(f"{k}_sig")), k)

    def compare(batches):
        for batch in batches:
            alive, _ = survivors(_table(batch.column("a_sig")), _table(batch.column("b_sig")), needed)
            yield batch.select(["a", "b"]).take(pa.array(alive))

    near = pairs.where(_sizes_allow("a_n", "b_n", permille))
    return near.select("a", "b", "a_sig", "b_sig").mapInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Partners of one a are dealt into blocks; a block gets the text of a once, ahead of its partners' texts, so a
    task holds one set and no pair carries two.
    """
    permille = round(threshold * 1000)
    pairs = cut_lineage(pairs)
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    heads = placed.select("a", "block").distinct().select("a", "block", F.lit(0).alias("kind"), F.col("a").alias("set_id"))
    members = placed.select("a", "block", F.lit(1).alias("kind"), F.col("b").alias("set_id"))
    rows = heads.union(members).join(texts, "set_id").select("a", "block", "kind", "set_id", "text")

    def check(batches):
        current, own = None, None
        for batch in batches:
            sets = by_slices(batch.column("text"), lambda part: shingle_hashes(part, size))
            keys = zip(batch.column("a").to_pylist(), batch.column("block").to_pylist())
            a, b = [], []
            for key, kind, other, found in zip(keys, batch.column("kind").to_pylist(), batch.column("set_id").to_pylist(), sets):
                if kind == 0:
                    current, own = key, found
                    continue
                if key != current:
                    raise ValueError("partners without the set they are compared with")
                shared = _shared(own, found)
                if 1000 * shared >= permille * (len(own) + len(found) - shared):
                    a.append(key[0])
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = deal(rows, "a", "block").sortWithinPartitions("a", "block", "kind")
    links = cut_lineage(ordered.mapInArrow(check, "a long, b long"))
    forget(pairs)
    return links


# ---- candidates -------------------------------------------------------------
def _bands(sig: Column) -> Column:
    """One key per band: hash of its number and its minima."""
    width = 2 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda i: F.xxhash64(i, F.substring(sig, i * width + 1, F.lit(width))))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (set_id, ...) with the root of the component they are in, themselves if in none."""
    named = roots.select(F.col("node").alias("set_id"), "root")
    return rows.join(named, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components."""
    for k in "ab":
        named = roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
        pairs = pairs.join(named, k, "left").withColumn(f"{k}_root", F.coalesce(f"{k}_root", k))
    return pairs.where("a_root <> b_root").select("a", "b")


def _crossing(members: DataFrame, sets: DataFrame, whole: DataFrame, roots: DataFrame, threshold: float, miss: float, block: int) -> DataFrame:
    """Verified links (a, b) that join components within bands that hold several; ``whole`` has the sets (set_id, own)."""
    permille, needed = round(threshold * 1000), least_matches(threshold, miss)
    rooted = _rooted(members.select("set_id", "key"), roots).join(sets.select("set_id", "n"), "set_id")
    rooted = cut_lineage(rooted)
    several = rooted.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("held"), F.sum("n").alias("size")
    )
    blocks = F.greatest(F.ceil(F.col("held") / block), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    several = several.where("low <> high and held > 2").select("key", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("set_id", "key"), F.col("blocks")).cast("int")
    held = cut_lineage(rooted.join(several, "key").withColumn("own_block", own))
    crowded = held.select("set_id").distinct().join(whole, "set_id").join(sets.select("set_id", "sig"), "set_id")
    placed = held.withColumn("other", F.explode_outer(F.expr("sequence(0, blocks - 1)")))
    placed = placed.select("key", "set_id", "root", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j"))
    placed = placed.join(crowded, "set_id").select("key", "i", "j", "set_id", "root", "sig", "own")
    keys = ["key", "i", "j"]

    def compare(batches):
        for table in grouped_runs(batches, keys, 256):
            ids, names = (table.column(c).to_numpy() for c in ("set_id", "root"))
            sigs = _table(table.column("sig"))
            lists = table.column("own").combine_chunks()
            hashes, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            sizes = np.diff(edges)
            marks = [table.column(c).to_numpy() for c in keys]
            changed = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            a, b = [], []
            for start, end in zip([0, *changed.tolist()], [*changed.tolist(), len(ids)]):
                group = np.unique(names[start:end], return_inverse=True)[1]  # components, renamed as they are joined
                for at in range(start, end - 1):
                    rest = np.arange(at + 1, end)
                    least, most = np.minimum(sizes[rest], sizes[at]), np.maximum(sizes[rest], sizes[at])
                    rest = rest[(group[rest - start] != group[at - start]) & (1000 * least >= permille * most)]
                    if not len(rest):
                        continue
                    alive, _ = survivors(np.broadcast_to(sigs[at], (len(rest), HASHES)), sigs[rest], needed)
                    left = hashes[edges[at] : edges[at + 1]]
                    for other in rest[alive].tolist():
                        if group[other - start] == group[at - start]:
                            continue
                        right = hashes[edges[other] : edges[other + 1]]
                        shared = _shared(left, right)
                        if 1000 * shared >= permille * (len(left) + len(right) - shared):
                            a.append(int(ids[at]))
                            b.append(int(ids[other]))
                            group[group == group[other - start]] = group[at - start]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = cut_lineage(deal(placed, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long").distinct())
    forget(rooted, held)
    return links


def _shared(left: np.ndarray, right: np.ndarray) -> int:
    """How many numbers two sorted arrays without repeats have in common."""
    if not len(left):
        return 0
    at = np.minimum(np.searchsorted(left, right), len(left) - 1)
    return int(np.count_nonzero(left[at] == right))


def _links(sets: DataFrame, texts: DataFrame, members: DataFrame, size: int, threshold: float, miss: float, block: int) -> DataFrame:
    """(node, root): components of the sets over verified pairs."""
    offered = members.where("set_id <> pivot")
    roots = None

    def joined(links: DataFrame) -> DataFrame:
        """The components with ``links`` added; those found before go in as stars, and stay as they are where no link is new."""
        if roots is None:
            found = cut_lineage(components(links))
        elif links.isEmpty():
            found = roots
        else:
            stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            found = cut_lineage(components(stars.union(links)))
            forget(roots)
        forget(links)
        return found

    verified = lambda pairs: _verified(_pruned(pairs, sets, threshold, miss), texts, size, threshold)
    first = offered.groupBy("set_id").agg(F.min("pivot").alias("a")).select("a", F.col("set_id").alias("b"))
    roots = joined(verified(first))
    others = offered.select(F.col("pivot").alias("a"), F.col("set_id").alias("b")).distinct()
    roots = joined(verified(_apart(others, roots)))
    whole = texts.select("set_id", _shingle_set(F.col("text"), size).alias("own"))
    return joined(_crossing(members, sets, whole, roots, threshold, miss, block))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, threshold: float = THRESHOLD,
    miss: float = MISS, block: int = BLOCK,
) -> DataFrame:
    """One row per document: its id column, ``n_shingles`` and ``component_id``.

    A-Z are lower-cased, words stand apart at ASCII blanks; a set holds the distinct runs of ``size`` words, the whole
    sequence where there are fewer. Documents whose sets have Jaccard similarity ``threshold`` or more, compared as whole
    numbers in thousandths, are linked; ``component_id`` is the smallest id reachable, the document itself included. Null and empty texts and texts
    without words have no shingles and are linked with nothing. Repeated rows stay and are linked as equal sets. A null id
    never names a group: where a group has no other, its ``component_id`` is null. Texts of any length count whole. Other
    columns of ``docs`` are not carried. An empty table gives an empty result.
    """
    docs = bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # the two hashes name a row whose text is read again, whatever its id
    hashes = {"id_hash": F.xxhash64("doc_id").alias("id_hash"), "text_hash": F.xxhash64("text").alias("text_hash")}
    found = docs.select("doc_id", *hashes.values(), signature(F.col("text"), size).alias("s"))
    rows = cut_lineage(found.select("doc_id", *hashes, "s.*"))
    sets = rows.where("n > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("least"), F.max(F.struct("n", "sig")).alias("s"), F.max(F.struct("id_hash", "text_hash")).alias("bearer")
    )
    sets = cut_lineage(sets.select("set_id", "least", "s.*", "bearer.*"))
    keyed = sets.select("set_id", F.explode_outer(_bands(F.col("sig"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("held"), F.min("set_id").alias("pivot")).where("held > 1")
    members = cut_lineage(keyed.join(shared.select("key", "pivot"), "key"))
    asked = sets.join(members.select("set_id").distinct(), "set_id", "left_semi").select("set_id", *hashes)
    texts = docs.select("text", *hashes.values()).join(asked, list(hashes)).dropDuplicates(list(hashes))
    texts = cut_lineage(texts.select("set_id", "text"))
    roots = _links(sets, texts, members, size, threshold, miss, block)
    rooted = cut_lineage(_rooted(sets.select("set_id", "least"), roots))
    forget(texts, members, roots, sets)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(named, "root").select("set_id", "component_id")
    found = rows.where("n > 0").join(labels, "set_id").select("doc_id", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.union(alone).select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay: of each group the rows with its smallest id; rows with a null id stay."""
    groups = near_duplicates(docs, text, doc_id, size, threshold)
    mark = free_name(docs, "dropped")
    dropped = groups.where(F.col(doc_id) != F.col("component_id")).select(F.col(doc_id).alias(mark)).distinct()
    return docs.join(dropped, docs[doc_id] == F.col(mark), "left_anti")
