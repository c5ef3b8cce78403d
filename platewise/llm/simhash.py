"""Near-duplicate grouping by SimHash and covering locality-sensitive hashing (operator 11).

*Fingerprints.*  A document's shingles are its runs of ``width`` words, repeats
included, joined by single spaces; with fewer words, the whole sequence is the one
shingle; without words there is none and the fingerprint is zero.  Each shingle
is hashed by XXH64 (UTF-8, seed 42), and a bit of the fingerprint is 1 if it is
set in over half of the hashes.

*Covering.*  Each of the 64 positions gets a nonzero vector ``m(i)`` of
``radius + 1`` bits.  Table ``v``, for each nonzero vector ``v``, compares the
positions whose ``m(i)`` has an odd product with ``v``.  At most ``radius`` differing
positions span less than the whole space, so some ``v`` is orthogonal to all of
them, and in its table the two fingerprints agree: every pair within the radius
meets in one of the ``2 ** (radius + 1) - 1`` tables, with certainty.  The vectors
are dealt evenly, so each table compares 32 to 34 positions at radius 4.

*Buckets.*  Equal fingerprints are one class and only classes go on.  Members of a
bucket are first compared with its least member; buckets whose members are then in
one group need nothing more.  The others are solved by comparing all members within
the row of a bucket where it has at most ``BLOCK`` of them, and give a star to the
least member of each group, not all pairs.  A larger bucket is dealt to the tables of a
second family over the positions left, and so on: each family halves the positions
in which members of a bucket may differ, so buckets shrink to the block whatever
their size, no pair within the radius is lost, and no task gets a large bucket.

*Grouping* is union-find over the links by alternating star steps (``near_dedup.components``).

Rows: null and empty texts and those of blanks alone have fingerprint zero and are
linked like any other; very long texts are taken in whole; repeated rows and rows
with one id are linked by their fingerprints only, each on its own; a row with a
null id links like any other but gives no name to its group, whose ``component_id``
is the least id there is, or null without any; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import U64, Words, materialize, raw_texts, release, slices
from platewise.llm.near_dedup import components

SEED = 42
#: Members of a bucket that are compared with each other within one row.
BLOCK = 256
#: Rows of one fingerprint are dealt to this many keys when results return to them.
SALTS = 64
#: Byte lanes of a sum of bits hold this many hashes.
LANES = 255


def shingle_hashes(texts: list[bytes], width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, one after another, and their numbers."""
    import xxhash

    raw = b"\n".join(b" ".join(t.lower().split()) for t in texts) + b"\n"  # bytes: A-Z only, ASCII blanks
    words = Words(raw)
    stops = np.cumsum(np.fromiter(map(len, raw.split(b"\n")[:-1]), np.int64, len(texts)) + 1)
    upto = np.searchsorted(words.starts, stops)
    n = np.diff(np.concatenate([[0], upto]))
    sizes = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.repeat(upto - n - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    last = np.where(np.repeat(n >= width, sizes), first + width, np.repeat(upto, sizes)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(words.starts[first].tolist(), words.stops[last].tolist())
    return np.fromiter((digest(raw[a:b], SEED) for a, b in spans), U64, len(first)), sizes


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of sets of hashes that lie one after another.

    A bit plane of eight byte lanes is summed over runs of at most ``LANES``
    hashes, then over the runs of a set.
    """
    full = np.nonzero(sizes)[0]
    found = np.zeros(len(sizes), U64)
    if not len(full):
        return found
    n = sizes[full]
    runs = -(-n // LANES)
    begin = np.repeat(np.cumsum(n) - n, runs)
    step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    cuts, groups = begin + step * LANES, np.cumsum(runs) - runs
    lanes = U64(0x0101010101010101)
    for plane in range(8):
        sums = np.add.reduceat((hashes >> U64(plane)) & lanes, cuts).view(np.uint8).reshape(-1, 8)
        more = np.add.reduceat(sums.astype(np.int64), groups, axis=0) * 2 > n[:, None]
        for lane in range(8):
            found[full] |= more[:, lane].astype(U64) << U64(8 * lane + plane)
    return found


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits as a long."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(1))
            for a, b in slices(texts, 3_000_000):
                found = majority(*shingle_hashes(texts[a:b], width)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mark, "doc_id long, fp long")


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """Masks of a covering family: any ``radius`` positions are left out by at least one of them.

    Families of different levels deal the vectors to the positions in different orders.
    """
    vectors = np.arange(64) % (2 ** (radius + 1) - 1) + 1
    if level:
        vectors = np.random.default_rng(level).permutation(vectors)
    bits = [np.array([int(v & m).bit_count() & 1 for m in vectors], np.uint64) for v in range(1, 2 ** (radius + 1))]
    return [int(sum(int(b) << i for i, b in enumerate(row))) for row in bits]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _dealt(members: DataFrame, radius: int, level: int) -> DataFrame:
    """``key, fp``: each member in the buckets of a family; buckets of an earlier one are split."""
    masks = F.posexplode(F.lit([_signed(m) for m in covering_masks(radius, level)])).alias("t", "mask")
    within = [F.col("key")] if level else []
    return members.select("*", masks).select(F.xxhash64(*within, F.lit(level), "t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")


def _shared(dealt: DataFrame) -> DataFrame:
    """Members of buckets of two or more, with the least member ``hub`` and the number of ``members``.

    A plan counts an exploded table as no larger than its source, so the join is told to broadcast neither side.
    """
    hubs = dealt.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("members")).where("members > 1")
    return dealt.join(hubs.hint("merge"), "key")


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def _stars(buckets: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` to the least member of each group within a bucket; ``buckets`` has the array ``fps``."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.values.to_numpy(zero_copy_only=False).view(U64)
            begin = lists.offsets.to_numpy()[:-1].astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            for m in np.unique(sizes).tolist():
                at, step = begin[sizes == m], max(1, 4_000_000 // (m * m))
                for k in range(0, len(at), step):
                    x = np.sort(flat[at[k : k + step, None] + np.arange(m)], axis=1)
                    near = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= radius
                    least = np.broadcast_to(np.arange(m), x.shape)
                    while True:
                        spread = np.where(near, least[:, None, :], m).min(axis=2)
                        if (spread == least).all():
                            break
                        least = spread
                    moved = least < np.arange(m)
                    tops = np.take_along_axis(x, least, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(tops[moved].view(np.int64)), pa.array(x[moved].view(np.int64))], ["a", "b"])

    return buckets.mapInArrow(solve, "a long, b long").distinct()


def link_fingerprints(classes: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """``fp, root`` of the distinct fingerprints ``classes.fp``: the least fingerprint reachable by links within ``radius``."""
    used: list[DataFrame] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        used.append(materialize(df, label))
        return used[-1]

    shared = keep(_shared(_dealt(classes.select("fp"), radius, 0)), "shared")
    links = keep(shared.where((F.col("fp") != F.col("hub")) & _near(F.col("fp"), F.col("hub"), radius)).select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct(), "links")
    level, todo = 0, shared
    while True:
        found = components(links)
        used.append(found)
        roots = found.withColumnRenamed("id", "fp")
        named = todo.select("key", "fp").join(roots.hint("merge"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
        groups = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"))
        groups = keep(groups.where("lo < hi").select("key", "members"), "groups")
        open_rows = todo.select("key", "fp").join(groups.hint("merge"), "key")
        whole = open_rows.where(F.col("members") <= block).groupBy("key").agg(F.collect_list("fp").alias("fps"))
        links = keep(links.union(_stars(whole.select("fps"), radius)), "links")
        if groups.where(F.col("members") > block).isEmpty():
            break
        level += 1
        split = _dealt(open_rows.where(F.col("members") > block).select("key", "fp"), radius, level)
        todo = keep(_shared(split).select("key", "fp"), "todo")
    found = components(links)
    used.append(found)
    result = keep(classes.select("fp").join(found.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    for table in used[:-1]:
        release(table)
    return result


def near_duplicates(docs: DataFrame, *, width: int = 4, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    marked = materialize(fingerprints(docs, width), "marked")
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    classes = materialize(salted.groupBy("fp", "salt").agg(F.min("doc_id").alias("least")), "classes")
    roots = link_fingerprints(classes.select("fp").distinct(), radius, block)
    placed = classes.join(roots, "fp")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("fp", "salt", "component_id")
    result = materialize(salted.join(named, ["fp", "salt"]).select("doc_id", "fp", "component_id"), "components")
    for table in (marked, classes, roots):
        release(table)
    return result


def group_table(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without those in the group of a lesser id; rows with a null id stay."""
    found = near_duplicates(docs, width=width, radius=radius)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select("_row.*")
