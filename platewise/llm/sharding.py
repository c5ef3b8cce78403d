"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 5).

Each shard owns ``VIRTUAL`` points of a 62-bit ring; a row's key hashes to a place
on it and belongs to the next point clockwise.  Loads are bounded: a shard takes
at most the floor or the ceiling of the mean, and rows that find it full go on
clockwise to the next shard with room.  Counts are therefore at most one apart
(the ``rows`` law), while most rows stay with the owner of their arc.

Only counts by arc and sub-bucket (at most ``shards * VIRTUAL * SPLITS`` numbers,
whatever the input) reach the driver, where the overflow is settled; it yields,
for each arc, intervals of ranks with their shard and first slot.  A row's rank
within its arc is its rank within its sub-bucket plus a sum of counts.
Sub-buckets come from a hash of id and text, so a hot id is split by its texts.
Rows that are equal in full are interchangeable: they are counted first (partly
before the shuffle), ranked as one row with a count, and dealt out afterwards in
blocks of ``BLOCK`` that go to tasks of their own.

Rows: null ids hash as null and null texts count as empty (size 16); of a very long
text only its size and CRC go on; repeated rows take
places of their own; ties are ordered by hash, size and CRC; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import materialize

SHARDS, VIRTUAL, SPLITS = 40, 32, 16
#: Equal rows that one task deals out at a time.
BLOCK = 65_536
#: Bytes counted for a row besides its text.
ROW_BYTES = 16
RING = 1 << 62


def ring_points(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """``(place, shard)`` of every virtual node, clockwise."""
    import xxhash

    return sorted((xxhash.xxh3_64_intdigest(f"{s}/{v}".encode()) >> 2, s) for s in range(shards) for v in range(virtual))


def settle(counts: list[int], owners: list[int], shards: int) -> list[list[tuple[int, int, int, int]]]:
    """For each arc, intervals ``(first rank, last rank + 1, shard, first slot)``.

    ``counts`` are rows by arc, ``owners`` the shard at the end of each arc.  Owners
    take what they have room for first, then what overflows goes clockwise.
    """
    total, arcs = sum(counts), len(counts)
    low, extra = divmod(total, shards)
    wish = [0] * shards
    for n, s in zip(counts, owners):
        wish[s] += n
    # the shards with most rows of their own may hold one more than the others
    fuller = set(sorted(range(shards), key=lambda s: (-wish[s], s))[:extra])
    room = [low + (s in fuller) for s in range(shards)]
    filled = [0] * shards
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]

    def put(arc: int, rank: int, n: int, s: int) -> int:
        n = min(n, room[s] - filled[s])
        if n:
            out[arc].append((rank, rank + n, s, filled[s]))
            filled[s] += n
        return n

    left = [put(k, 0, n, s) for k, (n, s) in enumerate(zip(counts, owners))]
    after = [k for k in range(arcs)]
    for k, n in enumerate(counts):
        rank = left[k]
        step = 1
        while rank < n and step < arcs:
            rank += put(k, rank, n - rank, owners[(after[k] + step) % arcs])
            step += 1
        assert rank == n
    return out


def deal_out(ranked: DataFrame, block: int) -> DataFrame:
    """One row for each of the ``n`` equal rows of a group, whose first has rank ``before``, with its ``rank``.

    Groups of more than a block are dealt to tasks by blocks, the others where they are.
    """
    few, many = ranked.where(F.col("n") <= block), ranked.where(F.col("n") > block)
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))
    blocks = many.withColumn("start", F.explode(starts)).repartition("doc_id", "text_crc32", "size", "start")
    parts = few.withColumn("start", F.lit(0).cast("long")).unionByName(blocks)
    last = F.least(F.col("n"), F.col("start") + block) - 1
    return parts.withColumn("step", F.explode(F.sequence("start", last))).withColumn("rank", F.col("before") + F.col("step")).drop("n", "before", "start", "step")


def assign(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, splits: int = SPLITS, block: int = BLOCK) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row."""
    spark = docs.sparkSession
    points = ring_points(shards, virtual)
    places, owners = [p for p, _ in points], [s for _, s in points]
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumns({
        "place": F.shiftrightunsigned(F.xxhash64("doc_id"), 2),
        "tie": F.xxhash64("doc_id", "text_crc32", "size"),
    })
    # arcs of equal width would need no search; with points at hashes, a two-level search by the top bits does
    cells = 4096
    width = RING // cells
    first = [bisect_left(places, c * width) for c in range(cells)]
    inside = [[p for p in places[first[c] : bisect_left(places, (c + 1) * width)]] for c in range(cells)]
    table = F.from_json(F.lit(str([[f, *i] for f, i in zip(first, inside)])), "array<array<bigint>>")
    cell = F.get(table, F.expr(f"cast(place div {width} as int)"))
    arc = (F.get(cell, F.lit(0)) + F.size(F.filter(F.slice(cell, F.lit(2), F.greatest(F.size(cell) - 1, F.lit(0))), lambda p: p < F.col("place")))) % len(places)
    keyed = keyed.withColumns({"arc": arc.cast("int"), "sub": F.pmod("tie", F.lit(splits)).cast("int")})
    # texts are read once; counts and ranks come from the same narrow table
    groups = materialize(keyed.groupBy("arc", "sub", "tie", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "sizes")
    counted = {(r.arc, r.sub): r.n for r in groups.groupBy("arc", "sub").agg(F.sum("n").alias("n")).collect()}
    counts = [sum(counted.get((k, b), 0) for b in range(splits)) for k in range(len(places))]
    intervals = settle(counts, owners, shards)
    # for each (arc, sub-bucket): intervals of ranks within it
    rows = []
    for k, spans in enumerate(intervals):
        at = 0
        for b in range(splits):
            n = counted.get((k, b), 0)
            for lo, hi, s, slot in spans:
                x, y = max(lo, at), min(hi, at + n)
                if x < y:
                    rows.append((k, b, x - at, y - at, s, slot + x - lo))
            at += n
    plan = spark.createDataFrame(rows, "arc int, sub int, lo long, hi long, shard int, first long")
    plan = plan.groupBy("arc", "sub").agg(F.collect_list(F.struct("lo", "hi", "shard", "first")).alias("spans"))
    order = Window.partitionBy("arc", "sub").orderBy("tie", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = deal_out(groups.withColumn("before", F.sum("n").over(order) - F.col("n")), block)
    # at most one row per arc and sub-bucket, and one more per interval: bounded by the ring
    found = ranked.join(F.broadcast(plan), ["arc", "sub"])
    mine = F.filter("spans", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"]))[0]
    found = found.withColumn("mine", mine)
    return found.select("doc_id", "size", "text_crc32", F.col("mine.shard").alias("shard"), (F.col("mine.first") + F.col("rank") - F.col("mine.lo")).cast("long").alias("slot"))


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
