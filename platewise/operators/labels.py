"""Labelling: histograms, nearest prototypes, votes, neighbourhood modes, plate assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.scalars import l2_distance
from platewise.functions.tables import written

#: Prototype tables up to this many rows are held as one array beside each vector.
ARRAY_ROWS = 10_000
#: Vectors and prototypes of larger tables are dealt to this many blocks each.
BLOCKS = 32


def histogram(pixels: DataFrame, keys: list[str], value: str, bins: int, width: float, total: float = 100.0) -> DataFrame:
    """Histogram of ``value`` by ``keys``: counts, share scaled to ``total``, and the share as saturated 8-bit number (half to even)."""
    counted = pixels.groupBy(*keys, F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    share = F.lit(total) * F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counted.withColumn("share", share).withColumn("level", F.least(F.bround("share", 0), F.lit(255.0)).cast("int"))


def equalise(pixels: DataFrame, keys: list[str], value: str, levels: int = 256) -> DataFrame:
    """Lookup table of histogram equalisation: for each value the level its cumulated count gives."""
    return equalised(pixels.groupBy(*keys, F.col(value).cast("int").alias("value")).agg(F.count("*").alias("n")), keys, levels)


def equalised(counted: DataFrame, keys: list[str], levels: int = 256) -> DataFrame:
    """The lookup table of counts ``keys, value, n``."""
    up = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    least = F.min_by("n", "value").over(whole)
    seen, total = F.sum("n").over(up), F.sum("n").over(whole)
    room = total - least
    level = F.when(room == 0, F.col("value").cast("double")).otherwise(F.bround((seen - least).cast("double") * (levels - 1) / F.when(room == 0, 1).otherwise(room), 0))
    return counted.select(*keys, "value", "n", level.cast("int").alias("level"))


def _allowed(prototypes: DataFrame, whitelist: list[int] | None) -> DataFrame:
    allowed = prototypes.where(F.col("label").isin(whitelist)) if whitelist is not None else prototypes
    return allowed.select("label", F.transform("vector", lambda x: x.cast("double")).alias("prototype"))


def _held(allowed: DataFrame) -> Column | None:
    """All prototypes as one array, read by a scalar subquery; None if they are too many."""
    if allowed.limit(ARRAY_ROWS + 1).count() > ARRAY_ROWS:
        return None
    return allowed.agg(F.collect_list(F.struct("label", "prototype")).alias("protos")).scalar()


def _met(vectors: DataFrame, allowed: DataFrame) -> DataFrame:
    """Vectors and prototypes dealt to blocks: every pair of blocks is a key of its own, so no task holds either side."""
    side = lambda df, key, own, other: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(BLOCKS))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    left = side(vectors.select("key", "vector"), "key", "i", "j")
    right = side(allowed, "label", "j", "i")
    return left.join(right, ["i", "j"]).select("key", "label", l2_distance(F.col("vector"), F.col("prototype")).alias("distance"))


def distances(vectors: DataFrame, prototypes: DataFrame, whitelist: list[int] | None = None) -> DataFrame:
    """``key, label, distance`` of every vector to every allowed prototype.

    A few prototypes (checked) are one array that each vector is measured against
    without a join; beyond the bound both tables are dealt to blocks.
    """
    allowed = _allowed(prototypes, whitelist)
    held = _held(allowed)
    if held is None:
        return _met(vectors, allowed)
    found = F.transform("protos", lambda p: F.struct(p["label"].alias("label"), l2_distance(F.col("vector"), p["prototype"]).alias("distance")))
    return vectors.withColumn("protos", held).select("key", F.explode(found).alias("d")).select("key", "d.label", "d.distance")


def nearest(found: DataFrame) -> DataFrame:
    """The nearest label of each key; ties to the smaller label."""
    return found.groupBy("key").agg(F.min(F.struct("distance", "label")).alias("m")).select("key", "m.label", "m.distance")


def nearest_prototype(vectors: DataFrame, prototypes: DataFrame, whitelist: list[int] | None = None) -> DataFrame:
    """The nearest allowed label of each vector (a tie: the smaller), without a shuffle where prototypes are few.

    One row for each row of ``vectors``; without allowed prototypes there is none.
    """
    allowed = _allowed(prototypes, whitelist)
    held = _held(allowed)
    if held is None:
        return nearest(_met(vectors, allowed))
    best = F.array_min(F.transform("protos", lambda p: F.struct(l2_distance(F.col("vector"), p["prototype"]).alias("distance"), p["label"].alias("label"))))
    found = vectors.withColumn("protos", held).select("key", F.explode(F.array(best)).alias("m"))
    return found.where("m is not null").select("key", "m.label", "m.distance")


def by_frequency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Distinct values with counts and rank: most frequent first, ties by value."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    if not keys:
        return _numbered(counted.orderBy(F.desc("n"), value))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value)))


def _numbered(ordered: DataFrame) -> DataFrame:
    """Sorted rows with their ``rank``: the place within a partition, after the rows of the partitions before.

    Only the partitions' sizes come together in one task.
    """
    placed = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumns({"_p": F.shiftright("_at", 33), "_k": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_b"))
    return placed.join(F.broadcast(offsets), "_p").withColumn("rank", (F.col("_b") + F.col("_k") + 1).cast("int")).drop("_p", "_k", "_at", "_b")


def tile(r: Column, c: Column, r0: Column, c0: Column, size: Column) -> tuple[Column, Column]:
    """Row and column of the square tile of a pixel."""
    return F.floor((r - r0) / size).cast("long"), F.floor((c - c0) / size).cast("long")


def mode_filter(grid: DataFrame, radius: int = 1, empty: int = -1) -> DataFrame:
    """Each cell's most frequent neighbour label, itself left out and empty cells ignored; ``empty`` if there is none.

    ``grid``: ``image_id, row, col, label``, one row a cell.  A tie goes to the label that
    first reaches the count in a scan by rows.  Each cell sends its label to its
    neighbours, so the work is linear and keyed by place.
    """
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if (a, b) != (0, 0)))
    votes = grid.where(F.col("label") != empty).withColumn("o", F.explode(offsets)).select(
        "image_id", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "label", (-F.col("o.dr") * (2 * radius + 1) - F.col("o.dc")).alias("scan")
    )
    counted = votes.groupBy("image_id", "row", "col", "label").agg(F.count("*").alias("n"), F.max("scan").alias("reached"))
    best = counted.groupBy("image_id", "row", "col").agg(F.max(F.struct("n", (-F.col("reached")).alias("early"), "label")).alias("b"))
    return grid.select("image_id", "row", "col").join(best, ["image_id", "row", "col"], "left").select("image_id", "row", "col", F.coalesce("b.label", F.lit(empty)).cast("int").alias("label"))


def assign_two_plates(found: DataFrame, families: DataFrame) -> DataFrame:
    """Labels of the two plates of a tray, one of the first family and one of the second.

    ``found``: ``tray, plate (0 or 1), label, distance``; ``families``: ``label, family``.
    A plate's loss is the gap between its best label of either family over its
    largest distance.  The plate with the larger loss (a tie: plate 0) takes its own
    nearer family and the other plate the other family.  Where a plate lacks a family, both keep their own best.
    """
    joined = found.join(F.broadcast(families), "label")
    best = lambda f: F.min(F.when(F.col("family") == f, F.struct("distance", "label")))
    plates = joined.groupBy("tray", "plate").agg(best("first").alias("a"), best("second").alias("b"), F.max("distance").alias("worst"))
    plates = plates.withColumn("loss", F.abs(F.col("a.distance") - F.col("b.distance")) / F.when(F.col("worst") > 0, F.col("worst")))
    w = Window.partitionBy("tray")
    whole = (F.count(F.col("a")).over(w) == 2) & (F.count(F.col("b")).over(w) == 2)
    lead = F.max_by(F.struct("plate", (F.col("a") < F.col("b")).alias("is_first")), F.struct(F.coalesce("loss", F.lit(0.0)), -F.col("plate"))).over(w)
    plates = plates.withColumns({"lead": lead, "whole": whole})
    take_first = F.when(F.col("plate") == F.col("lead.plate"), F.col("lead.is_first")).otherwise(~F.col("lead.is_first"))
    own = F.least("a", "b")
    chosen = F.when(~F.col("whole"), own).when(take_first, F.col("a")).otherwise(F.col("b"))
    return plates.withColumn("c", chosen).select("tray", "plate", F.col("c.label").alias("label"), F.col("c.distance").alias("distance"))


def keep_courses(votes: DataFrame, seconds: int = 1, sides: int = 2) -> DataFrame:
    """Best second course and side dishes of each plate: ``plate, label, family, n``."""
    rank = F.row_number().over(Window.partitionBy("plate", "family").orderBy(F.desc("n"), "label"))
    return votes.withColumn("rank", rank).where(f"family = 'second' and rank <= {seconds} or family = 'side' and rank <= {sides}")
