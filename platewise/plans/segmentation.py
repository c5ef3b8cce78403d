"""Segmentation of tray photos as one plan: plates, their foods, salad bowl and bread into a label mask.

Photos are dense rasters ``image_id, r, c, b, g, red``.  The after-photo of a pair is
limited to the labels that its before-photo yielded.  Approximate where the
operators say so (the foreground split of bread; circles).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.tables import written
from platewise.model import LABELS
from platewise.operators import foods, labels, raster, regions

FIRST, SECOND, SIDE = (tuple(i for i, _, f in LABELS if f == k) for k in ("first", "second", "side"))
SALAD, BREAD = 12, 13
PIXEL = list(foods.PIXEL)


@dataclass(frozen=True)
class Sizes:
    """Sizes in pixels that photos of the usual resolution are segmented by."""

    plates: tuple[tuple[int, int], ...] = foods.PLATE_BANDS
    bowls: tuple[tuple[int, int], ...] = foods.BOWL_BANDS
    coarse: int = 150
    fine: int = 50
    piece: float = 500.0
    bread: float = 20_000.0


def _families(spark) -> DataFrame:
    return spark.createDataFrame([(i, f) for i, _, f in LABELS if f in ("first", "second", "side")], "label int, family string")


def _allowed(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Rows (``image_id`` a plate's key, ``label``) whose label the image may have; images without any labels given may have all."""
    if allowed is None:
        return rows
    known = allowed.select("image_id").distinct().withColumn("_known", F.lit(True))
    listed = allowed.select("image_id", "label").distinct().withColumn("_listed", F.lit(True))
    keyed = rows.withColumn("_image", F.col("image_id.image_id"))
    met = keyed.join(known.withColumnRenamed("image_id", "_image"), "_image", "left").join(listed.withColumnRenamed("image_id", "_image"), ["_image", "label"], "left")
    return met.where("_known is null or _listed").select(*rows.columns)


def _distances(found: DataFrame, prototypes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys, label, distance`` from histograms to prototypes."""
    far = labels.distances(foods.hue_vectors(found, keys), prototypes)
    return far.select("key.*", F.col("label").cast("int").alias("label"), "distance")


def _nearest(found: DataFrame, *keys: str) -> DataFrame:
    return found.groupBy(*keys).agg(F.min(F.struct("distance", "label")).alias("_m")).select(*keys, "_m.label", "_m.distance")


def plate_courses(far: DataFrame, plates: DataFrame, families: DataFrame) -> DataFrame:
    """``image_id, is_first``: whether a plate holds a first course.

    ``far``: ``image_id, label, distance``; ``plates``: ``image_id`` (a plate's key) and ``plate``,
    its number.  A photo's two plates are decided together, a single one by its nearest label.
    """
    numbered = far.join(plates, "image_id").withColumn("tray", F.col("image_id.image_id"))
    counted = numbered.withColumn("_k", F.size(F.collect_set("plate").over(Window.partitionBy("tray"))))
    pairs = labels.assign_two_plates(counted.where("_k = 2").select("tray", "plate", "label", "distance"), families)
    of_pair = plates.withColumn("tray", F.col("image_id.image_id")).join(pairs, ["tray", "plate"]).select("image_id", "label")
    single = _nearest(counted.where("_k = 1"), "image_id").select("image_id", "label")
    return of_pair.unionByName(single).select("image_id", F.col("label").isin(*FIRST).alias("is_first"))


def mixed_plates(pixels: DataFrame, places: DataFrame, prototypes: DataFrame, allowed: DataFrame | None, families: DataFrame, sizes: Sizes) -> DataFrame:
    """``image_id, r, c, label, rank`` of plates with a second course and side dishes.

    Votes of coarse tiles choose the labels; fine tiles, smoothed by their neighbours, deal
    them out; then small pieces move.  ``pixels``: ``image_id, r, c, h, s, v`` of the food.
    """
    keys = ("image_id", "row", "col")
    own = families.where("family <> 'first'")
    coarse = _distances(foods.hue_histograms(foods.tiled(pixels, sizes.coarse), places, keys), prototypes, keys)
    votes = _nearest(_allowed(coarse.join(F.broadcast(own.select("label")), "label"), allowed), *keys).groupBy("image_id", "label").agg(F.count("*").alias("n"))
    chosen = labels.keep_courses(votes.join(F.broadcast(own), "label").withColumnRenamed("image_id", "plate"))
    order = F.row_number().over(Window.partitionBy("plate").orderBy(F.when(F.col("family") == "second", 0).otherwise(1), "rank"))
    chosen = written(chosen.select(F.col("plate").alias("image_id"), "label", order.alias("rank")), "chosen")
    fine = written(foods.tiled(pixels, sizes.fine), "fine")
    near = _distances(foods.hue_histograms(fine, places, keys), prototypes, keys).join(chosen.select("image_id", "label"), ["image_id", "label"])
    grid = labels.mode_filter(_nearest(near, *keys))
    parts = fine.select(*PIXEL, "row", "col").join(grid.where("label >= 0"), list(keys)).select(*PIXEL, "label")
    return regions.reassign(parts, sizes.piece, both=chosen.select("image_id", "label")).join(chosen, ["image_id", "label"]).select(*PIXEL, "label", "rank")


def plate_foods(photo: DataFrame, prototypes: DataFrame, allowed: DataFrame | None = None, sizes: Sizes = Sizes(), plates: DataFrame | None = None) -> DataFrame:
    """``image_id, r, c, label`` of the foods on each photo's plates; a later plate overwrites an earlier one, and a later label an earlier one."""
    circles = written(plates if plates is not None else foods.find_plates(photo, sizes.plates), "circles")
    ranked = circles.withColumn("plate", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("votes"), "y", "x")) - 1)
    keyed, own = foods.by_plate(photo, ranked)
    food = written(foods.plate_mask(keyed, own), "food")
    colours = written(foods.coloured(keyed).join(food, PIXEL, "left_semi"), "colours")
    places = photo.groupBy("image_id").agg(F.count("*").alias("places")).join(circles.select("image_id", "x", "y"), "image_id").select(F.struct("image_id", "x", "y").alias("image_id"), "places")
    families = _families(photo.sparkSession)
    far = _allowed(_distances(foods.hue_histograms(colours, places), prototypes, ("image_id",)).join(F.broadcast(families.select("label")), "label"), allowed)
    far = written(far.select("image_id", "label", "distance"), "distances")
    courses = written(plate_courses(far, own.select("image_id", "plate"), families), "courses")
    first = _nearest(far.where(F.col("label").isin(*FIRST)), "image_id").join(courses.where("is_first"), "image_id").select("image_id", "label", F.lit(1).alias("rank"))
    mixed = colours.join(courses.where("not is_first"), "image_id", "left_semi")
    parts = food.join(first, "image_id").select(*PIXEL, "label", "rank").unionByName(mixed_plates(mixed, places, prototypes, allowed, families, sizes))
    parts = written(parts, "parts")
    refined = parts.where(~F.col("label").isin(*foods.REFINEMENTS))
    for label, refine in foods.REFINEMENTS.items():
        some = parts.where(F.col("label") == label)
        ranks = some.select("image_id", "rank").distinct()
        raster_ = keyed.join(ranks, "image_id", "left_semi").join(some.select(*PIXEL).withColumn("_in", F.lit(True)), PIXEL, "left").withColumn("held", F.coalesce("_in", F.lit(False))).drop("_in")
        refined = refined.unionByName(refine(raster_).join(ranks, "image_id").select(*PIXEL, F.lit(label).alias("label"), "rank"))
    layers = refined.join(own.select("image_id", "plate"), "image_id").select(F.col("image_id.image_id").alias("image_id"), "r", "c", "label", (F.col("plate") * 100 + F.col("rank")).alias("seq"))
    return raster.merge_overwriting(layers)


def _barred(label: int, allowed: DataFrame) -> DataFrame:
    """Images whose labels are given without this one."""
    return allowed.groupBy("image_id").agg(F.bool_or(F.col("label") == label).alias("_has")).where("not _has").select("image_id")


def segment(photo: DataFrame, prototypes: DataFrame, allowed: DataFrame | None = None, sizes: Sizes = Sizes()) -> DataFrame:
    """``image_id, r, c, label`` of every photo: foods of the plates, salad and bread, whose labels add up where they overlap.

    ``allowed`` (``image_id, label``) limits the labels of the photos it lists.
    """
    plates = written(foods.find_plates(photo, sizes.plates), "plates")
    courses = plate_foods(photo, prototypes, allowed, sizes, plates)
    if allowed is None:
        bowls, free = foods.find_bowl(photo, plates, True, sizes.bowls), photo
    else:  # where no salad was, only a circle of the first band counts
        barred = written(_barred(SALAD, allowed), "barred")
        sought = foods.find_bowl(photo.join(barred, "image_id", "left_anti"), plates, True, sizes.bowls)
        bowls = sought.unionByName(foods.find_bowl(photo.join(barred, "image_id", "left_semi"), plates, False, sizes.bowls))
        free = photo.join(_barred(BREAD, allowed), "image_id", "left_anti")
    bowls = written(bowls, "bowls")
    salad = foods.salad_mask(photo, bowls).withColumn("label", F.lit(SALAD))
    numbered = lambda d: d.withColumn("id", regions.place("y", "x"))
    bread = foods.bread_mask(free, foods.bread_area(free, numbered(plates), numbered(bowls), sizes.bread)).withColumn("label", F.lit(BREAD))
    layers = courses.select(*PIXEL, "label").unionByName(salad.select(*PIXEL, "label")).unionByName(bread.select(*PIXEL, "label"))
    return raster.merge_saturating(layers)


def segment_pairs(before: DataFrame, after: DataFrame, prototypes: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """``image_id, side, r, c, label`` of photo pairs that share their ``image_id``; after-photos have only the labels of their before-photo."""
    first = written(segment(before, prototypes, None, sizes), "before")
    seen = first.select("image_id", "label").distinct()
    second = segment(after, prototypes, seen, sizes)
    return first.select("image_id", F.lit("before").alias("side"), "r", "c", "label").unionByName(second.select("image_id", F.lit("after").alias("side"), "r", "c", "label"))
