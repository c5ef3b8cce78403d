"""Foods of photos as plans: plates, bowls, food masks and refinements, composed of filters, regions and circles.

A photo is a dense raster ``image_id, r, c, b, g, red``; a mask is given or returned as
pixels ``image_id, r, c``, or as a boolean column of the raster.  Circles have
``image_id, x, y, radius``, one for each image unless said otherwise; where an image
has several plates, ``by_plate`` gives each its own copy under a key of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import scalars as fn
from platewise.functions.tables import written
from platewise.operators import circles as hough
from platewise.operators import filters, labels, raster, regions

PIXEL = ("image_id", "r", "c")
#: Radii of the circles that are looked for, in pixels: plates, and the small circles that are none.
PLATE_BANDS = ((280, 300), (192, 195), (176, 184))
BOWL_BANDS = ((192, 195), (193, 202))
#: Pi, to the digits with which shares of a plate's area are taken.
PI = 3.141


def coloured(photo: DataFrame) -> DataFrame:
    """The photo with ``h, s, v``."""
    return photo.withColumns(fn.hsv(F.col("b"), F.col("g"), F.col("red")))


def _hsv() -> dict[str, Column]:
    return {k: F.col(k) for k in "hsv"}


def _greyed(photo: DataFrame) -> DataFrame:
    return photo.withColumn("grey", fn.grey(F.col("b"), F.col("g"), F.col("red")))


def by_plate(photo: DataFrame, circles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos and circles with one image for each circle: ``image_id`` becomes ``(image_id, x, y)``."""
    own = F.struct("image_id", "x", "y")
    keyed = circles.withColumn("_k", own)
    return photo.join(keyed.select("image_id", "_k"), "image_id").withColumn("image_id", F.col("_k")).drop("_k"), keyed.withColumn("image_id", F.col("_k")).drop("_k")


# detection


def outlines(photo: DataFrame, edge: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """Edges above ``edge``, with half of it as the weak threshold, and the frames of photos, both written: circles of several bands come from them."""
    return written(filters.edges(_greyed(photo), "grey", edge / 2, edge), "edges"), written(filters.bounds(photo), "frames")


def find_circles(edges: DataFrame, frames: DataFrame, low: int, high: int) -> DataFrame:
    """Circles of a band of radii, at least half the photo's height apart."""
    return hough.hough_circles(edges, frames, low, high, (F.col("r1") - F.col("r0") + 1) / 2)


def drop_plates_near(plates: DataFrame, others: DataFrame) -> DataFrame:
    """Plates whose centre no other circle holds (strictly nearer than that circle's radius; truncated coordinates)."""
    cut = lambda k: F.col(k).cast("int")
    held = plates.select("image_id", cut("x").alias("px"), cut("y").alias("py"), "x", "y").join(others.select("image_id", cut("x").alias("ox"), cut("y").alias("oy"), cut("radius").alias("od")).hint("merge"), "image_id")
    dx, dy = F.col("px") - F.col("ox"), F.col("py") - F.col("oy")
    bad = held.where(dx * dx + dy * dy < F.col("od") * F.col("od")).select("image_id", "x", "y").distinct()
    return plates.join(bad.hint("merge"), ["image_id", "x", "y"], "left_anti").select(*plates.columns)


def find_plates(photo: DataFrame, bands: tuple[tuple[int, int], ...] = PLATE_BANDS) -> DataFrame:
    """Up to two plates of each photo: circles of the first band, most votes first.

    Those go that hold a centre of the second band and, where more than two are left,
    those whose centre a circle of the third band holds.
    """
    found = outlines(photo)
    first, second, third = (written(find_circles(*found, *band), "circles") for band in bands)
    left = written(_drop_holding(first, second), "plates")
    crowded = left.groupBy("image_id").count().where("count > 2").select("image_id")
    thinned = drop_plates_near(left.join(crowded.hint("merge"), "image_id", "left_semi"), third)
    return hough.strongest(left.join(crowded.hint("merge"), "image_id", "left_anti").unionByName(thinned), 2)


def _drop_holding(plates: DataFrame, others: DataFrame) -> DataFrame:
    """Plates that hold no other circle's centre (strictly nearer than the plate's radius; truncated coordinates)."""
    numbered = plates.withColumn("id", regions.place("y", "x"))
    return raster.drop_circles_holding(numbered, others.withColumn("id", F.lit(-1).cast("long"))).drop("id")


def find_bowl(photo: DataFrame, plates: DataFrame, seen: bool = True, bands: tuple[tuple[int, int], ...] = BOWL_BANDS) -> DataFrame:
    """The salad bowl of each photo: its one circle of the first band, else the best of the second.

    Of several in the second band, those go whose centre a plate holds.  Without a bowl to
    look for (``seen`` is false) the first band alone counts.
    """
    first = written(find_circles(*outlines(photo), *bands[0]), "bowls")
    if not seen:
        return hough.strongest(first, 1)
    single = first.groupBy("image_id").count().where("count = 1").select("image_id")
    second = written(find_circles(*outlines(photo, 150.0), *bands[1]).join(single, "image_id", "left_anti"), "bowls")
    several = second.groupBy("image_id").count().where("count > 1").select("image_id")
    crowd = drop_plates_near(second.join(several, "image_id", "left_semi"), plates)
    return hough.strongest(first.join(single, "image_id", "left_semi").unionByName(second.join(several, "image_id", "left_anti")).unionByName(crowd), 1)


# masks


def _on_disc(photo: DataFrame, circles: DataFrame, margin: Column) -> DataFrame:
    """Places of the square around each image's circle, with ``held`` (inside the circle) and the circle's ``cx, cy, cr`` and ``margin``."""
    ints = circles.select("image_id", F.col("x").cast("int").alias("cx"), F.col("y").cast("int").alias("cy"), F.col("radius").cast("int").alias("cr"), F.col("radius").cast("double").alias("radius")).withColumn("margin", margin)
    reach = F.col("cr") + F.col("margin")
    near = photo.join(ints, "image_id").where(F.col("r").between(F.col("cy") - reach, F.col("cy") + reach) & F.col("c").between(F.col("cx") - reach, F.col("cx") + reach))
    return near.withColumn("held", fn.in_disc(F.col("r"), F.col("c"), F.col("cy"), F.col("cx"), F.col("cr")))


def _most(df: DataFrame, column: str) -> int:
    """The largest value of a column, one number."""
    return int(df.agg(F.max(column)).first()[0] or 0)


def _marked(places: DataFrame, mask: DataFrame) -> DataFrame:
    """Places with ``on``: whether the pixel is in the mask."""
    return places.join(mask.select(*PIXEL).distinct().withColumn("_in", F.lit(True)), list(PIXEL), "left").withColumn("on", F.coalesce("_in", F.lit(False))).drop("_in")


def plate_mask(photo: DataFrame, circles: DataFrame) -> DataFrame:
    """Pixels of the food on each image's plate: colour and disc tests, large regions near the centre, filled and closed."""
    size = F.floor(F.col("radius") / 5).cast("int")
    near = written(_on_disc(coloured(filters.gaussian(photo, "b", "g", "red")), circles, size), "plate")
    whole, found = regions.measured(near.where(F.col("held") & fn.plate_pixel(_hsv())))
    sized = found.join(circles.select("image_id", F.col("radius").cast("double").alias("radius")), "image_id")
    large = raster.large_areas(sized.select(F.col("image_id").alias("plate"), F.col("component").alias("region"), "area", "radius"))
    centres = circles.select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("radius").cast("double").alias("radius"))
    far = regions.outline_distances(whole, centres.drop("radius")).join(centres.select("image_id", "radius"), "image_id").where("distance <= 0.75 * radius")
    kept = large.select(F.col("plate").alias("image_id"), F.col("region").alias("component")).join(far.select("image_id", "component"), ["image_id", "component"], "left_semi")
    food = regions.pixels_of(whole.join(kept, ["image_id", "component"], "left_semi"))
    places = _marked(near.select(*PIXEL, "margin"), food)
    return filters.closed_by_size(places, "margin", _most(near, "margin")).where("on").select(*PIXEL)


def salad_mask(photo: DataFrame, circles: DataFrame, share: float = 0.001) -> DataFrame:
    """Pixels of the salad in each image's bowl: bright or saturated, closed, without regions under a share of the bowl, filled."""
    size = F.greatest(F.floor(F.col("radius") / 3).cast("int"), F.lit(1))
    near = written(_on_disc(coloured(filters.gaussian(photo, "b", "g", "red")), circles, size), "bowl")
    flagged = near.select(*PIXEL, "margin", (F.col("held") & fn.salad_pixel(_hsv())).alias("on"))
    whole, found = regions.measured(filters.closed_by_size(flagged, "margin", _most(near, "margin")).where("on"))
    bowl = circles.select("image_id", F.col("radius").cast("double").alias("radius"))
    kept = found.join(bowl, "image_id").where(F.col("area") >= F.lit(share) * PI * F.col("radius") * F.col("radius"))
    return regions.pixels_of(whole.join(kept, ["image_id", "component"], "left_semi")).select(*PIXEL).distinct()


def bread_area(photo: DataFrame, plates: DataFrame, bowls: DataFrame, least: float = 20_000.0) -> DataFrame:
    """Pixels where bread may lie: the largest region of its chroma away from plates and bowl, cut down to what is textured and unsaturated.

    ``plates`` and ``bowls`` may have several circles an image, with an ``id`` each.
    """
    kernel = filters.ellipse(5)
    free = raster.erase_circles(raster.erase_circles(photo.select(*photo.columns), plates), bowls, 1.4)
    pale = free.where(fn.bread_band(fn.chroma_u(F.col("b"), F.col("g"), F.col("red")))).select(*PIXEL)
    band = regions.largest_filled(filters.closed(_marked(photo.select(*PIXEL), pale), filters.rectangle(11)).where("on"))
    dense = filters.box_filter(_marked(_greyed(photo), band).withColumn("v", F.when(F.col("on"), 255).otherwise(0)), "v", 51, 1 / 45**2)
    dark = written(dense.withColumn("grey", F.when(F.col("v") > 111, F.col("grey")).otherwise(0)).select(*PIXEL, "grey"), "dense")
    lines = _marked(dark, filters.edges(dark, "grey", 50, 150))
    busy = filters.box_filter(lines.withColumn("v", F.when(F.col("on"), 255).otherwise(0)), "v", 7)
    busy = written(busy.select(*PIXEL, (F.col("v") > 115).alias("on")), "busy")
    for step, times in ((filters.dilate, 10), (filters.closed, 4), (filters.erode, 6), (filters.dilate, 20)):
        busy = step(busy, kernel, times)
    plain = coloured(photo).select(*PIXEL, fn.bread_saturation(_hsv()).alias("_plain"))
    both = busy.join(plain, list(PIXEL)).select(*PIXEL, (F.col("on") & F.col("_plain")).alias("on"))
    return regions.largest_filled(filters.dilate(filters.erode(both, kernel), kernel, 12).where("on"), least=least)


# refinements: ``photo`` has the boolean column ``held``, the mask to refine


def refine_pesto(photo: DataFrame) -> DataFrame:
    green = coloured(photo).select(*PIXEL, (F.col("held") & fn.pesto_pixel(_hsv(), F.col("g"))).alias("on"))
    return regions.largest_filled(filters.open_cross(filters.close_cross(filters.dilate(green, filters.rectangle(5)), 10), 2).where("on"))


def refine_pilaf(photo: DataFrame) -> DataFrame:
    return regions.largest_filled(coloured(photo).where(F.col("held") & fn.pilaf_pixel(_hsv())).select(*PIXEL))


def refine_tomato(photo: DataFrame) -> DataFrame:
    return regions.largest_filled(filters.close_cross(photo.select(*PIXEL, (F.col("held") & fn.tomato_pixel(F.col("red"))).alias("on")), 5).where("on"))


def refine_pork(photo: DataFrame) -> DataFrame:
    """The mask closed with an ellipse of a quarter of its height; as it is where that is nothing."""
    heights = photo.where("held").groupBy("image_id").agg(F.floor((F.max("r") - F.min("r") + 1) / 4).cast("int").alias("_size"))
    sized = photo.select(*PIXEL, F.col("held").alias("on")).join(heights, "image_id")
    return filters.closed_by_size(sized, "_size", _most(heights, "_size")).where("on").select(*PIXEL)


REFINEMENTS = {1: refine_pesto, 5: refine_pilaf, 6: refine_pork}


def hue_histograms(pixels: DataFrame, places: DataFrame, keys: tuple[str, ...] = ("image_id",), bins: int = 60) -> DataFrame:
    """``keys, bin, n, share, level`` of the hues of masks, given as their pixels ``keys, h, s, v``.

    Values are equalised over the raster of ``places`` (``image_id, places``), where those
    outside the mask count as 0, and the result is converted once more as if it were
    blue, green and red.  The table of levels of a mask (256 at most) is a map beside its pixels.
    """
    keys = list(keys)
    held = pixels.groupBy(*keys, F.col("v").cast("int").alias("value")).agg(F.count("*").alias("n"))
    rest = held.groupBy(*keys).agg(F.sum("n").alias("_n")).join(places, "image_id").select(*keys, F.lit(0).alias("value"), (F.col("places") - F.col("_n")).alias("n"))
    counted = held.unionByName(rest.where("n > 0")).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    table = labels.equalised(counted, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("value", "level"))).alias("_levels"))
    even = pixels.join(table, keys).select(*keys, "h", "s", F.col("_levels")[F.col("v").cast("int")].alias("v"))
    again = even.withColumn("hue", fn.hsv(F.col("h"), F.col("s"), F.col("v"))["h"])
    return labels.histogram(again, keys, "hue", bins, 180 / bins)


def hue_histogram(photo: DataFrame, bins: int = 60) -> DataFrame:
    """The histogram of each photo's hues under the mask ``held``."""
    places = photo.groupBy("image_id").agg(F.count("*").alias("places"))
    return hue_histograms(coloured(photo).where("held").select("image_id", *"hsv"), places, bins=bins)


def hue_vectors(found: DataFrame, keys: tuple[str, ...] = ("image_id",), bins: int = 60) -> DataFrame:
    """``key, vector``: histograms as arrays of levels; ``key`` is the struct of ``keys``."""
    by = F.map_from_entries(F.collect_list(F.struct("bin", F.col("level").cast("double"))))
    rows = found.groupBy(*keys).agg(by.alias("_by"))
    return rows.select(F.struct(*keys).alias("key"), F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("_by")[b], F.lit(0.0))).alias("vector"))


def tiled(mask: DataFrame, size: int) -> DataFrame:
    """Pixels with the ``row`` and ``col`` of their square tile of each mask's bounding box; tiles are no larger than the box."""
    corner = mask.groupBy("image_id").agg(F.min("r").alias("_r0"), F.min("c").alias("_c0"), F.least(F.lit(size), F.max("r") - F.min("r") + 1, F.max("c") - F.min("c") + 1).alias("_size"))
    row, col = labels.tile(F.col("r"), F.col("c"), F.col("_r0"), F.col("_c0"), F.col("_size"))
    return mask.join(corner, "image_id").withColumns({"row": row, "col": col}).drop("_r0", "_c0", "_size")


def tile_counts(mask: DataFrame, size: int) -> DataFrame:
    """``image_id, row, col, pixels`` of the tiles of each mask."""
    return tiled(mask, size).groupBy("image_id", "row", "col").agg(F.count("*").alias("pixels"))


# bread


def split_foreground(photo: DataFrame, area: DataFrame, rounds: int = 3, shades: int = 8) -> DataFrame:
    """Foreground pixels within the bounding box of each image's ``area``, by colour and neighbourhood.

    Colours are dealt to ``shades`` shades a channel.  In each round the shades inside and
    outside are counted, a place of the box goes where its shade is more frequent, and a vote of the
    five by five places around it decides.  An approximation of iterated graph cuts, whose
    cut the vote replaces.
    """
    box = area.groupBy("image_id").agg(F.min("r").alias("_r0"), F.max("r").alias("_r1"), F.min("c").alias("_c0"), F.max("c").alias("_c1"))
    shade = sum((F.floor(F.col(k) * shades / 256) * shades**i for i, k in enumerate(("b", "g", "red"))), F.lit(0)).cast("int")
    inside = F.col("r").between(F.col("_r0"), F.col("_r1")) & F.col("c").between(F.col("_c0"), F.col("_c1"))
    rows = written(photo.join(box, "image_id").select(*PIXEL, shade.alias("shade"), inside.alias("box"), inside.alias("on")), "fore")
    for _ in range(rounds):
        counts = rows.groupBy("image_id", "shade").agg(F.count_if("on").alias("f"), F.count_if(~F.col("on")).alias("g"))
        totals = counts.groupBy("image_id").agg(F.sum("f").alias("_f"), F.sum("g").alias("_g"))
        likely = counts.join(totals, "image_id").select("image_id", "shade", ((F.col("f") + 1) * (F.col("_g") + shades**3) > (F.col("g") + 1) * (F.col("_f") + shades**3)).alias("_likely"))
        scored = rows.join(likely, ["image_id", "shade"]).withColumn("v", F.when(F.col("box") & F.col("_likely"), 255).otherwise(0))
        voted = filters.box_filter(scored, "v", 5, reflect=False)
        rows = written(voted.select(*PIXEL, "shade", "box", (F.col("box") & (F.col("v") > 127)).alias("on")), "fore")
    return rows.where("on").select(*PIXEL)


def bread_mask(photo: DataFrame, area: DataFrame) -> DataFrame:
    """Pixels of the bread: the largest foreground region of the area, which is first thinned from its upper left."""
    thinned = filters.shifted(filters.erode(_marked(photo.select(*PIXEL), area), filters.ellipse(5), 3), 3, 3)
    return regions.largest_filled(split_foreground(photo, thinned.where("on")))
