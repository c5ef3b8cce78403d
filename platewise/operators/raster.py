"""Rasters as sparse pixel rows ``image_id, r, c, label``: bounds, merges, regions and quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.scalars import in_disc
from platewise.model import FOOD_HIGH, FOOD_LOW

#: Side of the square cells that equi-join pixels with boxes and circles.
CELL = 64
#: Stretches of columns in which pixels are counted are up to this power of two long.
LEVELS = 8
#: Equal pixels that come out of one array at most.
BLOCK = 4096


def bounding_boxes(mask: DataFrame, low: int = FOOD_LOW, high: int = FOOD_HIGH) -> DataFrame:
    """One box for each image and label in range."""
    found = mask.where(F.col("label").between(low, high)).groupBy("image_id", "label").agg(F.min("c").alias("x"), F.min("r").alias("y"), F.max("c").alias("_c"), F.max("r").alias("_r"))
    return found.select("image_id", F.col("label").alias("class_id"), "x", "y", (F.col("_c") - F.col("x") + 1).alias("w"), (F.col("_r") - F.col("y") + 1).alias("h"))


def found_foods(mask: DataFrame, labels: DataFrame) -> DataFrame:
    seen = mask.where(F.col("label").between(FOOD_LOW, FOOD_HIGH)).select("image_id", "label").distinct()
    return seen.join(F.broadcast(labels.select(F.col("id").alias("label"), "name")), "label")


def quantities(pixels: DataFrame, *keys: str) -> DataFrame:
    """Pixels by label before and after, and the difference; labels absent before are left out.  ``pixels``: label, is_before, is_after."""
    found = pixels.where(F.col("label").between(FOOD_LOW, FOOD_HIGH)).groupBy(*keys, "label").agg(F.count_if("is_before").alias("before"), F.count_if("is_after").alias("after"))
    return found.where("before <> 0").withColumn("leftover", F.col("before") - F.col("after"))


def merge_saturating(layers: DataFrame) -> DataFrame:
    """Labels of overlapping layers add up, to 255 at most."""
    return layers.groupBy("image_id", "r", "c").agg(F.least(F.sum("label"), F.lit(255)).cast("int").alias("label"))


def merge_overwriting(layers: DataFrame) -> DataFrame:
    """The layer with the largest ``seq`` wins; ties go to the larger label."""
    return layers.groupBy("image_id", "r", "c").agg(F.max(F.struct("seq", "label")).alias("m")).select("image_id", "r", "c", F.col("m.label").cast("int").alias("label"))


def colourise(mask: DataFrame, colours: DataFrame) -> DataFrame:
    """Colour of every labelled pixel; an unknown label is black."""
    looked = mask.where("label <> 0").join(F.broadcast(colours), "label", "left")
    return looked.select("image_id", "r", "c", "label", *(F.coalesce(F.col(k), F.lit(0)).alias(k) for k in ("blue", "green", "red")))


def _cells(low: str, high: str) -> Column:
    return F.expr(f"if({high} >= {low}, sequence(cast(floor(({low}) / {CELL}) as bigint), cast(floor(({high}) / {CELL}) as bigint)), cast(array() as array<bigint>))")


def _stretches(low: Column, high: Column) -> Column:
    """The columns from ``low`` to before ``high`` as stretches of powers of two, each starting at a multiple of its length: at most two of a length (``level``) below the longest."""

    def of(k: Column) -> Column:
        first, end = -F.floor(-low / F.pow(F.lit(2), k)), F.floor(high / F.pow(F.lit(2), k))  # whole stretches inside
        ends = F.array(F.when(first % 2 != 0, first), F.when(end % 2 != 0, end - 1))
        found = F.when(k < LEVELS, F.filter(ends, lambda at: at.isNotNull())).otherwise(F.sequence(first, F.greatest(end - 1, first)))
        return F.transform(F.when(first < end, found).otherwise(F.expr("cast(array() as array<bigint>)")), lambda at: F.struct(k.alias("level"), at.alias("at")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of))


def pixels_in_boxes(mask: DataFrame, boxes: DataFrame) -> DataFrame:
    """Number of pixels of a box's own label inside it, for every box (0 included).

    Pixels are counted down the rows of each stretch of columns; a box asks the stretches
    that its columns consist of for the counts above its first row and below its last.
    So boxes and pixels are never paired, and nothing is broadcast.
    Boxes: ``image_id, pos, class_id, x, y, w, h``.
    """
    long = lambda c: F.col(c).cast("long")
    key, item = ("image_id", "class_id", "level", "at"), ("image_id", "pos", "class_id")
    levels = F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.floor(long("c") / F.pow(F.lit(2), k)).alias("at")))).alias("s")
    places = mask.select("image_id", F.col("label").alias("class_id"), "r", "c").dropna().groupBy("image_id", "class_id", "r", "c").agg(F.count("*").alias("n"))
    counts = places.select("image_id", "class_id", long("r").alias("r"), "n", levels).groupBy("image_id", "class_id", "s.level", "s.at", "r").agg(F.sum("n").alias("n"))
    asked = boxes.where("h > 0").select(*item, long("y").alias("y"), (long("y") + F.col("h")).alias("below"), F.explode(_stretches(long("x"), long("x") + F.col("w"))).alias("s"))
    sides = F.explode(F.array(F.struct(F.col("y").alias("r"), F.lit(-1).alias("sign")), F.struct(F.col("below").alias("r"), F.lit(1).alias("sign")))).alias("q")
    asked = asked.select(*item, "s.level", "s.at", sides).select(*key, "q.r", F.lit(None).cast("long").alias("n"), "pos", "q.sign")
    both = asked.unionByName(counts, allowMissingColumns=True)
    above = F.sum("n").over(Window.partitionBy(*key).orderBy("r").rangeBetween(Window.unboundedPreceding, -1))  # rows before this one
    told = both.withColumn("pixels", F.col("sign") * F.coalesce(above, F.lit(0))).where("sign is not null").select(*item, "pixels")
    return told.unionByName(boxes.select(*item, F.lit(0).cast("long").alias("pixels"))).groupBy(*item).agg(F.sum("pixels").alias("pixels"))


def _disc_cells(circles: DataFrame, radius: Column) -> DataFrame:
    """Circles as ``image_id, id, cx, cy, cr`` (truncated), one row for each cell that their square touches."""
    ints = circles.select("image_id", "id", F.col("x").cast("int").alias("cx"), F.col("y").cast("int").alias("cy"), radius.cast("int").alias("cr"))
    return ints.withColumn("ty", F.explode(_cells("cy - cr", "cy + cr"))).withColumn("tx", F.explode(_cells("cx - cr", "cx + cr")))


def drop_circles_holding(circles: DataFrame, others: DataFrame) -> DataFrame:
    """Circles that hold no other circle's centre (strictly nearer than their radius; truncated coordinates).

    Both have ``image_id, id, x, y, radius``; a circle is not compared with itself.
    Circles are dealt to the cells they touch and centres to theirs.
    """
    dealt = _disc_cells(circles, F.col("radius"))
    centres = others.select("image_id", F.col("id").alias("bid"), F.col("x").cast("int").alias("bx"), F.col("y").cast("int").alias("by"))
    centres = centres.withColumns({"ty": F.floor(F.col("by") / CELL), "tx": F.floor(F.col("bx") / CELL)})
    met = dealt.join(centres.hint("merge"), ["image_id", "ty", "tx"]).where("id <> bid and (cx - bx) * (cx - bx) + (cy - by) * (cy - by) < cr * cr")
    return circles.join(met.select("image_id", "id").distinct().hint("merge"), ["image_id", "id"], "left_anti").select(*circles.columns)


def _pixels_met(pixels: DataFrame, circles: DataFrame, scale: float) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Pixels with their cell, circles dealt to cells, and the condition that a circle holds a pixel (its edge included)."""
    placed = pixels.withColumns({"ty": F.floor(F.col("r") / CELL), "tx": F.floor(F.col("c") / CELL)}).alias("a")
    dealt = _disc_cells(circles, F.col("radius") * scale).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("image_id", "ty", "tx")]
    return placed, dealt, [*on, in_disc(F.col("a.r"), F.col("a.c"), F.col("b.cy"), F.col("b.cx"), F.col("b.cr"))]


def pixels_in_disc(pixels: DataFrame, circles: DataFrame, scale: float = 1.0) -> DataFrame:
    """Pixels with the circles of their image that hold them (edge included); ``scale`` enlarges radii.

    Equal pixels are compared as one, and so are circles that cover the same places;
    what met comes out once for every pixel and circle that it stands for.
    """
    once = pixels.groupBy(*pixels.columns).agg(F.count("*").alias("_n"))
    ints = circles.select("image_id", "id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), (F.col("radius") * scale).cast("int").alias("radius"))
    place = F.struct("image_id", "x", "y", "radius")
    discs = ints.select("image_id", "x", "y", "radius").distinct().withColumn("id", place)
    placed, dealt, on = _pixels_met(once, discs, 1.0)
    met = placed.join(dealt.hint("merge"), on).select("a.*", F.col("b.id").alias("_disc"))
    # counts come out in blocks, so that no array grows with them
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK)))
    named = met.join(ints.select(place.alias("_disc"), F.col("id").alias("circle_id")).hint("merge"), "_disc").withColumn("_b", blocks)
    copies = F.explode(F.array_repeat(F.lit(0).cast("byte"), F.least(F.lit(BLOCK), F.col("_n") - F.col("_b") * BLOCK).cast("int")))
    return named.select(*pixels.columns, "circle_id", copies.alias("_c")).drop("_c")


def erase_circles(pixels: DataFrame, circles: DataFrame, scale: float = 1.0) -> DataFrame:
    """Pixels that no circle of their image holds."""
    placed, dealt, on = _pixels_met(pixels, circles, scale)
    return placed.join(dealt, on, "left_anti").select(*pixels.columns)


def large_areas(regions: DataFrame, radius: str = "radius", small: float = 0.005, big: float = 0.07, circle: float = 3.141) -> DataFrame:
    """Regions (``plate, region, area, radius``) above the small share of the plate: the largest if any is big, else the two largest."""
    full = F.lit(circle) * F.col(radius) * F.col(radius)
    kept = regions.where(F.col("area") >= small * full).withColumn("is_big", F.col("area") > big * full)
    w = Window.partitionBy("plate")
    ranked = kept.withColumns({"any_big": F.bool_or("is_big").over(w), "rank": F.row_number().over(w.orderBy(F.desc("area"), "region"))})
    return ranked.where("rank <= if(any_big, 1, 2)").drop("is_big")


def dilate(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Set pixels spread over the offsets of a kernel."""
    o = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets))
    return mask.withColumn("o", F.explode(o)).select("image_id", (F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c")).distinct()


def erode(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Pixels all of whose kernel is set."""
    o = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets))
    votes = mask.select("image_id", "r", "c").distinct().withColumn("o", F.explode(o)).groupBy("image_id", (F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c")).agg(F.count("*").alias("n"))
    return votes.where(F.col("n") == len(offsets)).drop("n")
