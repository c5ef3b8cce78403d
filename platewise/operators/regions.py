"""Regions of rasters as plans of joins and aggregates over runs: components, holes, outlines, areas, reassignment.

A mask has one row for each set pixel: ``image_id, r, c`` (and further keys, such as a
label).  A *run* is a stretch of set pixels in a row, ``r, c0, c1``; everything below
works on runs, so the work follows the outlines rather than the areas, and no task
holds a whole image.  A region is named by its first pixel in a scan by rows
(``place``), which also settles ties.

Rows: a repeated pixel counts once; a null place is dropped; an empty mask has no regions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.tables import dropped, written

#: Width of the cells of columns that runs are dealt to before they meet those of the next row.
CELL = 64
IMAGE = ("image_id",)
_ROW = 1 << 32


def place(r: Column | str, c: Column | str) -> Column:
    """A pixel's place as one number, in the order of a scan by rows; places lie within 31 bits."""
    r, c = (F.col(x) if isinstance(x, str) else x for x in (r, c))
    return r.cast("long") * _ROW + c.cast("long")


def place_row(at: Column | str) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.shiftright(at + _ROW // 2, 32)


def place_column(at: Column | str) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return at - place_row(at) * _ROW


def runs(mask: DataFrame, *keys: str) -> DataFrame:
    """``keys, r, c0, c1``: the longest stretches of set pixels in each row."""
    keys = keys or IMAGE
    pixels = mask.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).where("r is not null and c is not null").distinct()
    island = F.col("c") - F.row_number().over(Window.partitionBy(*keys, "r").orderBy("c"))
    return pixels.withColumn("_i", island).groupBy(*keys, "r", "_i").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("_i")


def pixels_of(found: DataFrame) -> DataFrame:
    """One row for each pixel of runs: ``r, c`` and the other columns."""
    return found.withColumn("c", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def touching(above: DataFrame, below: DataFrame, keys: tuple[str, ...], diagonal: bool) -> DataFrame:
    """Runs with those of the next row that touch them, each pair once: ``keys, r, a0, a1, b0, b1``.

    Runs are dealt to the cells of columns they take part in; a pair is taken in the
    cell where its common stretch begins.
    """
    reach = int(diagonal)
    cell = lambda x: F.floor(x / CELL)
    low, high = F.col("c0") - reach, F.col("c1") + reach
    upper = above.select(*keys, (F.col("r") + 1).alias("_r"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.explode(F.sequence(cell(low), cell(high))).alias("_x"))
    lower = below.select(*keys, F.col("r").alias("_r"), F.col("c0").alias("b0"), F.col("c1").alias("b1"), F.explode(F.sequence(cell(F.col("c0")), cell(F.col("c1")))).alias("_x"))
    met = upper.join(lower.hint("merge"), [*keys, "_r", "_x"]).where((F.col("b0") <= F.col("a1") + reach) & (F.col("b1") >= F.col("a0") - reach))
    return met.where(cell(F.greatest(F.col("a0") - reach, F.col("b0"))) == F.col("_x")).select(*keys, (F.col("_r") - 1).alias("r"), "a0", "a1", "b0", "b1")


def _stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """A large star (neighbours above an id move to its least neighbour), then a small one (an id and those below it, too)."""
    both = edges.union(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.where("v > u").join(least.hint("merge"), [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    below = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    small = large.join(below.hint("merge"), [*keys, "u"]).select(*keys, F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
    return small.select(*keys, F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()


def contract(links: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """``keys, id, root`` of every linked id: the least id reachable.

    ``links`` has ``keys, u, v``.  Large and small stars alternate over tables that are
    written between rounds, until every id has one link, to an id without any.
    """
    keys = list(keys)
    edges = written(links.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"))))
    while True:
        counted = edges.select(*keys, ends.alias("e")).groupBy(*keys, "e.id").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
        if counted.where("up > 1 or up = 1 and n > 1").isEmpty():
            return edges.select(*keys, F.col("u").alias("id"), F.col("v").alias("root"))
        after = written(_stars(edges, keys), "edges")
        dropped(edges)
        edges = after


def components(mask: DataFrame, *keys: str, diagonal: bool = True) -> DataFrame:
    """Runs of a mask with the ``component`` they belong to (the place of its first pixel); 8-connected, or 4-connected."""
    keys = keys or IMAGE
    found = written(runs(mask, *keys), "runs")
    links = touching(found, found, keys, diagonal).select(*keys, place(F.col("r") + 1, "b0").alias("u"), place("r", "a0").alias("v"))
    roots = contract(links, keys)
    own = place("r", "c0")
    return found.withColumn("id", own).join(roots.hint("merge"), [*keys, "id"], "left").withColumn("component", F.coalesce("root", "id")).drop("id", "root")


def regions(found: DataFrame, *keys: str) -> DataFrame:
    """``keys, component, pixels, x, y, w, h`` of the regions whose runs are given."""
    keys = keys or IMAGE
    sums = found.groupBy(*keys, "component").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("pixels"), F.min("c0").alias("x"), F.min("r").alias("y"), F.max("c1").alias("_x"), F.max("r").alias("_y"))
    return sums.select(*keys, "component", "pixels", "x", "y", (F.col("_x") - F.col("x") + 1).alias("w"), (F.col("_y") - F.col("y") + 1).alias("h"))


def filled(found: DataFrame, *keys: str) -> DataFrame:
    """Runs of regions with everything that each encloses, whatever else lies there.

    A gap between two runs of a row is enclosed unless gaps that touch it, from row to
    row, lead beyond the ends of a row of the region.
    """
    keys = keys or IMAGE
    own = (*keys, "component")
    ahead = F.lead("c0").over(Window.partitionBy(*own, "r").orderBy("c0"))
    gaps = found.withColumn("_n", ahead).where("_n is not null").select(*own, "r", (F.col("c1") + 1).alias("c0"), (F.col("_n") - 1).alias("c1"))
    gaps = written(gaps, "gaps")
    if gaps.isEmpty():
        return found
    spans = found.groupBy(*own, "r").agg(F.min("c0").alias("lo"), F.max("c1").alias("hi"))
    beside = gaps.withColumn("_d", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("_r", F.col("r") + F.col("_d")).join(spans.withColumnRenamed("r", "_r"), [*own, "_r"], "left")
    out = F.col("lo").isNull() | (F.col("c0") < F.col("lo")) | (F.col("c1") > F.col("hi"))
    known = beside.groupBy(*own, "r", "c0", "c1").agg(F.bool_or(out).alias("out")).withColumn("id", place("r", "c0"))
    links = touching(gaps, gaps, own, False).select(*own, place(F.col("r") + 1, "b0").alias("u"), place("r", "a0").alias("v"))
    rooted = known.join(contract(links, own), [*own, "id"], "left").withColumn("root", F.coalesce("root", "id"))
    open_ = rooted.where("out").select(*own, "root").distinct()
    holes = rooted.join(open_, [*own, "root"], "left_anti").select(*own, "r", "c0", "c1")
    w = Window.partitionBy(*own, "r").orderBy("c0")
    parts = found.select(*own, "r", "c0", "c1").union(holes).withColumn("_s", F.coalesce((F.col("c0") != F.lag("c1").over(w) + 1).cast("int"), F.lit(1)))
    return parts.withColumn("_i", F.sum("_s").over(w)).groupBy(*own, "r", "_i").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_i")


def outline_areas(whole: DataFrame, *keys: str) -> DataFrame:
    """``keys, component, area``: the area of the polygon through the centres of each filled region's outline pixels.

    Of the squares between four neighbouring pixels, those with all four count 1 and
    those with three count a half.  For two runs of neighbouring rows that is their
    common length less one, and a half for every end of one that lies inside the other.
    """
    keys = keys or IMAGE
    own = (*keys, "component")
    a0, a1, b0, b1 = (F.col(k) for k in ("a0", "a1", "b0", "b1"))
    common = F.least(a1, b1) - F.greatest(a0, b0)
    ends = [(a0 < b0) & (b0 <= a1), (a0 <= b1) & (b1 < a1), (b0 < a0) & (a0 <= b1), (b0 <= a1) & (a1 < b1)]
    share = common + sum((e.cast("int") for e in ends), F.lit(0)) * 0.5
    areas = touching(whole, whole, own, False).groupBy(*own).agg(F.sum(share).alias("area"))
    return whole.select(*own).distinct().join(areas, list(own), "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def measured(mask: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The filled regions of a mask as runs, and ``keys, component, pixels, x, y, w, h, area`` of each."""
    keys = keys or IMAGE
    whole = written(filled(components(mask, *keys), *keys), "filled")
    return whole, regions(whole, *keys).join(outline_areas(whole, *keys), [*keys, "component"])


def largest(found: DataFrame, *keys: str, least: float = 0.0) -> DataFrame:
    """The region with the largest ``area`` above ``least`` for each key; ties to the first in a scan."""
    keys = keys or IMAGE
    best = F.max_by(F.struct(*(c for c in found.columns if c not in keys)), F.struct("area", -F.col("component"))).alias("_b")
    return found.where(F.col("area") > least).groupBy(*keys).agg(best).select(*keys, "_b.*")


def largest_filled(mask: DataFrame, *keys: str, least: float = 0.0) -> DataFrame:
    """Pixels of the largest region of a mask (see ``largest``), filled."""
    keys = keys or IMAGE
    whole, found = measured(mask, *keys)
    return pixels_of(whole.join(largest(found, *keys, least=least).select(*keys, "component"), [*keys, "component"], "left_semi")).drop("component")


def outlines(whole: DataFrame, *keys: str) -> DataFrame:
    """Pixels of filled regions that have a neighbour in the row or column outside: ``keys, component, r, c``."""
    own = (*(keys or IMAGE), "component")
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))))
    sent = pixels_of(whole).withColumn("o", F.explode(offsets))
    votes = sent.groupBy(*own, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).agg(F.count("*").alias("n"), F.bool_or((F.col("o.dr") == 0) & (F.col("o.dc") == 0)).alias("held"))
    return votes.where("held and n < 5").select(*own, "r", "c")


def outline_distances(whole: DataFrame, centres: DataFrame, *keys: str) -> DataFrame:
    """``keys, component, distance, r, c``: how far a region's outline is from its image's centre, and the nearest pixel of it (ties to the first).

    ``centres``: ``keys, cy, cx``.
    """
    keys = keys or IMAGE
    near = outlines(whole, *keys).join(centres, list(keys)).withColumn("_d", (F.col("r") - F.col("cy")) * (F.col("r") - F.col("cy")) + (F.col("c") - F.col("cx")) * (F.col("c") - F.col("cx")))
    best = near.groupBy(*keys, "component").agg(F.min(F.struct("_d", "r", "c")).alias("_b"))
    return best.select(*keys, "component", F.sqrt(F.col("_b._d").cast("double")).alias("distance"), "_b.r", "_b.c")


def reassign(mask: DataFrame, piece: float = 500.0, share: float = 0.9, both: DataFrame | None = None) -> DataFrame:
    """Pixels ``image_id, r, c, label`` of two labels with small pieces moved to the other label.

    Of a label's regions the largest stays if its outline area is above ``piece``, and
    the second if it also has over ``share`` of the largest's area; all others go to the other
    label.  An image that has not exactly two labels stays as it is; its labels are those of
    ``both`` (``image_id, label``) where given, else those of its pixels.
    """
    keys = ("image_id", "label")
    pieces = written(components(mask, *keys), "pieces")
    areas = outline_areas(filled(pieces, *keys), *keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("area"), "component")
    rated = areas.withColumns({"_n": F.row_number().over(w), "_top": F.first("area").over(w)})
    stays = (F.col("area") > piece) & ((F.col("_n") == 1) | (F.col("_n") == 2) & (F.col("area") > share * F.col("_top")))
    pair = (pieces if both is None else both).groupBy("image_id").agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.count_distinct("label").alias("_k"))
    fate = rated.select(*keys, "component", stays.alias("_stays")).join(pair, "image_id")
    to = F.when(F.col("_stays") | (F.col("_k") != 2), F.col("label")).otherwise(F.col("_a") + F.col("_b") - F.col("label"))
    moved = pieces.join(fate, [*keys, "component"]).select("image_id", "r", "c0", "c1", to.alias("label"))
    return pixels_of(moved).select("image_id", "r", "c", "label")
