"""Neighbourhood filters of dense rasters as windows along rows and columns: blur, box sums, morphology, edges.

A raster has one row for each place of its frame: ``image_id, r, c`` and values.
Every filter is a pass along raster rows and a pass along columns, each a window over
one row or column of one image: a pass shuffles each place once, whatever the width of
the filter, and no task holds a whole image.

Rows: places must be there once each and without gaps (``framed`` sees to that); an
empty raster stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.regions import components, pixels_of

PLACE = ("image_id", "r", "c")
#: A kernel's rows: by their offset from the anchor, the first and the last offset along the row.
Spans = dict[int, tuple[int, int]]


def _line(axis: str):
    """Window over a raster row (axis ``c``) or a column (axis ``r``)."""
    return Window.partitionBy("image_id", "r" if axis == "c" else "c")


def _along(axis: str):
    return _line(axis).orderBy(axis)


def framed(pixels: DataFrame, frames: DataFrame, **defaults) -> DataFrame:
    """A dense raster of sparse pixels: all places of ``frames`` (``image_id, r0, r1, c0, c1``), with a default for each value column."""
    places = frames.select("image_id", F.explode(F.sequence(F.col("r0").cast("long"), F.col("r1").cast("long"))).alias("r"), "c0", "c1")
    places = places.select("image_id", "r", F.explode(F.sequence(F.col("c0").cast("long"), F.col("c1").cast("long"))).alias("c"))
    held = pixels.select("image_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *defaults)
    return places.join(held, list(PLACE), "left").select(*PLACE, *(F.coalesce(k, F.lit(v)).alias(k) for k, v in defaults.items()))


def bounds(pixels: DataFrame, margin: int = 0) -> DataFrame:
    """The frame of each image's pixels, ``margin`` wider on all sides."""
    return pixels.groupBy("image_id").agg((F.min("r") - margin).alias("r0"), (F.max("r") + margin).alias("r1"), (F.min("c") - margin).alias("c0"), (F.max("c") + margin).alias("c1"))


# weighted sums


def gaussian_weights(reach: int = 2, sigma: float = 1.1) -> list[float]:
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return (k / k.sum()).tolist()


def _tap(value: Column, step: int, axis: str) -> Column:
    """The value ``step`` places on along an axis, reflected at the borders without repeating the border itself."""
    order, whole = _along(axis), _line(axis)
    if step == 0:
        return value
    at = F.row_number().over(order) - 1
    left = at if step < 0 else F.count("*").over(whole) - 1 - at
    sign = -1 if step < 0 else 1
    found = F.lead(value, step).over(order) if step > 0 else F.lag(value, -step).over(order)
    for k in range(abs(step)):  # places nearer to the border than the step
        turned = sign * (2 * k - abs(step))
        inner = value if turned == 0 else F.lead(value, turned).over(order) if turned > 0 else F.lag(value, -turned).over(order)
        found = F.when(left == k, F.coalesce(inner, value)).otherwise(found)
    return found


def gaussian(raster: DataFrame, *values: str, weights: list[float] | None = None) -> DataFrame:
    """Values blurred by separable weights and rounded half to even; borders are reflected."""
    weights = weights or gaussian_weights()
    reach = len(weights) // 2
    others = [c for c in raster.columns if c not in values]
    total = lambda v, axis: sum((F.lit(w) * _tap(F.col(v).cast("double"), k - reach, axis) for k, w in enumerate(weights)), F.lit(0.0))
    down = raster.select(*others, *(total(v, "r").alias(v) for v in values))
    across = down.select(*others, *(total(v, "c").alias(v) for v in values))
    return across.select(*others, *(F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0)).cast("long").alias(v) for v in values))


def _reflected(raster: DataFrame, axis: str, reach: int) -> DataFrame:
    """The raster with ``reach`` places more beyond both borders of an axis, marked by ``_own`` = false."""
    low, high = F.min(axis).over(_line(axis)), F.max(axis).over(_line(axis))
    x, lo, hi = F.col(axis), F.col("_lo"), F.col("_hi")
    spread = F.filter(
        F.array(
            F.struct(x.alias("at"), F.lit(True).alias("own")),
            F.struct((2 * lo - x).alias("at"), F.lit(False).alias("own")),
            F.struct((2 * hi - x).alias("at"), F.lit(False).alias("own")),
        ),
        lambda s: s["own"] | (s["at"] < lo) & (s["at"] >= lo - reach) | (s["at"] > hi) & (s["at"] <= hi + reach),
    )
    wide = raster.withColumns({"_lo": low, "_hi": high}).withColumn("_s", F.explode(spread))
    return wide.withColumns({axis: F.col("_s.at"), "_own": F.col("_s.own")}).drop("_s", "_lo", "_hi")


def _running(raster: DataFrame, value: str, axis: str, reach: int, reflect: bool) -> DataFrame:
    """``value`` summed over ``reach`` places to both sides along an axis, as a difference of two cumulated sums."""
    wide = _reflected(raster, axis, reach) if reflect else raster
    order = _along(axis)
    upto = wide.withColumn("_u", F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.sum(value).over(_line(axis))
    found = upto.withColumn(value, F.coalesce(F.lead("_u", reach).over(order), last) - F.coalesce(F.lag("_u", reach + 1).over(order), F.lit(0))).drop("_u")
    return found.where("_own").drop("_own") if reflect else found


def box_sums(raster: DataFrame, value: str, size: int, *, reflect: bool = False) -> DataFrame:
    """``value`` summed over the square of ``size`` places around each place; beyond the borders is nothing, or the reflected raster.

    Sums are differences of cumulated sums, so neither the work nor what is shuffled grows with ``size``.
    """
    return _running(_running(raster, value, "c", size // 2, reflect), value, "r", size // 2, reflect)


def box_filter(raster: DataFrame, value: str, size: int, weight: float | None = None, *, reflect: bool = True) -> DataFrame:
    """Box sums times ``weight`` (default: the mean), at most 255."""
    scaled = F.col(value) * (weight if weight is not None else 1 / size**2)
    return box_sums(raster, value, size, reflect=reflect).withColumn(value, F.least(scaled.cast("double"), F.lit(255.0)))


def box_filter_at(pixels: DataFrame, value: str, size: int, weight: float) -> DataFrame:
    """Box sums times ``weight``, at most 255, at the places of sparse pixels; other places count as nothing."""
    found = box_filter(framed(pixels, bounds(pixels), **{value: 0}), value, size, weight, reflect=False)
    return found.join(pixels.select(*PLACE), list(PLACE), "left_semi")


# morphology


def rectangle(height: int, width: int | None = None) -> Spans:
    width = width or height
    return {dy: (-(width // 2), (width - 1) // 2) for dy in range(-(height // 2), (height + 1) // 2)}


def ellipse(height: int, width: int | None = None) -> Spans:
    """The filled ellipse inscribed in a rectangle; of three places a side, the cross."""
    width = width or height
    cy, cx = height // 2, width // 2
    found = {}
    for dy in range(-cy, height - cy):
        half = round(cx * float(np.sqrt(max(0, cy * cy - dy * dy) / (cy * cy)))) if cy else cx
        found[dy] = (max(-half, -cx), min(half, width - 1 - cx))
    return found


def repeated(kernel: Spans, times: int) -> Spans:
    """The kernel that so many passes of a kernel amount to.

    Right at the borders too, for kernels that hold, with a place, all places
    between it and the axes: then a way from place to place need not leave their rectangle.
    """
    found = {0: (0, 0)}
    for _ in range(times):
        wider: Spans = {}
        for a, (lo, hi) in found.items():
            for b, (low, high) in kernel.items():
                old = wider.get(a + b, (lo + low, hi + high))
                wider[a + b] = (min(old[0], lo + low), max(old[1], hi + high))
        found = wider
    return found


def _nearest(flag: Column) -> tuple[Column, Column]:
    """Columns of the nearest places of a raster row where ``flag`` holds, at or before and at or after each place."""
    at = F.when(flag, F.col("c"))
    before = F.last(at, ignorenulls=True).over(_along("c").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(_along("c").rowsBetween(0, Window.unboundedFollowing))
    return before, after


def _met(raster: DataFrame, flag: str, low: int, high: int, span: Callable[[Column], tuple[Column, Column]], wanted: bool) -> DataFrame:
    """The raster with ``flag`` telling whether a place of the kernel around each place has it ``wanted``.

    The kernel's rows lie between ``low`` and ``high``; ``span`` gives the first and the last
    offset along a row of it, both null where it has none.
    """
    before, after = _nearest(F.col(flag) == wanted)
    near = raster.withColumn("_s", F.struct(F.col("r").alias("r"), before.alias("p"), after.alias("q")))
    held = near.withColumn("_a", F.collect_list("_s").over(_along("r").rowsBetween(low, high)))

    def touches(x: Column) -> Column:
        first, last = span((x["r"] - F.col("r")).cast("int"))
        return F.coalesce(x["p"] >= F.col("c") + first, F.lit(False)) | F.coalesce(x["q"] <= F.col("c") + last, F.lit(False))

    return held.withColumn(flag, F.exists("_a", touches)).drop("_a", "_s")


def _fixed(kernel: Spans) -> tuple[int, int, Callable[[Column], tuple[Column, Column]]]:
    low, high = min(kernel), max(kernel)
    first, last = (F.lit([kernel[k][side] for k in range(low, high + 1)]) for side in (0, 1))
    return low, high, lambda dy: (F.get(first, dy - low), F.get(last, dy - low))


def _by_size(size: Column, most: int) -> tuple[int, int, Callable[[Column], tuple[Column, Column]]]:
    """The ellipse of ``size`` places a side, ``most`` at most, as ``ellipse`` has it."""
    half = F.floor(size / 2).cast("int")

    def span(dy: Column) -> tuple[Column, Column]:
        wide = F.when(half == 0, 0).otherwise(F.rint(half * F.sqrt(F.greatest(half * half - dy * dy, F.lit(0)) / F.greatest(half * half, F.lit(1)))).cast("int"))
        inside = (dy >= -half) & (dy < size - half)
        return F.when(inside, -wide), F.when(inside, F.least(wide, size - 1 - half))

    return -(most // 2), max((most + 1) // 2 - 1, 0), span


def dilate(raster: DataFrame, kernel: Spans, times: int = 1, flag: str = "on") -> DataFrame:
    """``flag`` spread over a kernel, so many times; without a kernel nothing changes."""
    return _met(raster, flag, *_fixed(repeated(kernel, times)), True) if kernel and times else raster


def erode(raster: DataFrame, kernel: Spans, times: int = 1, flag: str = "on") -> DataFrame:
    """``flag`` kept where the whole kernel has it, so many times; places beyond the borders do not count."""
    return _met(raster, flag, *_fixed(repeated(kernel, times)), False).withColumn(flag, ~F.col(flag)) if kernel and times else raster


def closed_by_size(raster: DataFrame, size: str, most: int, flag: str = "on") -> DataFrame:
    """A dilation and an erosion with an ellipse of as many places as the column ``size`` says for the image (0: no change), ``most`` at most."""
    if not most:
        return raster
    kernel = _by_size(F.greatest(F.col(size), F.lit(1)), most)
    return _met(_met(raster, flag, *kernel, True), flag, *kernel, False).withColumn(flag, ~F.col(flag))


def shifted(raster: DataFrame, dy: int, dx: int, flag: str = "on") -> DataFrame:
    """``flag`` taken from the place ``dy`` rows and ``dx`` columns on; off beyond the borders."""
    down = F.lead(flag, dy).over(_along("r")) if dy > 0 else F.lag(flag, -dy).over(_along("r")) if dy < 0 else F.col(flag)
    moved = raster.withColumn(flag, F.coalesce(down, F.lit(False)))
    across = F.lead(flag, dx).over(_along("c")) if dx > 0 else F.lag(flag, -dx).over(_along("c")) if dx < 0 else F.col(flag)
    return moved.withColumn(flag, F.coalesce(across, F.lit(False)))


def cross_distance(raster: DataFrame, flag: str = "on", wanted: bool = True, out: str = "distance") -> DataFrame:
    """``out``: steps along rows and columns from each place to the nearest with ``flag`` = ``wanted``; null without any.

    The distance along the row first, then least sums from above and from below.
    """
    before, after = _nearest(F.col(flag) == wanted)
    along = raster.withColumn("_d", F.least(F.col("c") - before, after - F.col("c")))
    down = F.min(F.col("_d") - F.col("r")).over(_along("r").rowsBetween(Window.unboundedPreceding, 0)) + F.col("r")
    up = F.min(F.col("_d") + F.col("r")).over(_along("r").rowsBetween(0, Window.unboundedFollowing)) - F.col("r")
    return along.withColumn(out, F.least(down, up)).drop("_d")


def dilate_cross(raster: DataFrame, times: int, flag: str = "on") -> DataFrame:
    """So many passes of a cross of three places, as one threshold of a distance."""
    return cross_distance(raster, flag, True, "_x").withColumn(flag, F.coalesce(F.col("_x") <= times, F.lit(False))).drop("_x")


def erode_cross(raster: DataFrame, times: int, flag: str = "on") -> DataFrame:
    return cross_distance(raster, flag, False, "_x").withColumn(flag, F.coalesce(F.col("_x") > times, F.lit(True))).drop("_x")


def close_cross(raster: DataFrame, times: int = 1, flag: str = "on") -> DataFrame:
    return erode_cross(dilate_cross(raster, times, flag), times, flag)


def open_cross(raster: DataFrame, times: int = 1, flag: str = "on") -> DataFrame:
    return dilate_cross(erode_cross(raster, times, flag), times, flag)


def closed(raster: DataFrame, kernel: Spans, times: int = 1, flag: str = "on") -> DataFrame:
    return erode(dilate(raster, kernel, times, flag), kernel, times, flag)


def opened(raster: DataFrame, kernel: Spans, times: int = 1, flag: str = "on") -> DataFrame:
    return dilate(erode(raster, kernel, times, flag), kernel, times, flag)


# edges


def _beside(value: Column, order, otherwise: Column) -> tuple[Column, Column]:
    return F.coalesce(F.lag(value).over(order), otherwise), F.coalesce(F.lead(value).over(order), otherwise)


def gradients(raster: DataFrame, value: str) -> DataFrame:
    """The raster with ``gx, gy``, the derivatives by three by three weights; borders repeat."""
    v = F.col(value).cast("double")
    left, right = _beside(v, _along("c"), v)
    along = raster.withColumns({"_s": left + 2 * v + right, "_d": right - left})
    d, s = F.col("_d"), F.col("_s")
    above, below = _beside(d, _along("r"), d)
    top, bottom = _beside(s, _along("r"), s)
    return along.withColumns({"gx": above + 2 * d + below, "gy": bottom - top}).drop("_s", "_d")


def edges(raster: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """``image_id, r, c, gx, gy`` of edges: places that stand out along their gradient above ``low``, in a component with one above ``high``."""
    turned = gradients(raster, value).withColumn("_z", F.abs("gx") + F.abs("gy"))
    before, after = _beside(F.col("_z"), _along("c"), F.lit(0.0))
    three = turned.withColumn("_t", F.struct(before.alias("l"), F.col("_z").alias("m"), after.alias("n")))
    none = F.struct(*(F.lit(0.0).alias(k) for k in "lmn"))
    top, bottom = _beside(F.col("_t"), _along("r"), none)
    around = three.withColumns({"_a": top, "_b": bottom, "_k": F.pmod(F.rint(F.atan2("gy", "gx") / (np.pi / 4)).cast("int"), F.lit(4))})
    ahead = [F.col("_t.n"), F.col("_b.n"), F.col("_b.m"), F.col("_b.l")]
    behind = [F.col("_t.l"), F.col("_a.l"), F.col("_a.m"), F.col("_a.n")]
    pick = lambda found: F.element_at(F.array(*found), F.col("_k") + 1)
    weak = around.where((F.col("_z") >= pick(ahead)) & (F.col("_z") > pick(behind)) & (F.col("_z") > low)).select(*PLACE, "gx", "gy", (F.col("_z") > high).alias("_strong"))
    named = weak.join(pixels_of(components(weak)).hint("merge"), list(PLACE))  # plans take exploded places for few
    strong = named.where("_strong").select("image_id", "component").distinct()
    return named.join(strong.hint("merge"), ["image_id", "component"], "left_semi").select(*PLACE, "gx", "gy")
