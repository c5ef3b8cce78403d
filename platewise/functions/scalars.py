"""Column expressions: keys from paths, box geometry, colour conversion, ordered-array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number_after(path: Column, marker: str) -> Column:
    """Integer that follows the first occurrence of ``marker``, or -1."""
    at = F.locate(marker, path)
    tail = F.substr(path, at + len(marker))
    return F.when(at == 0, -1).otherwise(F.coalesce(F.regexp_extract(tail, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(-1)))


def tray_number(path: Column) -> Column:
    return _number_after(path, "tray")


def leftover_number(path: Column) -> Column:
    return _number_after(path, "/leftover")


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def box_name(path: Column) -> Column:
    return F.concat(F.regexp_extract(path, r"([^/]+)\.[^.]*$", 1), F.lit("_bounding_box"))


def mask_name(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]+)\.[^.]*$", 1)
    return F.when(name.startswith("food_image"), F.lit("food_image_mask")).otherwise(name)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes with keys x, y, w, h; NaN where both are empty, null without ``b``."""
    long = lambda c: c.cast("long")
    ax, ay, aw, ah = (long(a[k]) for k in "xywh")
    bx, by, bw, bh = (long(b[k]) for k in "xywh")
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0))
    union = aw * ah + bw * bh - w * h
    return F.when(bx.isNull(), None).when(union == 0, float("nan")).otherwise((w * h).cast("double") / union)


def index_of(array: Column, value: Column) -> Column:
    """First 0-based place of ``value``, or -1."""
    return (F.array_position(array, value) - 1).cast("int")


def bag_union(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def ordered_semi(a: Column, b: Column) -> Column:
    """Elements of ``a`` that ``b`` holds, with order and repeats of ``a``."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def hsv(b: Column, g: Column, r: Column) -> dict[str, Column]:
    """8-bit hue (0 to 179), saturation and value of 8-bit blue, green and red."""
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = v - low
    s = F.when(v == 0, 0).otherwise(half_up(255.0 * d / F.when(v == 0, 1).otherwise(v)))
    safe = F.when(d == 0, 1).otherwise(d)
    h = F.when(d == 0, 0.0).when(v == r, 30.0 * (g - b) / safe).when(v == g, 60.0 + 30.0 * (b - r) / safe).otherwise(120.0 + 30.0 * (r - g) / safe)
    h = half_up(F.when(h < 0, h + 180.0).otherwise(h))
    return {"h": F.when(h >= 180, h - 180).otherwise(h).cast("int"), "s": s.cast("int"), "v": v.cast("int")}


def grey(b: Column, g: Column, r: Column) -> Column:
    return half_up(0.114 * b + 0.587 * g + 0.299 * r).cast("int")


def chroma_u(b: Column, g: Column, r: Column) -> Column:
    """The U channel of YUV, 8-bit."""
    return F.least(F.greatest(half_up(0.492 * (b - (0.114 * b + 0.587 * g + 0.299 * r)) + 128.0), F.lit(0)), F.lit(255)).cast("int")


def plate_pixel(c: dict[str, Column]) -> Column:
    return (c["s"] > 80) | ((c["h"] > 20) & (c["h"] < 25))


def salad_pixel(c: dict[str, Column]) -> Column:
    return (c["s"] > 175) | (c["v"] > 245)


def pesto_pixel(c: dict[str, Column], g: Column) -> Column:
    return (c["s"] > 0.6 * 255) & (g >= 85)


def pilaf_pixel(c: dict[str, Column]) -> Column:
    return c["s"] > 0.35 * 255


def tomato_pixel(r: Column) -> Column:
    return r > 160


def bread_band(u: Column) -> Column:
    return u.between(70, 117)


def bread_saturation(c: dict[str, Column]) -> Column:
    return (c["s"] > 1) & (c["s"] <= 140)


def in_disc(r: Column, c: Column, cy: Column, cx: Column, radius: Column) -> Column:
    """Whether a pixel lies in a disc, its edge included; a range test comes first."""
    return r.between(cy - radius, cy + radius) & c.between(cx - radius, cx + radius) & ((r - cy) * (r - cy) + (c - cx) * (c - cx) <= radius * radius)
