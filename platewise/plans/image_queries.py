"""Queries of the raster operators over the driver tables: filters, edges, regions, circles and foods, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import scalars as fn
from platewise.functions.tables import written
from platewise.operators import circles, filters, foods, regions
from platewise.plans.registry import ORACLE_SQL, query
from platewise.plans.views import BLOBS_SQL, EDGES_SPARK_SQL, EDGES_SQL, PHOTO_SPARK_SQL, PHOTO_SQL, run_sql
from platewise.sources import boxes as box_source

H, W = 24, 32


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, PHOTO_SPARK_SQL)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, BLOBS_SQL)


NOISE = "((b + g + red) * 7 + b) % 11 < 5"


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos' places with a scattered mask ``on``."""
    return photos(spark, sf_dir).select("image_id", "r", "c", F.expr(NOISE).alias("on"))


def root(component: Column, width: int = 100) -> Column:
    """A region's name as the SQL has it: row times ``width`` and column of the first pixel."""
    return regions.place_row(component) * width + regions.place_column(component)


CROSS = "(VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) k(dy, dx)"


def _hsv(source: str, b: str, g: str, r: str, keep: str) -> str:
    """SQL that adds h, s and v of three columns; ``keep`` names the columns kept."""
    top, low = f"greatest({b}, {g}, {r})", f"least({b}, {g}, {r})"
    turn = f"CASE WHEN d = 0 THEN 0 WHEN v = {r} THEN 30.0::DOUBLE * ({g} - {b}) / d WHEN v = {g} THEN 60 + 30.0::DOUBLE * ({b} - {r}) / d ELSE 120 + 30.0::DOUBLE * ({r} - {g}) / d END"
    return f"""(SELECT {keep}, v, CASE WHEN v = 0 THEN 0 ELSE floor(255.0::DOUBLE * d / v + 0.5) END::INT AS s,
      (floor(CASE WHEN t < 0 THEN t + 180 ELSE t END + 0.5)::INT % 180)::INT AS h FROM (SELECT *, {turn} AS t FROM (SELECT *, {top} AS v, {top} - {low} AS d FROM {source})))"""


BLUR = " + ".join(f"CASE WHEN d = {k - 2} THEN {w!r}::DOUBLE ELSE 0 END" for k, w in enumerate(filters.gaussian_weights()))


@query(f"""WITH p AS ({PHOTO_SQL}), w AS (SELECT d, {BLUR} AS w FROM range(-2, 3) t(d)), o AS (SELECT a.d AS dy, b.d AS dx, a.w * b.w AS w FROM w a CROSS JOIN w b),
 m AS (SELECT p.image_id, p.r, p.c, w, CASE WHEN abs(p.r + dy) >= {H} THEN {2 * H - 2} - abs(p.r + dy) ELSE abs(p.r + dy) END AS y, CASE WHEN abs(p.c + dx) >= {W} THEN {2 * W - 2} - abs(p.c + dx) ELSE abs(p.c + dx) END AS x FROM p CROSS JOIN o)
 SELECT m.image_id, m.r::BIGINT AS r, m.c::BIGINT AS c, round_even(sum(m.w * q.b), 0)::BIGINT AS b, round_even(sum(m.w * q.g), 0)::BIGINT AS g, round_even(sum(m.w * q.red), 0)::BIGINT AS red
 FROM m JOIN p q ON m.image_id = q.image_id AND m.y = q.r AND m.x = q.c GROUP BY 1, 2, 3""")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.gaussian(photos(spark, sf_dir), "b", "g", "red")


def _morphology(first: str, second: str) -> str:
    """SQL of two passes of a cross over the scattered mask: ``max`` spreads, ``min`` thins; places outside do not count."""
    step = lambda source, how: f"SELECT a.image_id, a.r, a.c, {how}(b.v) AS v FROM {source} a CROSS JOIN {CROSS} JOIN {source} b ON a.image_id = b.image_id AND b.r = a.r + dy AND b.c = a.c + dx GROUP BY 1, 2, 3"
    return f"""WITH p AS (SELECT image_id, r, c, ({NOISE})::INT AS v FROM ({PHOTO_SQL})), x AS ({step('p', first)}), y AS ({step('x', second)}) SELECT image_id, r::BIGINT AS r, c::BIGINT AS c FROM y WHERE v = 1"""


@query(_morphology("max", "min"))
def close_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.close_cross(scattered(spark, sf_dir)).where("on").select("image_id", "r", "c")


@query(_morphology("min", "max"))
def open_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.open_cross(scattered(spark, sf_dir)).where("on").select("image_id", "r", "c")


def _canny(low: int, high: int) -> str:
    """SQL of the photos' edges: ``reach`` holds the places, ``n`` the gradients."""
    return f"""g AS (SELECT image_id, r, c, floor(b * 0.114::DOUBLE + g * 0.587::DOUBLE + red * 0.299::DOUBLE + 0.5)::INT AS v FROM ({PHOTO_SQL})),
 n AS (SELECT a.image_id, a.r, a.c, sum(b.v * kx) AS gx, sum(b.v * ky) AS gy FROM g a CROSS JOIN (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) k(dy, dx, kx, ky)
   JOIN g b ON a.image_id = b.image_id AND b.r = least(greatest(a.r + dy, 0), {H - 1}) AND b.c = least(greatest(a.c + dx, 0), {W - 1}) GROUP BY 1, 2, 3),
 s AS (SELECT *, abs(gx) + abs(gy) AS size, ((round_even(atan2(gy, gx) / (pi() / 4), 0)::INT % 4) + 4) % 4 AS turn FROM n),
 d AS (SELECT s.*, CASE turn WHEN 2 THEN 0 WHEN 3 THEN -1 ELSE 1 END AS dx, CASE turn WHEN 0 THEN 0 ELSE 1 END AS dy FROM s),
 weak AS (SELECT d.image_id, d.r, d.c, d.size FROM d LEFT JOIN s a ON a.image_id = d.image_id AND a.r = d.r + dy AND a.c = d.c + dx LEFT JOIN s z ON z.image_id = d.image_id AND z.r = d.r - dy AND z.c = d.c - dx
   WHERE d.size >= coalesce(a.size, 0) AND d.size > coalesce(z.size, 0) AND d.size > {low}),
 reach AS (SELECT image_id, r, c FROM weak WHERE size > {high} UNION SELECT w.image_id, w.r, w.c FROM reach x JOIN weak w ON x.image_id = w.image_id AND abs(x.r - w.r) <= 1 AND abs(x.c - w.c) <= 1)"""


@query("WITH RECURSIVE " + _canny(50, 150) + " SELECT image_id, r::BIGINT AS r, c::BIGINT AS c FROM reach")
def canny_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = photos(spark, sf_dir).withColumn("v", fn.grey(F.col("b"), F.col("g"), F.col("red")))
    return filters.edges(grey, "v", 50, 150).select("image_id", "r", "c")


INSIDE = "(r - 12) * (r - 12) + (c - 14) * (c - 14) <= 81"


def inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with the disc ``held``."""
    return photos(spark, sf_dir).withColumn("held", F.expr(INSIDE))


@query(f"""WITH p AS (SELECT *, {INSIDE} AS held FROM ({PHOTO_SQL})), a AS (SELECT * FROM {_hsv('p', 'b', 'g', 'red', 'image_id, r, c, held')}),
 n AS (SELECT image_id, CASE WHEN held THEN v ELSE 0 END AS value, count(*) AS n FROM a GROUP BY 1, 2),
 q AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS seen, sum(n) OVER (PARTITION BY image_id) AS total, first_value(n) OVER (PARTITION BY image_id ORDER BY value) AS low FROM n),
 e AS (SELECT a.image_id, a.h AS h1, a.s AS s1, round_even((q.seen - q.low)::DOUBLE * 255 / (q.total - q.low), 0)::INT AS v1 FROM a JOIN q ON a.image_id = q.image_id AND a.v = q.value WHERE a.held),
 k AS (SELECT image_id, (h // 3)::BIGINT AS bin, count(*) AS n FROM {_hsv('e', 'h1', 's1', 'v1', 'image_id')} GROUP BY 1, 2)
 SELECT image_id, bin, level FROM (SELECT image_id, bin, least(round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY image_id), 0), 255)::BIGINT AS level FROM k) WHERE level > 0""")
def hue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hue histograms under a disc, with equalised values and the second conversion."""
    return foods.hue_histogram(inside(spark, sf_dir)).where("level > 0").select("image_id", F.col("bin").cast("long").alias("bin"), F.col("level").cast("long").alias("level"))


def _regions(mask: str) -> str:
    """SQL of 8-connected regions of a mask (``image_id, r, c``), filled: ``root`` is the first pixel; ``area`` that of the outline's polygon."""
    return f"""WITH RECURSIVE m AS ({mask}),
 reach AS (SELECT image_id, r * 100 + c AS u, r, c FROM m UNION SELECT x.image_id, x.u, y.r, y.c FROM reach x JOIN m y ON x.image_id = y.image_id AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1),
 root AS (SELECT image_id, r, c, min(u) AS root FROM reach GROUP BY 1, 2, 3),
 roots AS (SELECT DISTINCT image_id, root FROM root),
 free AS (SELECT s.image_id, s.root, g.r, g.c FROM roots s CROSS JOIN (SELECT a.r, b.c FROM range(-1, {H + 1}) a(r) CROSS JOIN range(-1, {W + 1}) b(c)) g ANTI JOIN root o ON o.image_id = s.image_id AND o.root = s.root AND o.r = g.r AND o.c = g.c),
 sea AS (SELECT image_id, root, r, c FROM free WHERE r = -1 AND c = -1 UNION SELECT f.image_id, f.root, f.r, f.c FROM sea x JOIN free f ON x.image_id = f.image_id AND x.root = f.root AND abs(x.r - f.r) + abs(x.c - f.c) = 1),
 whole AS (SELECT s.image_id, s.root, g.r, g.c FROM roots s CROSS JOIN (SELECT a.r, b.c FROM range(0, {H}) a(r) CROSS JOIN range(0, {W}) b(c)) g ANTI JOIN sea o ON o.image_id = s.image_id AND o.root = s.root AND o.r = g.r AND o.c = g.c),
 quads AS (SELECT image_id, root, r - dy AS r, c - dx AS c, count(*) AS n FROM whole CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dy, dx) GROUP BY 1, 2, 3, 4),
 areas AS (SELECT image_id, root, sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0 END)::DOUBLE AS area FROM quads GROUP BY 1, 2)"""


@query(_regions(f"SELECT image_id, r, c FROM ({PHOTO_SQL}) WHERE {NOISE}") + " SELECT a.image_id, a.root, a.area, count(*) AS pixels FROM areas a JOIN whole w ON a.image_id = w.image_id AND a.root = w.root GROUP BY 1, 2, 3")
def region_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline area and filled pixels of every region; ``root`` names its first pixel."""
    found = regions.measured(scattered(spark, sf_dir).where("on"))[1]
    return found.select("image_id", root(F.col("component")).alias("root"), "area", "pixels")


@query(_regions(f"SELECT image_id, r::BIGINT AS r, c::BIGINT AS c FROM {_hsv(f'({PHOTO_SQL})', 'b', 'g', 'red', 'image_id, r, c')} WHERE s > 0.35::DOUBLE * 255 AND {INSIDE}")
       + ", best AS (SELECT image_id, root FROM areas WHERE area > 0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, root) = 1) SELECT w.image_id, w.r, w.c FROM whole w JOIN best b ON w.image_id = b.image_id AND w.root = b.root")
def refine_pilaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foods.refine_pilaf(inside(spark, sf_dir))


@query(f"""WITH p AS (SELECT image_id, r, c FROM ({PHOTO_SQL}) WHERE {NOISE} AND r BETWEEN 3 AND 19), o AS (SELECT image_id, min(r) AS y0, min(c) AS x0, least(20, max(r) - min(r) + 1, max(c) - min(c) + 1) AS size FROM p GROUP BY 1)
 SELECT p.image_id, ((p.r - y0) // size)::BIGINT AS row, ((p.c - x0) // size)::BIGINT AS col, count(*) AS pixels FROM p JOIN o ON p.image_id = o.image_id GROUP BY 1, 2, 3""")
def tile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in square tiles of a mask's bounding box; tiles are no larger than the box."""
    return foods.tile_counts(scattered(spark, sf_dir).where("on and r between 3 and 19"), 20)


@query(f"""WITH p AS ({PHOTO_SQL}) SELECT image_id, r::BIGINT AS r, c::BIGINT AS c, CASE WHEN {INSIDE} THEN b ELSE 0 END::BIGINT AS b, CASE WHEN g > 115 THEN 255 ELSE 0 END::BIGINT AS high FROM p WHERE r BETWEEN 4 AND 15 AND c BETWEEN 6 AND 25""")
def masked_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop: one channel under a mask, another by a binary threshold."""
    part = inside(spark, sf_dir).where("r between 4 and 15 and c between 6 and 25")
    return part.select("image_id", "r", "c", F.when(F.col("held"), F.col("b")).otherwise(0).cast("long").alias("b"), F.when(F.col("g") > 115, 255).otherwise(0).cast("long").alias("high"))


def _ball(n: int, keep: str = "true") -> str:
    """SQL of offsets up to ``n`` in both directions."""
    return f"(SELECT a.d AS dy, b.d AS dx FROM range({-n}, {n + 1}) a(d) CROSS JOIN range({-n}, {n + 1}) b(d) WHERE {keep})"


def _cross(times: int) -> str:
    """SQL of the offsets that a cross reaches in so many passes."""
    return _ball(times, f"abs(a.d) + abs(b.d) <= {times}")


def _passes(mask: str, *steps: tuple[str, str]) -> str:
    """SQL of set places after passes ``(max or min, offsets)`` over a dense mask ``image_id, r, c, v``; places outside do not count."""
    parts = [f"s0 AS ({mask})"]
    for i, (how, offsets) in enumerate(steps):
        parts.append(f"s{i + 1} AS (SELECT a.image_id, a.r, a.c, {how}(b.v) AS v FROM s{i} a CROSS JOIN {offsets} k JOIN s{i} b ON a.image_id = b.image_id AND b.r = a.r + k.dy AND b.c = a.c + k.dx GROUP BY 1, 2, 3)")
    return f"WITH {', '.join(parts)} SELECT image_id, r::BIGINT AS r, c::BIGINT AS c FROM s{len(steps)} WHERE v = 1"


#: Picks the region with the largest outline area, filled.
LARGEST = ", best AS (SELECT image_id, root FROM areas WHERE area > 0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, root) = 1) SELECT w.image_id, w.r, w.c FROM whole w JOIN best b ON w.image_id = b.image_id AND w.root = b.root"
#: Offsets of a filled ellipse inscribed in four by four places, from its centre.
ELLIPSE4 = "(SELECT * FROM (VALUES (-2, 0), (-1, -2), (-1, -1), (-1, 0), (-1, 1), (0, -2), (0, -1), (0, 0), (0, 1), (1, -2), (1, -1), (1, 0), (1, 1)) v(dy, dx))"
_PHOTO_HSV = _hsv(f"({PHOTO_SQL})", "b", "g", "red", "image_id, r, c, g")


@query(_regions(_passes(f"SELECT image_id, r, c, ({INSIDE} AND s > 0.6::DOUBLE * 255 AND g >= 85)::INT AS v FROM {_PHOTO_HSV}",
                        ("max", _ball(2)), ("max", _cross(10)), ("min", _cross(10)), ("min", _cross(2)), ("max", _cross(2)))) + LARGEST)
def refine_pesto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foods.refine_pesto(inside(spark, sf_dir))


@query(_regions(_passes(f"SELECT image_id, r, c, ({INSIDE} AND red > 160)::INT AS v FROM ({PHOTO_SQL})", ("max", _cross(5)), ("min", _cross(5)))) + LARGEST)
def refine_tomato(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foods.refine_tomato(inside(spark, sf_dir))


@query(_passes(f"SELECT image_id, r, c, ({INSIDE} AND ({NOISE} OR r IN (3, 21)))::INT AS v FROM ({PHOTO_SQL})", ("max", ELLIPSE4), ("min", ELLIPSE4)))
def refine_pork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scattered mask of 19 rows, closed with an ellipse of a quarter of them."""
    return foods.refine_pork(inside(spark, sf_dir).withColumn("held", F.expr(f"held and ({NOISE} or r in (3, 21))")))


@query(_regions(_passes(f"SELECT image_id, r, c, ({INSIDE} AND (s > 175 OR v > 245))::INT AS v FROM {_hsv('(' + ORACLE_SQL['gaussian_blur'] + ')', 'b', 'g', 'red', 'image_id, r, c')}", ("max", _cross(1)), ("min", _cross(1))))
       + ", large AS (SELECT image_id, root FROM areas WHERE area >= 0.001::DOUBLE * 3.141 * 81) SELECT DISTINCT w.image_id, w.r, w.c FROM whole w JOIN large b ON w.image_id = b.image_id AND w.root = b.root")
def salad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    bowls = photos(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(14).alias("x"), F.lit(12).alias("y"), F.lit(9.0).alias("radius"))
    return foods.salad_mask(photos(spark, sf_dir), bowls)


#: Regions of the event masks: every pixel with the first pixel of its component, as row times 100 and column.
_PIXELS = f"""WITH RECURSIVE m AS (SELECT DISTINCT image_id, r, c FROM ({BLOBS_SQL})),
 reach AS (SELECT image_id, r * 100 + c AS u, r, c FROM m UNION SELECT x.image_id, x.u, y.r, y.c FROM reach x JOIN m y ON x.image_id = y.image_id AND abs(x.r - y.r) <= 1 AND abs(x.c - y.c) <= 1),
 root AS (SELECT image_id, r, c, min(u) AS root FROM reach GROUP BY 1, 2, 3)"""


@query(_PIXELS + " SELECT * FROM root")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of the event masks with its component."""
    return regions.pixels_of(regions.components(blobs(spark, sf_dir))).select("image_id", "r", "c", root(F.col("component")).alias("root"))


@query(_PIXELS + """, n AS (SELECT image_id, root, count(*) AS pixels, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM root GROUP BY 1, 2)
 SELECT image_id, root, root // 100 AS first_r, root % 100 AS first_c, pixels, x, y, w, h FROM n QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY pixels DESC, root) = 1""")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component with most pixels of each event mask, ties to the first in a scan: its first pixel, area and bounds."""
    found = regions.regions(regions.components(blobs(spark, sf_dir))).withColumn("area", F.col("pixels"))
    best = regions.largest(found)
    return best.select("image_id", root(F.col("component")).alias("root"), regions.place_row("component").alias("first_r"), regions.place_column("component").alias("first_c"), "pixels", "x", "y", "w", "h")


_HOLED = _regions(f"SELECT DISTINCT image_id, r, c FROM ({BLOBS_SQL})").replace(f"range(-1, {H + 1}) a(r) CROSS JOIN range(-1, {W + 1}) b(c)", "range(-1, 28) a(r) CROSS JOIN range(-1, 35) b(c)").replace(f"range(0, {H}) a(r) CROSS JOIN range(0, {W}) b(c)", "range(0, 27) a(r) CROSS JOIN range(0, 34) b(c)")


@query(_HOLED + """, edge AS (SELECT w.image_id, w.root, w.r, w.c FROM whole w CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) k(dy, dx) LEFT JOIN whole o ON o.image_id = w.image_id AND o.root = w.root AND o.r = w.r + dy AND o.c = w.c + dx
   GROUP BY 1, 2, 3, 4 HAVING count(o.r) < 4),
 near AS (SELECT image_id, root, min((r - 13) * (r - 13) + (c - 17) * (c - 17)) AS d, arg_min(r * 100 + c, ((r - 13) * (r - 13) + (c - 17) * (c - 17)) * 10000 + r * 100 + c) AS nearest FROM edge GROUP BY 1, 2),
 held AS (SELECT image_id, root, count(*) AS filled FROM whole GROUP BY 1, 2), own AS (SELECT image_id, root, count(*) AS pixels FROM root GROUP BY 1, 2)
 SELECT image_id, root, own.pixels, filled, area, round(sqrt(d::DOUBLE), 9) AS distance, nearest FROM own JOIN held USING (image_id, root) JOIN areas USING (image_id, root) JOIN near USING (image_id, root)""")
def region_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of the event masks: pixels without and with its holes, outline area, and how far its outline is from the image's middle, with the nearest pixel."""
    found = written(regions.components(blobs(spark, sf_dir)), "found")
    whole = written(regions.filled(found), "whole")
    middle = found.select("image_id").distinct().select("image_id", F.lit(13).alias("cy"), F.lit(17).alias("cx"))
    own, held = (regions.regions(d).select("image_id", "component", F.col("pixels").alias(k)) for d, k in ((found, "pixels"), (whole, "filled")))
    keys = ["image_id", "component"]
    joined = own.join(held, keys).join(regions.outline_areas(whole), keys).join(regions.outline_distances(whole, middle), keys)
    return joined.select("image_id", root(F.col("component")).alias("root"), "pixels", "filled", "area", F.round("distance", 9).alias("distance"), (F.col("r") * 100 + F.col("c")).alias("nearest"))


#: Outline area over which the largest piece of a label stays, on the small masks.
SMALL_PIECE = 12
#: One label for each place of the event masks.
_LABELLED = f"SELECT image_id, r, c, min(label) AS label FROM ({BLOBS_SQL}) b0 GROUP BY image_id, r, c"


@query(_regions(f"SELECT 2 * image_id + CASE label WHEN 6 THEN 0 ELSE 1 END AS image_id, r, c FROM ({_LABELLED})").replace(f"range(-1, {H + 1}) a(r) CROSS JOIN range(-1, {W + 1}) b(c)", "range(-1, 28) a(r) CROSS JOIN range(-1, 35) b(c)").replace(f"range(0, {H}) a(r) CROSS JOIN range(0, {W}) b(c)", "range(0, 27) a(r) CROSS JOIN range(0, 34) b(c)")
       + f""", rated AS (SELECT image_id, root, area, first_value(area) OVER w AS top, row_number() OVER w AS n FROM areas WINDOW w AS (PARTITION BY image_id ORDER BY area DESC, root)),
 fate AS (SELECT image_id, root, area > {SMALL_PIECE} AND (n = 1 OR n = 2 AND area > 0.9::DOUBLE * top) AS stays FROM rated),
 sides AS (SELECT image_id // 2 AS image_id, count(DISTINCT image_id) AS k FROM root GROUP BY 1)
 SELECT p.image_id // 2 AS image_id, p.r, p.c, CASE WHEN (p.image_id % 2 = 0) = (f.stays OR b.k < 2) THEN 6 ELSE 10 END::INT AS label FROM root p JOIN fate f ON p.image_id = f.image_id AND p.root = f.root JOIN sides b ON b.image_id = p.image_id // 2""")
def piece_reassignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the event masks' two labels after small pieces went to the other one."""
    return regions.reassign(run_sql(spark, sf_dir, _LABELLED), SMALL_PIECE).select("image_id", "r", "c", F.col("label").cast("int").alias("label"))


_BITS = f"SELECT image_id, r, c, coalesce(v, 0) AS v FROM (SELECT s.image_id, a.r, b.c FROM (SELECT DISTINCT image_id FROM ({BLOBS_SQL})) s CROSS JOIN range(0, 27) a(r) CROSS JOIN range(0, 34) b(c)) LEFT JOIN (SELECT DISTINCT image_id, r, c, 1 AS v FROM ({BLOBS_SQL}) WHERE (r * 7 + c * 3) % 23 = 0) USING (image_id, r, c)"


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rasters of the event masks, thinned, with ``on``."""
    found = blobs(spark, sf_dir)
    frames = found.select("image_id").distinct().select("image_id", F.lit(0).alias("r0"), F.lit(26).alias("r1"), F.lit(0).alias("c0"), F.lit(33).alias("c1"))
    return filters.framed(found.where("(r * 7 + c * 3) % 23 = 0").select("image_id", "r", "c").distinct().withColumn("on", F.lit(True)), frames, on=False)


@query(f"""WITH p AS ({_BITS}) SELECT a.image_id, a.r, a.c, least(sum(b.v * 40) * {1 / 15**2!r}::DOUBLE, 255) AS v FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a.r - b.r) <= 10 AND abs(a.c - b.c) <= 10 GROUP BY 1, 2, 3""")
def wide_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box sums of 21 by 21 places, with nothing beyond the borders, by cumulated sums."""
    values = bits(spark, sf_dir).select("image_id", "r", "c", F.when(F.col("on"), 40).otherwise(0).alias("v"))
    return filters.box_filter(values, "v", 21, 1 / 15**2, reflect=False)


@query(_passes(_BITS, ("max", _cross(6)), ("min", _cross(6)), ("min", _cross(2)), ("max", _cross(2))))
def repeated_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six passes of closing and two of opening with a cross, as thresholds of distances."""
    return filters.open_cross(filters.close_cross(bits(spark, sf_dir), 6), 2).where("on").select("image_id", "r", "c")


def _hough(k: str, low: int, high: int, far: str) -> str:
    """SQL of circles from edges ``e`` (with gradients) in frames ``f``: ``circles{k}``, their centres ``far`` apart at least (SQL over ``f``).

    Votes are counted for every edge at every radius, and every candidate is compared with every better one that stays.
    """
    steps = ", ".join(str(x) for r in range(low, high + 1) for x in (r, -r))
    gap = lambda a, b: f"sqrt((({a}.cy - {b}.cy) * ({a}.cy - {b}.cy) + ({a}.cx - {b}.cx) * ({a}.cx - {b}.cx))::DOUBLE)"
    return f"""votes{k} AS (SELECT image_id, round_even(r + k * (gy / sqrt(gx * gx + gy * gy)), 0)::BIGINT AS cy, round_even(c + k * (gx / sqrt(gx * gx + gy * gy)), 0)::BIGINT AS cx FROM e CROSS JOIN (SELECT unnest([{steps}]) AS k) WHERE gx <> 0 OR gy <> 0),
 tally{k} AS (SELECT image_id, cy, cx, count(*) AS n FROM votes{k} JOIN f USING (image_id) WHERE cy BETWEEN r0 AND r1 AND cx BETWEEN c0 AND c1 GROUP BY 1, 2, 3),
 sums{k} AS (SELECT a.image_id, a.cy, a.cx, sum(b.n) AS n FROM tally{k} a JOIN tally{k} b ON a.image_id = b.image_id AND abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1 GROUP BY 1, 2, 3 HAVING sum(b.n) >= 20),
 peak{k} AS (SELECT * FROM sums{k} a WHERE NOT EXISTS (SELECT 1 FROM sums{k} b WHERE a.image_id = b.image_id AND abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1 AND (b.n > a.n OR b.n = a.n AND (b.cy < a.cy OR b.cy = a.cy AND b.cx < a.cx)))),
 ring{k} AS (SELECT p.image_id, p.cy, p.cx, p.n, round_even(sqrt(((r - cy) * (r - cy) + (c - cx) * (c - cx))::DOUBLE), 0)::INT AS radius, count(*) AS support FROM peak{k} p JOIN e ON e.image_id = p.image_id GROUP BY ALL),
 best{k} AS (SELECT image_id, cy, cx, n, radius, support FROM ring{k} WHERE radius BETWEEN {low} AND {high} QUALIFY row_number() OVER (PARTITION BY image_id, cy, cx ORDER BY support DESC, radius) = 1),
 ranked{k} AS (SELECT b.*, {far} AS far, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, cy, cx) AS k FROM best{k} b JOIN f USING (image_id) WHERE support >= 20),
 greedy{k} AS (SELECT image_id, k, [{{'cy': cy, 'cx': cx, 'k': k}}] AS kept FROM ranked{k} WHERE k = 1
   UNION ALL SELECT g.image_id, r.k, CASE WHEN len(list_filter(g.kept, lambda q: {gap('q', 'r')} < r.far)) > 0 THEN g.kept ELSE list_append(g.kept, {{'cy': r.cy, 'cx': r.cx, 'k': r.k}}) END
   FROM greedy{k} g JOIN ranked{k} r ON r.image_id = g.image_id AND r.k = g.k + 1),
 final{k} AS (SELECT image_id, unnest(arg_max(kept, k)) AS q FROM greedy{k} GROUP BY 1),
 circles{k} AS (SELECT r.image_id, cx AS x, cy AS y, radius, n::BIGINT AS votes, support FROM ranked{k} r JOIN final{k} f ON r.image_id = f.image_id AND r.k = f.q.k)"""


_EDGES = f"WITH RECURSIVE e AS ({EDGES_SQL}), f AS (SELECT image_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM e GROUP BY 1), {_hough('', 10, 13, '9')}"
#: Radii of the small photos' plates, and of the circles that are none.
SMALL_BANDS = ((7, 10), (3, 4), (2, 2))


@query(_EDGES + " SELECT * FROM circles")
def hough_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles of 10 to 13 pixels from the events' edges."""
    found = written(run_sql(spark, sf_dir, EDGES_SPARK_SQL), "edges")
    return circles.hough_circles(found, written(filters.bounds(found), "frames"), 10, 13, F.lit(9))


@query(_EDGES + " SELECT * FROM circles QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, y, x) <= 2")
def two_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two circles of each image, those with most votes."""
    return circles.strongest(hough_circles(spark, sf_dir), 2)


@query("WITH RECURSIVE " + _canny(50, 100) + f""", e AS (SELECT x.image_id, x.r, x.c, n.gx, n.gy FROM reach x JOIN n USING (image_id, r, c)),
 f AS (SELECT image_id, 0 AS r0, {H - 1} AS r1, 0 AS c0, {W - 1} AS c1 FROM (SELECT DISTINCT image_id FROM ({PHOTO_SQL}))), {', '.join(_hough(str(k), *band, '(r1 - r0 + 1) / 2') for k, band in enumerate(SMALL_BANDS))},
 held AS (SELECT * FROM circles0 p WHERE NOT EXISTS (SELECT 1 FROM circles1 o WHERE o.image_id = p.image_id AND (p.x - o.x) ** 2 + (p.y - o.y) ** 2 < p.radius ** 2)),
 crowd AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS k FROM held),
 left_ AS (SELECT * FROM crowd p WHERE k <= 2 OR NOT EXISTS (SELECT 1 FROM circles2 o WHERE o.image_id = p.image_id AND (p.x - o.x) ** 2 + (p.y - o.y) ** 2 < o.radius ** 2))
 SELECT image_id, x, y, radius, votes, support FROM left_ QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, y, x) <= 2""")
def plate_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates of the photos: circles of a band of radii without those that small circles rule out."""
    return foods.find_plates(photos(spark, sf_dir), SMALL_BANDS)


_DISC = "(r - 12) * (r - 12) + (c - 14) * (c - 14) <= 121"
_FULL = "3.141::DOUBLE * 11 * 11"


@query(_passes("SELECT p.image_id, p.r, p.c, (o.r IS NOT NULL)::INT AS v FROM (SELECT image_id, r, c FROM (" + PHOTO_SQL + ")) p LEFT JOIN (" + _regions(f"SELECT image_id, r, c FROM {_hsv('(' + ORACLE_SQL['gaussian_blur'] + ')', 'b', 'g', 'red', 'image_id, r, c')} WHERE {_DISC} AND (s > 80 OR (h > 20 AND h < 25))")
       + f""", edge AS (SELECT w.image_id, w.root, w.r, w.c FROM whole w CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) k(dy, dx) LEFT JOIN whole o ON o.image_id = w.image_id AND o.root = w.root AND o.r = w.r + dy AND o.c = w.c + dx GROUP BY 1, 2, 3, 4 HAVING count(o.r) < 4),
 far AS (SELECT image_id, root, sqrt(min((r - 12) * (r - 12) + (c - 14) * (c - 14))::DOUBLE) AS d FROM edge GROUP BY 1, 2),
 large AS (SELECT *, bool_or(area > 0.07::DOUBLE * {_FULL}) OVER (PARTITION BY image_id) AS big, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, root) AS k FROM areas WHERE area >= 0.005::DOUBLE * {_FULL})
 SELECT DISTINCT w.image_id, w.r, w.c FROM whole w JOIN large USING (image_id, root) JOIN far USING (image_id, root) WHERE k <= CASE WHEN big THEN 1 ELSE 2 END AND d <= 0.75::DOUBLE * 11) o USING (image_id, r, c)""",
               ("max", "(VALUES (-1, 0), (0, -1), (0, 0)) v(dy, dx)"), ("min", "(VALUES (-1, 0), (0, -1), (0, 0)) v(dy, dx)")).replace(") v(dy, dx) k JOIN", ") k(dy, dx) JOIN"))
def plate_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Food on a plate of eleven pixels: colours in the disc, large regions near its middle, closed with an ellipse of two."""
    plates = photos(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(14).alias("x"), F.lit(12).alias("y"), F.lit(11.0).alias("radius"))
    return foods.plate_mask(photos(spark, sf_dir), plates)


_PATHS = "'set/tray' || (p_partkey % 8 + 1)"


@query(f"SELECT p_partkey AS key, {_PATHS} || '/food_image.jpg' AS before_path, {_PATHS} || '/leftover' || (p_partkey % 3 + 1) || '.jpg' AS after_path, (p_partkey % 8 + 1)::INT AS tray, (p_partkey % 3 + 1)::INT AS leftover FROM part")
def explicit_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs given by their two paths, one for each part, with the keys read from the paths."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    given = part.select(F.col("p_partkey").alias("key"), F.expr(f"{_PATHS} || '/food_image.jpg'").alias("before"), F.expr(f"{_PATHS} || '/leftover' || (p_partkey % 3 + 1) || '.jpg'").alias("after"))
    return box_source.explicit_pairs(given, "before", "after")
