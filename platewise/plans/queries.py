"""The registered queries of the engine, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.functions import scalars as fn
from platewise.model import COLOURS, LABELS, colours_dim, labels_dim
from platewise.functions.tables import shared_folder, written
from platewise.operators import evaluation as evaluation_state
from platewise.operators import filters, labels, metrics, raster
from platewise.plans import image_queries  # noqa: F401 (registers its queries)
from platewise.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from platewise.plans.views import CIRCLES_SQL, COLOUR_SQL, GRID_SQL, GT_SQL, MASK_SQL, PRED_SQL, run_sql
from platewise.sources import boxes as box_source
from platewise.sources import line_files, sinks

SCENE = f"WITH gt AS ({GT_SQL}), pred AS ({PRED_SQL}), "
MATCH = (
    SCENE
    + """first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY pos) AS k FROM pred) WHERE k = 1),
 corners AS (SELECT g.image_id, g.pos, g.class_id, p.pos AS pred_pos, g.w::BIGINT * g.h AS ga, p.w::BIGINT * p.h AS pa,
   greatest(least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x), 0)::BIGINT * greatest(least(g.y + g.h, p.y + p.h) - greatest(g.y, p.y), 0) AS i
   FROM gt g LEFT JOIN first p ON g.image_id = p.image_id AND g.class_id = p.class_id),
 matched AS (SELECT image_id, pos, class_id, pred_pos, CASE WHEN pred_pos IS NULL THEN NULL ELSE i::DOUBLE / (ga + pa - i) END AS iou FROM corners)"""
)
PREDS = (
    MATCH
    + """, taken AS (SELECT image_id, pred_pos, arg_max(iou, pos) AS confidence FROM matched WHERE pred_pos IS NOT NULL GROUP BY 1, 2),
 preds AS (SELECT p.image_id, p.pos, p.class_id, coalesce(t.confidence, 0.0)::DOUBLE AS confidence, coalesce(t.confidence, 0.0) > 0.5 AS is_tp
   FROM pred p LEFT JOIN taken t ON p.image_id = t.image_id AND p.pos = t.pred_pos)"""
)
SCOPES = {"image": "image_id", "tray": "image_id % 8", "all": "0"}
SCOPED = (
    PREDS
    + """, sp AS (SELECT 'image' AS scope, image_id AS scope_id, * FROM preds UNION ALL SELECT 'tray', image_id % 8, * FROM preds UNION ALL SELECT 'all', 0, * FROM preds),
 sg AS (SELECT 'image' AS scope, image_id AS scope_id, class_id FROM gt UNION ALL SELECT 'tray', image_id % 8, class_id FROM gt UNION ALL SELECT 'all', 0, class_id FROM gt),
 counts AS (SELECT scope, scope_id, class_id, count(*) AS n_gt FROM sg GROUP BY 1, 2, 3),
 ranked AS (SELECT p.scope, p.scope_id, p.class_id, coalesce(c.n_gt, -1) AS n_gt,
   sum(is_tp::INT) OVER w AS tp, count(*) OVER w AS n
   FROM sp p LEFT JOIN counts c ON p.scope = c.scope AND p.scope_id = c.scope_id AND p.class_id = c.class_id
   WINDOW w AS (PARTITION BY p.scope, p.scope_id, p.class_id ORDER BY confidence DESC, image_id, pos ROWS UNBOUNDED PRECEDING)),
 points AS (SELECT unnest([0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]::DOUBLE[]) AS v, unnest(range(11)) AS k),
 keyed AS (SELECT *, row_number() OVER () AS id FROM ranked),
 snapped AS (SELECT r.scope, r.scope_id, r.class_id, r.tp::DOUBLE / r.n AS p, s.k
   FROM keyed r JOIN (SELECT id, arg_min(k, {'d': abs(tp::DOUBLE / n_gt - v), 'k': -k}) AS k FROM keyed CROSS JOIN points GROUP BY id) s ON r.id = s.id),
 best AS (SELECT scope, scope_id, class_id, k, max(p) AS p FROM snapped GROUP BY 1, 2, 3, 4),
 classes AS (SELECT DISTINCT scope, scope_id, class_id FROM best),
 curve AS (SELECT c.scope, c.scope_id, c.class_id, q.k, coalesce(max(b.p), 0) AS y FROM classes c CROSS JOIN points q
   LEFT JOIN best b ON b.scope = c.scope AND b.scope_id = c.scope_id AND b.class_id = c.class_id AND b.k >= q.k GROUP BY 1, 2, 3, 4),
 ap AS (SELECT scope, scope_id, class_id, sum(y) / 11 AS ap FROM curve GROUP BY 1, 2, 3)"""
)


def scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return run_sql(spark, sf_dir, GT_SQL), run_sql(spark, sf_dir, PRED_SQL)


@query(MATCH + " SELECT image_id, pos, class_id, coalesce(pred_pos, -1) AS pred_pos, round(coalesce(iou, 0), 9) AS iou FROM matched")
def iou_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.first_match(*scene(spark, sf_dir))
    return found.select("image_id", "pos", "class_id", F.coalesce("pred_pos", F.lit(-1)).alias("pred_pos"), F.round(F.coalesce("iou", F.lit(0.0)), 9).alias("iou"))


@query(PREDS + " SELECT image_id, pos, class_id, round(confidence, 9) AS confidence, is_tp FROM preds")
def tp_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.predictions(*scene(spark, sf_dir)).select("image_id", "pos", "class_id", F.round("confidence", 9).alias("confidence"), "is_tp")


@query(MATCH + " SELECT round(sum(coalesce(iou, 0)) / count(*), 9) AS miou, count(*) AS n_gt, count(iou) AS n_matched FROM matched")
def miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_iou(metrics.first_match(*scene(spark, sf_dir))).select(F.round("miou", 9).alias("miou"), "n_gt", "n_matched")


@query(SCOPED + " SELECT scope, scope_id, class_id, n_gt FROM counts")
def gt_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = metrics.with_scopes(scene(spark, sf_dir)[0], SCOPES)
    return metrics.class_counts(gt, "scope", "scope_id")


def _ap(spark: SparkSession, sf_dir: str, scopes: dict[str, str]) -> DataFrame:
    gt, pred = scene(spark, sf_dir)
    preds = metrics.with_scopes(metrics.predictions(gt, pred), scopes).select("scope", "scope_id", "class_id", "confidence", "is_tp", "image_id", "pos")
    return metrics.average_precision(preds, metrics.class_counts(metrics.with_scopes(gt, scopes), "scope", "scope_id"), "scope", "scope_id")


@query(SCOPED + " SELECT class_id, round(ap, 9) AS ap FROM ap WHERE scope = 'all'")
def ap_11pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ap(spark, sf_dir, {"all": "0"}).select("class_id", F.round("ap", 9).alias("ap"))


@query(SCOPED + " SELECT scope, scope_id, round(avg(ap), 9) AS map, count(*) AS n_classes FROM ap GROUP BY 1, 2")
def map_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean AP by image, tray and overall, from the counts of each image and class."""
    found = evaluation_state.scores(evaluation_state.contributions(*scene(spark, sf_dir)), SCOPES)
    return found.where("map is not null").select("scope", "scope_id", F.round("map", 9).alias("map"), "n_classes")


#: Every fourth image is a leftover of the third kind, which takes no part in IoU and AP.
GATED = SCOPED.replace(f"({GT_SQL})", f"(SELECT * FROM ({GT_SQL}) WHERE image_id % 4 IN (0, 1, 2))", 1).replace(f"({PRED_SQL})", f"(SELECT * FROM ({PRED_SQL}) WHERE image_id % 4 IN (0, 1, 2))", 1)


@query(GATED + """, m AS (SELECT scope, scope_id, avg(ap) AS map, count(*) AS n_classes FROM ap GROUP BY 1, 2),
 sm AS (SELECT 'image' AS scope, image_id AS scope_id, iou FROM matched UNION ALL SELECT 'tray', image_id % 8, iou FROM matched UNION ALL SELECT 'all', 0, iou FROM matched),
 i AS (SELECT scope, scope_id, sum(coalesce(iou, 0)) / count(*) AS miou, count(*) AS n_gt FROM sm GROUP BY 1, 2)
 SELECT i.scope, i.scope_id, round(miou, 9) AS miou, n_gt, round(coalesce(map, -1), 9) AS map, coalesce(n_classes, 0) AS n_classes FROM i LEFT JOIN m ON i.scope = m.scope AND i.scope_id = m.scope_id""")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean IoU and mean AP by image, tray and overall, of the images whose leftover code takes part."""
    return _rounded(evaluation_state.scores(evaluation_state.contributions(*_detected(spark, sf_dir)), SCOPES))


def _detected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The scene's boxes of images whose leftover code takes part."""
    gt, pred = (metrics.detected(d.withColumn("code", F.col("image_id") % 4)).drop("code") for d in scene(spark, sf_dir))
    return gt, pred


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("scope", "scope_id", F.round("miou", 9).alias("miou"), "n_gt", F.round(F.coalesce("map", F.lit(-1.0)), 9).alias("map"), F.coalesce("n_classes", F.lit(0)).cast("long").alias("n_classes"))


@query(GATED + """, i AS (SELECT sum(coalesce(iou, 0)) / count(*) AS miou FROM matched)
 SELECT 'tray ' || scope_id || ' mAP: ' || CAST(CAST(round(avg(ap), 4) AS DECIMAL(10, 4)) AS VARCHAR) AS line FROM ap WHERE scope = 'tray' GROUP BY scope_id
 UNION ALL SELECT 'overall mAP: ' || CAST(CAST(round(avg(ap), 4) AS DECIMAL(10, 4)) AS VARCHAR) FROM ap WHERE scope = 'all'
 UNION ALL SELECT 'overall mIoU: ' || CAST(CAST(round(miou, 4) AS DECIMAL(10, 4)) AS VARCHAR) FROM i""")
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.metric_lines(metrics.evaluate(*_detected(spark, sf_dir), SCOPES))


@query(ORACLE_SQL["evaluation"])
def evaluation_by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of ``evaluation`` from a state that grew in three batches, the first with every fourth image's boxes mistaken, which come again."""
    gt, pred = _detected(spark, sf_dir)
    part = lambda d, k: d.where(F.col("image_id") % 3 == k)
    mistaken = part(pred, 0).withColumn("x", F.when(F.col("image_id") % 4 == 0, F.col("x") + 500).otherwise(F.col("x")))
    state = written(evaluation_state.contributions(part(gt, 0), mistaken), "state")
    late = F.col("image_id") % 12 == 0
    for k, (truth, found) in enumerate(((part(gt, 1), part(pred, 1)), (part(gt, 2).union(gt.where(late)), part(pred, 2).union(pred.where(late)))), 1):
        state = written(evaluation_state.merged(state, evaluation_state.contributions(truth, found, k)), "state")
    return _rounded(evaluation_state.scores(state, SCOPES))


PAIRED = SCENE + """ga AS (SELECT floor(image_id / 2)::BIGINT AS pair_id, pos, class_id, w::BIGINT * h AS px, image_id % 2 AS after FROM gt),
 pa AS (SELECT floor(image_id / 2)::BIGINT AS pair_id, pos, class_id, w::BIGINT * h AS px, image_id % 2 AS after FROM pred),
 lastb AS (SELECT pair_id, class_id, arg_max(px, pos) AS gt_b FROM ga WHERE after = 0 GROUP BY 1, 2),
 firstb AS (SELECT pair_id, class_id, arg_min(px, pos) AS our_b FROM pa WHERE after = 0 GROUP BY 1, 2),
 led AS (SELECT g.pair_id, g.class_id, g.pos, p.pos AS pred_pos, CASE WHEN l.gt_b IS NULL THEN 0 ELSE g.px::DOUBLE / l.gt_b END AS gt_ratio, p.px::DOUBLE / f.our_b AS our_ratio
   FROM ga g LEFT JOIN lastb l ON g.pair_id = l.pair_id AND g.class_id = l.class_id
   JOIN pa p ON p.after = 1 AND g.pair_id = p.pair_id AND g.class_id = p.class_id JOIN firstb f ON g.pair_id = f.pair_id AND g.class_id = f.class_id WHERE g.after = 1)"""


@query(PAIRED + " SELECT pair_id, class_id, pos, pred_pos, round(gt_ratio, 9) AS gt_ratio, round(our_ratio, 9) AS our_ratio, round(abs(our_ratio - gt_ratio), 9) AS difference FROM led")
def leftover_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leftovers(spark, sf_dir).select("pair_id", "class_id", "pos", "pred_pos", *(F.round(c, 9).alias(c) for c in ("gt_ratio", "our_ratio", "difference")))


def _leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def items(df: DataFrame, after: int) -> DataFrame:
        return df.where(F.col("image_id") % 2 == after).select(F.floor(F.col("image_id") / 2).alias("pair_id"), "pos", "class_id", (F.col("w").cast("long") * F.col("h")).alias("pixels"))

    gt, pred = scene(spark, sf_dir)
    return metrics.leftover_ratios(items(gt, 0), items(gt, 1), items(pred, 0), items(pred, 1))


def _digits(x: str) -> str:
    """SQL of a finite number with six significant digits, without trailing zeros."""
    return f"regexp_replace(CAST(CAST(printf('%.5e', ({x})::DOUBLE) AS DOUBLE)::DECIMAL(30, 12) AS VARCHAR), '\\.?0+$', '')"


@query(MATCH + f" SELECT image_id, pos, 'Food ' || class_id || ', IoU = ' || {_digits('iou')} AS line FROM matched WHERE pred_pos IS NOT NULL")
def iou_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for every matched box."""
    return sinks.iou_lines(metrics.first_match(*scene(spark, sf_dir)))


@query(PAIRED + f""" SELECT pair_id, pos, pred_pos, n, 'Food item ' || class_id || ' : ' || name || ' = ' || {_digits('v')} AS line FROM led CROSS JOIN LATERAL
 (VALUES (1, 'our R_i', our_ratio), (2, 'gT R_i', gt_ratio), (3, 'abs diff', abs(our_ratio - gt_ratio))) k(n, name, v)""")
def leftover_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines for every item of a pair: its leftover ratio, the true one, and their difference."""
    return sinks.leftover_lines(_leftovers(spark, sf_dir))


NAMES_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', '{f}')" for i, n, f in LABELS) + ")"
ORDER_PIXELS = "SELECT CAST(o_custkey % 15 AS INT) AS label, o_orderstatus <> 'P' AS is_before, o_orderstatus = 'O' AS is_after FROM orders"


@query(f"SELECT label, count(*) FILTER (is_before) AS before, count(*) FILTER (is_after) AS after, count(*) FILTER (is_before) - count(*) FILTER (is_after) AS leftover FROM ({ORDER_PIXELS}) WHERE label BETWEEN 1 AND 13 GROUP BY 1 HAVING before <> 0")
def food_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.quantities(run_sql(spark, sf_dir, ORDER_PIXELS))


@query(f"""SELECT label, name || chr(10) || chr(9) || 'Before amount = ' || before || chr(10) || chr(9) || 'After amount = ' || after || chr(10) || chr(9) || 'Leftover amount = ' || (before - after) AS line
 FROM (SELECT label, count(*) FILTER (is_before) AS before, count(*) FILTER (is_after) AS after FROM ({ORDER_PIXELS}) WHERE label BETWEEN 1 AND 13 GROUP BY 1) q JOIN {NAMES_SQL} d(id, name, family) ON q.label = d.id WHERE before <> 0""")
def quantity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.quantity_lines(raster.quantities(run_sql(spark, sf_dir, ORDER_PIXELS)), labels_dim(spark))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, MASK_SQL)


@query(f"SELECT image_id, label AS class_id, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM ({MASK_SQL}) WHERE label BETWEEN 1 AND 13 GROUP BY 1, 2")
def bounding_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.bounding_boxes(mask(spark, sf_dir))




@query(f"SELECT DISTINCT m.image_id, m.label, d.name FROM ({MASK_SQL}) m JOIN {NAMES_SQL} d(id, name, family) ON m.label = d.id")
def found_foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.found_foods(mask(spark, sf_dir), labels_dim(spark)).select("image_id", "label", "name")


PROTO_SQL = "SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings WHERE label IN (1, 2, 3, 4, 5) GROUP BY 1"
NEAR_SQL = f"WITH proto AS ({PROTO_SQL}), dist AS (SELECT e.vec_id AS key, p.label, list_distance(e.embedding::DOUBLE[], p.v::DOUBLE[]) AS distance FROM embeddings e CROSS JOIN proto p)"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[int]]:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prototypes = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return vectors.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), prototypes, [1, 2, 3, 4, 5]


@query(NEAR_SQL + " SELECT key, label, round(distance, 6) AS distance FROM dist")
def label_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.distances(*_vectors(spark, sf_dir)).select("key", "label", F.round("distance", 6).alias("distance"))


@query(NEAR_SQL + " SELECT key, arg_min(label, {'d': distance, 'l': label}) AS label, round(min(distance), 6) AS distance FROM dist GROUP BY key")
def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.nearest_prototype(*_vectors(spark, sf_dir)).select("key", "label", F.round("distance", 6).alias("distance"))


@query("""WITH n AS (SELECT l_returnflag AS key, least(floor(l_quantity / 3), 15)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2)
 SELECT key, bin, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY key), 9) AS share, least(round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY key), 0), 255)::INT AS level FROM n""")
def hist_l1_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("key"), "l_quantity")
    return labels.histogram(items, ["key"], "l_quantity", 16, 3.0).withColumn("share", F.round("share", 9))


@query("""WITH n AS (SELECT l_returnflag AS key, l_quantity::INT AS value, count(*) AS n FROM lineitem GROUP BY 1, 2),
 s AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY value ROWS UNBOUNDED PRECEDING) AS seen, sum(n) OVER (PARTITION BY key) AS total, first_value(n) OVER (PARTITION BY key ORDER BY value) AS low FROM n)
 SELECT key, value, n, round_even((seen - low)::DOUBLE * 255 / (total - low), 0)::INT AS level FROM s""")
def equalize_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("key"), "l_quantity")
    return labels.equalise(items, ["key"], "l_quantity")


TILE_SQL = f"SELECT image_id, floor(r / 50)::BIGINT AS row, floor(c / 50)::BIGINT AS col, label, count(*) AS n FROM ({MASK_SQL}) GROUP BY ALL"


@query(f"SELECT image_id, row, col, label, n, row_number() OVER (PARTITION BY image_id, row, col ORDER BY n DESC, label)::INT AS rank FROM ({TILE_SQL})")
def tile_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = labels.tile(F.col("r"), F.col("c"), F.lit(0), F.lit(0), F.lit(50))
    return labels.by_frequency(mask(spark, sf_dir).withColumns({"row": row, "col": col}), "label", "image_id", "row", "col")


@query("SELECT o_orderpriority AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority)::INT AS rank FROM orders GROUP BY 1")
def freq_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("value"))
    return labels.by_frequency(orders, "value")


@query(f"""WITH g AS ({GRID_SQL}), v AS (SELECT a.row, a.col, b.label, count(*) AS n, max((b.row - a.row) * 3 + b.col - a.col) AS reached
   FROM g a JOIN g b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) AND b.label <> -1 GROUP BY 1, 2, 3),
 k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, reached) AS k FROM v)
 SELECT 0 AS image_id, g.row, g.col, coalesce(k.label, -1)::INT AS label FROM g LEFT JOIN k ON g.row = k.row AND g.col = k.col AND k.k = 1""")
def mode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.mode_filter(run_sql(spark, sf_dir, GRID_SQL))


PLATE_SQL = """SELECT floor(vec_id / 2)::BIGINT AS tray, (vec_id % 2)::INT AS plate, p.label, list_distance(e.embedding::DOUBLE[], p.v::DOUBLE[]) AS distance
 FROM embeddings e CROSS JOIN (SELECT label + 1 AS label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY 1) p"""


@query(f"""WITH d AS ({PLATE_SQL}), b AS (SELECT tray, plate, min(CASE WHEN label <= 5 THEN distance END) AS a, min(CASE WHEN label BETWEEN 6 AND 9 THEN distance END) AS b,
   arg_min(label, distance) FILTER (label <= 5) AS al, arg_min(label, distance) FILTER (label BETWEEN 6 AND 9) AS bl, max(distance) AS worst FROM d GROUP BY 1, 2),
 l AS (SELECT *, coalesce(abs(a - b) / nullif(worst, 0), 0) AS loss, count(*) OVER (PARTITION BY tray) AS n FROM b),
 t AS (SELECT tray, arg_max({{'p': plate, 'f': a < b OR (a = b AND al < bl)}}, {{'l': loss, 'q': -plate}}) AS lead FROM l GROUP BY 1),
 c AS (SELECT l.*, CASE WHEN n < 2 THEN a <= b WHEN plate = lead.p THEN lead.f ELSE NOT lead.f END AS f FROM l JOIN t USING (tray))
 SELECT tray, plate, CASE WHEN f THEN al ELSE bl END::INT AS label, round(CASE WHEN f THEN a ELSE b END, 6) AS distance FROM c""")
def two_plate_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prototypes = vectors.groupBy((F.col("label") + 1).alias("label")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    found = labels.distances(vectors.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), prototypes)
    found = found.select(F.floor(F.col("key") / 2).alias("tray"), (F.col("key") % 2).cast("int").alias("plate"), "label", "distance")
    families = labels_dim(spark).select(F.col("id").alias("label"), "family")
    return labels.assign_two_plates(found, families).select("tray", "plate", F.col("label").cast("int").alias("label"), F.round("distance", 6).alias("distance"))


@query(f"WITH n AS ({TILE_SQL.replace('row, floor', 'row_, floor')}), v AS (SELECT image_id AS plate, label, count(*) AS n FROM n GROUP BY 1, 2) SELECT plate, v.label, family, n, k::INT AS rank FROM (SELECT v.*, d.family, row_number() OVER (PARTITION BY plate, family ORDER BY n DESC, label) AS k FROM v JOIN {NAMES_SQL} d(id, name, family) ON v.label = d.id) v WHERE family = 'second' AND k <= 1 OR family = 'side' AND k <= 2")
def keep_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = labels.tile(F.col("r"), F.col("c"), F.lit(0), F.lit(0), F.lit(50))
    votes = mask(spark, sf_dir).select("image_id", row.alias("row"), col.alias("col"), "label").distinct().groupBy(F.col("image_id").alias("plate"), "label").agg(F.count("*").alias("n"))
    votes = votes.join(F.broadcast(labels_dim(spark).select(F.col("id").alias("label"), "family")), "label")
    return labels.keep_courses(votes).select("plate", "label", "family", "n", "rank")


LAYER_SQL = "SELECT CAST(l_suppkey % 50 AS BIGINT) AS image_id, CAST(l_partkey % 40 AS INT) AS r, CAST(l_orderkey % 60 AS INT) AS c, CAST(l_linenumber + 9 AS INT) AS label, l_orderkey * 100 + l_linenumber AS seq FROM lineitem"


@query(f"SELECT image_id, r, c, least(sum(label), 255)::INT AS label FROM ({LAYER_SQL}) GROUP BY 1, 2, 3")
def label_merge_saturating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.merge_saturating(run_sql(spark, sf_dir, LAYER_SQL))


@query(f"SELECT image_id, r, c, arg_max(label, {{'s': seq, 'l': label}})::INT AS label FROM ({LAYER_SQL}) GROUP BY 1, 2, 3")
def label_merge_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.merge_overwriting(run_sql(spark, sf_dir, LAYER_SQL))


@query(f"""WITH c AS ({CIRCLES_SQL}) SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.image_id = b.image_id AND a.id <> b.id
 AND (trunc(a.x) - trunc(b.x)) ** 2 + (trunc(a.y) - trunc(b.y)) ** 2 < trunc(a.radius) ** 2)""")
def circle_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    circles = run_sql(spark, sf_dir, CIRCLES_SQL)
    return raster.drop_circles_holding(circles, circles)


SMALL_BOXES = f"SELECT image_id % 40 AS image_id, pos, CASE class_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 10 ELSE 12 END AS class_id, CAST(x % 200 AS INT) AS x, CAST(y % 150 AS INT) AS y, w, h FROM ({GT_SQL}) g0"


@query(f"""SELECT b.image_id, b.pos, b.class_id, count(m.r) AS pixels FROM ({SMALL_BOXES}) b LEFT JOIN ({MASK_SQL}) m
 ON m.image_id = b.image_id AND m.label = b.class_id AND m.r >= b.y AND m.r < b.y + b.h AND m.c >= b.x AND m.c < b.x + b.w GROUP BY 1, 2, 3""")
def pixel_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixels_in_boxes(mask(spark, sf_dir), run_sql(spark, sf_dir, SMALL_BOXES))


SMALL_PREDS = f"SELECT image_id % 40 AS image_id, pos, class_id, x + 3 AS x, y + 2 AS y, w, h FROM ({SMALL_BOXES}) p0 WHERE pos % 5 <> 0"


@query(f"""WITH m AS ({MASK_SQL}), b AS (SELECT 'gt' AS kind, * FROM ({SMALL_BOXES}) UNION ALL SELECT 'our', * FROM ({SMALL_PREDS})),
 px AS (SELECT b.kind, floor(b.image_id / 2)::BIGINT AS pair_id, b.image_id % 2 AS after, b.pos, b.class_id, count(m.r) AS px FROM b LEFT JOIN m
   ON m.image_id = b.image_id AND m.label = b.class_id AND m.r >= b.y AND m.r < b.y + b.h AND m.c >= b.x AND m.c < b.x + b.w GROUP BY ALL),
 lastb AS (SELECT pair_id, class_id, arg_max(px, pos) AS gt_b FROM px WHERE kind = 'gt' AND after = 0 GROUP BY 1, 2),
 firstb AS (SELECT pair_id, class_id, arg_min(px, pos) AS our_b FROM px WHERE kind = 'our' AND after = 0 GROUP BY 1, 2)
 SELECT g.pair_id, g.class_id, g.pos, p.pos AS pred_pos, round(CASE WHEN l.gt_b IS NULL THEN 0 WHEN l.gt_b = 0 THEN -1 ELSE g.px::DOUBLE / l.gt_b END, 9) AS gt_ratio,
  round(CASE WHEN f.our_b = 0 THEN -1 ELSE p.px::DOUBLE / f.our_b END, 9) AS our_ratio
 FROM px g LEFT JOIN lastb l ON g.pair_id = l.pair_id AND g.class_id = l.class_id JOIN px p ON p.kind = 'our' AND p.after = 1 AND g.pair_id = p.pair_id AND g.class_id = p.class_id
 JOIN firstb f ON g.pair_id = f.pair_id AND g.class_id = f.class_id WHERE g.kind = 'gt' AND g.after = 1""")
def leftover_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftover ratios from the pixels of a box's own label inside it; -1 where the before-item has none."""

    def items(boxes: DataFrame, after: int) -> DataFrame:
        counted = raster.pixels_in_boxes(mask(spark, sf_dir), boxes.where(F.col("image_id") % 2 == after))
        return counted.select(F.floor(F.col("image_id") / 2).alias("pair_id"), "pos", "class_id", "pixels")

    gt, pred = run_sql(spark, sf_dir, SMALL_BOXES), run_sql(spark, sf_dir, SMALL_PREDS)
    true, ours = metrics.leftover_sides(items(gt, 0), items(gt, 1), items(pred, 0), items(pred, 1))
    finite = lambda c: F.round(F.when(F.isnan(c) | (F.col(c) == float("inf")), -1.0).otherwise(F.col(c)), 9).alias(c)
    return metrics.paired(true.withColumn("gt_ratio", finite("gt_ratio")), ours.withColumn("our_ratio", finite("our_ratio")))


DISC_SQL = f"SELECT image_id, id, x % 320 AS x, y % 240 AS y, radius FROM ({CIRCLES_SQL}) c0"


@query(f"""SELECT m.image_id, m.r, m.c, m.label, d.id AS circle_id FROM ({MASK_SQL}) m JOIN ({DISC_SQL}) d ON m.image_id = d.image_id
 AND (m.r - trunc(d.y)) ** 2 + (m.c - trunc(d.x)) ** 2 <= trunc(d.radius) ** 2""")
def disc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixels_in_disc(mask(spark, sf_dir), run_sql(spark, sf_dir, DISC_SQL))


@query(f"""SELECT * FROM ({MASK_SQL}) m WHERE NOT EXISTS (SELECT 1 FROM ({DISC_SQL}) d WHERE m.image_id = d.image_id
 AND (m.r - trunc(d.y)) ** 2 + (m.c - trunc(d.x)) ** 2 <= trunc(d.radius * 1.4) ** 2)""")
def erase_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.erase_circles(mask(spark, sf_dir), run_sql(spark, sf_dir, DISC_SQL), 1.4)


HSV_SQL = f"""WITH p AS (SELECT *, greatest(b, g, red) AS v, greatest(b, g, red) - least(b, g, red) AS d FROM ({COLOUR_SQL})),
 h0 AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE floor(255.0::DOUBLE * d / v + 0.5) END::INT AS s,
   CASE WHEN d = 0 THEN 0 WHEN v = red THEN 30.0::DOUBLE * (g - b) / d WHEN v = g THEN 60 + 30.0::DOUBLE * (b - red) / d ELSE 120 + 30.0::DOUBLE * (red - g) / d END AS t FROM p),
 hsv AS (SELECT *, (floor(CASE WHEN t < 0 THEN t + 180 ELSE t END + 0.5)::INT % 180)::INT AS h FROM h0)"""


@query(HSV_SQL + """ SELECT h, s, v::INT AS v, s > 80 OR (h > 20 AND h < 25) AS plate, s > 175 OR v > 245 AS salad, s > 153 AND g >= 85 AS pesto, s > 89.25 AS pilaf, red > 160 AS tomato, s > 1 AND s <= 140 AS bread,
 least(greatest(floor(0.492::DOUBLE * (b - (0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * red)) + 128.5), 0), 255)::INT BETWEEN 70 AND 117 AS bread_chroma, count(*) AS n FROM hsv GROUP BY ALL""")
def hsv_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, g, r = (F.col(k) for k in ("b", "g", "red"))
    pixels = run_sql(spark, sf_dir, COLOUR_SQL).withColumns(fn.hsv(b, g, r))
    c = {k: F.col(k) for k in "hsv"}
    flags = {"plate": fn.plate_pixel(c), "salad": fn.salad_pixel(c), "pesto": fn.pesto_pixel(c, g), "pilaf": fn.pilaf_pixel(c), "tomato": fn.tomato_pixel(r), "bread": fn.bread_saturation(c), "bread_chroma": fn.bread_band(fn.chroma_u(b, g, r))}
    return pixels.withColumns(flags).groupBy("h", "s", "v", *flags).agg(F.count("*").alias("n"))


COLOUR_ROWS = "(VALUES " + ", ".join(f"({k}, {b}, {g}, {r})" for k, (b, g, r) in COLOURS.items()) + ")"


@query(f"SELECT m.image_id, m.r, m.c, m.label, coalesce(d.b, 0)::INT AS blue, coalesce(d.g, 0)::INT AS green, coalesce(d.r, 0)::INT AS red FROM ({MASK_SQL}) m LEFT JOIN {COLOUR_ROWS} d(k, b, g, r) ON m.label = d.k WHERE m.label <> 0")
def colourise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.colourise(mask(spark, sf_dir), colours_dim(spark))


THIN_SQL = f"SELECT DISTINCT image_id, CAST(floor(r / 4) AS BIGINT) AS r, CAST(floor(c / 4) AS BIGINT) AS c FROM ({MASK_SQL}) m0"
COARSE_SQL = THIN_SQL.replace("/ 4", "/ 16")
SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


@query(f"WITH m AS ({THIN_SQL}) SELECT DISTINCT image_id, r + a AS r, c + b AS c FROM m CROSS JOIN (SELECT unnest([-1, 0, 1]) AS a) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS b)")
def dilate_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.dilate(run_sql(spark, sf_dir, THIN_SQL), SQUARE)


@query(f"WITH m AS ({COARSE_SQL}), v AS (SELECT image_id, r + a AS r, c + b AS c FROM m CROSS JOIN (VALUES (0, 0), (0, 1)) k(a, b)), w AS (SELECT image_id, r, c FROM v) SELECT image_id, r, c FROM w GROUP BY 1, 2, 3 HAVING count(*) = 2")
def erode_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.erode(run_sql(spark, sf_dir, COARSE_SQL), [(0, 0), (0, -1)])


@query(f"""WITH m AS ({THIN_SQL}) SELECT a.image_id, a.r, a.c, least(sum(10) * 2.0::DOUBLE, 255) AS v FROM m a JOIN m b ON a.image_id = b.image_id
 AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 GROUP BY 1, 2, 3""")
def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.box_filter_at(run_sql(spark, sf_dir, THIN_SQL).withColumn("v", F.lit(10)), "v", 7, 2.0)


LISTS = "SELECT o_custkey AS key, list(CAST(o_orderkey % 7 AS BIGINT) ORDER BY o_orderkey) AS a, list(CAST(floor(o_totalprice) AS BIGINT) % 5 ORDER BY o_orderkey) AS b FROM orders GROUP BY 1"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.groupBy(F.col("o_custkey").alias("key")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 7).alias("a"), (F.floor("o_totalprice") % 5).alias("b")))).alias("s"))
    return rows.select("key", F.col("s.a").alias("a"), F.col("s.b").alias("b"))


@query(f"SELECT key, array_to_string(list_concat(a, b), ',') AS joined FROM ({LISTS})")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("key", F.array_join(F.transform(fn.bag_union(F.col("a"), F.col("b")), lambda x: x.cast("string")), ",").alias("joined"))


@query(f"SELECT key, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS kept FROM ({LISTS})")
def ordered_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("key", F.array_join(F.transform(fn.ordered_semi(F.col("a"), F.col("b")), lambda x: x.cast("string")), ",").alias("kept"))


@query(f"SELECT key, (coalesce(list_position(a, 3), 0) - 1)::INT AS at FROM ({LISTS})")
def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("key", fn.index_of(F.col("a"), F.lit(3).cast("long")).alias("at"))


@query("""SELECT s_suppkey AS tray, l::INT AS leftover, 'data/tray' || s_suppkey || '/food_image.jpg' AS before_path, 'data/tray' || s_suppkey || '/leftover' || l || '.jpg' AS after_path
 FROM (SELECT s_suppkey, unnest(range(1, 4)) AS l FROM supplier)""")
def pair_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after paths of every tray, one for each supplier, and its three leftovers."""
    return box_source.enumerate_pairs(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("tray")), "data")


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'set/tray' || p_size || '/leftover' || p_partkey % 3 || '.jpg' WHEN 1 THEN 'a/my_tray_data/tray1/x.jpg' WHEN 2 THEN 'no/number.png' ELSE 'my_leftover/tray' || p_size || 'b/food_image.jpg' END AS path FROM part)
 SELECT p_partkey, CASE WHEN strpos(path, 'tray') = 0 THEN -1 ELSE coalesce(try_cast(regexp_extract(substr(path, strpos(path, 'tray') + 4), '^([+-]?[0-9]+)', 1) AS INT), -1) END AS tray,
  CASE WHEN strpos(path, '/leftover') = 0 THEN -1 ELSE coalesce(try_cast(regexp_extract(substr(path, strpos(path, '/leftover') + 9), '^([+-]?[0-9]+)', 1) AS INT), -1) END AS leftover,
  list_extract(string_split(path, '/'), -2) AS parent, regexp_extract(path, '([^/]+)[.][^.]*$', 1) || '_bounding_box' AS box_name FROM p""")
def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("set/tray"), size, F.lit("/leftover"), (k % 3).cast("string"), F.lit(".jpg"))).when(k % 4 == 1, "a/my_tray_data/tray1/x.jpg").when(k % 4 == 2, "no/number.png").otherwise(F.concat(F.lit("my_leftover/tray"), size, F.lit("b/food_image.jpg")))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", path.alias("path"))
    p = F.col("path")
    return rows.select("p_partkey", fn.tray_number(p).alias("tray"), fn.leftover_number(p).alias("leftover"), fn.parent_name(p).alias("parent"), fn.box_name(p).alias("box_name"))


@query(f"SELECT image_id, pos, class_id, x, y, w, h FROM ({GT_SQL})")
def box_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = run_sql(spark, sf_dir, GT_SQL)
    lines = gt.select("image_id", "pos", sinks.box_line(*(F.col(c) for c in ("class_id", "x", "y", "w", "h"))).alias("value"))
    return box_source.parse_boxes(lines).select("image_id", "pos", "class_id", "x", "y", "w", "h")


FILE_SQL = f"""SELECT 'image' || image_id AS image_id, pos, CASE WHEN pos % 17 = 5 THEN 'ID: x; [' || x || ', ' || y || ']' ELSE CASE WHEN pos % 10 = 3 THEN 'ID ' ELSE 'ID: ' END || class_id || '; [' || x || ', ' || y || ', ' || w || ', ' || h || ']' END AS value FROM ({GT_SQL}) g"""


@query(f"""SELECT image_id, count(*) AS lines, count(*) FILTER (pos % 17 <> 5 AND pos % 10 <> 3) AS strict, count(*) FILTER (pos % 17 <> 5) AS lenient, count(*) FILTER (pos % 17 = 5) AS malformed,
 coalesce(sum(x + y + w + h) FILTER (pos % 17 <> 5), 0)::BIGINT AS total FROM (SELECT 'image' || image_id AS image_id, pos, x, y, w, h FROM ({GT_SQL}) g) GROUP BY 1""")
def box_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box files of all images written and read back, strictly and leniently, with their malformed lines counted."""
    folder = f"{shared_folder(spark)}/box-files-{uuid.uuid4().hex}"
    line_files.write_lines(run_sql(spark, sf_dir, FILE_SQL), folder, "_bounding_box.txt")
    lines = line_files.read_lines(spark, folder, "_bounding_box.txt")
    marked = box_source.marked_boxes(lines)
    total = F.sum(F.when(F.col("lenient"), F.col("x") + F.col("y") + F.col("w") + F.col("h")))
    return marked.groupBy("image_id").agg(F.count("*").alias("lines"), F.count_if("strict").alias("strict"), F.count_if("lenient").alias("lenient"), F.count_if(~F.col("lenient")).alias("malformed"), F.coalesce(total, F.lit(0)).cast("long").alias("total"))


REGION_SQL = "SELECT CAST(o_custkey AS BIGINT) AS plate, o_orderkey AS region, o_totalprice AS area, 300.0 AS radius FROM orders"


@query(f"""WITH r AS (SELECT plate, region, area, 300.0::DOUBLE AS radius FROM ({REGION_SQL}) WHERE area >= 0.005::DOUBLE * 3.141::DOUBLE * 300 * 300), b AS (SELECT *, bool_or(area > 0.07::DOUBLE * 3.141::DOUBLE * 300 * 300) OVER (PARTITION BY plate) AS any_big,
 row_number() OVER (PARTITION BY plate ORDER BY area DESC, region)::INT AS rank FROM r) SELECT * FROM b WHERE rank <= CASE WHEN any_big THEN 1 ELSE 2 END""")
def large_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.large_areas(run_sql(spark, sf_dir, REGION_SQL).withColumn("radius", F.col("radius").cast("double")))


@query(f"""WITH k AS (SELECT image_id, label, pos, w::BIGINT * h AS area, row_number() OVER (PARTITION BY image_id ORDER BY w::BIGINT * h DESC, pos) AS k FROM (SELECT *, class_id AS label FROM ({GT_SQL})))
 SELECT a.image_id, b.pos FROM k a JOIN k b ON a.image_id = b.image_id AND a.k = 1 AND b.k = 2 AND a.area > 500 AND b.area > 0.9::DOUBLE * a.area""")
def second_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-largest regions that nearly reach the largest."""
    w = Window.partitionBy("image_id").orderBy(F.desc("area"), "pos")
    rows = run_sql(spark, sf_dir, GT_SQL).withColumn("area", F.col("w").cast("long") * F.col("h"))
    ranked = rows.withColumns({"rank": F.row_number().over(w), "before": F.lag("area").over(w)}).where("rank <= 2")
    return ranked.where("rank = 2 and before > 500 and area > 0.9D * before").select("image_id", "pos")


@query(f"WITH g AS (SELECT image_id, class_id FROM ({GT_SQL})), p AS (SELECT image_id, class_id FROM ({PRED_SQL})) SELECT image_id, class_id FROM g UNION SELECT image_id, class_id FROM p")
def class_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = scene(spark, sf_dir)
    return gt.select("image_id", "class_id").union(pred.select("image_id", "class_id")).distinct()
