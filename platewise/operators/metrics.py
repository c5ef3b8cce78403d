"""Detection metrics: matching, IoU, interpolated AP, mAP by scope, leftover ratios.

Boxes have ``image_id, pos, class_id, x, y, w, h``; ``pos`` is the order in the
source, which decides first and last matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.scalars import iou
from platewise.model import RECALL_POINTS

#: A prediction is a true positive above this confidence.
TRUE_POSITIVE = 0.5
#: Slices of confidence that a class is ranked in, so that no task holds all of a class.
CONFIDENCE_SLICES = 256


def first_match(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Each ground-truth box with the first prediction of its image and class, and their IoU (null if none)."""
    first = pred.groupBy("image_id", "class_id").agg(F.min_by(F.struct("pos", "x", "y", "w", "h"), "pos").alias("p"))
    joined = gt.join(first, ["image_id", "class_id"], "left")
    box = {k: F.col(k) for k in "xywh"}
    return joined.withColumns({"pred_pos": F.col("p.pos"), "iou": iou(box, {k: F.col(f"p.{k}") for k in "xywh"})}).drop("p")


def predictions(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Each prediction with its confidence (the IoU of the last ground truth that took it, else 0) and whether it is a true positive."""
    taken = first_match(gt, pred).where("pred_pos is not null").groupBy("image_id", F.col("pred_pos").alias("pos")).agg(F.max_by("iou", "pos").alias("confidence"))
    found = pred.select("image_id", "pos", "class_id").join(taken, ["image_id", "pos"], "left").fillna(0.0, ["confidence"])
    return found.withColumn("is_tp", ~F.isnan("confidence") & (F.col("confidence") > TRUE_POSITIVE))


def mean_iou(matched: DataFrame, *scope: str) -> DataFrame:
    """Sum of IoU over number of ground-truth boxes; unmatched ones count as 0."""
    value = F.sum(F.coalesce("iou", F.lit(0.0))) / F.count("*")
    return matched.groupBy(*scope).agg(value.alias("miou"), F.count("*").alias("n_gt"), F.count("iou").alias("n_matched"))


def class_counts(gt: DataFrame, *scope: str) -> DataFrame:
    return gt.groupBy(*scope, "class_id").agg(F.count("*").alias("n_gt"))


def average_precision(preds: DataFrame, counts: DataFrame, *scope: str) -> DataFrame:
    """11-point AP of every predicted class: recall is snapped to the nearest point, ties to the larger.

    ``preds``: scope, class_id, confidence, is_tp, and further columns that break
    ties; ``counts``: scope, class_id, n_gt.  A class without ground truth counts -1.

    Predictions less confident than a class's last true positive change no precision that
    counts, so they are not ranked: those without any match, all of confidence 0, stay out.
    """
    keys = [*scope, "class_id"]
    ties = [c for c in preds.columns if c not in (*keys, "confidence", "is_tp")]
    order = F.coalesce(F.when(F.isnan("confidence"), 2.0).otherwise(F.col("confidence")), F.lit(-1.0))
    placed = preds.withColumns({"_o": order, "_t": F.col("is_tp").cast("long")})
    classes = placed.groupBy(*keys).agg(F.min(F.when(F.col("is_tp"), F.col("_o"))).alias("_last"))
    # a class is ranked in slices of confidence: sums within a slice, and sums of the slices before
    sliced = placed.join(classes.where("_last is not null"), keys).where("_o >= _last").withColumn("_s", F.floor(F.col("_o") * CONFIDENCE_SLICES))
    sums = sliced.groupBy(*keys, "_s").agg(F.sum("_t").alias("_st"), F.count("*").alias("_sn"))
    before = Window.partitionBy(*keys).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_s", F.coalesce(F.sum("_st").over(before), F.lit(0)).alias("_bt"), F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_bn"))
    w = Window.partitionBy(*keys, "_s").orderBy(F.desc("confidence"), *ties).rowsBetween(Window.unboundedPreceding, 0)
    within = sliced.select(*keys, "_s", F.sum("_t").over(w).alias("_t"), F.count("*").over(w).alias("_n"))
    ranked = within.join(sums, [*keys, "_s"]).join(counts, keys, "left").select(
        *keys,
        F.coalesce("n_gt", F.lit(-1)).alias("n_gt"),
        (F.col("_bt") + F.col("_t")).alias("tp"),
        (F.col("_bn") + F.col("_n")).alias("n"),
    )
    snapped = ranked.withColumns({"k": snapped_recall(F.col("tp"), F.col("n_gt")), "p": F.col("tp").cast("double") / F.col("n")})
    best = snapped.groupBy(*keys, "k").agg(F.max("p").alias("p"))
    # at most eleven points a class; the envelope is the largest precision at or above each
    curve = best.groupBy(*keys).agg(F.collect_list(F.struct("k", "p")).alias("curve"))
    at = lambda k: F.coalesce(F.array_max(F.transform(F.filter("curve", lambda x: x["k"] >= k), lambda x: x["p"])), F.lit(0.0))
    total = sum((at(k) for k in range(1, len(RECALL_POINTS))), at(0))
    found = curve.select(*keys, (total / len(RECALL_POINTS)).alias("ap"))
    return classes.select(*keys).join(found, keys, "left").fillna(0.0, ["ap"])


def snapped_recall(tp: Column, n_gt: Column) -> Column:
    """The number of the recall point nearest to ``tp / n_gt``; ties go to the larger point."""
    recall = tp.cast("double") / n_gt
    points = F.array(*(F.struct(F.abs(recall - v).alias("d"), F.lit(-k).alias("k")) for k, v in enumerate(RECALL_POINTS)))
    return -F.array_min(points)["k"]


def with_scopes(rows: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """One copy of each row for every scope: ``scope`` names it, ``scope_id`` is the SQL value."""
    return rows.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(k).alias("scope"), F.expr(v).cast("long").alias("scope_id")) for k, v in scopes.items())))).select("*", "_s.scope", "_s.scope_id").drop("_s")


def mean_average_precision(ap: DataFrame, *scope: str) -> DataFrame:
    """Mean AP over predicted classes."""
    return ap.groupBy(*scope).agg(F.avg("ap").alias("map"), F.count("*").alias("n_classes"))


def detected(rows: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose leftover code takes part in IoU and AP: before (0) and after of the first two kinds."""
    return rows.where(F.col(code).isin(0, 1, 2))


def left_over(rows: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose leftover code takes part in leftover ratios: all but before (0)."""
    return rows.where(F.col(code) != 0)


def evaluate(gt: DataFrame, pred: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """``scope, scope_id, miou, n_gt, n_matched, map, n_classes``; ``map`` is null where nothing is predicted."""
    keys = ["scope", "scope_id"]
    overlap = mean_iou(with_scopes(first_match(gt, pred), scopes), *keys)
    preds = with_scopes(predictions(gt, pred), scopes).select(*keys, "class_id", "confidence", "is_tp", "image_id", "pos")
    ap = average_precision(preds, class_counts(with_scopes(gt, scopes), *keys), *keys)
    return overlap.join(mean_average_precision(ap, *keys), keys, "left")


def leftover_sides(gt_before: DataFrame, gt_after: DataFrame, pred_before: DataFrame, pred_after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pair_id, class_id, pos, gt_ratio`` of the true after-items and ``pair_id, class_id, pred_pos, our_ratio`` of the predicted ones (see ``leftover_ratios``)."""
    keys = ["pair_id", "class_id"]
    counted = F.when(F.col("pixels").isNotNull(), F.col("pos"))
    last = gt_before.groupBy(*keys).agg(F.max_by("pixels", counted).alias("gt_b"))
    first = pred_before.groupBy(*keys).agg(F.min_by("pixels", counted).alias("our_b"))
    ratio = lambda a, b: F.when(F.col(b) == 0, F.when(F.col(a) == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col(a).cast("double") / F.when(F.col(b) == 0, 1).otherwise(F.col(b)))
    true = gt_after.join(last, keys, "left").select(*keys, "pos", F.when(F.col("gt_b").isNull(), 0.0).otherwise(ratio("pixels", "gt_b")).alias("gt_ratio"))
    ours = pred_after.join(first, keys).select(*keys, F.col("pos").alias("pred_pos"), ratio("pixels", "our_b").alias("our_ratio"))
    return true, ours


def paired(true: DataFrame, ours: DataFrame) -> DataFrame:
    """True and predicted items of a pair and class, each with each; neither side is broadcast, as plans take both for small."""
    return true.join(ours.hint("merge"), ["pair_id", "class_id"]).select("pair_id", "class_id", "pos", "pred_pos", "gt_ratio", "our_ratio")


def leftover_ratios(gt_before: DataFrame, gt_after: DataFrame, pred_before: DataFrame, pred_after: DataFrame) -> DataFrame:
    """Leftover ratio of every item, true and predicted, and their difference.

    Inputs: ``pair_id, pos, class_id, pixels``.  The last true before-item of a
    class counts (0 ratio without one), each predicted after-item gives a row,
    the first predicted before-item counts; items without both predictions drop out.
    Before-items of unknown size don't count; without another, the true ratio is 0
    and the predicted one null.
    """
    rows = paired(*leftover_sides(gt_before, gt_after, pred_before, pred_after))
    return rows.withColumn("difference", F.abs(F.col("our_ratio") - F.col("gt_ratio")))
