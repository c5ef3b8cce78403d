"""Evaluation that grows image by image: counts of each image merge into trays and the whole.

A *state* has one row for each image and class, ``image_id, class_id, n_gt, n_matched,
iou, n_pred, n_tp, version``.  Its numbers add up, so any split of the images into batches
gives the scores of one evaluation of all; an image that comes again takes the place of
its earlier rows.  Every true positive is more confident than every false one (a
prediction is true above a confidence), so AP needs no ranking: precision is 1 up to
the recall reached.

Rows: an image with ground truth only, or predictions only, counts with what it has; of two
versions of an image the later counts, of rows with one version all do; an empty
batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.tables import written
from platewise.model import RECALL_POINTS
from platewise.operators.metrics import first_match, predictions, snapped_recall, with_scopes

STATE = "image_id long, class_id int, n_gt long, n_matched long, iou double, n_pred long, n_tp long, version long"
COUNTS = ("n_gt", "n_matched", "iou", "n_pred", "n_tp")


def contributions(gt: DataFrame, pred: DataFrame, version: int = 0) -> DataFrame:
    """The state of a batch of images, from their boxes."""
    truth = first_match(gt, pred).groupBy("image_id", "class_id").agg(F.count("*").alias("n_gt"), F.count("iou").alias("n_matched"), F.sum(F.coalesce("iou", F.lit(0.0))).alias("iou"))
    made = predictions(gt, pred).groupBy("image_id", "class_id").agg(F.count("*").alias("n_pred"), F.count_if("is_tp").alias("n_tp"))
    both = truth.join(made, ["image_id", "class_id"], "full")
    filled = [F.coalesce(k, F.lit(0)).cast("double" if k == "iou" else "long").alias(k) for k in COUNTS]
    return both.select(F.col("image_id").cast("long").alias("image_id"), F.col("class_id").cast("int").alias("class_id"), *filled, F.lit(version).cast("long").alias("version"))


def current(state: DataFrame) -> DataFrame:
    """The rows of each image's last version."""
    last = F.max("version").over(Window.partitionBy("image_id"))
    return state.withColumn("_last", last).where("version = _last").drop("_last")


def merged(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state with the images of a batch in place of their earlier rows."""
    return state.join(batch.select("image_id").distinct(), "image_id", "left_anti").unionByName(batch)


def scores(state: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """``scope, scope_id, miou, n_gt, n_matched, map, n_classes`` of a state with one version an image; ``map`` is null where nothing is predicted.

    Sums by class first, so that a scope's rows are its classes.
    """
    keys = ["scope", "scope_id"]
    classes = with_scopes(state, scopes).groupBy(*keys, "class_id").agg(*(F.sum(k).alias(k) for k in COUNTS))
    n_gt = F.when(F.col("n_gt") > 0, F.col("n_gt")).otherwise(-1)
    ap = F.when(F.col("n_tp") > 0, (snapped_recall(F.col("n_tp"), n_gt) + 1) / len(RECALL_POINTS)).otherwise(0.0)
    rated = classes.withColumn("ap", F.when(F.col("n_pred") > 0, ap))
    sums = rated.groupBy(*keys).agg(F.sum("iou").alias("iou"), F.sum("n_gt").alias("n_gt"), F.sum("n_matched").alias("n_matched"), F.avg("ap").alias("map"), F.count("ap").alias("n_classes"))
    return sums.where("n_gt > 0").select(*keys, (F.col("iou") / F.col("n_gt")).alias("miou"), "n_gt", "n_matched", "map", F.when(F.col("n_classes") > 0, F.col("n_classes")).alias("n_classes"))


def keep_state(batch: DataFrame, version: int, path: str) -> None:
    """Add a batch's state to the table at ``path``, as a folder of its own: the same batch again replaces itself."""
    batch.drop("version").write.mode("overwrite").parquet(f"{path}/version={version}")


def kept_state(spark, path: str) -> DataFrame:
    """The state that ``keep_state`` has kept, one version an image."""
    return current(spark.read.schema(STATE).option("basePath", path).parquet(path))


def evaluate_stream(boxes: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the state of a stream of boxes at ``path``.

    ``boxes`` streams ``image_id, kind ('gt' or 'pred'), pos, class_id, x, y, w, h``; all boxes of
    an image come in one micro-batch, and come whole again when the image changes.  After a
    failure a micro-batch runs again and replaces what it had written.
    """

    def fold(rows: DataFrame, version: int) -> None:
        known = written(rows, "batch")
        side = lambda k: known.where(F.col("kind") == k).drop("kind")
        keep_state(contributions(side("gt"), side("pred"), version), version, path)

    return boxes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
