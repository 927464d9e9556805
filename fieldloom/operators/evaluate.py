"""Accuracy of predicted fields against reference fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import boxes
from fieldloom.operators.spatial_join import overlap_join


def iou_pairs(reference: DataFrame, predicted: DataFrame, threshold: float, cell: float) -> DataFrame:
    """``ref_id, pred_id, iou, ref_area, pred_area`` of pairs whose IoU reaches the threshold."""
    l, r = F.col("l.box"), F.col("r.box")
    pairs = overlap_join(reference.select("fid", "box"), predicted.select("fid", "box"), cell)
    return pairs.select(
        F.col("l.fid").alias("ref_id"), F.col("r.fid").alias("pred_id"), boxes.iou(l, r).alias("iou"), boxes.area(l).alias("ref_area"), boxes.area(r).alias("pred_area")
    ).where(F.col("iou") >= threshold)


def best_match(pairs: DataFrame) -> DataFrame:
    """The best pair of each reference; the lesser prediction on a tie."""
    top = Window.partitionBy("ref_id").orderBy(F.col("iou").desc(), "pred_id")
    return pairs.select("*", F.row_number().over(top).alias("n"), F.count("*").over(Window.partitionBy("ref_id")).alias("matches")).where("n = 1").drop("n")


def metrics(reference: DataFrame, predicted: DataFrame, threshold: float = 0.5, cell: float = 100.0) -> DataFrame:
    """One row of metrics; with an empty side, its degenerate values (both empty: all perfect)."""
    pairs = iou_pairs(reference, predicted, threshold, cell)
    best = best_match(pairs)
    of_ref = best.agg(
        F.count("*").alias("tp"), F.countDistinct("pred_id").alias("matched"), F.avg("iou").alias("iou_mean"),
        F.avg(F.abs(F.col("ref_area") - F.col("pred_area"))).alias("area_error"), F.sum((F.col("matches") > 1).cast("long")).alias("over"),
    )
    of_pred = pairs.groupBy("pred_id").count().agg(F.sum((F.col("count") > 1).cast("long")).alias("under"))
    sizes = reference.agg(F.count("*").alias("n_ref")).crossJoin(predicted.agg(F.count("*").alias("n_pred")))  # one row each
    one = sizes.crossJoin(of_ref).crossJoin(of_pred)
    fp, fn = F.col("n_pred") - F.col("matched"), F.col("n_ref") - F.col("tp")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    one = one.select("*", fp.alias("fp"), fn.alias("fn")).select("*", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    none = (F.col("n_ref") == 0) & (F.col("n_pred") == 0)
    perfect = lambda c, v=1.0: F.when(none, F.lit(v)).otherwise(c)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return one.select(
        perfect(zero(F.col("iou_mean"))).alias("iou_mean"), perfect(p).alias("precision"), perfect(r).alias("recall"), perfect(share(2 * p * r, p + r)).alias("f1"),
        share(F.coalesce("over", F.lit(0)), F.col("n_ref")).alias("over_segmentation"), share(F.coalesce("under", F.lit(0)), F.col("n_pred")).alias("under_segmentation"),
        zero(F.col("area_error")).alias("area_error_mean_m2"),
        F.col("n_pred").alias("count_predicted"), F.col("n_ref").alias("count_reference"),
        F.col("tp").alias("count_tp"), F.col("fp").alias("count_fp"), F.col("fn").alias("count_fn"), F.lit(float(threshold)).alias("iou_threshold"),
    )
