"""Measures of segmentation, detection and depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) over rows with a truth."""
    return df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_accuracy(matrix: DataFrame) -> DataFrame:
    """(label, truth_n, predicted_n, hit, acc, iou) per class of the confusion matrix; nulls where undefined."""
    t = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("truth_n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    p = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted_n"))
    zero = F.lit(0).cast("bigint")
    out = t.join(p, "label", "full").select("label", *[F.coalesce(c, zero).alias(c) for c in ("truth_n", "predicted_n", "hit")]).where(F.col("label").isNotNull())
    return out.withColumns({"acc": F.try_divide(F.col("hit"), F.col("truth_n")), "iou": F.try_divide(F.col("hit"), F.col("truth_n") + F.col("predicted_n") - F.col("hit"))})


def segmentation_scores(matrix: DataFrame) -> DataFrame:
    """One row (pixel_acc, mean_acc, mean_iou, freq_iou): mean IoU over the classes in the truth, undefined values left out."""
    c = class_accuracy(matrix)
    total = F.sum("truth_n")
    return c.agg(F.try_divide(F.sum("hit"), total).alias("pixel_acc"), F.avg("acc").alias("mean_acc"), F.avg(F.when(F.col("truth_n") > 0, F.col("iou"))).alias("mean_iou"), F.try_divide(F.sum(F.when(F.col("truth_n") > 0, F.col("truth_n") * F.col("iou"))), total).alias("freq_iou"))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """IoU of two boxes (y1, x1, y2, x2), half-open; 0 if both are empty."""
    h = F.greatest(F.lit(0.0), F.least(a[2], b[2]).cast("double") - F.greatest(a[0], b[0]))
    w = F.greatest(F.lit(0.0), F.least(a[3], b[3]).cast("double") - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]).cast("double") * (x[3] - x[1])
    return F.coalesce(F.try_divide(h * w, area(a) + area(b) - h * w), F.lit(0.0))


def box_overlaps(left: DataFrame, right: DataFrame, key: str, cell: int = 64) -> DataFrame:
    """(key, id_a, id_b, iou) of boxes of one image that overlap: rows (key, id, y1, x1, y2, x2).

    Boxes meet through the grid cells they touch, so boxes far apart never do; a pair is kept in one cell only."""

    def cells(df: DataFrame, side: str) -> DataFrame:
        r = df.select(F.col(key), F.col("id").alias(f"id_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("y1", "x1", "y2", "x2")])
        r = r.where((F.col(f"y2_{side}") > F.col(f"y1_{side}")) & (F.col(f"x2_{side}") > F.col(f"x1_{side}")))
        at = lambda c, off=0: F.floor((F.col(f"{c}_{side}") - off) / cell)
        return r.withColumn("cy", F.explode(F.sequence(at("y1"), at("y2", 1e-9)))).withColumn("cx", F.explode(F.sequence(at("x1"), at("x2", 1e-9))))

    both = cells(left, "a").join(cells(right, "b"), [key, "cy", "cx"])
    first = (F.col("cy") == F.floor(F.greatest("y1_a", "y1_b") / cell)) & (F.col("cx") == F.floor(F.greatest("x1_a", "x1_b") / cell))
    iou = box_iou(*[[F.col(f"{c}_{s}") for c in ("y1", "x1", "y2", "x2")] for s in ("a", "b")])
    return both.where(first).withColumn("iou", iou).where("iou > 0").select(key, "id_a", "id_b", "iou")


def run_intersections(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, id_a, id_b, inter) of masks as runs (key, line, start, len, id) that share pixels of a line."""
    a = left.select(key, "line", F.col("id").alias("id_a"), F.col("start").alias("s_a"), (F.col("start") + F.col("len")).alias("e_a"))
    b = right.select(key, "line", F.col("id").alias("id_b"), F.col("start").alias("s_b"), (F.col("start") + F.col("len")).alias("e_b"))
    n = F.least("e_a", "e_b") - F.greatest("s_a", "s_b")
    return a.join(b, [key, "line"]).withColumn("n", n).where("n > 0").groupBy(key, "id_a", "id_b").agg(F.sum("n").alias("inter"))


def mask_iou(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, id_a, id_b, iou) of masks that share pixels."""
    size = lambda df, s: df.groupBy(key, F.col("id").alias(f"id_{s}")).agg(F.sum("len").alias(f"n_{s}"))
    inter = run_intersections(left, right, key).join(size(left, "a"), [key, "id_a"]).join(size(right, "b"), [key, "id_b"])
    return inter.select(key, "id_a", "id_b", (F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))).alias("iou"))


def nms(boxes: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, id) of boxes (key, id, y1, x1, y2, x2, score) kept by greedy suppression: by falling score (ties by id) each box drops those that overlap it above the threshold."""
    schema = boxes.select(key, "id").schema

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        b = pdf[["y1", "x1", "y2", "x2"]].to_numpy(float)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        left, out = np.arange(len(b)), []
        while len(left):
            i, rest = left[0], left[1:]
            out.append(i)
            h = np.clip(np.minimum(b[i, 2], b[rest, 2]) - np.maximum(b[i, 0], b[rest, 0]), 0, None)
            w = np.clip(np.minimum(b[i, 3], b[rest, 3]) - np.maximum(b[i, 1], b[rest, 1]), 0, None)
            union = area[i] + area[rest] - h * w
            left = rest[np.divide(h * w, union, out=np.zeros_like(union), where=union > 0) <= threshold]
        return pdf.iloc[out][[key, "id"]]

    return boxes.groupBy(key).applyInPandas(keep, schema)


def match_detections(predictions: DataFrame, truth: DataFrame, overlaps_: DataFrame, threshold: float) -> DataFrame:
    """(image_id, id, class_id, score, gt): each prediction's true object or null.

    By falling score a prediction takes the free object of its class it overlaps most, if that reaches the threshold.
    overlaps_: (image_id, id_a prediction, id_b truth, iou)."""
    p = predictions.select("image_id", "id", "class_id", "score")
    t = truth.select("image_id", F.col("id").alias("id_b"), F.col("class_id").alias("class_b"))
    o = overlaps_.join(t, ["image_id", "id_b"]).select("image_id", F.col("id_a").alias("id"), "id_b", "class_b", "iou")
    rows = p.join(o.where(F.col("iou") >= threshold), ["image_id", "id"], "left")
    rows = rows.groupBy("image_id", "id", "class_id", "score").agg(F.collect_list(F.when(F.col("class_b") == F.col("class_id"), F.struct("iou", "id_b"))).alias("options"))
    schema = "image_id bigint, id bigint, class_id int, score double, gt bigint"

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for r in pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            free = sorted((x for x in r.options if x["id_b"] not in used), key=lambda x: (-x["iou"], x["id_b"]))
            gt = free[0]["id_b"] if free else None
            used.add(gt)
            out.append((r.image_id, r.id, r.class_id, r.score, gt))
        return pd.DataFrame(out, columns=["image_id", "id", "class_id", "score", "gt"]).astype({"gt": "Int64"})

    return rows.groupBy("image_id").applyInPandas(greedy, schema)


def average_precision(matched: DataFrame, n_truth: DataFrame) -> DataFrame:
    """(image_id, ap, recall): area under the precision-recall curve, precision made falling from the right. n_truth: (image_id, n)."""
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "id")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = matched.join(n_truth, "image_id").withColumn("hit", F.col("gt").isNotNull().cast("int"))
    x = x.withColumns({"k": F.row_number().over(order), "tp": F.sum("hit").over(run)})
    x = x.withColumn("precision", F.max(F.col("tp") / F.col("k")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return x.groupBy("image_id").agg(F.sum(F.when(F.col("hit") == 1, F.col("precision")).otherwise(0.0) / F.col("n")).alias("ap"), (F.max("tp") / F.max("n")).alias("recall"))


def average_precision_range(predictions: DataFrame, truth: DataFrame, overlaps_: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, image_id, ap, recall) for several thresholds, such as 0.5, 0.55, ..., 0.95."""
    n = truth.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for t in thresholds:
        step = average_precision(match_detections(predictions, truth, overlaps_, t), n).select(F.lit(t).alias("threshold"), "image_id", "ap", "recall")
        out = step if out is None else out.unionByName(step)
    return out


def apply_deltas(box: list[Column], delta: list[Column]) -> list[Column]:
    """Boxes refined by (dy, dx, log dh, log dw)."""
    h, w = box[2] - box[0], box[3] - box[1]
    cy, cx = box[0] + 0.5 * h + delta[0] * h, box[1] + 0.5 * w + delta[1] * w
    nh, nw = h * F.exp(delta[2]), w * F.exp(delta[3])
    return [cy - 0.5 * nh, cx - 0.5 * nw, cy + 0.5 * nh, cx + 0.5 * nw]


def box_deltas(box: list[Column], target: list[Column]) -> list[Column]:
    """The deltas that refine box into target; the inverse of apply_deltas."""
    h, w, th, tw = box[2] - box[0], box[3] - box[1], target[2] - target[0], target[3] - target[1]
    return [(target[0] + 0.5 * th - box[0] - 0.5 * h) / h, (target[1] + 0.5 * tw - box[1] - 0.5 * w) / w, F.log(th / h), F.log(tw / w)]


def norm_box(box: list[Column], height: Column, width: Column) -> list[Column]:
    """Pixel corners (the far ones exclusive) as shares of the image."""
    return [box[0] / (height - 1), box[1] / (width - 1), (box[2] - 1) / (height - 1), (box[3] - 1) / (width - 1)]


def denorm_box(box: list[Column], height: Column, width: Column) -> list[Column]:
    scale = [height - 1, width - 1, height - 1, width - 1]
    return [F.rint(b * s + off).cast("int") for b, s, off in zip(box, scale, (0, 0, 1, 1))]


def depth_errors(df: DataFrame, key: str, truth: str, predicted: str, *, low: float = 1e-3, high: float = 80.0, median_scaling: bool = True) -> DataFrame:
    """(key, ratio, abs_rel, sq_rel, rmse, rmse_log, a1, a2, a3) per image over pixels with a true depth in (low, high)."""
    rows = df.where((F.col(truth) > low) & (F.col(truth) < high)).select(key, F.col(truth).alias("t"), F.col(predicted).alias("p"))
    ratio = rows.groupBy(key).agg((F.percentile("t", F.lit(0.5)) / F.percentile("p", F.lit(0.5))).alias("ratio")) if median_scaling else rows.select(key).distinct().withColumn("ratio", F.lit(1.0))
    x = rows.join(ratio, key).withColumn("p", F.greatest(F.lit(low), F.least(F.lit(high), F.col("p") * F.col("ratio"))))
    t, p = F.col("t"), F.col("p")
    worst = F.greatest(t / p, p / t)
    return x.groupBy(key).agg(
        F.max("ratio").alias("ratio"), F.avg(F.abs(t - p) / t).alias("abs_rel"), F.avg((t - p) * (t - p) / t).alias("sq_rel"), F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        F.sqrt(F.avg(F.pow(F.log(t) - F.log(p), F.lit(2)))).alias("rmse_log"), *[F.avg((worst < 1.25**k).cast("double")).alias(f"a{k}") for k in (1, 2, 3)],
    )


def disparity_to_depth(disparity: Column, low: float = 0.1, high: float = 100.0) -> tuple[Column, Column]:
    """Scaled disparity between 1 / high and 1 / low, and depth."""
    scaled = 1 / high + (1 / low - 1 / high) * disparity
    return scaled, 1 / scaled


def _steady_avg(x: str) -> Column:
    """Average to 12 digits of values from -1 to 1 that doesn't depend on the order of the rows: their first nine digits are summed as integers, exactly.

    Values of more than nine digits add what is left as doubles, others (and nan) are summed as such."""
    v = F.col(x).cast("double")
    whole = F.when(F.abs(v) <= 1, F.rint(v * 1e9).cast("bigint")).otherwise(F.when(v.isNotNull(), 0))
    return F.round((F.sum(whole) / 1e9 + F.sum(v - whole / 1e9)) / F.count(v), 12)


def top_labels(probabilities: DataFrame, key: list[str], group: list[str], k: int) -> DataFrame:
    """(group, label, avg_prob) of the k most probable labels of each pixel (key), averaged over the group; those that round to 0.000 are dropped."""
    order = Window.partitionBy(*key).orderBy(F.desc("prob"), "label")
    top = probabilities.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    return top.groupBy(*group, "label").agg(_steady_avg("prob").alias("avg_prob")).where(F.bround("avg_prob", 3) > 0)


def result_records(detections: DataFrame) -> DataFrame:
    """Detections (image_id, class_id, score, y1, x1, y2, x2) with boxes as x, y, width, height."""
    return detections.select("image_id", F.col("class_id").alias("category_id"), "score", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


def anchors(spark, scales: list[float], ratios: list[float], shapes: list[tuple[int, int]], strides: list[int], anchor_stride: int = 1) -> DataFrame:
    """(level, y1, x1, y2, x2): boxes of each scale's level: every ratio at every anchor_stride-th cell of the level's feature shape."""
    levels = spark.createDataFrame([(i, float(s), h, w, st) for i, (s, (h, w), st) in enumerate(zip(scales, shapes, strides))], "level int, scale double, fh int, fw int, stride int")
    rows = levels.select("*", F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("fh") - 1, F.lit(anchor_stride)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("fw") - 1, F.lit(anchor_stride))))
    h, w, cy, cx = F.col("scale") / F.sqrt("ratio"), F.col("scale") * F.sqrt("ratio"), F.col("i") * F.col("stride"), F.col("j") * F.col("stride")
    return rows.select("level", (cy - 0.5 * h).alias("y1"), (cx - 0.5 * w).alias("x1"), (cy + 0.5 * h).alias("y2"), (cx + 0.5 * w).alias("x2"))


def trim_zeros(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value other than zero in some of the columns."""
    some = F.lit(False)
    for c in columns:
        some = some | (F.coalesce(F.col(c), F.lit(0)) != 0)
    return df.where(some)


def predict(rows: DataFrame, model, schema: str) -> DataFrame:
    """Hook for networks: model maps an iterator of pandas frames to one, on each partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from model(frames)

    return rows.mapInPandas(run, schema)
