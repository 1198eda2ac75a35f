"""Panoptic segments: ids as colours, merging of masks, and panoptic quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of pixels without segment and of the class of pixels without class.
VOID = 0


def rgb_to_id(r: Column, g: Column, b: Column) -> Column:
    return r.cast("bigint") + g.cast("bigint") * 256 + b.cast("bigint") * 65536


def id_to_rgb(c: Column) -> list[Column]:
    return [F.pmod(c, F.lit(256)), F.pmod(F.shiftright(c, 8), F.lit(256)), F.pmod(F.shiftright(c, 16), F.lit(256))]


def check_ids(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """(image_id, segment_id, problem): ids in the raster but not among the segments, and the converse."""
    drawn = pixels.where(F.col("segment_id") != VOID).select("image_id", "segment_id").distinct()
    known = segments.select("image_id", "segment_id").distinct()
    a = drawn.join(known, ["image_id", "segment_id"], "left_anti").withColumn("problem", F.lit("not in segments"))
    return a.unionByName(known.join(drawn, ["image_id", "segment_id"], "left_anti").withColumn("problem", F.lit("not in raster")))


def overlaps(pairs: DataFrame) -> DataFrame:
    """(image_id, gt, pred, inter) from rows (image_id, gt, pred, n): runs or pixels of both rasters laid over each other."""
    return pairs.groupBy("image_id", "gt", "pred").agg(F.sum("n").alias("inter"))


def segment_status(inter: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(image_id, category_id, kind, segment_id, iou) with kind tp, fp, fn or ignored.

    inter: (image_id, gt, pred, inter) with 0 for void. truth: (image_id, segment_id, category_id, area, iscrowd);
    predicted: (image_id, segment_id, category_id). A pair is tp if the categories agree, the true segment is no crowd
    and the intersection over union (without the part on void) is above one half. fn are unmatched true segments that
    are no crowd; unmatched predictions are ignored if more than half lies on void and on crowds of their category (of
    several crowds of a category in an image the last by id counts), else fp."""
    area = inter.where(F.col("pred") != VOID).groupBy("image_id", "pred").agg(F.sum("inter").alias("p_area"), F.sum(F.when(F.col("gt") == VOID, F.col("inter")).otherwise(0)).alias("on_void"))
    t = truth.select("image_id", F.col("segment_id").alias("gt"), F.col("category_id").alias("gt_cat"), F.col("area").alias("g_area"), "iscrowd")
    p = predicted.select("image_id", F.col("segment_id").alias("pred"), F.col("category_id").alias("pred_cat")).join(area, ["image_id", "pred"], "left")
    pairs = inter.where((F.col("gt") != VOID) & (F.col("pred") != VOID)).join(t, ["image_id", "gt"]).join(p, ["image_id", "pred"])
    union = F.col("p_area") + F.col("g_area") - F.col("inter") - F.col("on_void")
    tp = pairs.where((F.col("gt_cat") == F.col("pred_cat")) & (F.col("iscrowd") == 0)).withColumn("iou", F.col("inter") / union).where(F.col("iou") > 0.5)
    matched_g, matched_p = tp.select("image_id", "gt"), tp.select("image_id", "pred")
    fn = t.where(F.col("iscrowd") == 0).join(matched_g, ["image_id", "gt"], "left_anti")
    crowd = t.where(F.col("iscrowd") == 1).groupBy("image_id", F.col("gt_cat").alias("pred_cat")).agg(F.max("gt").alias("gt"))
    left = p.join(matched_p, ["image_id", "pred"], "left_anti").join(crowd, ["image_id", "pred_cat"], "left").join(inter, ["image_id", "gt", "pred"], "left")
    ignored = F.try_divide(F.col("on_void") + F.coalesce("inter", F.lit(0)), F.col("p_area")) > 0.5
    left = left.withColumn("kind", F.when(ignored, "ignored").otherwise("fp"))
    none = F.lit(None).cast("double").alias("iou")
    return (
        tp.select("image_id", F.col("gt_cat").alias("category_id"), F.lit("tp").alias("kind"), F.col("pred").alias("segment_id"), "iou")
        .unionByName(fn.select("image_id", F.col("gt_cat").alias("category_id"), F.lit("fn").alias("kind"), F.col("gt").alias("segment_id"), none))
        .unionByName(left.select("image_id", F.col("pred_cat").alias("category_id"), "kind", F.col("pred").alias("segment_id"), none))
    )


def _measures(df: DataFrame, keys: list[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.sum(F.coalesce("iou", F.lit(0.0))).alias("iou"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")]).where("tp + fp + fn > 0")
    both = F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")
    zero = F.lit(0.0)
    return counts.select(
        *keys, "tp", "fp", "fn", (F.col("iou") / both).alias("pq"), F.coalesce(F.try_divide(F.col("iou"), F.col("tp")), zero).alias("sq"), (F.col("tp") / both).alias("rq"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero).alias("recall"),
    )


def quality_by_category(status: DataFrame) -> DataFrame:
    """(category_id, tp, fp, fn, pq, sq, rq, precision, recall) of categories with data; partial counts merge map-side."""
    return _measures(status, ["category_id"])


def quality_by_image(status: DataFrame) -> DataFrame:
    """(image_id, tp, fp, fn, pq, sq, rq): means over the image's categories with data; counts are sums."""
    per = _measures(status, ["image_id", "category_id"])
    return per.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(c) for c in ("pq", "sq", "rq")])


def quality_report(by_category: DataFrame, categories: DataFrame) -> DataFrame:
    """(part, pq, sq, rq, precision, recall, n): means over categories with data for all, things and stuff."""
    rows = by_category.join(categories.select(F.col("id").alias("category_id"), "isthing"), "category_id")
    rows.createOrReplaceTempView("__quality")
    measures = ", ".join(f"avg({c}) AS {c}" for c in ("pq", "sq", "rq", "precision", "recall"))
    part = "CASE WHEN grouping(isthing) = 1 THEN 'all' WHEN isthing = 1 THEN 'things' ELSE 'stuff' END"
    return rows.sparkSession.sql(f"SELECT {part} AS part, {measures}, count(*) AS n FROM __quality GROUP BY GROUPING SETS ((isthing), ()) HAVING count(*) > 0")


def false_positives(status: DataFrame, categories: DataFrame) -> DataFrame:
    """(image_id, segment_id, category_id, name, r, g, b): false positives with category and colour of their id."""
    fp = status.where(F.col("kind") == "fp").join(categories.select(F.col("id").alias("category_id"), "name"), "category_id")
    r, g, b = id_to_rgb(F.col("segment_id"))
    return fp.select("image_id", "segment_id", "category_id", "name", r.alias("r"), g.alias("g"), b.alias("b"))


def merge_masks(detections: DataFrame, stuff: DataFrame, *, things: list[int], void: int = 183, least_stuff: int = 4096, most_overlap: float = 0.5, by_area: bool = False) -> DataFrame:
    """(image_id, segment_id, category_id, area, runs) of each image's merged segments.

    detections: (image_id, ord, category_id, runs), stuff: (image_id, category_id, runs); runs are arrays of
    struct<start, len> over the flattened image. In order (by_area: larger ones first) a detection is skipped if it is
    empty or more than most_overlap of it is taken, else it gets its free pixels; detections left without pixels are
    dropped. Then each stuff class that is neither void nor a thing gets its free pixels if these are at least
    least_stuff. Ids count from 1 per image. Sequential by nature: one Python call per image."""
    kind = "image_id bigint, segment_id int, category_id int, area bigint, runs array<struct<start:bigint,len:bigint>>"

    def expand(runs) -> np.ndarray:
        return np.concatenate([np.arange(x["start"], x["start"] + x["len"]) for x in runs]) if runs is not None and len(runs) else np.empty(0, np.int64)

    def runs_of(px: np.ndarray) -> list[dict]:
        if not len(px):
            return []
        px = np.sort(px)
        first = np.flatnonzero(np.concatenate([[True], np.diff(px) != 1]))
        size = np.diff(np.concatenate([first, [len(px)]]))
        return [{"start": int(px[f]), "len": int(n)} for f, n in zip(first, size)]

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, used = [], np.empty(0, np.int64)
        rows = [(r, np.unique(expand(r["runs"]))) for r in pdf.to_dict("records")]
        found = [x for x in rows if not x[0]["is_stuff"]]
        found.sort(key=(lambda x: (-len(x[1]), x[0]["ord"])) if by_area else (lambda x: x[0]["ord"]))
        for r, px in found:
            taken = np.isin(px, used)
            if not len(px) or taken.mean() > most_overlap:
                continue
            used = np.union1d(used, px)
            free = px[~taken]
            if len(free):
                out.append((r["category_id"], free))
        for r, px in sorted((x for x in rows if x[0]["is_stuff"] and x[0]["category_id"] != void and x[0]["category_id"] not in things), key=lambda x: x[0]["category_id"]):
            free = px[~np.isin(px, used)]
            if len(free) and len(free) >= least_stuff:
                used = np.union1d(used, free)
                out.append((r["category_id"], free))
        return pd.DataFrame([(key[0], i + 1, int(c), len(px), runs_of(px)) for i, (c, px) in enumerate(out)], columns=["image_id", "segment_id", "category_id", "area", "runs"])

    common = [F.col("image_id").cast("bigint").alias("image_id")]
    both = detections.select(*common, F.col("ord").cast("bigint").alias("ord"), F.col("category_id").cast("int").alias("category_id"), "runs", F.lit(False).alias("is_stuff"))
    both = both.unionByName(stuff.select(*common, F.lit(0).cast("bigint").alias("ord"), F.col("category_id").cast("int").alias("category_id"), "runs", F.lit(True).alias("is_stuff")))
    return both.groupBy("image_id").applyInPandas(merge, kind)


def assign_ids(segments: DataFrame, categories: DataFrame) -> DataFrame:
    """segments with segment_id: the id of the category's colour for its first segment in an image, then the next ids free there.

    segments: (image_id, ord, category_id). A definite rule in place of random colours near the category's."""
    from pyspark.sql import Window

    base = F.col("color")[0].cast("bigint") + F.col("color")[1].cast("bigint") * 256 + F.col("color")[2].cast("bigint") * 65536
    rows = segments.join(categories.select(F.col("id").alias("category_id"), base.alias("base")), "category_id")
    # ids rise by base; one that is taken by the row before moves up behind it
    order = Window.partitionBy("image_id").orderBy("base", "ord")
    k = F.row_number().over(order)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("__k", k).withColumn("segment_id", F.col("__k") + F.max(F.col("base") - F.col("__k")).over(run)).select(*segments.columns, "segment_id")
