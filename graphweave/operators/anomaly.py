"""Anomalies: links and objects that contradict the pairwise summary, set against segment statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.model import Graphs
from graphweave.operators.prs import likelihood


def pair_anomalies(g: Graphs, prs: DataFrame, status: DataFrame) -> DataFrame:
    """(graph_id, s, r, class, likelihood, sup, entropy) of each edge; the last three are null without a histogram.

    status has rows (graph_id, node_id, status) with fp or tp. The first that holds: both_fp, both_tp, tp_fp, fp_ignored
    (one fp, the other unknown), ignored."""
    t = likelihood(g.triples(), prs)
    a, b = (status.select("graph_id", F.col("node_id").alias(c), F.col("status").alias(f"st_{c}")) for c in ("s", "r"))
    t = t.join(a, ["graph_id", "s"], "left").join(b, ["graph_id", "r"], "left")
    x, y = F.coalesce("st_s", F.lit("")), F.coalesce("st_r", F.lit(""))
    kind = (
        F.when((x == "fp") & (y == "fp"), "both_fp").when((x == "tp") & (y == "tp"), "both_tp")
        .when(((x == "tp") & (y == "fp")) | ((x == "fp") & (y == "tp")), "tp_fp").when((x == "fp") | (y == "fp"), "fp_ignored").otherwise("ignored")
    )
    return t.select("graph_id", "s", "r", kind.alias("class"), "likelihood", "sup", "entropy")


def pair_report(anomalies: DataFrame) -> DataFrame:
    """(class, links, no_histogram, avg_likelihood): by class; averages are over links with a histogram."""
    return anomalies.groupBy("class").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("likelihood").isNull()).alias("no_histogram"), F.avg("likelihood").alias("avg_likelihood"))


def object_anomalies(g: Graphs, prs: DataFrame, status: DataFrame, threshold: float) -> DataFrame:
    """(graph_id, node_id, status, n_links, n_anom, anom_pct, avg_likelihood) of each node that is fp or tp (fp goes first).

    Links without histogram are skipped; a link is anomalous below the threshold; 0 without links."""
    t = likelihood(g.triples(), prs).where(F.col("likelihood").isNotNull())
    ends = t.select("graph_id", F.col("s").alias("node_id"), "likelihood").unionByName(t.select("graph_id", F.col("r").alias("node_id"), "likelihood"))
    per = ends.groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("likelihood") < threshold).alias("n_anom"), F.avg("likelihood").alias("avg_likelihood"))
    one = status.groupBy("graph_id", "node_id").agg(F.min("status").alias("status"))
    out = g.nodes.select("graph_id", "node_id").join(one, ["graph_id", "node_id"]).join(per, ["graph_id", "node_id"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_links", "n_anom")})
    return out.select("graph_id", "node_id", "status", "n_links", "n_anom", F.coalesce(F.try_divide(100.0 * F.col("n_anom"), F.col("n_links")), F.lit(0.0)).alias("anom_pct"), F.coalesce("avg_likelihood", F.lit(0.0)).alias("avg_likelihood"))


def threshold_curve(scores: DataFrame, score: str, positive: str, low: float = 0.0, high: float = 0.2, steps: int = 1000) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) of calling a row positive below the threshold, for steps thresholds in [low, high).

    Rows are first counted by the first threshold that reaches them, so the data is read once; null scores are ignored."""
    from pyspark.sql import Window

    spark = scores.sparkSession
    width = (high - low) / steps
    rows = scores.where(F.col(score).isNotNull()).select(F.col(score).alias("x"), F.col(positive).alias("y"))
    # called positive from threshold number k on, where low + k * width > x; what differs from a threshold by rounding only is equal to it
    step = F.greatest(F.lit(0), F.floor(F.round((F.col("x") - low) / width, 9)).cast("int") + 1)
    step = F.when(F.col("x") < low, 0).otherwise(step)
    counts = rows.groupBy(step.alias("k")).agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    total = rows.agg(F.count_if("y")).scalar()
    grid = spark.range(steps).select(F.col("id").cast("int").alias("k"))
    below = counts.where(F.col("k") < steps)
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # as many rows as thresholds
    curve = grid.join(below, "k", "left").na.fill(0, ["p", "n"]).select("k", F.sum("p").over(upto).alias("tp"), F.sum("n").over(upto).alias("fp")).withColumn("fn", total - F.col("tp"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    curve = curve.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return curve.select((F.lit(low) + F.col("k") * width).alias("threshold"), "tp", "fp", "fn", "precision", "recall", f1.alias("f1"))


def at_share(objects: DataFrame, share: float) -> DataFrame:
    """One row (recall, precision) of calling objects false positives where at least this share (in %) of the links is anomalous."""
    called, fp = F.col("anom_pct") >= share, F.col("status") == "fp"
    return objects.agg(F.try_divide(F.count_if(called & fp), F.count_if(fp)).alias("recall"), F.try_divide(F.count_if(called & fp), F.count_if(called)).alias("precision"))
