"""The scene graphs of the tables nodes and edges as a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.terms import term
from graphweave.model import Graphs


def delivered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as delivered: labels and positions in normal form, null where there is none."""
    nodes = spark.read.parquet(f"{d}/nodes.parquet").select("graph_id", "node_id", term("label").alias("label"))
    edges = spark.read.parquet(f"{d}/edges.parquet").select("graph_id", "s", "r", "loaded_at", F.replace(term("pos"), F.lit(" "), F.lit("-")).alias("pos"))
    return nodes, edges


def load(spark: SparkSession, d: str) -> Graphs:
    """Labels and positions in normal form; nodes without label and edges without position or end are left out.

    Deliveries count once; of several positions between two nodes the last delivered stays, ties to the greatest name."""
    nodes, edges = delivered(spark, d)
    graphs = nodes.select("graph_id").distinct()
    nodes = nodes.where(F.col("label").isNotNull()).distinct()
    edges = edges.where(F.col("pos").isNotNull()).groupBy("graph_id", "s", "r").agg(F.max_by("pos", F.struct("loaded_at", "pos")).alias("pos"))
    ids = nodes.select("graph_id", "node_id")
    edges = edges.join(ids.withColumnRenamed("node_id", "s"), ["graph_id", "s"], "left_semi").join(ids.withColumnRenamed("node_id", "r"), ["graph_id", "r"], "left_semi")
    return Graphs(graphs, nodes, edges.select("graph_id", "s", "pos", "r"))


_TERM = "nullif(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), '')"
#: The same collection in SQL: tables g, n, e and t (edges with labels).
SQL = f"""g AS (SELECT DISTINCT graph_id FROM nodes),
    n AS (SELECT DISTINCT graph_id, node_id, {_TERM.format('label')} label FROM nodes WHERE {_TERM.format('label')} IS NOT NULL),
    e0 AS (SELECT graph_id, s, r, loaded_at, replace({_TERM.format('pos')}, ' ', '-') pos FROM edges),
    e1 AS (SELECT graph_id, s, r, arg_max(pos, (loaded_at, pos)) pos FROM e0 WHERE pos IS NOT NULL GROUP BY ALL),
    t AS (SELECT e1.graph_id, s, a.label subj, pos, b.label ref, r FROM e1 JOIN n a ON a.graph_id = e1.graph_id AND a.node_id = s JOIN n b ON b.graph_id = e1.graph_id AND b.node_id = r),
    e AS (SELECT graph_id, s, pos, r FROM t),
    h AS (SELECT subj, ref, pos, count(*) n FROM t GROUP BY ALL),
    p0 AS (SELECT *, sum(n) OVER (PARTITION BY subj, ref)::BIGINT sup, n / sum(n) OVER (PARTITION BY subj, ref) likelihood FROM h),
    prs AS (SELECT *, -sum(likelihood * log2(likelihood)) OVER (PARTITION BY subj, ref) + 0.0 entropy FROM p0),
    pairs AS (SELECT DISTINCT subj, ref, sup, round(entropy, 12) entropy FROM prs),
    th AS (SELECT round_even(pow(10, median(log10(sup))), 0)::BIGINT minsup, {{ceiling}} max_entropy FROM pairs),
    f AS (SELECT prs.* FROM prs, th WHERE sup >= minsup AND entropy <= max_entropy + 1e-12)"""
