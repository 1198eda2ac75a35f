"""Pruning and projecting collections of graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.model import COARSE, Graphs, cut_graphs
from graphweave.operators.keys import dense_ids
from graphweave.operators.prs import filter_prs, likelihood, pairs
from graphweave.session import cut, lookup



def edge_pruning(g: Graphs, prs: DataFrame) -> Graphs:
    """Edges whose pair has a histogram in prs; a graph that lost an edge keeps only nodes that still have one.

    A graph that lost nothing keeps its isolated nodes; one that lost everything stays in the collection, empty. An
    edge whose position has likelihood 0 in the histogram is kept."""
    triples = g.triples()
    kept = triples.join(pairs(prs).select("subj", "ref"), ["subj", "ref"], "left_semi")
    before = g.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("had"))
    after = kept.groupBy("graph_id").agg(F.count(F.lit(1)).alias("has"))
    lost = before.join(after, "graph_id", "left").where(F.col("had") > F.coalesce("has", F.lit(0))).select("graph_id")
    ends = kept.select("graph_id", F.col("s").alias("node_id")).unionByName(kept.select("graph_id", F.col("r").alias("node_id"))).distinct()
    marked = g.nodes.join(lost.withColumn("__lost", F.lit(True)), "graph_id", "left").join(ends.withColumn("__end", F.lit(True)), ["graph_id", "node_id"], "left")
    nodes = marked.where(F.col("__lost").isNull() | F.col("__end").isNotNull()).select("graph_id", "node_id", "label")
    return Graphs(g.graphs, nodes, kept.select("graph_id", "s", "pos", "r"))


def edge_stats(before: Graphs, after: Graphs) -> DataFrame:
    """One row (graphs, avg_before, avg_after): mean edges a graph, graphs without edges counted."""
    n = before.graphs.agg(F.count(F.lit(1))).scalar()
    b, a = before.edges.agg(F.count(F.lit(1))).scalar(), after.edges.agg(F.count(F.lit(1))).scalar()
    one = before.graphs.sparkSession.range(1)
    return one.select(n.alias("graphs"), F.try_divide(b, n).alias("avg_before"), F.try_divide(a, n).alias("avg_after"))


def node_descriptions(g: Graphs) -> DataFrame:
    """nodes with description: the sorted set of (direction, position, label at the other end); empty for isolated nodes."""
    t = g.triples()
    out = t.select("graph_id", F.col("s").alias("node_id"), F.struct(F.lit("out").alias("dir"), "pos", F.col("ref").alias("label")).alias("d"))
    into = t.select("graph_id", F.col("r").alias("node_id"), F.struct(F.lit("in").alias("dir"), "pos", F.col("subj").alias("label")).alias("d"))
    sets = out.unionByName(into).groupBy("graph_id", "node_id").agg(F.array_sort(F.collect_set("d")).alias("description"))
    return g.nodes.join(sets, ["graph_id", "node_id"], "left").withColumn("description", F.coalesce("description", F.array().cast("array<struct<dir:string,pos:string,label:string>>")))


def node_pruning(g: Graphs) -> Graphs:
    """Of nodes of one graph with equal label and description the last stays; edges of the others go.

    Descriptions come from the unpruned graph, so a second pass may prune more."""
    alike = F.md5(F.to_json("description")).alias("alike")  # 128 bits in place of the array
    last = node_descriptions(g).select("graph_id", "label", "node_id", alike).groupBy("graph_id", "label", "alike").agg(F.max("node_id").alias("node_id"))
    nodes = last.select("graph_id", "node_id", "label")
    ids = nodes.select("graph_id", "node_id")
    edges = g.edges.join(ids.withColumnRenamed("node_id", "s"), ["graph_id", "s"], "left_semi").join(ids.withColumnRenamed("node_id", "r"), ["graph_id", "r"], "left_semi")
    return Graphs(g.graphs, nodes, edges.select("graph_id", "s", "pos", "r"))


def node_stats(before: Graphs, after: Graphs) -> DataFrame:
    """One row (avg_before, avg_after, removed, removed_pct)."""
    n = before.graphs.agg(F.count(F.lit(1))).scalar()
    b, a = before.nodes.agg(F.count(F.lit(1))).scalar(), after.nodes.agg(F.count(F.lit(1))).scalar()
    one = before.graphs.sparkSession.range(1).select(n.alias("n"), b.alias("b"), a.alias("a"))
    return one.select(
        F.try_divide(F.col("b"), F.col("n")).alias("avg_before"), F.try_divide(F.col("a"), F.col("n")).alias("avg_after"),
        (F.col("b") - F.col("a")).alias("removed"), F.try_divide(100.0 * (F.col("b") - F.col("a")), F.col("b")).alias("removed_pct"),
    )


def prepare(g: Graphs, prs: DataFrame, edges: bool = True, nodes: bool = True, minsup: int | None = None) -> Graphs:
    """Graphs as the miner takes them. Without edge pruning the entropy ceiling is lifted, the support filter still holds."""
    kept = filter_prs(prs, minsup) if edges else filter_prs(prs, minsup, 100.0)
    out = edge_pruning(g, cut(kept))
    return node_pruning(cut_graphs(out)) if nodes else out


def label_subset(g: Graphs, labels: list[str]) -> Graphs:
    """The subgraphs induced by nodes with these labels, of the graphs that hold all of them."""
    wanted = g.nodes.where(F.col("label").isin(labels))
    full = wanted.groupBy("graph_id").agg(F.countDistinct("label").alias("k")).where(F.col("k") == len(set(labels))).select("graph_id")
    nodes = wanted.join(full, "graph_id", "left_semi")
    ids = nodes.select("graph_id", "node_id")
    edges = g.edges.join(ids.withColumnRenamed("node_id", "s"), ["graph_id", "s"], "left_semi").join(ids.withColumnRenamed("node_id", "r"), ["graph_id", "r"], "left_semi")
    return Graphs(full, nodes.select("graph_id", "node_id", "label"), edges.select("graph_id", "s", "pos", "r"))


def best_pair_likelihood(g: Graphs, prs: DataFrame, subj: str, ref: str) -> DataFrame:
    """(graph_id, best): greatest likelihood of an edge of this pair in each graph, -1 if it has none with a histogram."""
    own = likelihood(g.triples().where((F.col("subj") == subj) & (F.col("ref") == ref)), prs)
    best = own.groupBy("graph_id").agg(F.max("likelihood").alias("best"))
    return g.graphs.join(best, "graph_id", "left").select("graph_id", F.coalesce("best", F.lit(-1.0)).alias("best"))


def label_frequency(nodes: DataFrame) -> DataFrame:
    """(label, nodes, graphs); counts are combined map-side, so a frequent label is no hot spot."""
    per = nodes.groupBy("label", "graph_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("label").agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("graphs"))


def more_than(nodes: DataFrame, label: str, k: int) -> DataFrame:
    """graph_ids with more than k nodes of a label."""
    return nodes.where(F.col("label") == label).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("graph_id")


def clean_class(label: Column) -> Column:
    """Class name without its merge suffix."""
    return F.regexp_replace(label, "(-other)?-merged$", "")


def coarse_positions(edges: DataFrame) -> DataFrame:
    """Edges with above and side-up made higher, below and side-down made lower."""
    names = F.create_map(*[F.lit(x) for kv in COARSE.items() for x in kv])
    return edges.withColumn("pos", F.coalesce(F.element_at(names, F.col("pos")), F.col("pos")))


def evenly_spaced(df: DataFrame, order: str, most: int = 500) -> DataFrame:
    """All rows if they are at most so many, else that many at equal distances by order (unique), the first and last among them.

    The places are those of as many evenly spaced points from the first to the last row, rounded (half to even)."""
    numbered = dense_ids(df, [F.asc(order)], "__at")
    n = df.count()
    if n <= most:
        return numbered.drop("__at")
    places = np.unique(np.round(np.linspace(0, n - 1, most)).astype(np.int64)).tolist()
    wanted = df.sparkSession.createDataFrame([(p,) for p in places], "__at bigint")
    return lookup(numbered, wanted, ["__at"], len(places), "left_semi").drop("__at")


def positive_relationships(triples: DataFrame, prs: DataFrame, threshold: float) -> DataFrame:
    """Edges whose position has a likelihood above the threshold."""
    return likelihood(triples, prs).where(F.col("likelihood") > threshold)
