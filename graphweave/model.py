"""The data model: collections of labelled scene graphs as flat tables, and their nested form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.session import cut

#: Relative positions of an edge (fixed values).
POSITIONS = ("above", "below", "side", "side-up", "side-down", "on", "hanging", "inside", "around")
#: Coarser positions; the others stay as they are (fixed values).
COARSE = {"above": "higher", "side-up": "higher", "below": "lower", "side-down": "lower"}

NODE = "struct<id:bigint,label:string>"
LINK = "struct<s:bigint,r:bigint,pos:string>"
GRAPH = f"struct<directed:boolean,multigraph:boolean,graph:struct<name:bigint>,nodes:array<{NODE}>,links:array<{LINK}>>"


@dataclass(frozen=True)
class Graphs:
    """nodes(graph_id, node_id, label), edges(graph_id, s, pos, r); node_id is also the order of a graph's nodes.

    graphs(graph_id) lists all graphs, so that graphs without nodes or edges stay part of the collection."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def triples(self) -> DataFrame:
        """Edges with the labels of both ends: graph_id, s, subj, pos, ref, r. Edges without node at an end are left out."""
        a = self.nodes.select("graph_id", F.col("node_id").alias("s"), F.col("label").alias("subj"))
        b = self.nodes.select("graph_id", F.col("node_id").alias("r"), F.col("label").alias("ref"))
        return self.edges.join(a, ["graph_id", "s"]).join(b, ["graph_id", "r"]).select("graph_id", "s", "subj", "pos", "ref", "r")


def cut_graphs(g: Graphs) -> Graphs:
    """The same tables computed and written to the shared folder: later steps read them several times."""
    return Graphs(cut(g.graphs), cut(g.nodes), cut(g.edges))


def nest(g: Graphs) -> DataFrame:
    """One row per graph in the nested node-link form; a graph's own nodes and links are gathered, in order."""
    nodes = g.nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").cast("bigint").alias("id"), "label"))).alias("nodes"))
    links = g.edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("bigint").alias("s"), F.col("r").cast("bigint").alias("r"), "pos"))).alias("links"))
    out = g.graphs.join(nodes, "graph_id", "left").join(links, "graph_id", "left")
    return out.select(
        F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), F.struct(F.col("graph_id").cast("bigint").alias("name")).alias("graph"),
        F.coalesce("nodes", F.array().cast(f"array<{NODE}>")).alias("nodes"), F.coalesce("links", F.array().cast(f"array<{LINK}>")).alias("links"),
    )


def flatten_graphs(df: DataFrame) -> Graphs:
    """Flat tables of graphs in the nested form. Parallel links between two nodes collapse, the last one stays."""
    graphs = df.select(F.col("graph.name").alias("graph_id")).distinct()
    nodes = df.select(F.col("graph.name").alias("graph_id"), F.explode("nodes").alias("n")).select("graph_id", F.col("n.id").alias("node_id"), "n.label")
    links = df.select(F.col("graph.name").alias("graph_id"), F.posexplode("links").alias("at", "l"))
    links = links.groupBy("graph_id", F.col("l.s").alias("s"), F.col("l.r").alias("r")).agg(F.max_by("l.pos", "at").alias("pos"))
    return Graphs(graphs, nodes.distinct(), links.select("graph_id", "s", "pos", "r"))
