"""From a collection to an evaluated summary: parameters, cached stages, methods side by side."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.model import Graphs, cut_graphs
from graphweave.operators import evaluate, matching, mining, prs, prune
from graphweave.operators.mining import Patterns


@dataclass(frozen=True)
class Settings:
    """Parameters of a run. minsup is the share of graphs with edges; the thresholds of the summary are the collection's own."""

    edge_pruning: bool = True
    node_pruning: bool = True
    alg: str = "gspan"
    minsup: float = 0.01
    nsubs: int = 100
    max_edges: int | None = None
    directed: bool = False
    prs_minsup: int | None = None
    min_nodes: int = 2
    coarse: bool = False
    faithful: bool = True

    @property
    def name(self) -> str:
        return mining.experiment_name(self.alg, self.edge_pruning, self.node_pruning, self.minsup if self.alg == "gspan" else None, None if self.alg == "gspan" else self.nsubs)

    @property
    def key(self) -> str:
        """Differs for any difference in the parameters, so that no stage of another run is taken for this one's."""
        return f"{self.name}-{hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]}"


#: The grid of the original experiments: pruning of edges and nodes, miner, support or number of patterns (fixed values).
GRID = tuple(
    Settings(edge_pruning=e, node_pruning=n, alg=a, minsup=m, nsubs=k)
    for e, n, a, m, k in (
        (False, False, "gspan", 0.01, 0), (False, True, "gspan", 0.01, 0), (True, False, "gspan", 0.1, 0), (True, False, "gspan", 0.01, 0),
        (True, False, "subdue", 0, 10), (True, False, "subdue", 0, 100), (True, False, "subdue", 0, 10000), (True, True, "gspan", 0.1, 0),
        (True, True, "gspan", 0.01, 0), (True, True, "gspan", 0.005, 0), (True, True, "gspan", 0.001, 0), (True, True, "subdue", 0, 10000), (True, True, "gspan", 0.05, 0),
    )
)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def stored(spark: SparkSession, path: str | None, make) -> DataFrame:
    """The table at the path, made and written first if it isn't there whole; without a path just made."""
    if path is None:
        return make()
    if not _complete(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _stored_graphs(spark: SparkSession, folder: str | None, make) -> Graphs:
    made: list[Graphs] = []

    def part(name: str):
        def f() -> DataFrame:
            if not made:
                made.append(make())
            return getattr(made[0], name)

        return stored(spark, folder and f"{folder}/{name}", f)

    return Graphs(part("graphs"), part("nodes"), part("edges"))


def prepare(g: Graphs, s: Settings, folder: str | None = None) -> Graphs:
    """The graphs as they are mined and covered, kept below the folder."""
    spark = g.graphs.sparkSession

    def make() -> Graphs:
        h = Graphs(g.graphs, g.nodes, prune.coarse_positions(g.edges)) if s.coarse else g
        h = cut_graphs(h)
        return prune.prepare(h, prs.build(h.triples()), s.edge_pruning, s.node_pruning, s.prs_minsup)

    return _stored_graphs(spark, folder and f"{folder}/{s.key}/prepared", make)


def summarise(g: Graphs, s: Settings, folder: str | None = None) -> tuple[Graphs, Patterns]:
    """(prepared graphs, patterns with at least min_nodes nodes)."""
    prepared = cut_graphs(prepare(g, s, folder))
    if s.alg == "gspan":
        return prepared, mining.frequent_subgraphs(prepared, mining.least_support(prepared, s.minsup), max_edges=s.max_edges, directed=s.directed, min_nodes=s.min_nodes)
    if s.alg == "subdue":
        return prepared, mining.compressing_subgraphs(prepared, s.nsubs, max_edges=s.max_edges)
    raise ValueError(f"unknown miner {s.alg}")


def evaluate_run(g: Graphs, s: Settings, ks: list[int | None] = [None], folder: str | None = None) -> DataFrame:
    """One row a k: the parameters and the measures of the k patterns of greatest support (None: of all)."""
    prepared, p = summarise(g, s, folder)
    spark = g.graphs.sparkSession
    cells = stored(spark, folder and f"{folder}/{s.key}/coverage", lambda: matching.coverage(prepared, p.nodes, p.edges, min_nodes=s.min_nodes, faithful=s.faithful))
    out = None
    for k in ks:
        row = evaluate.summary(prepared, p.patterns, p.nodes, p.edges, cells, k)
        row = row.select(F.lit(s.name).alias("run"), F.lit(s.minsup).alias("minsup"), F.lit(s.alg).alias("alg"), F.lit(k).cast("int").alias("k"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def grid(g: Graphs, runs: tuple[Settings, ...], folder: str | None = None, **changes) -> DataFrame:
    """The evaluation rows of several runs under each other."""
    out = None
    for s in runs:
        row = evaluate_run(g, replace(s, **changes), folder=folder)
        out = row if out is None else out.unionByName(row)
    return out


def image_summary(g: Graphs, s: Settings, method: str = "mean") -> Graphs:
    """The graphs that represent the patterns, pruned like the collection: their count of nodes is that of the raw graphs."""
    prepared, p = summarise(g, s)
    cells = matching.coverage(prepared, p.nodes, p.edges, min_nodes=s.min_nodes, faithful=s.faithful)
    sizes = g.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return evaluate.represented_graphs(prepared, evaluate.represent(cells, sizes, method))


def medoid_graphs(g: Graphs, medoids: DataFrame) -> Graphs:
    """The graphs of medoid images: medoids has a column medoid of graph ids."""
    chosen = medoids.select(F.col("medoid").alias("graph_id")).distinct()
    keep = lambda df: df.join(F.broadcast(chosen), "graph_id", "left_semi")
    return Graphs(keep(g.graphs), keep(g.nodes), keep(g.edges))


def as_patterns(g: Graphs) -> Patterns:
    """Graphs as a summary, each its own pattern with support 1."""
    patterns = g.graphs.select(F.col("graph_id").alias("pattern_id"), F.lit(1).cast("bigint").alias("sup"))
    nodes = g.nodes.select(F.col("graph_id").alias("pattern_id"), F.col("node_id").alias("node"), "label")
    return Patterns(patterns, nodes, g.edges.select(F.col("graph_id").alias("pattern_id"), "s", "pos", "r"))
