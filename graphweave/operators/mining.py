"""Frequent subgraphs by level-wise edge growth over a table of embeddings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.model import Graphs
from graphweave.operators.keys import dense_ids
from graphweave.session import BROADCAST_ROWS, cut

_EDGE = "struct<id:bigint,s:bigint,r:bigint,subj:string,pos:string,ref:string>"


@dataclass(frozen=True)
class Patterns:
    """patterns(pattern_id, code, sup, n_nodes, n_edges), nodes(pattern_id, node, label), edges(pattern_id, s, pos, r).

    pattern_id orders by falling support, ties by code."""

    patterns: DataFrame
    nodes: DataFrame
    edges: DataFrame


def canonical(raw: str, directed: bool) -> str:
    """The same text for isomorphic labelled graphs, given as JSON [[i, label, pos, j, label], ...]: [labels, [[i, pos, j], ...]].

    Nodes are numbered by label; among equal labels by refining colours through their neighbours until nothing changes;
    where nodes still are alike, each is tried as the first (of nodes with the same neighbours one), and the least form
    stays. Without direction an edge goes from the lower to the higher number."""
    edges = json.loads(raw)
    labels, near = {}, {}
    for i, a, p, j, b in edges:
        labels[i], labels[j] = a, b
        near.setdefault(i, []).append((1 if directed else 0, p, j))
        near.setdefault(j, []).append((-1 if directed else 0, p, i))

    def ranked(key: dict) -> dict:
        order = {k: i for i, k in enumerate(sorted(set(key.values())))}
        return {n: order[k] for n, k in key.items()}

    def refined(colour: dict) -> dict:
        while True:
            finer = ranked({n: (colour[n], tuple(sorted((d, p, colour[m]) for d, p, m in near[n]))) for n in colour})
            if len(set(finer.values())) == len(set(colour.values())):
                return finer
            colour = finer

    def least(colour: dict) -> list:
        cells: dict = {}
        for n, c in colour.items():
            cells.setdefault(c, []).append(n)
        alike = next((cells[c] for c in sorted(cells) if len(cells[c]) > 1), None)
        if alike is None:
            return sorted([colour[i], p, colour[j]] if directed or colour[i] < colour[j] else [colour[j], p, colour[i]] for i, _, p, j, _ in edges)
        first = {tuple(sorted(near[n])): n for n in alike}.values()
        return min(least(refined(ranked({m: (c, m != n) for m, c in colour.items()}))) for n in first)

    return json.dumps([sorted(labels.values()), least(refined(ranked(labels)))], separators=(",", ":"), ensure_ascii=False)


def _canonise(directed: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"raw": pdf["raw"], "code": [canonical(x, directed) for x in pdf["raw"]]})

    return run


def _raw(edges: Column) -> Column:
    """The labelled structure of an embedding, its nodes numbered by label and id; equal for many embeddings of a pattern."""
    ends = F.flatten(F.transform(edges, lambda e: F.array(F.struct(e["subj"].alias("label"), e["s"].alias("n")), F.struct(e["ref"].alias("label"), e["r"].alias("n")))))
    order = F.array_sort(F.array_distinct(ends))
    place = lambda label, n: F.array_position(order, F.struct(label.alias("label"), n.alias("n"))).cast("int")
    rows = F.transform(edges, lambda e: F.struct(place(e["subj"], e["s"]).alias("i"), e["subj"], e["pos"], place(e["ref"], e["r"]).alias("j"), e["ref"]))
    return F.to_json(F.transform(F.array_sort(rows), lambda x: F.array(x["i"].cast("string"), x["subj"], x["pos"], x["j"].cast("string"), x["ref"])))


def _coded(emb: DataFrame, directed: bool) -> DataFrame:
    """Embeddings with canonical codes; Python sees only the distinct structures."""
    emb = cut(emb.withColumn("raw", _raw(F.col("edges"))))
    kinds = cut(emb.select("raw").distinct().mapInPandas(_canonise(directed), "raw string, code string"))
    return emb.join(F.broadcast(kinds) if kinds.count() <= BROADCAST_ROWS else kinds, "raw").drop("raw")


def _frequent(emb: DataFrame, minsup: int) -> tuple[DataFrame, DataFrame]:
    sup = emb.groupBy("code").agg(F.countDistinct("graph_id").alias("sup")).where(F.col("sup") >= minsup)
    sup = cut(sup)
    n = sup.count()
    return emb.join(F.broadcast(sup.select("code")) if n <= BROADCAST_ROWS else sup.select("code"), "code", "left_semi"), sup


def least_support(g: Graphs, share: float) -> int:
    """Absolute support of a relative one: the share of the graphs with an edge, rounded up (graphs without edges aren't mined)."""
    n = g.edges.select("graph_id").distinct().count()
    return max(1, -int(-(share * n) // 1))


def _frequent_edges(g: Graphs, minsup: int, directed: bool, self_loops: bool) -> DataFrame:
    """(graph_id, e): the edges whose kind is in at least minsup graphs."""
    t = g.triples()
    if not self_loops:
        t = t.where(F.col("s") != F.col("r"))
    if not directed:
        swap = (F.col("subj") > F.col("ref")) | ((F.col("subj") == F.col("ref")) & (F.col("s") > F.col("r")))
        t = t.select("graph_id", *[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("s", "r"), ("r", "s"), ("subj", "ref"), ("ref", "subj"))], "pos").distinct()
    t = t.select("graph_id", F.struct(F.xxhash64("s", "pos", "r").alias("id"), F.col("s").cast("bigint").alias("s"), F.col("r").cast("bigint").alias("r"), "subj", "pos", "ref").alias("e"))
    one = t.groupBy("e.subj", "e.pos", "e.ref").agg(F.countDistinct("graph_id").alias("n")).where(F.col("n") >= minsup).drop("n")
    return cut(t.select("graph_id", "e", "e.subj", "e.pos", "e.ref").join(one, ["subj", "pos", "ref"], "left_semi").select("graph_id", "e"))


def _grown(emb: DataFrame, edges: DataFrame, max_nodes: int | None) -> DataFrame:
    """Embeddings with one more edge each, one row per set of edges."""
    touch = F.exists("edges", lambda x: (x["s"] == F.col("e.s")) | (x["s"] == F.col("e.r")) | (x["r"] == F.col("e.s")) | (x["r"] == F.col("e.r")))
    new = ~F.exists("edges", lambda x: x["id"] == F.col("e.id"))
    grown = emb.select("graph_id", "edges").join(edges, "graph_id").where(touch & new)
    grown = grown.select("graph_id", F.array_sort(F.concat("edges", F.array("e"))).alias("edges"))
    if max_nodes is not None:
        grown = grown.where(F.size(F.array_distinct(F.flatten(F.transform("edges", lambda x: F.array(x["s"], x["r"]))))) <= max_nodes)
    return grown.withColumn("ids", F.transform("edges", lambda x: x["id"])).dropDuplicates(["graph_id", "ids"]).drop("ids")


def frequent_subgraphs(g: Graphs, minsup: int, *, max_edges: int | None = None, directed: bool = False, self_loops: bool = False, min_nodes: int = 2, max_nodes: int | None = None, max_graphs: int | None = None) -> Patterns:
    """All connected patterns found in at least minsup graphs (edges of a graph may be extra: not induced), with up to max_edges edges and max_nodes nodes if given,
    in the first max_graphs graphs by id if given.

    directed=False mines edges without direction, which is then rebuilt from the order of the labels; edges between
    equal labels so lose theirs. Support counts graphs. Each level joins the embeddings kept so far with the frequent
    edges of their graph, keeps one row per set of edges, and drops patterns below minsup; a level is written to the
    shared folder, so a lost executor costs no earlier level. Empty collections give empty tables."""
    if max_graphs is not None:
        first = g.graphs.orderBy("graph_id").limit(max_graphs)
        g = Graphs(first, g.nodes.join(first, "graph_id", "left_semi"), g.edges.join(first, "graph_id", "left_semi"))
    edges = _frequent_edges(g, minsup, directed, self_loops)
    emb, found = _frequent(_coded(edges.select("graph_id", F.array("e").alias("edges")), directed), minsup)
    every, n = found, 1
    while max_edges is None or n < max_edges:
        emb, found = _frequent(_coded(_grown(emb, edges, max_nodes), directed), minsup)
        if found.isEmpty():
            break
        emb, n = cut(emb), n + 1
        every = every.unionByName(found)
    return pattern_tables(every, min_nodes)


def pattern_tables(found: DataFrame, min_nodes: int = 2) -> Patterns:
    """Patterns (code, sup) as tables."""
    form = F.from_json("code", "array<string>")
    parsed = found.select("code", "sup", F.from_json(form[0], "array<string>").alias("labels"), F.from_json(form[1], "array<array<string>>").alias("links"))
    parsed = parsed.where(F.size("labels") >= min_nodes)
    parsed = dense_ids(parsed, [F.desc("sup"), F.asc("code")], "pattern_id")
    patterns = parsed.select("pattern_id", "code", "sup", F.size("labels").alias("n_nodes"), F.size("links").alias("n_edges"))
    nodes = parsed.select("pattern_id", F.posexplode("labels").alias("node", "label"))
    edges = parsed.select("pattern_id", F.explode("links").alias("l")).select("pattern_id", F.col("l")[0].cast("int").alias("s"), F.col("l")[1].alias("pos"), F.col("l")[2].cast("int").alias("r"))
    return Patterns(patterns, nodes, edges)


def compressing_subgraphs(g: Graphs, nsubs: int, *, beam: int = 4, max_edges: int | None = None, minsup: int = 2) -> Patterns:
    """The nsubs patterns that compress the collection most, found by growth with a beam; sup counts graphs.

    A pattern's score is size(G) / (size(S) + size(G | S)) with size = nodes + edges and non-overlapping instances
    estimated by one per graph. Approximate by nature: of each level the embeddings of the best beam * nsubs patterns are
    extended, by whatever is in minsup graphs."""
    size = g.nodes.count() + g.edges.count()
    form = F.from_json("code", "array<string>")
    own = F.size(F.from_json(form[0], "array<string>")) + F.size(F.from_json(form[1], "array<array<string>>"))
    score = F.lit(float(size)) / (own + F.lit(size) - F.col("sup") * (own - 1))
    edges = _frequent_edges(g, minsup, False, False)
    emb, found = _frequent(_coded(edges.select("graph_id", F.array("e").alias("edges")), False), minsup)
    every, n = found, 1
    while max_edges is None or n < max_edges:
        best = cut(found.orderBy(F.desc(score), "code").limit(beam * nsubs).select("code"))
        emb = emb.join(F.broadcast(best) if beam * nsubs <= BROADCAST_ROWS else best, "code", "left_semi")
        emb, found = _frequent(_coded(_grown(emb, edges, None), False), minsup)
        if found.isEmpty():
            break
        emb, n = cut(emb), n + 1
        every = every.unionByName(found)
    return pattern_tables(every.orderBy(F.desc(score), "code").limit(nsubs))


def experiment_name(alg: str, edges: bool, nodes: bool, minsup: float | None = None, nsubs: int | None = None) -> str:
    """Name of a mining run from its parameters."""
    tail = str(nsubs) if nsubs is not None else str(minsup)[2:]
    return "sgs" + "_eprune" * edges + "_nprune" * nodes + f"_{alg}_{tail}"


def sweep(g: Graphs, minsups: list[int], **options) -> DataFrame:
    """(minsup, patterns, max_nodes, avg_edges): mining repeated over supports. Mined once, at the least of them."""
    every = cut(frequent_subgraphs(g, min(minsups), **options).patterns)
    grid = g.graphs.sparkSession.createDataFrame([(m,) for m in sorted(set(minsups))], "minsup int")
    reached = F.filter(F.array(*[F.lit(m) for m in sorted(set(minsups))]), lambda m: m <= F.col("sup"))
    rows = every.withColumn("minsup", F.explode(reached)).groupBy("minsup").agg(F.count(F.lit(1)).alias("patterns"), F.max("n_nodes").alias("max_nodes"), F.avg("n_edges").alias("avg_edges"))
    return grid.join(rows, "minsup", "left").withColumn("patterns", F.coalesce("patterns", F.lit(0).cast("bigint")))


def maximal_itemsets(patterns: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pattern_id, sup, labels): for each maximal label set the pattern of greatest support, first on ties.

    A label set has the support of its first pattern; it is maximal unless a proper superset has a support that is at
    most as great. Supersets are found through an inverted index on labels: a superset shares the set's rarest label."""
    sets = nodes.groupBy("pattern_id").agg(F.array_sort(F.collect_set("label")).alias("labels")).join(patterns.select("pattern_id", "sup"), "pattern_id")
    items = sets.groupBy("labels").agg(F.min_by("sup", "pattern_id").alias("first_sup"), F.max_by("pattern_id", F.struct("sup", -F.col("pattern_id"))).alias("pattern_id"))
    items = cut(items)
    each = items.select("labels", "first_sup", F.explode("labels").alias("label"))
    freq = each.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rare = each.join(freq, "label").groupBy("labels", "first_sup").agg(F.min_by("label", F.struct("n", "label")).alias("label"))
    bigger = each.select("label", F.col("labels").alias("other"), F.col("first_sup").alias("other_sup"))
    beaten = rare.join(bigger, "label").where((F.size("labels") < F.size("other")) & (F.size(F.array_except("labels", "other")) == 0) & (F.col("other_sup") <= F.col("first_sup"))).select("labels").distinct()
    return items.join(beaten, "labels", "left_anti").join(patterns.select("pattern_id", "sup"), "pattern_id").select("pattern_id", "sup", "labels")


def where_found(g: Graphs, patterns: Patterns) -> DataFrame:
    """(pattern_id, graph_id): the graphs that hold each pattern, directed and not induced."""
    from graphweave.operators.matching import matches

    return matches(g, patterns.nodes, patterns.edges, faithful=False)
