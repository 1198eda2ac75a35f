"""Which graphs hold which patterns, and how much of them the patterns cover."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.model import Graphs
from graphweave.session import cut


def is_match(pattern: list[tuple], edges: list[tuple], faithful: bool, lone: list[tuple] = (), nodes: list[tuple] = ()) -> bool:
    """Whether an injective map of the pattern's nodes exists under which its edges are edges of the graph.

    pattern and edges: (s, pos, r, subj, ref), the edges only those whose triple is in the pattern. lone: (node, label)
    of the pattern's nodes without edge, nodes: (node, label) of the graph's nodes with one of their labels. faithful:
    between mapped nodes there may be no further of these edges."""
    have = {(s, p, r) for s, p, r, _, _ in edges}
    near: dict = {}
    for s, _, r in have:
        near.setdefault(s, set()).add(r)
        near.setdefault(r, set()).add(s)
    by = {}
    for s, p, r, a, b in edges:
        by.setdefault((a, p, b), []).append((s, r))
    todo, known, order = list(pattern), set(), []
    while todo:  # connected edges first
        k = next((i for i, e in enumerate(todo) if e[0] in known or e[2] in known), 0)
        e = todo.pop(k)
        order.append(e)
        known |= {e[0], e[2]}
    want = {(s, p, r) for s, p, r, _, _ in pattern}
    free: dict = {}
    for n, label in nodes:
        free.setdefault(label, []).append(n)
    f: dict = {}  # pattern node to graph node
    used: dict = {}  # the inverse

    def put(u, s) -> bool:
        """Maps u to s if that is new and free; whether it was mapped here."""
        if u in f:
            return False
        f[u], used[s] = s, u
        return True

    def take(u) -> None:
        del used[f.pop(u)]

    def alone(k: int) -> bool:
        if k == len(lone):
            return True
        u, label = lone[k]
        for s in free.get(label, ()):
            if s in used or (faithful and any(x in used for x in near.get(s, ()))):
                continue
            put(u, s)
            if alone(k + 1):
                return True
            take(u)
        return False

    def place(k: int) -> bool:
        if k == len(order):
            if faithful and not all((used[s], p, used[r]) in want for s, p, r in have if s in used and r in used and s != r):
                return False
            return alone(0)
        u, p, v, a, b = order[k]
        for s, r in by.get((a, p, b), ()):
            if (u == v) != (s == r) or f.get(u, s) != s or f.get(v, r) != r or used.get(s, u) != u or used.get(r, v) != v:
                continue
            mine, other = put(u, s), put(v, r)
            if place(k + 1):
                return True
            if other:
                take(v)
            if mine:
                take(u)
        return False

    return place(0)


def label_candidates(own: DataFrame, labels: DataFrame) -> DataFrame:
    """(pattern_id, graph_id, k): the graphs that hold all labels of a pattern as often as it does; k is its number of labels.

    own: (graph_id, label, n), labels: (pattern_id, label, m). Each pattern meets only the graphs with its rarest label;
    of these the other labels are then looked up."""
    freq = own.groupBy("label").agg(F.count(F.lit(1)).alias("graphs"))
    ranked = labels.join(freq, "label", "left").groupBy("pattern_id").agg(
        F.min_by(F.struct("label", "m"), F.struct(F.coalesce("graphs", F.lit(0)), "label")).alias("x"), F.count(F.lit(1)).alias("k"), F.count("graphs").alias("known"))
    rare = ranked.where(F.col("known") == F.col("k")).select("pattern_id", "k", "x.label", "x.m")
    first = own.join(rare, "label").where(F.col("n") >= F.col("m")).select("graph_id", "pattern_id", "k")
    rest = first.where("k > 1").join(labels, "pattern_id").join(own, ["graph_id", "label"]).where(F.col("n") >= F.col("m"))
    full = rest.groupBy("graph_id", "pattern_id").agg(F.first("k").alias("k"), F.count(F.lit(1)).alias("have")).where(F.col("have") == F.col("k"))
    return first.where("k = 1").unionByName(full.drop("have"))


def _label_counts(nodes: DataFrame, key: str, name: str) -> DataFrame:
    return nodes.groupBy(key, "label").agg(F.count(F.lit(1)).alias(name))


def matches(g: Graphs, nodes: DataFrame, edges: DataFrame, *, faithful: bool = True) -> DataFrame:
    """(pattern_id, graph_id) of each pattern found in a graph; at most one row each.

    A pattern may have nodes without edge, or no edge at all: its nodes need as many different nodes of their labels.
    faithful: edges of the graph with a triple of the pattern may not be extra between matched nodes. Only graphs that
    hold all triples of a pattern are candidates, found by one join on triples, and only those with enough nodes of each
    label where it has nodes without edge; of them only the edges with these triples and the nodes with these labels go to
    the backtracking search, one row per candidate. A pattern without nodes matches no graph; null labels match null
    ones of no other node."""
    a = nodes.select("pattern_id", F.col("node").alias("s"), F.col("label").alias("subj"))
    b = nodes.select("pattern_id", F.col("node").alias("r"), F.col("label").alias("ref"))
    p = edges.join(a, ["pattern_id", "s"]).join(b, ["pattern_id", "r"])
    kinds = p.select("pattern_id", "subj", "pos", "ref").distinct()
    needed = kinds.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("k"))
    forms = p.groupBy("pattern_id").agg(F.collect_list(F.struct("s", "pos", "r", "subj", "ref")).alias("pattern")).join(needed, "pattern_id")
    ends = p.select("pattern_id", F.col("s").alias("node")).unionByName(p.select("pattern_id", F.col("r").alias("node"))).distinct()
    lone = cut(nodes.select("pattern_id", "node", "label").join(ends, ["pattern_id", "node"], "left_anti"))
    t = g.triples()
    hits = t.join(kinds, ["subj", "pos", "ref"])
    per = hits.groupBy("graph_id", "pattern_id").agg(F.countDistinct("subj", "pos", "ref").alias("have"), F.collect_list(F.struct("s", "pos", "r", "subj", "ref")).alias("edges"))
    candidates = per.join(forms, "pattern_id").where(F.col("have") == F.col("k"))
    kind = g.graphs.schema["graph_id"].dataType.simpleString()
    id_kind = nodes.schema["pattern_id"].dataType.simpleString()

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(x) -> list[tuple]:
            return [] if x is None else [tuple(y.values()) for y in x]

        for pdf in frames:
            ok = [is_match(rows(q), rows(e), faithful, rows(n), rows(m)) for q, e, n, m in zip(pdf["pattern"], pdf["edges"], pdf["lone"], pdf["nodes"])]
            yield pdf.loc[ok, ["pattern_id", "graph_id"]]

    result = f"pattern_id {id_kind}, graph_id {kind}"
    if lone.isEmpty():
        # a single edge without loop is found by its triple unless both labels are equal
        easy = (F.size("pattern") == 1) & (F.col("pattern")[0]["subj"] != F.col("pattern")[0]["ref"])
        quick = candidates.where(easy).select("pattern_id", "graph_id")
        none = F.lit(None).cast("array<struct<node:bigint,label:string>>")
        hard = candidates.where(~easy).select("pattern_id", "graph_id", "pattern", "edges", none.alias("lone"), none.alias("nodes"))
        return quick.unionByName(hard.mapInPandas(search, result))
    own = _label_counts(g.nodes.where(F.col("label").isNotNull()), "graph_id", "n")
    enough = label_candidates(own, _label_counts(nodes, "pattern_id", "m")).select("pattern_id", "graph_id")
    edged = forms.select("pattern_id", F.lit(True).alias("edged"))
    both = enough.join(edged, "pattern_id", "left").join(candidates.select("pattern_id", "graph_id", "pattern", "edges"), ["pattern_id", "graph_id"], "left")
    both = both.where(F.col("edged").isNull() | F.col("pattern").isNotNull()).select("pattern_id", "graph_id", "pattern", "edges")
    lists = lone.groupBy("pattern_id").agg(F.collect_list(F.struct("node", "label")).alias("lone"))
    wanted = lone.select("pattern_id", "label").distinct()
    free = both.select("pattern_id", "graph_id").join(wanted, "pattern_id").join(g.nodes.select("graph_id", F.col("node_id").alias("node"), "label"), ["graph_id", "label"])
    free = free.groupBy("pattern_id", "graph_id").agg(F.collect_list(F.struct("node", "label")).alias("nodes"))
    hard = both.join(lists, "pattern_id", "left").join(free, ["pattern_id", "graph_id"], "left")
    return hard.select("pattern_id", "graph_id", "pattern", "edges", "lone", "nodes").mapInPandas(search, result)


def coverage(g: Graphs, nodes: DataFrame, edges: DataFrame, *, min_nodes: int = 2, faithful: bool = True) -> DataFrame:
    """(graph_id, pattern_id, cnt, overlap) where the pattern's labels are all in the graph; other cells are 0.

    cnt is 1 if the pattern matches; overlap is the pattern's number of labels over the graph's, whether it matches or
    not. Patterns with fewer than min_nodes nodes have no rows."""
    large = nodes.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_nodes).select("pattern_id")
    nodes = nodes.join(large, "pattern_id", "left_semi")
    one = F.lit(1).cast("bigint")
    own = g.nodes.where(F.col("label").isNotNull()).select("graph_id", "label").distinct()
    total = g.nodes.select("graph_id", "label").distinct().groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"))
    cells = label_candidates(own.withColumn("n", one), nodes.select("pattern_id", "label").distinct().withColumn("m", one)).join(total, "graph_id")
    found = matches(g, nodes, edges.join(large, "pattern_id", "left_semi"), faithful=faithful).withColumn("cnt", F.lit(1))
    out = cells.join(found, ["graph_id", "pattern_id"], "left")
    return out.select("graph_id", "pattern_id", F.coalesce("cnt", F.lit(0)).alias("cnt"), (F.col("k") / F.col("total")).alias("overlap"))


def wide(cells: DataFrame, value: str, patterns: list[int]) -> DataFrame:
    """One row per graph and one column per pattern, for export."""
    return cells.groupBy("graph_id").pivot("pattern_id", patterns).agg(F.max(value)).na.fill(0)


def long(matrix: DataFrame, value: str) -> DataFrame:
    """The inverse of wide: non-zero cells."""
    columns = [c for c in matrix.columns if c != "graph_id"]
    return matrix.unpivot("graph_id", columns, "pattern_id", value).where(F.col(value) != 0)


def first_matches(g: Graphs, nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """The first n graphs by id that hold each pattern."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("pattern_id").orderBy("graph_id"))
    return matches(g, nodes, edges).withColumn("k", rank).where(F.col("k") <= n).drop("k")


def project_match(g: Graphs, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pattern_id, graph_id, s, subj, pos, ref, r): of each matching graph the edges whose triple is in the pattern."""
    a = nodes.select("pattern_id", F.col("node").alias("s"), F.col("label").alias("subj"))
    b = nodes.select("pattern_id", F.col("node").alias("r"), F.col("label").alias("ref"))
    kinds = edges.join(a, ["pattern_id", "s"]).join(b, ["pattern_id", "r"]).select("pattern_id", "subj", "pos", "ref").distinct()
    return g.triples().join(kinds, ["subj", "pos", "ref"]).join(matches(g, nodes, edges), ["pattern_id", "graph_id"], "left_semi").select("pattern_id", "graph_id", "s", "subj", "pos", "ref", "r")
