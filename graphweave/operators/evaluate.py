"""How well a summary of patterns represents a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.model import Graphs


def diversity(sets: DataFrame, ids: str, items: str, keys: list[str] | None = None) -> DataFrame:
    """keys and diversity: mean over pairs of 1 - Jaccard of the item sets; pairs with an empty set add 0 but count.

    sets has a row per id and an array of items. A single set has diversity 1 if it isn't empty, else 0; none give no
    row. Computed from an inverted index: only pairs that share an item are joined, all others add 1 (or 0). The measure is
    one of all pairs, so it is meant for summaries, which are of the top k."""
    keys = keys or []
    full = sets.select(*keys, F.col(ids).alias("id"), F.array_distinct(F.coalesce(F.col(items), F.array().cast(sets.schema[items].dataType))).alias("x"))
    sizes = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("x") > 0).alias("f"))
    each = full.select(*keys, "id", F.size("x").alias("k"), F.explode("x").alias("item"))
    a = each.select(*keys, "item", F.col("id").alias("a"), F.col("k").alias("ka"))
    b = each.select(*keys, "item", F.col("id").alias("b"), F.col("k").alias("kb"))
    shared = a.join(b, [*keys, "item"]).where(F.col("a") < F.col("b")).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("ka").alias("ka"), F.max("kb").alias("kb"))
    loss = shared.groupBy(*keys).agg(F.sum(F.col("c") / (F.col("ka") + F.col("kb") - F.col("c"))).alias("loss"))
    out = sizes.join(loss, keys, "left") if keys else sizes.withColumn("__k", F.lit(1)).join(loss.withColumn("__k", F.lit(1)), "__k", "left").drop("__k")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    value = F.when(F.col("n") == 1, F.col("f").cast("double")).otherwise((F.col("f") * (F.col("f") - 1) / 2 - F.coalesce("loss", F.lit(0.0))) / pairs)
    return out.where("n > 0").select(*keys, value.alias("diversity"))


def pattern_sets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pattern_id, labels, triples): label set and triple set of each pattern."""
    labels = nodes.groupBy("pattern_id").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.count(F.lit(1)).alias("n_nodes"))
    a = nodes.select("pattern_id", F.col("node").alias("s"), F.col("label").alias("subj"))
    b = nodes.select("pattern_id", F.col("node").alias("r"), F.col("label").alias("ref"))
    t = edges.join(a, ["pattern_id", "s"]).join(b, ["pattern_id", "r"])
    triples = t.groupBy("pattern_id").agg(F.array_sort(F.collect_set(F.concat_ws("|", "subj", "pos", "ref"))).alias("triples"))
    return labels.join(triples, "pattern_id", "left")


def top_patterns(patterns: DataFrame, k: int | None) -> DataFrame:
    """The k patterns of greatest support, ties by id; k of None or 0 takes all."""
    return patterns if not k else patterns.orderBy(F.desc("sup"), "pattern_id").limit(k)


def summary(g: Graphs, patterns: DataFrame, nodes: DataFrame, edges: DataFrame, cells: DataFrame, k: int | None = None) -> DataFrame:
    """One row of measures of the top-k patterns as a summary.

    n_graphs, distinct_sets (different label sets), set_ratio, avg_nodes, std_nodes (population), avg_classes,
    max_classes, distinct_node_ratio, coverage (share of graphs with a match), coverage_overlap (mean over graphs of the
    greatest overlap), diversity (labels), diversity_ne (triples); rounded half to even to 2 places, set_ratio to 3."""
    top = top_patterns(patterns, k).select("pattern_id")
    keep = lambda df: df.join(F.broadcast(top), "pattern_id", "left_semi") if k else df
    sets = pattern_sets(keep(nodes), keep(edges))
    size = F.size("labels")
    one = sets.agg(
        F.count(F.lit(1)).alias("n_graphs"), F.countDistinct("labels").alias("distinct_sets"), F.avg("n_nodes").alias("avg_nodes"),
        F.stddev_pop("n_nodes").alias("std_nodes"), F.avg(size).alias("avg_classes"), F.max(size).alias("max_classes"),
        F.avg(size / F.col("n_nodes")).alias("distinct_node_ratio"),
    )
    n = g.graphs.agg(F.count(F.lit(1)))
    per = keep(cells).groupBy("graph_id").agg(F.max("cnt").alias("hit"), F.max("overlap").alias("overlap"))
    cover = per.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.coalesce(F.sum("overlap"), F.lit(0.0)).alias("overlaps"))
    out = one.withColumns({"hits": cover.select("hits").scalar(), "overlaps": cover.select("overlaps").scalar(), "graphs": n.scalar()})
    out = out.withColumns({
        "diversity": diversity(sets, "pattern_id", "labels").scalar(), "diversity_ne": _triple_diversity(sets).scalar(),
    })
    two = lambda c: F.bround(c, 2) + F.lit(0.0)
    return out.select(
        "n_graphs", "distinct_sets", F.bround(F.try_divide(F.col("distinct_sets"), F.col("n_graphs")), 3).alias("set_ratio"),
        two(F.col("avg_nodes")).alias("avg_nodes"), two(F.col("std_nodes")).alias("std_nodes"), two(F.col("avg_classes")).alias("avg_classes"), "max_classes",
        two(F.col("distinct_node_ratio")).alias("distinct_node_ratio"), two(F.try_divide(F.col("hits"), F.col("graphs"))).alias("coverage"),
        two(F.try_divide(F.col("overlaps"), F.col("graphs"))).alias("coverage_overlap"), two(F.col("diversity")).alias("diversity"), two(F.col("diversity_ne")).alias("diversity_ne"),
    )


def _triple_diversity(sets: DataFrame) -> DataFrame:
    return diversity(sets, "pattern_id", "triples")


def represent(cells: DataFrame, sizes: DataFrame, method: str = "mean") -> DataFrame:
    """(pattern_id, graph_id): of the graphs a pattern covers the one with least (min), most (max) or most average (mean) nodes.

    sizes has the node counts (graph_id, n) of the raw graphs; ties go to the least graph_id; patterns that cover
    nothing have no row."""
    covered = cells.where("cnt > 0").join(sizes, "graph_id").select("pattern_id", "graph_id", "n")
    if method == "mean":
        mean = covered.groupBy("pattern_id").agg(F.avg("n").alias("m"))
        covered = covered.join(mean, "pattern_id").withColumn("key", F.round(F.abs(F.col("n") - F.col("m")), 9))
    elif method in ("min", "max"):
        covered = covered.withColumn("key", F.col("n") * (1.0 if method == "min" else -1.0))
    else:
        raise ValueError(f"unknown method {method}")
    return covered.groupBy("pattern_id").agg(F.min_by("graph_id", F.struct("key", "graph_id")).alias("graph_id"))


def represented_graphs(g: Graphs, pairing: DataFrame) -> Graphs:
    """The graphs chosen by represent as a summary: one graph per pattern, pattern_id as its graph_id."""
    nodes = pairing.join(g.nodes, "graph_id").select(F.col("pattern_id").alias("graph_id"), "node_id", "label")
    edges = pairing.join(g.edges, "graph_id").select(F.col("pattern_id").alias("graph_id"), "s", "pos", "r")
    return Graphs(pairing.select(F.col("pattern_id").alias("graph_id")), nodes, edges)


def subset_by_labels(nodes: DataFrame, groups: list[list[str]]) -> DataFrame:
    """(group_no, graph_id): graphs that hold all labels of a group, each under the first group that fits."""
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(i, x) for i, labels in enumerate(groups) for x in set(labels)], "group_no int, label string")
    need = wanted.groupBy("group_no").agg(F.count(F.lit(1)).alias("k"))
    have = nodes.select("graph_id", "label").distinct().join(F.broadcast(wanted), "label").groupBy("graph_id", "group_no").agg(F.count(F.lit(1)).alias("n"))
    fit = have.join(F.broadcast(need), "group_no").where(F.col("n") == F.col("k"))
    return fit.groupBy("graph_id").agg(F.min("group_no").alias("group_no")).select("group_no", "graph_id")


def caption_search(captions: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, term, text): captions that contain a term, one row for each term they contain."""
    found = F.filter(F.array(*[F.when(F.contains(F.col(text), F.lit(t)), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return captions.select(key, F.explode(found).alias("term"), text)


def subset_by_caption(graphs: DataFrame, captions: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """The graphs with a caption that contains one of the terms."""
    return graphs.join(caption_search(captions, key, text, terms).select(key).distinct(), key, "left_semi")


def select_features(matrix: DataFrame, graphs: DataFrame, key: str) -> DataFrame:
    """The rows of a feature matrix that belong to the graphs of a subset."""
    return matrix.join(graphs.select(key).distinct(), key, "left_semi")


def compare_methods(tables: dict[str, DataFrame], k: str = "n_graphs", least: int = 0) -> DataFrame:
    """The evaluation rows of several methods under each other, with a column method, from k = least."""
    out = None
    for name, df in tables.items():
        df = df.withColumn("method", F.lit(name)).where(F.col(k) >= least)
        out = df if out is None else out.unionByName(df)
    return out
