"""Graph collections, summaries and matrices as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweave.model import GRAPH, Graphs, flatten_graphs, nest
from graphweave.session import cut, lookup

#: Lines of a miner's file that one task numbers.
LINES = 1 << 20


def _ddl(struct: str) -> str:
    """The fields of a struct type as a schema string."""
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(struct)


def read_graphs(spark: SparkSession, path: str, lines: bool = False) -> Graphs:
    """A JSON array of graphs (lines=False) or one graph a line."""
    return flatten_graphs(spark.read.schema(_ddl(GRAPH)).json(path, multiLine=not lines))


def write_graphs(g: Graphs, path: str) -> None:
    """One graph a line, in many files."""
    nest(g).write.mode("overwrite").json(path)


def read_patterns(spark: SparkSession, path: str, min_nodes: int = 2) -> DataFrame:
    """Patterns (g, sup) of a JSON array, those with at least min_nodes nodes, numbered in order."""
    rows = spark.read.schema(_ddl(f"struct<g:{GRAPH},sup:bigint>")).json(path, multiLine=True)
    return rows.where(F.size("g.nodes") >= min_nodes)


def write_prs(prs: DataFrame, path: str) -> None:
    """The summary as one JSON object per pair: key 'subj,ref', bins by likelihood, sup and entropy."""
    bins = prs.groupBy("subj", "ref").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pos", "likelihood")))).alias("bins"), F.max("sup").alias("sup"), F.max("entropy").alias("entropy"))
    bins.write.mode("overwrite").json(path)


def read_prs(spark: SparkSession, path: str) -> DataFrame:
    """(subj, ref, pos, n, sup, likelihood, entropy) of a written summary."""
    rows = spark.read.schema("subj string, ref string, bins map<string,double>, sup bigint, entropy double").json(path)
    rows = rows.select("subj", "ref", "sup", "entropy", F.explode("bins").alias("pos", "likelihood"))
    return rows.withColumn("n", F.round(F.col("likelihood") * F.col("sup")).cast("bigint")).select("subj", "ref", "pos", "n", "sup", "likelihood", "entropy")


def write_matrix(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").option("header", True).csv(path)


def read_matrix(spark: SparkSession, path: str, columns: list[str], kind: str = "double") -> DataFrame:
    return spark.read.schema(", ".join(["graph_id bigint", *[f"`{c}` {kind}" for c in columns]])).option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows to a ;-separated table, which is created if need be."""
    df.write.mode("append").option("sep", ";").option("header", True).csv(path)


def miner_text(g: Graphs, subdue: bool = False) -> DataFrame:
    """(graph_id, block): each graph with an edge as the text a miner reads.

    gSpan: 't # i', 'v id label', 'e s r label' with ids from 0 and without self loops; SUBDUE: 'XP', ids from 1. Labels
    are the numbers of label_codes. The last block of the file is 't # -1'."""
    codes = label_codes(g)
    edges = g.edges if subdue else g.edges.where(F.col("s") != F.col("r"))
    used = edges.select("graph_id").distinct()
    base = 1 if subdue else 0
    nodes = g.nodes.join(used, "graph_id", "left_semi").withColumn("v", F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1 + base)
    lab = nodes.join(codes.withColumnRenamed("name", "label"), "label")
    a, b = nodes.select("graph_id", F.col("node_id").alias("s"), F.col("v").alias("vs")), nodes.select("graph_id", F.col("node_id").alias("r"), F.col("v").alias("vr"))
    links = edges.join(a, ["graph_id", "s"]).join(b, ["graph_id", "r"]).join(codes.withColumnRenamed("name", "pos"), "pos")
    v = lab.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("v", F.concat_ws(" ", F.lit("v"), "v", "code").alias("t")))).alias("vs"))
    word = "u" if subdue else "e"
    e = links.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.concat_ws(" ", F.lit(word), "vs", "vr", "code"))).alias("es"))
    head = F.lit("XP") if subdue else F.concat(F.lit("t # "), F.col("graph_id").cast("string"))
    return v.join(e, "graph_id").select("graph_id", F.concat_ws("\n", head, F.array_join(F.transform("vs", lambda x: x["t"]), "\n"), F.array_join("es", "\n")).alias("block"))


def label_codes(g: Graphs) -> DataFrame:
    """(name, code): labels and positions in order of their names, numbered from 2."""
    from graphweave.operators.keys import dense_ids

    names = g.nodes.select(F.col("label").alias("name")).union(g.edges.select("pos")).distinct()
    return dense_ids(names, [F.asc("name")], "code").withColumn("code", F.col("code") + 2)


def parse_miner_text(lines: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patterns, nodes, edges) from lines (file, no, line) of miner output: 't # i * sup', 'v id label', 'e s r label'.

    lines of one file are numbered; a file's blocks follow from running counts of 't' lines, within parts of LINES lines
    and over the parts' totals, so that no task gets a whole file."""
    x = lines.withColumn("p", F.split(F.trim("line"), r"\s+")).withColumn("part", F.floor(F.col("no") / LINES)).withColumn("t", (F.col("p")[0] == "t").cast("bigint"))
    totals = cut(x.groupBy("file", "part").agg(F.sum("t").alias("n")))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    up = Window.partitionBy("file", "part").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = lookup(x, starts, ["file", "part"], totals.count()).withColumn("block", F.col("first") + F.sum("t").over(up)).where("block > 0")
    key = F.struct("file", "block").alias("pattern")
    patterns = x.where(F.col("p")[0] == "t").where(F.get("p", F.lit(2)) != "-1").select(key, F.get("p", F.lit(4)).cast("bigint").alias("sup"))
    c = codes.select(F.col("code").cast("string").alias("code"), "name")
    nodes = x.where(F.col("p")[0] == "v").select(key, F.col("p")[1].cast("int").alias("node"), F.col("p")[2].alias("code")).join(c, "code").select("pattern", "node", F.col("name").alias("label"))
    edges = x.where(F.col("p")[0].isin("e", "u", "d")).select(key, F.col("p")[1].cast("int").alias("s"), F.col("p")[2].cast("int").alias("r"), F.col("p")[3].alias("code")).join(c, "code").select("pattern", "s", F.col("name").alias("pos"), "r")
    return patterns, nodes, edges
