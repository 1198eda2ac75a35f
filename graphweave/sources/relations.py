"""Relation triples and annotated relationships as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.model import Graphs

_OBJECT = "struct<bbox:array<int>,category:string>"


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(uri, rel, start, end, info) of a tab-separated file; info is JSON."""
    return spark.read.schema("uri string, rel string, start string, end string, info string").option("sep", "\t").option("quote", "").csv(path)


def write_triples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def relationship_graphs(rows: DataFrame) -> Graphs:
    """Graphs from rows (graph_id, relationships array<struct<subject, object: struct<bbox, category>, predicate>>).

    A node per distinct box, numbered by first appearance (subjects before objects), with the category it first has; of
    several predicates between two nodes the last stays."""
    kind = f"array<struct<subject:{_OBJECT},object:{_OBJECT},predicate:string>>"
    x = rows.select("graph_id", F.posexplode(F.col("relationships").cast(kind)).alias("at", "r"))
    ends = x.select("graph_id", (F.col("at") * 2).alias("k"), F.col("r.subject").alias("o")).unionByName(x.select("graph_id", (F.col("at") * 2 + 1).alias("k"), F.col("r.object").alias("o")))
    first = ends.groupBy("graph_id", F.col("o.bbox").alias("bbox")).agg(F.min("k").alias("k"), F.min_by("o.category", "k").alias("label"))
    from pyspark.sql import Window

    nodes = first.withColumn("node_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("k")) - 1)
    a, b = nodes.select("graph_id", F.col("bbox").alias("sb"), F.col("node_id").alias("s")), nodes.select("graph_id", F.col("bbox").alias("rb"), F.col("node_id").alias("r"))
    links = x.select("graph_id", "at", F.col("r.subject.bbox").alias("sb"), F.col("r.object.bbox").alias("rb"), F.col("r.predicate").alias("pos")).join(a, ["graph_id", "sb"]).join(b, ["graph_id", "rb"])
    edges = links.groupBy("graph_id", "s", "r").agg(F.max_by("pos", "at").alias("pos"))
    return Graphs(rows.select("graph_id").distinct(), nodes.select("graph_id", "node_id", "label"), edges.select("graph_id", "s", "pos", "r"))


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of images offered together, from rows with image_candidates array<struct<image_filename>>; each has two."""
    from graphweave.sources.images import image_id

    names = rows.select(F.col("image_candidates")[0]["image_filename"].alias("x"), F.col("image_candidates")[1]["image_filename"].alias("y"))
    return names.select(image_id(F.col("x")).alias("a"), image_id(F.col("y")).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
