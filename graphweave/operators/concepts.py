"""Concepts and places: filtering relation triples and ranking places by the concepts related to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relations between a concept and a place (fixed values).
TO_PLACE = ("RelatedTo", "AtLocation", "LocatedNear", "PartOf")
FROM_PLACE = TO_PLACE + ("HasA", "MadeOf")
#: Relations that say something about a concept (fixed values).
MEANINGFUL = ("RelatedTo", "AtLocation", "LocatedNear", "PartOf", "HasA", "MadeOf", "IsA", "UsedFor", "Antonym")


def readable(uri: Column) -> Column:
    """The last piece of a URI: /c/en/dog gives dog (and /c/en/dog/n gives n)."""
    return F.element_at(F.split(uri, "/"), -1)


def class_concept(label: Column, mapping: dict[str, str]) -> Column:
    """Concept of a class: as mapped, else the class itself; blanks become underscores."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), label) if mapping else F.lit(None)
    return F.translate(F.coalesce(named, label), " ", "_")


def english(triples: DataFrame, language: str = "en") -> DataFrame:
    """Triples (uri, rel, start, end, info) with both ends in the language."""
    at = f"/c/{language}/"
    return triples.where(F.startswith(F.col("start"), F.lit(at)) & F.startswith(F.col("end"), F.lit(at)))


def named(triples: DataFrame) -> DataFrame:
    """(rel, start, end, weight, surface) with readable names; weight and surface text come from the JSON column info."""
    return triples.select(
        readable(F.col("rel")).alias("rel"), readable(F.col("start")).alias("start"), readable(F.col("end")).alias("end"),
        F.expr("try_cast(get_json_object(info, '$.weight') AS double)").alias("weight"), F.get_json_object("info", "$.surfaceText").alias("surface"),
    )


def meaningful(edges: DataFrame, relations: tuple[str, ...] = MEANINGFUL) -> DataFrame:
    return edges.where(F.col("rel").isin(list(relations)))


def both_in(edges: DataFrame, concepts: DataFrame, either: bool = False) -> DataFrame:
    """Edges with both ends (or either end) among the concepts (column concept)."""
    a = edges.join(concepts.select(F.col("concept").alias("start")).distinct(), "start", "left_semi")
    if not either:
        return a.join(concepts.select(F.col("concept").alias("end")).distinct(), "end", "left_semi").select(edges.columns)
    b = edges.join(concepts.select(F.col("concept").alias("end")).distinct(), "end", "left_semi")
    return a.select(edges.columns).unionByName(b.select(edges.columns)).distinct()


def related(edges: DataFrame, concept: str) -> DataFrame:
    """Edges at a concept, antonyms left out."""
    return edges.where(((F.col("start") == concept) | (F.col("end") == concept)) & (F.col("rel") != "Antonym"))


def related_places(edges: DataFrame, concepts: DataFrame, places: DataFrame, antonyms: bool = False) -> DataFrame:
    """(place, concept, rel, weight): edges from a concept to a place and from a place to a concept, each by its relations.

    concepts has a column concept, places a column place."""
    c, p = concepts.select("concept").distinct(), places.select("place").distinct()
    extra = ["Antonym"] if antonyms else []
    out = edges.where(F.col("rel").isin([*TO_PLACE, *extra])).select(F.col("start").alias("concept"), F.col("end").alias("place"), "rel", "weight")
    back = edges.where(F.col("rel").isin([*FROM_PLACE, *extra])).select(F.col("end").alias("concept"), F.col("start").alias("place"), "rel", "weight")
    both = out.unionByName(back).join(c, "concept", "left_semi").join(p, "place", "left_semi")
    return both.select("place", "concept", "rel", "weight")


def rank_places(edges: DataFrame, concepts: DataFrame, places: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, place, score) by falling score: the sum over concepts of the greatest weight, and 1 if the place is itself a concept.

    concepts has keys and concept. A place with an Antonym edge to a concept of the set is out; two scores at least are needed."""
    keys = keys or []
    found = related_places(edges, concepts, places, antonyms=True)
    found = found.join(concepts.select(*keys, "concept").distinct(), "concept")
    veto = found.where(F.col("rel") == "Antonym").select(*keys, "place").distinct()
    scores = found.where(F.col("rel") != "Antonym").groupBy(*keys, "place", "concept").agg(F.max("weight").alias("w"))
    same = concepts.join(places.select(F.col("place").alias("concept")).distinct(), "concept", "left_semi").select(*keys, F.col("concept").alias("place"), F.lit(None).cast("string").alias("concept"), F.lit(1.0).alias("w")).distinct()
    every = scores.select(*keys, "place", "concept", "w").unionByName(same)
    out = every.groupBy(*keys, "place").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    return out.join(veto, [*keys, "place"], "left_anti")


def surface_position(text: Column) -> list[Column]:
    """Subject, position and reference of a sentence on where something is; nulls if no form fits. [[...]] mark concepts."""
    forms = [
        (r"^\s*\[\[(.+?)\]\] (?:is|are) (.+?) \[\[(.+?)\]\]", (1, 2, 3)),
        (r"^\s*\*?[Ss]omething you find (.+?) \[\[(.+?)\]\] is \[\[(.+?)\]\]", (3, 1, 2)),
        (r"^\s*\*?[Yy]ou are likely to find \[\[(.+?)\]\] (.+?) \[\[(.+?)\]\]", (1, 2, 3)),
    ]
    return [F.coalesce(*[F.nullif(F.regexp_extract(text, form, at[k]), F.lit("")) for form, at in forms]) for k in range(3)]


def place_candidates(edges: DataFrame, seeds: list[str]) -> DataFrame:
    """Places by their links: ends of IsA edges to a seed and ends with more than one AtLocation link, without digits and quotes and not among the seeds."""
    isa = edges.where((F.col("rel") == "IsA") & F.col("end").isin(seeds)).select(F.col("start").alias("place")).distinct()
    at = edges.where(F.col("rel") == "AtLocation").groupBy(F.col("end").alias("place")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place")
    both = isa.union(at).distinct()
    return both.where(~F.rlike("place", F.lit("[0-9'\"]")) & ~F.col("place").isin(seeds))


def place_names(edges: DataFrame, syllable: str = "place") -> DataFrame:
    """(place, links): ends of relations whose name holds the syllable, with more than one link or an IsA link, without digits and quotes."""
    named = edges.where(F.contains(F.col("end"), F.lit(syllable))).groupBy(F.col("end").alias("place")).agg(F.count(F.lit(1)).alias("links"), F.bool_or(F.col("rel") == "IsA").alias("isa"))
    return named.where(((F.col("links") > 1) | F.col("isa")) & ~F.rlike("place", F.lit("[0-9'\"]"))).select("place", "links")


def place_list(edges: DataFrame, chosen: list[str], kept: list[str], added: list[str] = (), general: str = "place") -> DataFrame:
    """(place, part): the places list. Of the names chosen among place_names (but for the general one) and of those added part is 'places';
    of the starts of IsA links to a chosen one that are kept, without digits and quotes and not named n, it is 'sub-places'."""
    spark = edges.sparkSession
    have = place_names(meaningful(edges, tuple(x for x in MEANINGFUL if x != "Antonym"))).select("place")
    named = [p for p in dict.fromkeys([*chosen, *added]) if p != general]
    wanted = spark.createDataFrame([(p, p in added) for p in named], "place string, free boolean")
    top = wanted.join(have.withColumn("known", F.lit(True)), "place", "left").where(F.col("free") | F.col("known")).select("place", F.lit("places").alias("part"))
    sub = edges.where((F.col("rel") == "IsA") & F.col("end").isin(list(chosen)) & (F.col("start") != "n")).select(F.col("start").alias("place")).distinct()
    sub = sub.where(~F.rlike("place", F.lit("[0-9'\"]")) & F.col("place").isin(list(kept)))
    return top.unionByName(sub.select("place", F.lit("sub-places").alias("part")))


def image_places(cells: DataFrame, pattern_places: DataFrame) -> DataFrame:
    """(graph_id, place, score): product of the 0/1 coverage and the patterns' place scores (pattern_id, place, score), as sparse matrices."""
    hit = cells.where("cnt > 0").select("graph_id", "pattern_id")
    return hit.join(pattern_places, "pattern_id").groupBy("graph_id", "place").agg(F.sum("score").alias("score"))


def place_profile(matrix: DataFrame, graphs: DataFrame) -> DataFrame:
    """(place, mean_score): column means over all graphs, uncovered ones counted."""
    n = graphs.agg(F.count(F.lit(1))).scalar()
    return matrix.groupBy("place").agg(F.sum("score").alias("s")).select("place", (F.col("s") / n).alias("mean_score"))


def uncovered_share(matrix: DataFrame, graphs: DataFrame) -> DataFrame:
    n = graphs.agg(F.count(F.lit(1))).scalar()
    return matrix.agg((1 - F.countDistinct("graph_id") / n).alias("uncovered"))


def ancestors(spark, links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, distance) of a hierarchy given as links; a recursive query."""
    links.select(F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("parent")).distinct().createOrReplaceTempView("__hierarchy")
    return spark.sql("""WITH RECURSIVE up(node, ancestor, distance) AS (
        SELECT child, parent, 1 FROM __hierarchy UNION ALL SELECT u.node, h.parent, u.distance + 1 FROM up u JOIN __hierarchy h ON h.child = u.ancestor)
        SELECT node, ancestor, distance FROM up""")
