"""Scene graphs from segmented images: column runs, relative positions of segment pairs, features.

A raster is kept as runs(image_id, x, run, segment_id, y0, len): the runs of equal ids down each image column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.session import cut

#: The counters of a pair (i, j), in the order of the feature vector (fixed values).
COUNTERS = ("i on j", "j on i", "i above j", "j above i", "i around j", "j around i", "other")


def column_runs(pixels: DataFrame) -> DataFrame:
    """Runs from pixels (image_id, x, y, segment_id): gaps and islands down each column. Run numbers start at 0."""
    down = Window.partitionBy("image_id", "x").orderBy("y")
    new = F.when(F.lag("segment_id").over(down).eqNullSafe(F.col("segment_id")) & (F.row_number().over(down) > 1), 0).otherwise(1)
    p = pixels.withColumn("new", new).withColumn("run", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return p.groupBy("image_id", "x", "run").agg(F.max("segment_id").alias("segment_id"), F.min("y").alias("y0"), F.count(F.lit(1)).alias("len"))


def column_runs_depth(pixels: DataFrame, share: float = 0.1) -> DataFrame:
    """As column_runs with depth(pixels: depth 0..255): means of the first and last share of each run, at least one pixel, scaled to 0..1."""
    down = Window.partitionBy("image_id", "x").orderBy("y")
    new = F.when(F.lag("segment_id").over(down).eqNullSafe(F.col("segment_id")) & (F.row_number().over(down) > 1), 0).otherwise(1)
    p = pixels.withColumn("new", new).withColumn("run", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    run = Window.partitionBy("image_id", "x", "run")
    p = p.withColumns({"k": F.row_number().over(run.orderBy("y")), "n": F.count(F.lit(1)).over(run)})
    edge = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return p.groupBy("image_id", "x", "run").agg(
        F.max("segment_id").alias("segment_id"), F.min("y").alias("y0"), F.count(F.lit(1)).alias("len"),
        (F.avg(F.when(F.col("k") <= edge, F.col("depth"))) / 255).alias("depth_first"), (F.avg(F.when(F.col("k") > F.col("n") - edge, F.col("depth"))) / 255).alias("depth_last"),
    )


def pair_positions(runs: DataFrame, order: DataFrame) -> DataFrame:
    """(image_id, i, j, seven counters): columns by what the words of each pair say; pairs without a common column have no row.

    order: (image_id, segment_id, rank); i is the one of lower rank. Per column the runs of i and j form a word: a
    symbol for each change of object, + before it if other runs lie between; a repeated object adds nothing but moves on
    the place from which between counts. Runs of id 0 are no object."""
    seen = runs.where(F.col("segment_id") != 0).join(order, ["image_id", "segment_id"]).select("image_id", "x", "run", "segment_id", "rank")
    # one row a column with its runs in order; its pairs are formed in place, so nothing but the runs is shuffled
    columns = seen.groupBy("image_id", "x").agg(F.array_sort(F.collect_list(F.struct("run", "segment_id", "rank"))).alias("runs"))
    columns = columns.withColumn("objects", F.array_sort(F.array_distinct(F.transform("runs", lambda r: F.struct(r["rank"].alias("rank"), r["segment_id"].alias("id"))))))
    firsts = columns.select("image_id", "runs", "objects", F.posexplode("objects").alias("at", "a"))
    pairs = firsts.select("image_id", "runs", F.col("a.id").alias("i"), F.explode(F.slice("objects", F.col("at") + 2, F.size("objects"))).alias("b")).select("image_id", "runs", "i", F.col("b.id").alias("j"))
    mine = F.filter("runs", lambda r: (r["segment_id"] == F.col("i")) | (r["segment_id"] == F.col("j")))
    per = pairs.select("image_id", "i", "j", F.transform(mine, lambda r: F.struct(r["run"].alias("run"), F.when(r["segment_id"] == F.col("i"), "i").otherwise("j").alias("sym"))).alias("s"))
    start = F.struct(F.lit("").alias("word"), F.lit("").alias("last"), F.lit(-1).cast("bigint").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = (acc["last"] != "") & (x["run"] > acc["at"] + 1)
        word = F.when(x["sym"] == acc["last"], acc["word"]).otherwise(F.concat(acc["word"], F.when(gap, "+").otherwise(""), x["sym"]))
        return F.struct(word.alias("word"), x["sym"].alias("last"), x["run"].cast("bigint").alias("at"))

    word = F.aggregate("s", start, step)["word"]
    w = per.select("image_id", "i", "j", word.alias("word"))
    mark = F.col("word")
    kind = (
        F.when(mark == "ij", "i on j").when(mark == "ji", "j on i").when(mark == "i+j", "i above j").when(mark == "j+i", "j above i")
        .when(mark.isin("iji", "i+ji", "ij+i", "i+j+i"), "i around j").when(mark.isin("jij", "j+ij", "ji+j", "j+i+j"), "j around i").otherwise("other")
    )
    return w.withColumn("kind", kind).groupBy("image_id", "i", "j").agg(*[F.count_if(F.col("kind") == c).alias(c) for c in COUNTERS])


def boxes(runs: DataFrame) -> DataFrame:
    """(image_id, segment_id, y1, x1, y2, x2): half-open bounding boxes of segments; id 0 is none."""
    r = runs.where(F.col("segment_id") != 0)
    return r.groupBy("image_id", "segment_id").agg(F.min("y0").alias("y1"), F.min("x").alias("x1"), F.max(F.col("y0") + F.col("len")).alias("y2"), (F.max("x") + 1).alias("x2"))


def barycentre(runs: DataFrame) -> DataFrame:
    """(image_id, segment_id, cx, cy): mean pixel of each segment, cut to whole pixels."""
    n = F.col("len")
    mid = F.sum(n * (F.col("y0") + (n - 1) / 2)) / F.sum(n)
    return runs.where(F.col("segment_id") != 0).groupBy("image_id", "segment_id").agg((F.sum(n * F.col("x")) / F.sum(n)).cast("int").alias("cx"), mid.cast("int").alias("cy"))


def side_features(i: list[Column], j: list[Column]) -> list[Column]:
    """deltaY1, deltaY2, deltaX1, deltaX2: differences of two boxes (y1, x1, y2, x2), over the greater of the axis's absolute values; 0 if both are 0."""
    y1, y2, x1, x2 = i[0] - j[0], i[2] - j[2], i[1] - j[1], i[3] - j[3]
    my, mx = F.greatest(F.abs(y1), F.abs(y2)), F.greatest(F.abs(x1), F.abs(x2))
    ratio = lambda a, m: F.coalesce(F.try_divide(a.cast("double"), m), F.lit(0.0))
    return [ratio(y1, my), ratio(y2, my), ratio(x1, mx), ratio(x2, mx)]


def pair_features(positions: DataFrame, box: DataFrame) -> DataFrame:
    """(image_id, i, j, the seven counters over the narrower segment's width, four side features)."""
    at = lambda s: box.select("image_id", F.col("segment_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("y1", "x1", "y2", "x2")])
    p = positions.join(at("i"), ["image_id", "i"]).join(at("j"), ["image_id", "j"])
    width = F.least(F.col("i_x2") - F.col("i_x1"), F.col("j_x2") - F.col("j_x1"))
    sides = side_features(*[[F.col(f"{s}_{c}") for c in ("y1", "x1", "y2", "x2")] for s in ("i", "j")])
    return p.select("image_id", "i", "j", *[F.try_divide(F.col(f"`{c}`").cast("double"), width).alias(c) for c in COUNTERS], *[s.alias(n) for s, n in zip(sides, ("deltaY1", "deltaY2", "deltaX1", "deltaX2"))])


def recomputed_features(runs: DataFrame, order: DataFrame, labelled: DataFrame) -> DataFrame:
    """pair_features of the labelled pairs (image_id, i, j) alone: only their images are gone through. i is the pair's subject."""
    images = labelled.select("image_id").distinct()
    mine = cut(runs.join(images, "image_id", "left_semi"))
    features = pair_features(pair_positions(mine, order.select("image_id", "segment_id", "rank")), boxes(mine))
    return features.join(labelled.select("image_id", "i", "j").distinct(), ["image_id", "i", "j"], "left_semi")


def segment_order(segments: DataFrame, categories: DataFrame) -> DataFrame:
    """(image_id, segment_id, label, rank): segments with their category's name (none without), ranked by name."""
    named = segments.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("label")), "category_id")
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("label", "segment_id"))
    return named.select("image_id", "segment_id", "label", rank.alias("rank"))


def scene_graphs(runs: DataFrame, segments: DataFrame, categories: DataFrame, classify) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all images with segments: an edge for each pair with a common column, its position by classify.

    classify takes pair_features and returns them with a column pos (a fitted model's transform)."""
    order = segment_order(segments, categories)
    features = pair_features(pair_positions(runs, order.select("image_id", "segment_id", "rank")), boxes(runs))
    edges = classify(features).select(F.col("image_id").alias("graph_id"), F.col("i").alias("s"), "pos", F.col("j").alias("r"))
    return order.select(F.col("image_id").alias("graph_id"), F.col("segment_id").alias("node_id"), "label"), edges


def encode_mask(pixels: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """(key, runs): run lengths of 0/1 values in order, starting with a run of 0 (of length 0 if need be)."""
    by = Window.partitionBy(*key).orderBy(order)
    v = F.col(value).cast("int")
    new = F.when(F.row_number().over(by) == 1, (v != 0).cast("int")).when(F.lag(v).over(by) != v, 1).otherwise(0)
    p = pixels.withColumn("__run", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per = p.groupBy(*key, "__run").agg(F.count(F.lit(1)).cast("int").alias("n"))
    runs = per.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__run", "n"))).alias("r"))
    lens = F.transform("r", lambda x: x["n"])
    return runs.select(*key, F.when(F.col("r")[0]["__run"] == 0, lens).otherwise(F.concat(F.array(F.lit(0)), lens)).alias("runs"))


def decode_mask(runs: Column) -> Column:
    """The 0/1 values of run lengths that start with 0."""
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat((i % 2).cast("int"), n)))


def touch_depth(runs: DataFrame, order: DataFrame) -> DataFrame:
    """(image_id, i, j, touches, touch_gap): where runs of a pair follow each other in a column, the mean absolute difference of depth at their border.

    runs: column_runs_depth. The depth variant of pair_positions, whose counters it goes with; pairs that never touch
    have no row."""
    down = Window.partitionBy("image_id", "x").orderBy("run")
    r = runs.withColumns({"next_id": F.lead("segment_id").over(down), "next_first": F.lead("depth_first").over(down)})
    r = r.where((F.col("segment_id") != 0) & (F.col("next_id") != 0) & (F.col("segment_id") != F.col("next_id")))
    rank = order.select("image_id", "segment_id", "rank")
    r = r.join(rank, ["image_id", "segment_id"]).join(rank.select("image_id", F.col("segment_id").alias("next_id"), F.col("rank").alias("next_rank")), ["image_id", "next_id"])
    up = (F.col("rank") < F.col("next_rank")) | ((F.col("rank") == F.col("next_rank")) & (F.col("segment_id") < F.col("next_id")))
    i, j = F.when(up, F.col("segment_id")).otherwise(F.col("next_id")), F.when(up, F.col("next_id")).otherwise(F.col("segment_id"))
    return r.groupBy("image_id", i.alias("i"), j.alias("j")).agg(F.count(F.lit(1)).alias("touches"), F.avg(F.abs(F.col("depth_last") - F.col("next_first"))).alias("touch_gap"))
