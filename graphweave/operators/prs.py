"""Pairwise relationship summary: which relative positions two classes of objects take, and how dependably."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.operators.keys import dense_ids

#: Default entropy ceiling: that of three equally likely bins in nats, compared with entropies in bits.
MAX_ENTROPY = math.log(3)
#: The same ceiling in the unit of the entropies.
MAX_ENTROPY_BITS = math.log2(3)


def entropy(p: Column, base: float = 2.0) -> Column:
    """Entropy of the likelihoods of a group; + 0.0 turns a negative zero into zero."""
    return -F.sum(p * F.log2(p)) * F.lit(1.0 if base == 2.0 else math.log(2) / math.log(base)) + F.lit(0.0)


def reference_entropies(spark, most: int = 4) -> DataFrame:
    """(bins, bits, nats): entropies of uniform distributions over 2..most bins."""
    n = F.col("id").cast("int")
    return spark.range(2, most + 1).select(n.alias("bins"), F.log2("id").alias("bits"), F.log("id").alias("nats"))


def graph_hist(triples: DataFrame) -> DataFrame:
    """(graph_id, subj, ref, pos, n): each graph's histogram of positions by class pair, in stored order."""
    return triples.groupBy("graph_id", "subj", "ref", "pos").agg(F.count(F.lit(1)).alias("n"))


def build(triples: DataFrame) -> DataFrame:
    """(subj, ref, pos, n, sup, likelihood, entropy): one row per bin; counts are aggregated map-side, then once by pair."""
    bins = triples.groupBy("subj", "ref", "pos").agg(F.count(F.lit(1)).alias("n"))
    pair = Window.partitionBy("subj", "ref")
    bins = bins.withColumn("sup", F.sum("n").over(pair)).withColumn("likelihood", F.col("n") / F.col("sup"))
    return bins.withColumn("entropy", entropy_over(F.col("likelihood"), pair))


def entropy_over(p: Column, pair) -> Column:
    return -F.sum(p * F.log2(p)).over(pair) + F.lit(0.0)


def pairs(prs: DataFrame) -> DataFrame:
    """(subj, ref, sup, entropy): one row per pair."""
    return prs.select("subj", "ref", "sup", "entropy").groupBy("subj", "ref").agg(F.max("sup").alias("sup"), F.max("entropy").alias("entropy"))


def thresholds(prs: DataFrame, max_entropy: float = MAX_ENTROPY) -> DataFrame:
    """One row (minsup, max_entropy): minsup is 10 to the median of log10 of the supports, rounded half to even."""
    median = F.percentile(F.log10("sup"), F.lit(0.5))
    return pairs(prs).agg(F.bround(F.pow(F.lit(10.0), median)).cast("bigint").alias("minsup"), F.lit(max_entropy).alias("max_entropy"))


def filter_prs(prs: DataFrame, minsup: int | Column | None = None, max_entropy: float | None = MAX_ENTROPY) -> DataFrame:
    """The pairs with enough support and an entropy low enough; without minsup the default thresholds of the collection."""
    least = thresholds(prs).select("minsup").scalar() if minsup is None else (minsup if isinstance(minsup, Column) else F.lit(minsup))
    out = prs.where(F.col("sup") >= least)
    return out if max_entropy is None else out.where(F.col("entropy") <= F.lit(max_entropy))


def likelihood(triples: DataFrame, prs: DataFrame) -> DataFrame:
    """Triples with sup, entropy and likelihood of their position: null without a histogram of the pair, 0 without a bin."""
    # one row a pair with its bins as a map, so that the triples are joined once
    bins = F.map_from_entries(F.collect_list(F.struct("pos", "likelihood"))).alias("__bins")
    known = prs.groupBy("subj", "ref").agg(F.max("sup").alias("sup"), F.max("entropy").alias("entropy"), bins)
    out = triples.join(known, ["subj", "ref"], "left")
    return out.withColumn("likelihood", F.when(F.col("sup").isNotNull(), F.coalesce(F.try_element_at("__bins", F.col("pos")), F.lit(0.0)))).drop("__bins")


def clean(prs: DataFrame, top: int | None = None) -> DataFrame:
    """The bins above 1 / number of bins, or the top ones (ties by name); likelihood to 3 and entropy to 2 places, half to even."""
    pair = Window.partitionBy("subj", "ref")
    if top is None:
        out = prs.withColumn("__bins", F.count(F.lit(1)).over(pair)).where(F.col("likelihood") > 1 / F.col("__bins")).drop("__bins")
    else:
        out = prs.withColumn("__k", F.row_number().over(pair.orderBy(F.desc("n"), "pos"))).where(F.col("__k") <= top).drop("__k")
    return out.withColumns({"likelihood": F.bround("likelihood", 3), "entropy": F.bround("entropy", 2)})


def merge_labels(prs: DataFrame, mapping: dict[str, str], base: float = 2.0) -> DataFrame:
    """prs with positions renamed and bins of one name united; the entropy is computed again (base e as in the original analysis)."""
    keys = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else None
    pos = F.coalesce(F.element_at(keys, F.col("pos")), F.col("pos")) if mapping else F.col("pos")
    bins = prs.groupBy("subj", "ref", pos.alias("pos")).agg(F.sum("n").alias("n"), F.max("sup").alias("sup"), F.sum("likelihood").alias("likelihood"))
    p, pair = F.col("likelihood"), Window.partitionBy("subj", "ref")
    return bins.withColumn("entropy", -F.sum(p * F.log2(p)).over(pair) * F.lit(math.log(2) / math.log(base)) + F.lit(0.0))


def merge_matrix(prs: DataFrame, ceiling: float, positions: list[str], base: float = math.e) -> DataFrame:
    """(pos_a, pos_b, low): histograms whose entropy is at most the ceiling after merging two positions; equal positions: without merging.

    Each histogram's bins meet the pairs of the given positions, which are a fixed handful."""
    grid = F.array(*[F.struct(F.lit(a).alias("pos_a"), F.lit(b).alias("pos_b")) for a in positions for b in positions if a <= b])
    merged = prs.withColumn("__m", F.explode(grid)).select("*", "__m.*").withColumn("pos", F.when(F.col("pos") == F.col("pos_b"), F.col("pos_a")).otherwise(F.col("pos")))
    bins = merged.groupBy("pos_a", "pos_b", "subj", "ref", "pos").agg(F.sum("likelihood").alias("p"))
    per = bins.groupBy("pos_a", "pos_b", "subj", "ref").agg(entropy(F.col("p"), base).alias("entropy"))
    return per.groupBy("pos_a", "pos_b").agg(F.count_if(F.round("entropy", 9) <= F.lit(round(ceiling, 9))).alias("low"))


def best_merges(matrix: DataFrame, n: int, worst: bool = False) -> DataFrame:
    """The n merges of two positions with most (or fewest) low-entropy histograms; ties by name."""
    order = F.col("low") if worst else F.desc("low")
    return matrix.where("pos_a < pos_b").orderBy(order, "pos_a", "pos_b").limit(n)


def support_outliers(prs: DataFrame) -> DataFrame:
    """(subj, ref, sup, low, high): pairs whose log10 support lies outside the quartiles by more than 1.5 times their distance."""
    own = pairs(prs)
    q = own.agg(F.percentile(F.log10("sup"), F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    low = q.select((F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0]))).scalar()
    high = q.select((F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0]))).scalar()
    x = F.log10("sup")
    return own.withColumns({"low": low, "high": high}).where((x < F.col("low")) | (x > F.col("high"))).select("subj", "ref", "sup", "low", "high")


def same_class(prs: DataFrame) -> DataFrame:
    """(label, sup, place): pairs of a class with itself by falling support."""
    own = pairs(prs).where(F.col("subj") == F.col("ref")).select(F.col("subj").alias("label"), "sup")
    return dense_ids(own, [F.desc("sup"), F.asc("label")], "place").withColumn("place", (F.col("place") + 1).cast("int"))


def kth_with_position(prs: DataFrame, pos: str, k: int) -> DataFrame:
    """The bins of the k-th (from 0) histogram by entropy among those that keep the position after cleaning; ties by pair."""
    cleaned = clean(prs)
    own = pairs(prs).join(cleaned.where(F.col("pos") == pos).select("subj", "ref"), ["subj", "ref"], "left_semi")
    pick = own.orderBy("entropy", "subj", "ref").limit(k + 1).orderBy(F.desc("entropy"), F.desc("subj"), F.desc("ref")).limit(1)
    enough = own.agg(F.count(F.lit(1))).scalar() > k
    return cleaned.join(F.broadcast(pick.select("subj", "ref")), ["subj", "ref"]).where(enough)


def numeric_histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts over equal bins 1..bins of [low, high); 0 and bins + 1 hold what lies outside; nulls are ignored."""
    at = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.where(F.col(column).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
