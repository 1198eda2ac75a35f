"""Filling containers of fixed capacity: vector best-fit over residual capacities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.session import cut, lookup

#: Items of a shard, which one task packs; a first pass packs shards on their own, later passes merge their half-empty containers.
SHARD_ITEMS = 4000
#: Containers filled below this share are taken up again as whole items by the next pass.
REOPEN_BELOW = 0.97
#: Passes over half-empty containers of several shards.
MERGE_PASSES = 3


@dataclass(frozen=True)
class Limits:
    """What a container holds besides its tokens: documents, and attention cost (sum of squared piece lengths), as shares of what its capacity suggests.

    docs_per_token: at most max(1, capacity * docs_per_token) pieces with tokens. attention: at most capacity ** 2 * attention;
    a piece whose own cost is above that is alone in its container, as it may not be cut."""

    docs_per_token: float = 1.0
    attention: float = 1.0
    #: weights of tokens, documents and attention in the dot product
    weights: tuple[float, float, float] = (1.0, 0.05, 0.1)
    #: "dot" for the largest weighted dot product of need and use, "norm" for the least weighted norm of what stays free
    rule: str = "norm"


def best_fit(need: np.ndarray, limit: np.ndarray, weights: np.ndarray, rule: str) -> np.ndarray:
    """Container of each item (n x 3 needs, each at most the limit), items in falling order of need, ties by position.

    An item goes to the open container that fits it under every limit and has the best score, ties to the oldest; if
    none fits, a container is opened. Containers left without room for the least item are closed."""
    scaled = need / limit
    order = np.lexsort((np.arange(len(need)), -(scaled @ weights), -scaled[:, 0]))
    where = np.full(len(need), -1, np.int64)
    free = np.empty((1024, 3))
    ids = np.empty(1024, np.int64)
    n, made, least = 0, 0, min(scaled[scaled[:, 0] > 0, 0], default=0)
    eps = 1e-12
    for k in order:
        x = scaled[k]
        pick = -1
        if n:
            f = free[:n]
            ok = np.flatnonzero((f[:, 0] >= x[0] - eps) & (f[:, 1] >= x[1] - eps) & (f[:, 2] >= x[2] - eps))
            if len(ok):
                if rule == "dot":
                    pick = ok[np.argmax((1 - f[ok]) @ (weights * np.maximum(x, eps)))]
                else:
                    rest = f[ok] - x
                    pick = ok[np.argmin((rest * rest) @ weights)]
        if pick < 0:
            if n == len(ids):
                free, ids = np.concatenate([free, np.empty_like(free)]), np.concatenate([ids, np.empty_like(ids)])
            free[n], ids[n], pick = 1.0, made, n
            made, n = made + 1, n + 1
        where[k] = ids[pick]
        free[pick] -= x
        if free[pick, 0] < max(least, eps) - eps or free[pick, 1] < eps or free[pick, 2] < eps:
            n -= 1
            free[pick], ids[pick] = free[n], ids[n]
    return where


def pack(sizes: DataFrame, jobs: DataFrame, *, item: str = "doc_id", tokens: str = "tokens", source: str = "source", limits: Limits = Limits()) -> DataFrame:
    """(job_id, container_id, item, piece_no, start_token, n_tokens): each job's items in containers of its capacity.

    jobs has rows (job_id, source, capacity_tokens); a null source takes all items, one without items gives no rows. An
    item is cut only if it exceeds the capacity: into full pieces, each alone in a container, and a remainder. No
    container exceeds the capacity; none with more than one piece exceeds the number of pieces or the attention cost of
    the limits. Items of size 0 get a piece of size 0, which counts under no limit. Null sizes count as 0; rows with null item
    are ignored; each repeated row is an item of its own. A job with null or non-positive capacity gives no rows; empty
    tables give no rows.

    Method: items are spread over shards by hash, each shard is packed by vector best-fit; containers left half-empty
    are then taken as items themselves and packed across shards, so the loss doesn't grow with the number of shards."""
    docs = sizes.select(F.col(item).alias("item"), F.col(source).cast("string").alias("source"), F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("bigint").alias("tokens")).where(F.col("item").isNotNull())
    key = F.when(F.col("source").isNull(), "*").otherwise(F.concat(F.lit("="), "source"))
    jobs = cut(jobs.select(F.col("job_id").cast("int").alias("job_id"), key.alias("of"), F.col("capacity_tokens").cast("bigint").alias("capacity")).where("capacity > 0").distinct())
    n_jobs = jobs.count()
    rows = docs.select("item", "tokens", F.explode(F.array(F.lit("*"), F.concat(F.lit("="), "source"))).alias("of")).where(F.col("of").isNotNull())
    rows = lookup(rows, jobs, ["of"], n_jobs)
    whole = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    full = F.transform(F.sequence(F.lit(1), whole), lambda k: F.struct((k - 1).alias("piece_no"), F.col("capacity").alias("n_tokens")))
    rest = F.array(F.struct(whole.alias("piece_no"), (F.col("tokens") - whole * F.col("capacity")).alias("n_tokens")))
    none = F.array().cast("array<struct<piece_no:int,n_tokens:bigint>>")
    pieces = F.concat(F.when(whole > 0, full).otherwise(none), F.when((F.col("tokens") > whole * F.col("capacity")) | (whole == 0), rest).otherwise(none))
    pieces = rows.select("job_id", "capacity", "item", F.explode(pieces).alias("p")).select("job_id", "capacity", "item", "p.piece_no", "p.n_tokens")
    tokens_ = F.col("n_tokens").cast("double")
    pieces = pieces.withColumn("cost", tokens_ * tokens_)
    large = (F.col("n_tokens") == F.col("capacity")) | (F.col("cost") > F.col("capacity").cast("double") * F.col("capacity") * limits.attention)
    alone, loose = pieces.where(large), pieces.where(~large)
    weights = np.array(limits.weights)

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cap = float(pdf["capacity"].iloc[0])
        limit = np.array([cap, max(1.0, np.floor(cap * limits.docs_per_token)), cap * cap * limits.attention])
        pdf = pdf.sort_values("hash", kind="stable")
        bins = best_fit(pdf[["tokens", "docs", "cost"]].to_numpy(float), limit, weights, limits.rule)
        prefix = "-".join(str(int(k)) for k in key)
        return pdf.assign(bin=[f"{prefix}-{b}" for b in bins])[["job_id", "capacity", "unit", "tokens", "docs", "cost", "bin"]]

    schema = "job_id int, capacity bigint, unit string, tokens bigint, docs bigint, cost double, bin string"
    item_key = F.concat_ws(":", F.col("item").cast("string"), F.col("piece_no"), F.monotonically_increasing_id())
    loose = cut(loose.withColumn("unit", item_key))
    units = loose.select("job_id", "capacity", "unit", F.col("n_tokens").alias("tokens"), (F.col("n_tokens") > 0).cast("bigint").alias("docs"), "cost")
    placed = None
    for level in range(1 + MERGE_PASSES):
        shards = units.groupBy("job_id").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / SHARD_ITEMS)).cast("int").alias("shards"))
        shards = cut(shards)
        most = shards.agg(F.max("shards")).first()[0]
        if most is None and placed is not None:
            break
        hashed = lookup(units.withColumn("hash", F.xxhash64("unit", F.lit(level))), shards, ["job_id"], n_jobs)
        hashed = hashed.withColumn("level", F.lit(level)).withColumn("shard", F.pmod("hash", "shards").cast("int")).drop("shards")
        bins = cut(hashed.groupBy("job_id", "level", "shard").applyInPandas(packed, schema))
        step = bins.select("job_id", F.col("unit").alias("lower"), "bin")
        placed = step.select("job_id", F.col("lower").alias("unit"), "bin") if placed is None else _lift(placed, step)
        if (most or 1) <= 1 or level == MERGE_PASSES:
            break
        fill = bins.groupBy("job_id", "capacity", F.col("bin").alias("unit")).agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"), F.sum("cost").alias("cost"))
        units = cut(fill.where(F.col("tokens") < F.col("capacity") * REOPEN_BELOW))
    first = loose.select("job_id", "capacity", "item", "piece_no", "n_tokens", "unit").join(placed, ["job_id", "unit"])
    out = first.select("job_id", "capacity", F.col("bin").alias("container_id"), "item", "piece_no", "n_tokens")
    lone = alone.select("job_id", "capacity", F.concat_ws("-", F.lit("full"), F.col("item").cast("string"), F.col("piece_no"), F.monotonically_increasing_id()).alias("container_id"), "item", "piece_no", "n_tokens")
    both = out.unionByName(lone)
    return both.select("job_id", "container_id", F.col("item").alias(item), "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start_token"), "n_tokens")


def _lift(placed: DataFrame, step: DataFrame) -> DataFrame:
    """Items in containers, these in containers of the next pass where they were taken up again."""
    upper = step.select("job_id", F.col("lower").alias("bin"), F.col("bin").alias("__upper"))
    return placed.join(upper, ["job_id", "bin"], "left").select("job_id", "unit", F.coalesce("__upper", "bin").alias("bin"))


def pack_report(packed: DataFrame, jobs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(job_id, capacity_tokens, containers, pieces, tokens, fill, least_containers, docs_fill, attention_fill, alone_above, over) of each job with containers.

    docs_fill and attention_fill are the shares used of the other limits (of all containers together). alone_above counts the
    single pieces whose own attention cost is above the limit; over the containers that exceed a limit otherwise (always 0)."""
    capacity = jobs.select("job_id", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).where("capacity_tokens > 0").distinct()
    cost = F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens"))
    bins = packed.groupBy("job_id", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.count(F.when(F.col("n_tokens") > 0, 1)).alias("docs"), cost.alias("cost"))
    most = F.greatest(F.lit(1.0), F.floor(F.col("capacity_tokens") * F.lit(limits.docs_per_token)).cast("double"))
    dearest = F.col("capacity_tokens").cast("double") * F.col("capacity_tokens") * F.lit(limits.attention)
    bins = lookup(bins, capacity, ["job_id"], capacity.count()).withColumn("most", most).withColumn("dearest", dearest)
    above = F.col("cost") > F.col("dearest") * (1 + 1e-9)
    over = (F.col("tokens") > F.col("capacity_tokens")) | (F.col("docs") > F.col("most")) | (above & (F.col("docs") > 1))
    total = bins.groupBy("job_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), (F.sum("docs") / F.sum("most")).alias("docs_fill"),
        (F.sum("cost") / F.sum("dearest")).alias("attention_fill"), F.count(F.when(above & (F.col("docs") <= 1), 1)).alias("alone_above"), F.count(F.when(over, 1)).alias("over"),
    )
    fill = F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return total.select("job_id", "capacity_tokens", "containers", "pieces", "tokens", fill.alias("fill"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), "docs_fill", "attention_fill", "alone_above", "over")
