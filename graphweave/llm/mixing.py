"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.session import cut

#: Blocks that a mix's budget is divided into, at least.
BLOCKS = 10_000
#: Blocks for each shard, if these are more.
BLOCKS_A_SHARD = 8
#: Items of a shard, in which one task selects, and the most shards of a source, whatever its size: what the driver handles is bounded by both.
SHARD_ITEMS, MAX_SHARDS = 20_000, 4096


def sainte_lague(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """Seats one by one by the highest quotient weight / (2 * got + 1), ties by key; none above its cap."""
    caps = caps or {}
    got = {k: 0 for k in weights}
    heap = [(-w, str(k), k) for k, w in weights.items() if w and w > 0 and caps.get(k, 1) > 0]
    heapq.heapify(heap)
    left = seats
    while left > 0 and heap:
        _, name, k = heapq.heappop(heap)
        got[k] += 1
        left -= 1
        if got[k] < caps.get(k, seats):
            heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), name, k))
    return got


def mix(sizes: DataFrame, targets: DataFrame, *, item: str = "doc_id", tokens: str = "tokens", source: str = "source", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two tables: drawn (mix_id, source, item, copies, tokens) and report (mix_id, source, target_share, quota_tokens, tokens, share, copies_max, items).

    targets has rows (mix_id, source, weight, max_repeats, budget_fraction): weights are relative within a mix, a null
    max_repeats sets no cap, the budget is the fraction of the size of all items. The budget is divided into blocks
    of equal size, which highest quotients give to the sources, none above its supply times its cap; what a
    capped source can't take goes to the others. A source's blocks are given to its shards in the same way by their
    sizes; each shard is taken whole as often as its quota holds it, and once more as far as its seeded order reaches
    the rest, the item at the border being taken if that comes nearer to the quota. Only a count and a size a source
    and shard go to the driver, at most MAX_SHARDS a source.

    Items with null source, null item or null or no size are never drawn (their size is 0); each repeated row is an
    item of its own; absent sources and empty tables give a report with 0. A null weight counts as 0."""
    spark = sizes.sparkSession
    docs = sizes.select(F.col(item).alias("item"), F.col(source).alias("source"), F.col(tokens).cast("bigint").alias("tokens"))
    docs = cut(docs.where(F.col("item").isNotNull() & (F.col("tokens") > 0)).withColumn("row", F.monotonically_increasing_id()))
    plan = [r.asDict() for r in targets.select("mix_id", "source", "weight", "max_repeats", "budget_fraction").distinct().collect()]
    named = sorted({r["source"] for r in plan if r["source"] is not None})
    by_source = {r["source"]: (r["n"], r["t"]) for r in docs.where(F.col("source").isin(named)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()} if named else {}
    total = docs.agg(F.sum("tokens")).first()[0] or 0
    number = F.lit(1)
    for s, (n, _) in by_source.items():
        number = F.when(F.col("source") == s, F.lit(min(MAX_SHARDS, max(1, -(-n // SHARD_ITEMS))))).otherwise(number)
    docs = docs.where(F.col("source").isin(list(by_source))).withColumn("shard", F.pmod(F.xxhash64("item", "row", F.lit(seed)), number).cast("int"))
    shards = {}
    for r in docs.groupBy("source", "shard").agg(F.sum("tokens").alias("t")).collect():
        shards.setdefault(r["source"], {})[r["shard"]] = r["t"]
    quotas, reports = [], []
    for m in sorted({r["mix_id"] for r in plan}):
        rows = [r for r in plan if r["mix_id"] == m]
        budget = max((r["budget_fraction"] or 0.0) for r in rows) * total
        block = max(1.0, budget / max(BLOCKS, BLOCKS_A_SHARD * sum(len(shards.get(r["source"], ())) for r in rows)))
        weights: dict[str, float] = {}
        caps: dict[str, int] = {}
        for r in rows:
            s = r["source"]
            if s is None:
                continue
            weights[s] = weights.get(s, 0.0) + max(0.0, r["weight"] or 0.0)
            supply = by_source.get(s, (0, 0))[1]
            if not supply:
                caps[s] = 0
            elif r["max_repeats"] is not None:
                caps[s] = int(max(0, r["max_repeats"]) * supply / block + 1e-9)
                if r["max_repeats"] > 0:
                    caps[s] = max(1, caps[s])
        got = sainte_lague(weights, round(budget / block) if budget > 0 else 0, caps)
        all_weight = sum(weights.values())
        for s, n in got.items():
            limit = next((r["max_repeats"] for r in rows if r["source"] == s), None)
            reports.append((int(m), s, float(weights[s] / all_weight) if all_weight else 0.0, int(n * block), limit))
            own = shards.get(s, {})
            room = {} if limit is None else {k: max(1, -(-limit * t // int(block))) for k, t in own.items()}
            for shard, blocks in sainte_lague(own, n, room).items():
                wanted = blocks * block if limit is None else min(blocks * block, limit * own[shard])
                if wanted > 0:
                    quotas.append((int(m), s, int(shard), float(wanted), int(own[shard]), limit))
    quota = spark.createDataFrame(quotas, "mix_id int, source string, shard int, quota double, supply long, cap int")
    # a quota a shard and mix: at most MAX_SHARDS a source and mix
    cells = docs.join(F.broadcast(quota) if len(quotas) <= 100_000 else quota, ["source", "shard"])
    order = Window.partitionBy("mix_id", "source", "shard").orderBy(F.xxhash64("row", "item", "mix_id", F.lit(seed)), "row")
    passes = F.floor(F.col("quota") / F.col("supply"))
    rest = F.col("quota") - passes * F.col("supply")
    upto = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.withColumn("passes", passes).withColumn("rest", rest).withColumn("upto", upto)
    extra = (F.col("rest") > 0) & (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")) & (F.col("cap").isNull() | (F.col("passes") < F.col("cap")))
    drawn = cells.withColumn("copies", (F.col("passes") + F.when(extra, 1).otherwise(0)).cast("int")).where("copies > 0")
    drawn = cut(drawn.select("mix_id", "source", F.col("item").alias(item), "copies", "tokens"))
    wanted = spark.createDataFrame(reports, "mix_id int, source string, target_share double, quota_tokens long, max_repeats int")
    sums = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("copies_max"), F.count(F.lit(1)).alias("items"))
    zero = F.lit(0).cast("bigint")
    report = wanted.join(sums, ["mix_id", "source"], "left").withColumns({"tokens": F.coalesce("tokens", zero), "items": F.coalesce("items", zero), "copies_max": F.coalesce("copies_max", F.lit(0))})
    share = F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy("mix_id")))
    return drawn, report.withColumn("share", F.coalesce(share, F.lit(0.0)))
