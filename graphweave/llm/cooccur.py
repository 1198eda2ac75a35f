"""Items that appear together: counts of item pairs by external sorting of packed 64-bit pair codes."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.operators.keys import dense_ids
from graphweave.session import BROADCAST_ROWS, cut, parallelism

#: Items of a basket handled at once; a larger basket is split into blocks of about this many, and each pair of blocks is work of its own.
BLOCK_ITEMS = 1024
#: Pair codes held by a task before they are sorted into a run.
RUN_CODES = 1 << 21
#: Items whose rows in a lookup by item are broadcast: the most frequent ones, so that no task gets their rows.
HEAD_ITEMS = 2000

_CODE = "code bigint, n bigint"


def _runs(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with the sum of their counts."""
    if counts is None:
        codes = np.sort(codes)
        counts = None
    else:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    if not len(codes):
        return codes, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    n = np.diff(np.concatenate([first, [len(codes)]])) if counts is None else np.add.reduceat(counts, first)
    return codes[first], n.astype(np.int64)


def _pair_codes(sizes: np.ndarray, flat: np.ndarray) -> Iterator[np.ndarray]:
    """Packed codes of the pairs in each list; flat holds 4 * id + side: 0 whole basket, 1 and 2 the two blocks to be crossed, 3 one block within."""
    starts = np.cumsum(sizes) - sizes
    ids, side = flat >> 2, flat & 3
    full = np.flatnonzero(sizes > 0)
    crossed = np.zeros(len(sizes), bool)
    crossed[full] = np.isin(np.minimum.reduceat(side, starts[full]), (1, 2)) if len(full) else False
    for r in np.flatnonzero(crossed):  # blocks of a large basket: only the pairs between them
        part, of = ids[starts[r] : starts[r] + sizes[r]], side[starts[r] : starts[r] + sizes[r]]
        x, y = part[of == 1], part[of == 2]
        step = max(1, RUN_CODES // max(1, len(y)))
        for at in range(0, len(x), step):
            u, v = x[at : at + step, None], y[None]
            yield ((np.minimum(u, v) << 32) | np.maximum(u, v)).ravel()
    for m in np.unique(sizes[~crossed]):
        if m < 2:
            continue
        rows = np.flatnonzero((sizes == m) & ~crossed)
        a, b = np.triu_indices(m, 1)
        step = max(1, RUN_CODES // len(a))
        for at in range(0, len(rows), step):
            pick = starts[rows[at : at + step]][:, None] + np.arange(m)
            x, y = ids[pick][:, a], ids[pick][:, b]
            yield ((np.minimum(x, y) << 32) | np.maximum(x, y)).ravel()


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's pair codes as sorted runs with counts."""
    held, size, done, counts = [], 0, np.empty(0, np.int64), np.empty(0, np.int64)

    def batch(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    for b in batches:
        lists = b.column(0)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        for codes in _pair_codes(sizes, flat):
            held.append(codes)
            size += len(codes)
            if size >= RUN_CODES:
                fresh, n = _runs(np.concatenate(held))
                done, counts = _runs(np.concatenate([done, fresh]), np.concatenate([counts, n]))
                held, size = [], 0
                if len(done) >= RUN_CODES:
                    yield batch(done, counts)
                    done, counts = done[:0], counts[:0]
    if held:
        fresh, n = _runs(np.concatenate(held))
        done, counts = _runs(np.concatenate([done, fresh]), np.concatenate([counts, n]))
    yield batch(done, counts)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length count of codes that come in order, runs going on over batches."""
    code, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        code = np.concatenate([code, b.column(0).to_numpy(zero_copy_only=False)])
        n = np.concatenate([n, b.column(1).to_numpy(zero_copy_only=False)])
        code, n = _runs(code, n)
        if len(code) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(code[:-1]), pa.array(n[:-1])], names=["code", "n"])
            code, n = code[-1:], n[-1:]
    if len(code):
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])


def _by_id(big: DataFrame, vocabulary: DataFrame, rows: int, id_col: str, head: DataFrame | None = None) -> DataFrame:
    """big joined to the vocabulary on id_col; beyond the broadcast bound only its head is broadcast and the rest shuffled."""
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(vocabulary), id_col)
    top, rest = vocabulary.where(F.col(id_col) < HEAD_ITEMS), vocabulary.where(F.col(id_col) >= HEAD_ITEMS)
    return big.where(F.col(id_col) < HEAD_ITEMS).join(F.broadcast(top), id_col).unionByName(big.where(F.col(id_col) >= HEAD_ITEMS).join(rest, id_col))


def cooccurrences(df: DataFrame, basket: str, item: str, *, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, baskets, lift, odds_ratio, log_odds) of each pair of items found together.

    item_a < item_b; n_a, n_b, n_ab count baskets, baskets is the number of baskets with an item. lift is
    n_ab * baskets / (n_a * n_b); the odds ratio adds 0.5 to each cell of the 2 x 2 table, so that it is always finite.
    Pairs with n_ab < min_count or lift < min_lift are left out; items in fewer than min_count baskets, or in more than
    baskets / min_lift, can be in no such pair and are dropped beforehand.

    Method: items get dense ids by falling frequency; a pair is packed into 64 bits; each task turns its codes into
    sorted runs with counts, the runs are shuffled by code, merged by the engine's spilling external sort and counted
    by run length. Baskets above BLOCK_ITEMS items are split into blocks and pairs of blocks.

    Rows with null basket or item are ignored; repeated rows count once; an empty table gives no rows; other columns
    are ignored. Ties in frequency get ids by item. Up to 2^31 items."""
    spark = df.sparkSession
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where(F.col("basket").isNotNull() & F.col("item").isNotNull())
    rows = cut(rows.distinct())
    baskets = rows.select("basket").distinct().count()
    n = F.count(F.lit(1))
    counts = rows.groupBy("item").agg(n.alias("n")).where(F.col("n") >= min_count)
    if min_lift > 0:
        counts = counts.where(F.col("n") * F.lit(float(min_lift)) <= F.lit(float(baskets) * (1 + 1e-9)))
    vocabulary = cut(dense_ids(counts, [F.desc("n"), F.asc("item")]))
    words = vocabulary.count()
    if words >= 1 << 31:
        raise ValueError("more than 2^31 items")
    pairs = vocabulary.select("item", "id")
    if words <= BROADCAST_ROWS:
        coded = rows.join(F.broadcast(pairs), "item").select("basket", "id")
    else:  # the frequent items by broadcast, the others by shuffle
        top = rows.join(F.broadcast(pairs.where(F.col("id") < HEAD_ITEMS)), "item", "left")
        rest = top.where(F.col("id").isNull()).drop("id").join(pairs.where(F.col("id") >= HEAD_ITEMS), "item")
        coded = top.where(F.col("id").isNotNull()).select("basket", "id").unionByName(rest.select("basket", "id"))
    coded = cut(coded)
    large = cut(coded.groupBy("basket").agg(n.alias("size")).where(F.col("size") > BLOCK_ITEMS))
    many = large.count()
    blocks = large.select("basket", F.ceil(F.col("size") / BLOCK_ITEMS).cast("int").alias("blocks"))
    whole = coded
    if many:
        blocks = F.broadcast(blocks) if many <= BROADCAST_ROWS else blocks
        whole = coded.join(blocks, "basket", "left_anti")
    lists = whole.groupBy("basket").agg(F.collect_list(F.col("id") * 4).alias("ids")).where(F.size("ids") > 1).select("ids")
    if many:
        split = coded.join(blocks, "basket").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        split = split.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        lo, hi = F.least("i", "j"), F.greatest("i", "j")
        side = F.when(F.col("i") == F.col("j"), 3).when(F.col("i") < F.col("j"), 1).otherwise(2)
        split = split.select("basket", lo.alias("lo"), hi.alias("hi"), (F.col("id") * 4 + side).alias("x"))
        lists = lists.unionByName(split.groupBy("basket", "lo", "hi").agg(F.collect_list("x").alias("ids")).select("ids"))
    runs = lists.mapInArrow(_sorted_runs, _CODE)
    merged = runs.repartition(parallelism(spark), "code").sortWithinPartitions("code").mapInArrow(_count_runs, _CODE)
    found = merged.where(F.col("n") >= min_count).select(F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), F.col("n").alias("n_ab"))
    for side in ("a", "b"):
        words_of = vocabulary.select(F.col("id").alias(side), F.col("item").alias(f"w_{side}"), F.col("n").alias(f"c_{side}"))
        found = _by_id(found, words_of, words, side)
    swap = F.col("w_a") > F.col("w_b")
    out = found.select(
        F.when(swap, F.col("w_b")).otherwise(F.col("w_a")).alias("item_a"), F.when(swap, F.col("w_a")).otherwise(F.col("w_b")).alias("item_b"),
        F.when(swap, F.col("c_b")).otherwise(F.col("c_a")).alias("n_a"), F.when(swap, F.col("c_a")).otherwise(F.col("c_b")).alias("n_b"),
        "n_ab", F.lit(baskets).cast("bigint").alias("baskets"),
    )
    exact = "cast(n_ab as decimal(19,0)) * cast(baskets as decimal(19,0))", "cast(n_a as decimal(19,0)) * cast(n_b as decimal(19,0))"
    if min_lift > 0:  # in whole numbers: both sides times the power of ten that makes min_lift whole
        lift = Decimal(str(min_lift))
        scale = max(0, -lift.normalize().as_tuple().exponent)
        out = out.where(F.expr(exact[0]) * F.lit(10**scale).cast("decimal(18,0)") >= F.expr(exact[1]) * F.lit(int(lift.scaleb(scale))).cast("decimal(18,0)"))
    half = F.lit(0.5)
    odds = (F.col("n_ab") + half) * (F.col("baskets") - F.col("n_a") - F.col("n_b") + F.col("n_ab") + half) / ((F.col("n_a") - F.col("n_ab") + half) * (F.col("n_b") - F.col("n_ab") + half))
    return out.withColumns({"lift": F.col("n_ab") * F.col("baskets") / (F.col("n_a").cast("double") * F.col("n_b")), "odds_ratio": odds, "log_odds": F.log(odds)})
