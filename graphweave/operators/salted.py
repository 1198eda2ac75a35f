"""Per-key results where a few keys hold most of the rows: two-stage salted aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.session import BROADCAST_ROWS, cut

KINDS = ("count", "sum", "min", "max", "avg", "count_distinct")


def heavy_keys(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The keys that hold at least this share of the rows: at most 1 / share of them, found from exact counts."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)))
    return counts.where(F.col("__n") >= F.lit(share) * total.scalar()).drop("__n")


def _null_safe(keys: list[str], other: dict[str, str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"h.{other[k]}"))
    return on


def salted_aggregate(
    df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str | list[str] | None]], *,
    heavy_share: float = 0.005, salts: int = 64,
) -> DataFrame:
    """One row per key with the aggregates, no task getting all rows of a heavy key.

    aggs: result name -> (kind, column), with kind one of count, sum, min, max, avg, count_distinct (column or list of
    columns; one such set of columns a call). Method: keys holding at least heavy_share of the rows get a salt of
    0..salts-1, drawn by hashing the row (with a count_distinct its columns, so that a value is in one salt and the
    counts add up; without one also the row's partition, which is free as partials of any rows add up); a first stage
    aggregates by (key, salt), a second merges the partials by key. df is read twice (for the heavy keys and for the
    result): where it is dear to compute, give it cut.

    Nulls: a null key is a key of its own; null values are ignored as in SQL (count of a column counts its non-null
    values, count with None counts rows). Ties and repeated rows count as they stand. An empty table gives no rows."""
    for name, (kind, _) in aggs.items():
        if kind not in KINDS:
            raise ValueError(f"{name}: unknown kind {kind}")
    distinct = {tuple([c] if isinstance(c, str) else c) for kind, c in aggs.values() if kind == "count_distinct"}
    if len(distinct) > 1:
        raise ValueError("one set of columns for count_distinct a call")
    used = sorted({c for _, x in aggs.values() if x for c in ([x] if isinstance(x, str) else x)} - set(keys))
    rows = df.select(*keys, *used)
    by = list(next(iter(distinct))) if distinct else list(rows.columns)
    heavy = cut(heavy_keys(rows, keys, heavy_share))
    small = heavy.count() <= BROADCAST_ROWS
    renamed = {k: f"__h_{i}" for i, k in enumerate(keys)}
    heavy = heavy.select(*[F.col(k).alias(renamed[k]) for k in keys], F.lit(True).alias("__heavy"))
    spread = F.pmod(F.xxhash64(F.lit(7), *[F.col(f"l.{c}") for c in by]), F.lit(salts))
    if not distinct:  # repeated rows are spread too: their partition is part of the draw and partials only add up
        spread = F.pmod(F.xxhash64(F.lit(7), F.spark_partition_id(), *[F.col(f"l.{c}") for c in by]), F.lit(salts))
    salted = rows.alias("l").join(F.broadcast(heavy.alias("h")) if small else heavy.alias("h"), _null_safe(keys, renamed), "left").select(
        *[F.col(f"l.{c}") for c in rows.columns],
        F.when(F.col("__heavy"), spread).otherwise(F.lit(0)).alias("__salt"),
    )
    if distinct:
        # one row per key, salt and value, carrying the partials of the other aggregates
        salted = salted.groupBy(*keys, "__salt", *by).agg(*_partials(aggs, skip_distinct=True))
        first = salted.groupBy(*keys, "__salt").agg(*_merge(aggs), *_distinct(aggs, by))
    else:
        first = salted.groupBy(*keys, "__salt").agg(*_partials(aggs))
    out = first.groupBy(*keys).agg(*_merge(aggs), *[F.sum(f"__{n}_d").alias(f"__{n}_d") for n, (k, _) in aggs.items() if k == "count_distinct"])
    return out.select(*keys, *[_final(n, k).alias(n) for n, (k, _) in aggs.items()])


def _partials(aggs: dict, skip_distinct: bool = False) -> list[Column]:
    out = [F.count(F.lit(1)).alias("__rows")]
    for n, (kind, c) in aggs.items():
        if kind == "count":
            out.append(F.count(F.lit(1) if c is None else F.col(c)).alias(f"__{n}_c"))
        elif kind == "avg":
            out += [F.sum(F.col(c).cast("double")).alias(f"__{n}_s"), F.count(c).alias(f"__{n}_c")]
        elif kind in ("sum", "min", "max"):
            out.append(getattr(F, kind)(c).alias(f"__{n}_v"))
    return out


def _merge(aggs: dict) -> list[Column]:
    out = [F.sum("__rows").alias("__rows")]
    for n, (kind, _) in aggs.items():
        if kind == "count":
            out.append(F.sum(f"__{n}_c").alias(f"__{n}_c"))
        elif kind == "avg":
            out += [F.sum(f"__{n}_s").alias(f"__{n}_s"), F.sum(f"__{n}_c").alias(f"__{n}_c")]
        elif kind in ("sum", "min", "max"):
            out.append(getattr(F, kind)(f"__{n}_v").alias(f"__{n}_v"))
    return out


def _distinct(aggs: dict, by: list[str]) -> list[Column]:
    whole = F.lit(True)
    for c in by:
        whole = whole & F.col(c).isNotNull()
    return [F.count(F.when(whole, 1)).alias(f"__{n}_d") for n, (k, _) in aggs.items() if k == "count_distinct"]


def _final(n: str, kind: str) -> Column:
    if kind == "avg":
        return F.try_divide(F.col(f"__{n}_s"), F.col(f"__{n}_c"))
    return F.col({"count": f"__{n}_c", "count_distinct": f"__{n}_d"}.get(kind, f"__{n}_v"))
