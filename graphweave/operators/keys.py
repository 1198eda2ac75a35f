"""Dense numbering of rows in a total order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.session import cut


def dense_ids(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """df with a column of numbers 0, 1, 2, ... following the order, whose key should be unique.

    The rows are range-partitioned, sorted in each partition and written to the shared folder; then only one count a
    partition goes to the driver, from which each partition's first number follows. Ties get numbers in an
    unspecified but fixed order; an empty table stays empty."""
    mark = "__row"
    spark = df.sparkSession
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = cut(ordered.withColumn(mark, F.monotonically_increasing_id()))
    part, row = F.shiftright(F.col(mark), 33), F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in fixed.groupBy(part.alias("p")).count().collect())
    first, start = {}, 0
    for p, n in sizes:
        first[p], start = start, start + n
    starts = spark.createDataFrame([(p, n) for p, n in first.items()], "__part long, __start long")
    return (
        fixed.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(name, row + F.col("__start"))
        .drop(mark, "__part", "__start")
    )
