"""Session helpers: where lineage is cut, size-checked broadcasts, small batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows above which a lookup side is never broadcast, whatever its kind.
BROADCAST_ROWS = 100_000


def _own_folder() -> str:
    """A temporary folder, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="graphweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); on a local master, where it is unset, a temporary one.

    What is written there is removed once nothing in the session refers to it any more."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or _own_folder())
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed now and written to the shared folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, records: int = 2000, size: int = 4 << 20) -> Iterator[None]:
    """Within it, what runs sends whole texts to Python in batches that keep a task's memory low; needs steps that run at once."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(records), "spark.sql.execution.arrow.maxBytesPerBatch": f"{size}b"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def parallelism(spark: SparkSession) -> int:
    """Partitions that a shuffle gets in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def lookup(big: DataFrame, dim: DataFrame, on: list[str], dim_rows: int, how: str = "inner") -> DataFrame:
    """big joined to dim, whose row count is known: broadcast if that is small, else shuffled (AQE splits skewed parts)."""
    return big.join(F.broadcast(dim) if dim_rows <= BROADCAST_ROWS else dim, on, how)
