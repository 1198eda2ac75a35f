"""The pairwise summary kept up to date over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphweave.operators.prs import entropy_over


def bin_counts(triples: DataFrame) -> DataFrame:
    """Running counts (subj, ref, pos, n) of a stream of triples; state grows with the distinct bins only."""
    return triples.groupBy("subj", "ref", "pos").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(triples: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Counts per time window with a watermark, for summaries of a period."""
    return triples.withWatermark(time, late).groupBy(F.window(time, window), "subj", "ref", "pos").agg(F.count(F.lit(1)).alias("n"))


def summarise(counts: DataFrame) -> DataFrame:
    """Ratios and entropies of counts."""
    from pyspark.sql import Window

    pair = Window.partitionBy("subj", "ref")
    out = counts.withColumn("sup", F.sum("n").over(pair)).withColumn("likelihood", F.col("n") / F.col("sup"))
    return out.withColumn("entropy", entropy_over(F.col("likelihood"), pair))


def start(triples: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the whole summary after each micro-batch (complete mode) to a folder of its own below table, so that readers always
    find a whole version (latest) and a restart resumes from the checkpoint. Versions but the last two are removed."""

    def write(batch: DataFrame, epoch: int) -> None:
        summarise(batch).write.mode("overwrite").parquet(f"{table}/version={epoch}")
        fs, path = _files(batch.sparkSession, table)
        for old in range(max(0, epoch - 10), epoch - 1):
            fs.delete(path(f"{table}/version={old}"), True)

    q = bin_counts(triples).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The last whole version of a summary that start keeps up to date."""
    fs, path = _files(spark, table)
    done = [int(x.getPath().getName().partition("=")[2]) for x in fs.listStatus(path(table)) if fs.exists(path(x.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{table}/version={max(done)}")
