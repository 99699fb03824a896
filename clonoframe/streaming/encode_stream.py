"""Incremental encoding: new repertoire rows are assigned and counted as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.encode import assign
from ..operators.preprocess import drop_failures
from ..sources import repertoire


def stream_clonotypes(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100, fmt: str = "parquet") -> DataFrame:
    """A stream of files; ``files_per_batch`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def encode_stream(rows: DataFrame, centroids: DataFrame, by: tuple = ("sample",)) -> DataFrame:
    """Streaming counts and sums: state is one row for each (sample, cluster); use output mode update or complete."""
    assigned = assign(rows, centroids)
    f = F.nanvl(F.col("freq").cast("double"), F.lit(None).cast("double"))
    return assigned.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("diversity"), F.coalesce(F.sum(f), F.lit(0.0)).alias("abundance"))


def windowed_counts(rows: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", key: str = "sample", value: str = "freq") -> DataFrame:
    """Rows and sums of each key and tumbling window; rows later than the watermark are dropped from state."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def run_to_parts(rows: DataFrame, path: str, checkpoint: str, centroids: DataFrame) -> StreamingQuery:
    """Write assigned rows to Parquet parts until the input is used up; a restart with the same checkpoint goes on after the last part."""
    return (
        assign(rows, centroids).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start()
    )


def encode_files(
    spark: SparkSession, directory: str, out: str, checkpoint: str, centroids: DataFrame, encoder: Callable[[DataFrame], DataFrame], dataset: str = "", suffix: str = ".tsv", files_per_batch: int = 100, wait: bool = True,
) -> StreamingQuery:
    """Encodes repertoire files as they come: (dataset, sample, cluster, diversity, abundance) below ``out``, a folder ``file`` for each path.

    The stream is one of paths; each micro-batch resolves its files' headers, so files with different columns may share a folder. ``encoder`` adds ``vec`` to clonotypes; rows without one,
    failed rows and files without the required columns give nothing. A batch replaces the folders of its own files, so a batch that is run again after a failure,
    or a file that is listed twice, leaves each file's rows once. ``centroids`` must fit a broadcast, as in ``assign``.
    """
    paths = (
        spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true")
        .schema("path string, modificationTime timestamp, length long, content binary").load(directory).select("path")
    )

    def write(batch: DataFrame, _: int) -> None:
        files = sorted(r["path"] for r in batch.distinct().collect())  # ``files_per_batch`` at most
        if not files:
            return
        rows = encoder(drop_failures(repertoire.read_repertoires(spark, files, dataset, with_path=True), "full_seq")).where("vec is not null")
        assigned = assign(rows, centroids)
        f = F.nanvl(F.col("freq").cast("double"), F.lit(None).cast("double"))
        per = assigned.groupBy("dataset", "sample", "path", "cluster").agg(F.count(F.lit(1)).alias("diversity"), F.coalesce(F.sum(f), F.lit(0.0)).alias("abundance"))
        per.withColumn("file", F.sha2("path", 256)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(out)

    query = paths.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query
