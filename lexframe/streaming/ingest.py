"""Deliveries as a stream: files of entries that keep arriving, each row counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deliveries(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """The parquet files of a folder as a stream, in bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_within(stream: DataFrame, keys: list[str], time: str = "loaded_at", late: str = "14 days") -> DataFrame:
    """The first delivery of each key as far as the watermark reaches, with bounded state.

    A copy that comes more than ``late`` afterwards passes again and a row behind the watermark is
    dropped; ``once_to_table`` is exact.
    """
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def arrivals(stream: DataFrame, time: str = "loaded_at", width: str = "1 day", late: str = "14 days") -> DataFrame:
    """Rows per pack and window of arrival; late rows count until the watermark passes."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), "pack_id").agg(F.count(F.lit(1)).alias("n")).select("w.start", "pack_id", "n")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a parquet table, each row of the stream exactly once, until all that is there has been read."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()


def once_to_table(stream: DataFrame, keys: list[str], path: str, checkpoint: str, time: str = "loaded_at") -> StreamingQuery:
    """Appends the first delivery of each key to a parquet table, however late its copies come, until all that is there has been read.

    A batch keeps one row a key, the earliest, and of these the ones that earlier batches have not
    written; nothing is held in memory between batches and no late row is dropped. Null keys are
    keys like any other. Each batch is a folder ``batch_id=N`` of the table, written anew if the
    batch is repeated after a failure.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        ties = [c for c in batch.columns if c not in (time, *keys) and batch.schema[c].dataType.typeName() not in ("map", "variant")]
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).asc_nulls_last(), *ties))
        new = batch.withColumn("_n", rank).where("_n = 1").drop("_n")
        done = [f"{path}/batch_id={k}" for k in _written(spark, path, n)]
        if done:
            known = spark.read.schema(batch.schema).parquet(*done).select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            new = new.join(known, same, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch_id={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str, before: int) -> list[int]:
    """The numbers of the batches in a table that were written before this one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(k for k in (int(x.removeprefix("batch_id=")) for x in names if x.startswith("batch_id=")) if k < before)
