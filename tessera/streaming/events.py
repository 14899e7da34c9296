"""Windowed aggregation of an event stream: an extension, with watermark and a
once-through trigger, so that the result of all available input can be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from tessera.operators.shared import new_path


def tumbling_counts(spark: SparkSession, path: str, width: str, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of all events at ``path`` (a file or a folder).  State of
    windows behind the watermark is dropped; each batch writes the windows it changed,
    and the last state of each counts."""
    schema = spark.read.parquet(path).schema
    name = path.rstrip("/").rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    # A stream reads folders: a single file is found by its name in its folder.
    folder = path if not _is_file(spark, path) else name[0]
    if folder != path:
        source = source.option("pathGlobFilter", name[1])
    events = source.parquet(folder).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = events.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    shaped = grouped.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own files.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = shaped.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    last = F.max_by(F.struct("n", "total"), "batch").alias("last")
    found = spark.read.schema(StructType([*shaped.schema, StructField("batch", LongType())])).parquet(out)
    return found.groupBy("start", "event_type").agg(last).select("start", "event_type", "last.*")


def _is_file(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(own).isFile()
