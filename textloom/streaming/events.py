"""Streams: append-only events and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.operators import relational as R


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream; new files are new rows."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def hourly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by type and hour; rows later than `late` behind the newest are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_upsert(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: str) -> str:
    """Keeps at target the latest row of each key. A batch writes a new version folder, named by its number, and only then the
    next reads it: a batch that is run again after a failure writes the same version over. Returns the last version's folder."""
    spark = stream.sparkSession
    made = ["v=none"]

    def put(batch: DataFrame, number: int) -> None:
        new = R.latest(batch, keys, order).select(*batch.columns)
        if number:
            old = spark.read.parquet(f"{target}/v={number - 1}")
            new = R.latest(old.unionByName(new), keys, order).select(*batch.columns)
        new.write.mode("overwrite").parquet(f"{target}/v={number}")
        if number > 1:  # the version before stays, for a batch that is run again
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v={number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        made.append(f"v={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{target}/{made[-1]}"


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "complete") -> None:
    """A finite run into parquet: aggregates in complete mode are written whole by each batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(target)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
