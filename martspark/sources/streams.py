"""Streaming sources: Parquet folders, message topics and ordered replay."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from martspark.sources.tables import Tables

EVENT_SCHEMA = T.StructType([
    T.StructField("txn_id", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("country", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])


class StreamedTables(Tables):
    """The same named tables, with some of them read as unbounded streams of files."""

    def __init__(self, spark: SparkSession, folder: str, streamed: Iterable[str]):
        super().__init__(spark, folder)
        self.streamed = set(streamed)

    def __call__(self, name: str, *columns: str) -> DataFrame:
        if name not in self.streamed:
            return super().__call__(name, *columns)
        schema = super().__call__(name).schema
        frame = self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)
        return frame.select(*columns) if columns else frame


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def topic_stream(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """Messages of one or more topics from the earliest offset on.

    Needs the message-broker connector on the cluster's class path. Progress is
    kept in the query's checkpoint, which takes the place of a consumer group.
    """
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()
    )


def parsed_messages(messages: DataFrame, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """JSON values to columns, with the ISO time text as an event time."""
    fields = F.from_json(F.col("value").cast("string"), schema)
    return messages.select(fields.alias("m")).select("m.*").withColumn(
        "timestamp", F.col("timestamp").try_cast("timestamp")
    )


def json_messages(df: DataFrame) -> DataFrame:
    """Rows as JSON values, the form a message sink takes."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def start_without_repeats(events: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write each message of a stream once, however late it or its repeats arrive.

    What was written is the memory: it lies in folders by event day, and a
    micro-batch is compared with the days it holds only, so nothing grows in the
    executors and no row is dropped for being late. Repeats share keys and event
    time. A batch that is run again replaces its own folder and ignores it.
    """
    spark = events.sparkSession
    stored = T.StructType([*events.schema.fields, T.StructField("day", T.StringType()), T.StructField("batch", T.LongType())])

    def keep(batch: DataFrame, batch_id: int) -> None:
        day = F.coalesce(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("none"))
        fresh = batch.dropDuplicates(keys).withColumn("day", day).persist()
        days = [r.day for r in fresh.select("day").distinct().collect()]  # one row per event day
        if batch_id and days:
            seen = spark.read.schema(stored).parquet(path).filter(F.col("day").isin(days) & (F.col("batch") < batch_id))
            new = fresh.join(seen.select(*keys, "day"), [*keys, "day"], "left_anti")
        else:
            new = fresh
        new.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
        fresh.unpersist()

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_replay(df: DataFrame, time: Column, path: str, slices: int = 8, files_per_slice: int = 1) -> None:
    """Write a table as time slices, oldest first, for replay in order.

    A file stream reads by modification time, so slices are written one after
    the other and each holds ``files_per_slice`` files: with as many files per
    trigger every micro-batch is one slice. The cut points only balance the
    slices; each row falls in exactly one.
    """
    seconds = df.select(F.unix_micros(time).alias("s"))
    cuts = [i / slices for i in range(1, slices)]
    bounds = sorted(set(seconds.agg(F.percentile_approx("s", cuts, 10_000)).first()[0] or []))
    edges = [None, *bounds, None]
    stamped = df.withColumn("_s", F.unix_micros(time))
    for low, high in zip(edges, edges[1:]):
        part = stamped
        if low is not None:
            part = part.filter(F.col("_s") >= low)
        if high is not None:
            part = part.filter(F.col("_s") < high)
        part.drop("_s").repartition(files_per_slice).write.mode("append").parquet(path)
