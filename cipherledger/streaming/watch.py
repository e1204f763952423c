"""Structured Streaming: scans of arriving files, and windowed counts of events with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import run
from ..sources import corpus

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, root: str) -> DataFrame:
    """New files below ``root`` as a stream of ``path, content, length``."""
    return spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).load(root).select("path", "content", "length")


def append_findings(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Detects in every micro-batch and appends the findings; a batch that is repeated after a failure overwrites its own
    folder, so nothing counts twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        texts, _ = corpus.sources(batch)
        run.sources(texts).where("error is null").drop("error").write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; events later than the watermark are dropped, closed windows are emitted once."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def event_windows(spark: SparkSession, path: str, out: str, checkpoint: str) -> DataFrame:
    """Runs ``windowed`` over all files of ``path`` and reads what it wrote."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    events = spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    q = windowed(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
