"""Streaming: new IDAT files become bead rows, and signals flow into a file set, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.signal import betas
from ..sources import idat, tables


def bead_stream(spark: SparkSession, path: str) -> DataFrame:
    """Bead rows (prefix, channel, address, mean, beads, error) of files as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.idat*").load(path)
    named = raw.select(F.regexp_extract("path", idat.NAME, 1).alias("prefix"), F.regexp_extract("path", idat.NAME, 2).alias("channel"), "content")
    return idat.bead_rows(named.where("channel <> ''"))


def betas_to_file_set(signals: DataFrame, path: str, checkpoint: str, prepare=None) -> StreamingQuery:
    """Writes the betas of a stream of whole samples' signals to a file set; a batch replaces its samples only."""

    def write(batch: DataFrame, _: int) -> None:
        tables.write_file_set(betas(prepare(batch) if prepare else batch), path)

    return signals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intensity_windows(readings: DataFrame, time: str = "time", every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean of m and u by sample and time window of a stream of readings; rows later than ``late`` are dropped by the watermark."""
    return readings.withWatermark(time, late).groupBy(F.window(time, every), "sample_id").agg(F.avg("m").alias("m"), F.avg("u").alias("u"), F.count("*").alias("n"))
