"""Green and red files of a sample paired as they arrive, in whatever order and batch."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.idat import NAME, parse
from ..sources.idat_source import BEADS, content, located

PAIRS = "prefix string, green string, red string, status string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pairing(StatefulProcessor):
    """Holds the first file of a sample, emits both when the second comes, and reports a file
    that has waited for ``wait`` milliseconds alone. State is a path and a time a colour."""

    def __init__(self, wait: int, event_time: bool):
        self.wait, self.event_time = wait, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "channel string", "path string, at long")

    def now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v for k, v in self.held.iterator()} if self.held.exists() else {}
        for batch in rows:
            for channel, path, at in zip(batch["channel"], batch["path"], batch["at"]):
                held[channel] = (path, int(at))
                self.held.updateValue((channel,), held[channel])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if {"Grn", "Red"} <= held.keys():
            self.held.clear()
            yield pd.DataFrame({"prefix": [key[0]], "green": [held["Grn"][0]], "red": [held["Red"][0]], "status": ["pair"]})
        else:
            since = max(v[1] for v in held.values()) if self.event_time else self.now(timerValues)
            self.handle.registerTimer(max(since + self.wait, self.now(timerValues) + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {k[0]: v for k, v in self.held.iterator()} if self.held.exists() else {}
        self.held.clear()
        if held:
            at = lambda c: held[c][0] if c in held else None
            yield pd.DataFrame({"prefix": [key[0]], "green": [at("Grn")], "red": [at("Red")], "status": ["lone"]})

    def close(self) -> None:
        pass


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, channel, path, time) of IDAT files as they appear below a folder; their contents are not read."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    named = raw.option("pathGlobFilter", "*.idat*").option("recursiveFileLookup", True).load(path)
    return named.select(F.regexp_extract("path", NAME, 1).alias("prefix"), F.regexp_extract("path", NAME, 2).alias("channel"), "path", F.col("modificationTime").alias("time")).where("channel <> ''")


def pair_arrivals(files: DataFrame, wait: str = "1 hour", event_time: bool = False) -> DataFrame:
    """(prefix, green, red, status) of a stream of files (prefix, channel, path, time).

    A sample's second file emits ``pair``. A file that stays alone for ``wait`` is reported
    ``lone`` and forgotten: by the clock, or with ``event_time`` by the times of later
    files, so that a replayed stream gives the same rows. A file that is written again
    before its partner comes replaces the first. State survives restarts in the query's
    checkpoint; it needs the RocksDB state store.
    """
    spark = files.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    timed = files.withWatermark("time", "0 seconds") if event_time else files
    rows = timed.withColumn("at", F.unix_millis("time"))
    return rows.groupBy("prefix").transformWithStateInPandas(Pairing(wait_ms, event_time), PAIRS, "Append", "EventTime" if event_time else "ProcessingTime")


def pair_beads(pairs: DataFrame) -> DataFrame:
    """(sample_id, address, g, r, gn, rn) of the rows with status ``pair``; a damaged pair gives none."""

    def run(batches):
        for b in batches:
            for prefix, green, red in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    g, r = (parse(content(*located(p))) for p in (green, red))
                except (ValueError, KeyError, OSError, EOFError):
                    continue
                address, i, j = np.intersect1d(g["address"], r["address"], return_indices=True)
                columns = [pa.array([posixpath.basename(prefix)] * len(address), pa.string()), pa.array(address, pa.int32()), pa.array(g["mean"][i].astype(float)),
                           pa.array(r["mean"][j].astype(float)), pa.array(g["beads"][i].astype(np.int32)), pa.array(r["beads"][j].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BEADS.split(", ")])

    return pairs.where("status = 'pair'").select("prefix", "green", "red").mapInArrow(run, BEADS)
