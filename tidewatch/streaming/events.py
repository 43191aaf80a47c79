"""Structured Streaming: incremental counts, windows, duplicates, trust and bursts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidewatch.runtime import work_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # state beyond memory, several variables a key


def session_of(spark: SparkSession) -> SparkSession:
    """A session of its own for streams, whose settings leave the caller's alone."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"):
        if (value := spark.conf.get(name, None)) is not None:
            try:
                own.conf.set(name, value)
            except Exception:  # a setting of the whole application is there already  # noqa: BLE001
                pass
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STATE)
    return own


def source(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A stream of events, with ts as an instant of the session's zone."""
    return rows_of(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))


def rows_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the files of a folder or of one file."""
    spark = session_of(spark)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    single = name.endswith(".parquet") and not _is_folder(spark, path)
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def tumbling_counts(stream: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("bucket"), "event_type", "n", "value")


def sliding_counts(stream: DataFrame, late: str = "4 days", width: str = "3 days", step: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "event_type", "n")


def session_activity(stream: DataFrame, late: str = "1 day", gap: str = "6 hours") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "n")


def dedup(stream: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def with_trust(stream: DataFrame, levels: DataFrame) -> DataFrame:
    """Stream joined with a short static table (event_type, trust_level)."""
    return stream.join(F.broadcast(levels), "event_type", "left").withColumn("trust_level", F.coalesce("trust_level", F.lit("unknown")))


#: Hours behind the newest that a key's state tells apart; older ones are kept as their number and sum.
KEEP_HOURS = 72


class BurstState(StatefulProcessor):
    """Count of the newest hour of a key against the mean of the hours before.

    The state of a key doesn't grow: hours within KEEP_HOURS of the newest stand alone, older ones are folded into one number
    of hours and one sum. A row later than that adds to the sum only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getMapState("hours", StructType([StructField("hour", LongType())]), StructType([StructField("n", LongType())]))
        self.past = handle.getValueState("past", StructType([StructField("hours", LongType()), StructField("n", LongType()), StructField("until", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        recent = {k[0]: v[0] for k, v in self.hours.iterator()}
        before = dict(recent)
        hours, total, until = self.past.get() if self.past.exists() else (0, 0, -(2**62))
        for f in rows:
            unit = 3600 * 10**9 if str(f["ts"].dtype).endswith("ns]") else 3600 * 10**6
            for hour, n in (f["ts"].astype("int64") // unit).value_counts().items():
                if hour < until:
                    total += int(n)
                else:
                    recent[int(hour)] = recent.get(int(hour), 0) + int(n)
        newest = max(recent)
        until = max(until, newest - KEEP_HOURS)
        for hour in [h for h in recent if h < until]:
            hours, total = hours + 1, total + recent.pop(hour)
            if hour in before:
                self.hours.removeKey((hour,))
        for hour, n in recent.items():
            if before.get(hour) != n:
                self.hours.updateValue((hour,), (n,))
        self.past.update((hours, total, until))
        seen = hours + len(recent)
        base = (total + sum(recent.values()) - recent[newest]) / max(1, seen - 1)
        yield pd.DataFrame({"event_type": [key[0]], "hours": [seen], "burst": [(recent[newest] + 0.1) / (base + 0.1)]})

    def close(self) -> None:
        pass


def bursts(stream: DataFrame) -> DataFrame:
    out = StructType([StructField("event_type", StringType()), StructField("hours", LongType()), StructField("burst", DoubleType())])
    return stream.groupBy("event_type").transformWithStateInPandas(statefulProcessor=BurstState(), outputStructType=out, outputMode="Update", timeMode="None")


def drain(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, into a table of the shared work folder, and read that.

    In append mode a window comes out once, when the watermark has passed it and its state is dropped."""
    folder = f"{work_dir(spark)}/tidewatch/stream-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{'all' if mode == 'complete' else f'batch={batch_id}'}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").schema(stream.schema).parquet(f"{folder}/rows")
    return rows


