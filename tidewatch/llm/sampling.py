"""Problem 4: a sample that is the same on every run and partitioning and only grows as data grows.

Method: permanent random numbers. Every identifier gets a uniform value at first sight, kept in a registry table that
is extended by anti-join inserts; a sample is all identifiers whose value lies under a threshold that never decreases.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidewatch.runtime import materialise, work_dir

NUMBERS = T.StructType([T.StructField("id", T.StringType()), T.StructField("u", T.DoubleType()), T.StructField("year_seen", T.IntegerType())])
THRESHOLDS = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("year", T.IntegerType()), T.StructField("threshold", T.DoubleType())])
_DIGITS = 13  # hexadecimal digits, 52 bits: exact in a double


def uniform(identifier: Column, seed: str) -> Column:
    """Uniform in [0, 1): a digest of seed and identifier, so a lost registry is rebuilt with the same values."""
    digest = F.sha2(F.concat(F.lit(seed + "\x1f"), identifier), 256)
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / float(16**_DIGITS)


class PermanentSample:
    """Registry of permanent random numbers in a shared folder.

    Null identifiers are never sampled. The first year seen of an identifier (the smallest of the batch that brings it;
    null if it has none) is kept with its value and decides its stratum for good, so rows of one identifier are taken or
    left together even if a later harvest gives another year."""

    def __init__(self, spark: SparkSession, path: str, seed: str = "tidewatch-sample-1"):
        self.spark, self.path, self.seed = spark, path.rstrip("/"), seed

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def numbers(self) -> DataFrame:
        """(id, u, year_seen), one row an identifier. Two writers, or a job that ran twice, may have inserted one identifier
        more than once: its number is the same in all rows, and the earliest of the years counts."""
        return self._table("numbers", NUMBERS).groupBy("id").agg(F.min("u").alias("u"), F.min("year_seen").alias("year_seen"))

    def insert(self, rows: DataFrame, identifier: str, year: str) -> None:
        """Give every identifier of rows that the registry doesn't hold its value. Running it again changes nothing."""
        seen = rows.select(F.col(f"`{identifier}`").cast("string").alias("id"), F.col(f"`{year}`").cast("int").alias("y")).where("id is not null")
        fresh = seen.groupBy("id").agg(F.min("y").alias("year_seen")).join(self._table("numbers", NUMBERS).select("id"), "id", "left_anti")
        fresh = materialise(fresh.select("id", uniform(F.col("id"), self.seed).alias("u"), "year_seen"), "numbers")
        fresh.write.mode("append").parquet(f"{self.path}/numbers")

    def raise_thresholds(self, default: float, by_year: dict[int, float] | None = None) -> dict[int | None, float]:
        """Set the inclusion thresholds (year None: all others). A year never gets less than it had before."""
        kept = self._table("thresholds", THRESHOLDS).collect()  # one row a year and change
        before: dict[int | None, float] = {}
        for r in kept:
            before[r.year] = max(before.get(r.year, 0.0), r.threshold)
        want = {None: default, **(by_year or {})}
        floor = before.get(None, 0.0)
        now = {None: max(default, floor)}
        for y in {*before, *want} - {None}:
            now[y] = max(want.get(y, default), before.get(y, floor))
        if now != before:
            version = max((r.version for r in kept), default=0) + 1
            new = self.spark.createDataFrame([(version, y, float(t)) for y, t in now.items()], THRESHOLDS)
            new.coalesce(1).write.mode("append").parquet(f"{self.path}/thresholds")
        return now

    def members(self, thresholds: dict[int | None, float]) -> DataFrame:
        """(id, u, year_seen) of the identifiers under their threshold."""
        limit = F.lit(thresholds[None])
        for y, t in thresholds.items():
            if y is not None:
                limit = F.when(F.col("year_seen") == y, F.lit(t)).otherwise(limit)
        return self.numbers().where(F.col("u") < limit)

    def sample(self, rows: DataFrame, identifier: str, year: str, default: float, by_year: dict[int, float] | None = None) -> DataFrame:
        """Rows of rows whose identifier is sampled, with the column sample_u; first inserts what is new.

        All rows of an identifier stay, repeated ones too. An empty rows gives no rows; the other columns pass through
        (a column sample_u of rows is replaced)."""
        self.insert(rows, identifier, year)
        chosen = self.members(self.raise_thresholds(default, by_year)).select(F.col("id").alias("__id"), F.col("u").alias("sample_u"))
        return rows.drop("sample_u").join(chosen, F.col(f"`{identifier}`").cast("string") == F.col("__id")).drop("__id")


def registry_of(spark: SparkSession, source: str) -> str:
    """Folder of the registry that belongs to a source folder, under the shared work folder."""
    return f"{work_dir(spark)}/tidewatch/registry-{hashlib.sha256(source.encode()).hexdigest()[:16]}"
