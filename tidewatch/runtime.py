"""Session-level helpers: the shared work folder, materialised intermediates and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows (of narrow columns) is broadcast; beyond it the join shuffles with salted keys.
BROADCAST_ROWS = 100_000
SALTS = 16


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only where the setting is absent (tests, notebooks) a local one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tidewatch-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table of the work folder and read it back: lineage is cut, the rows survive lost executors,
    and later counts come from the file footers."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the tables that materialise wrote for df and that nothing reads any more, as the steps of an iteration."""
    spark = df.sparkSession
    own = f"{work_dir(spark)}/tidewatch/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if own.removeprefix("file:").lstrip("/") in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], salt: Column, how: str = "inner", table_rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows with a table that is unique on keys, whatever the skew of the keys in rows.

    A table of at most ``limit`` rows is broadcast. A larger one is copied to SALTS salts, and rows spread over them
    by ``salt``, so that a key holding a third of all rows meets SALTS tasks."""
    n = table.count() if table_rows is None else table_rows
    if n <= limit:
        return rows.join(F.broadcast(table), list(keys), how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
