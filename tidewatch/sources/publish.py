"""Sinks: contract-typed tables, atomic publication, journals, merges."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch import contracts


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, name: str, path: str, partition_by: list[str] | None = None) -> None:
    """Write beside the target, check the contract there, then rename; an existing target is refused."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path}.building-{uuid.uuid4().hex}"
    writer = contracts.project(df, name).write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    written = contracts.project(spark.read.parquet(staging), name)  # columns of the folders' names take their types and places again
    found = contracts.problems(written, name).limit(20).collect()
    if found:
        fs.delete(_fs(spark, staging)[1], True)
        raise ValueError(f"{name}: {[(r.problem, r.n) for r in found]}")
    if not fs.rename(_fs(spark, staging)[1], target):
        raise OSError(f"couldn't rename {staging} to {path}")


def replace_dataset(spark: SparkSession, df: DataFrame, dataset: str, path: str) -> None:
    """Replace the rows of one dataset of a table kept by dataset; other datasets stay."""
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.withColumn("dataset", F.lit(dataset)).write.mode("overwrite").partitionBy("dataset").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def write_jdbc(df: DataFrame, name: str, url: str, table: str, properties: dict[str, str]) -> None:
    """To a staging table with the contract's column types; the swap is the database's transaction."""
    types = ", ".join(f"{f.name} {contracts.sql_type(f.dataType)}" for f in contracts.CONTRACTS[name])
    contracts.project(df, name).write.option("createTableColumnTypes", types).option("truncate", "true").jdbc(url, table, "overwrite", properties)


def journal(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("dataset", "tbl"), version: str = "loaded_at") -> DataFrame:
    """Upsert: of each key the row of the highest version."""
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(version)))
    return old.unionByName(new).withColumn("__r", latest).where("__r = 1").drop("__r")


def merge_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key new hasn't, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, digest): the same for the same rows in any order."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    h = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *cells), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def status(spark: SparkSession, path: str) -> DataFrame:
    """The journal by dataset and table; no rows where there is none."""
    fs, p = _fs(spark, path)
    rows = spark.read.parquet(path) if fs.exists(p) else spark.createDataFrame([], contracts.CONTRACTS["loads"])
    return rows.orderBy("dataset", "tbl")


def datasets(spark: SparkSession, roots: list[str]) -> list[tuple[str, str]]:
    """(name, folder) of the subfolders of roots with a valid name; the first root wins."""
    found: dict[str, str] = {}
    for root in roots:
        fs, p = _fs(spark, root)
        if fs.exists(p):
            for s in fs.listStatus(p):
                name = s.getPath().getName()
                if s.isDirectory() and re.fullmatch(r"[a-z0-9][a-z0-9-]{0,63}", name):
                    found.setdefault(name, s.getPath().toString())
    return sorted(found.items())


def loaded(spark: SparkSession, dataset: str, table: str, df: DataFrame, source: str) -> DataFrame:
    """A row of the journal for df."""
    f = fingerprint(df)
    return f.select(F.lit(dataset).alias("dataset"), F.lit(table).alias("tbl"), "n_rows", F.lit(source).alias("source"), F.sha2("digest", 256).alias("sha256"), F.lit(dt.datetime.now(dt.UTC)).cast("timestamp").alias("loaded_at"))


def write_manifest(df: DataFrame, folder: str, **config: str | int) -> dict:
    """A manifest beside a table: rows, digest, status and the given settings."""
    spark = df.sparkSession
    n, digest = fingerprint(df).first()
    manifest = {"status": "complete", "n_rows": n, "sha256": digest, "built_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), **config}
    fs, target = _fs(spark, f"{folder}/manifest.json")
    staging = _fs(spark, f"{folder}/.manifest-{uuid.uuid4().hex}")[1]
    stream = fs.create(staging)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(staging, target)
    return manifest


def check_manifest(df: DataFrame, folder: str, **config: str | int) -> None:
    """Raise unless the manifest is complete, has the settings and fits the rows."""
    text = "\n".join(r.value for r in df.sparkSession.read.text(f"{folder}/manifest.json").collect())  # one short file
    manifest = json.loads(text)
    n, digest = fingerprint(df).first()
    wrong = [k for k, v in {"status": "complete", "n_rows": n, "sha256": digest, **config}.items() if manifest.get(k) != v]
    if wrong:
        raise ValueError(f"manifest of {folder} differs in {wrong}")
