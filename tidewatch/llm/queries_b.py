"""Queries of problems 8 and 9. SQL has no tokenizer; tests compare with direct encoding and exact round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import encoding, packing
from tidewatch.runtime import materialise, read


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(read(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(materialise(encoding.token_counts(read(spark, d, "documents")), "token-counts"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p9_containers(spark, d))


QUERIES = {"p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill}
