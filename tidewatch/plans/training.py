"""Query of problem 5, the general one of the training-data problems. SQL has no such parser; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.functions.instants import Rules, changed_instants
from tidewatch.runtime import read


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rules = Rules.load(read(spark, d, "sources"), read(spark, d, "zone_names"))
    return changed_instants(read(spark, d, "works"), "doc_id", ["date", "harvested_at"], "source", rules)


QUERIES = {"p5_found": p5_found}
