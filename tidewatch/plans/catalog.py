"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans import extra_queries, more_queries, reference_queries, reference_sql, serving_queries, training

QUERIES: dict = {**training.QUERIES, **reference_queries.QUERIES, **more_queries.QUERIES, **extra_queries.QUERIES, **serving_queries.QUERIES}
SQL: dict = {**reference_sql.SQL, **more_queries.SQL, **extra_queries.SQL, **serving_queries.SQL}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return reference_queries.emergence_score(spark, folder)
