"""Stratified samples by hash and their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def year_quotas(first: int, last: int, budget: int) -> dict[int, int]:
    """The budget split over the years, the remainder to the earliest."""
    base, rest = divmod(budget, last - first + 1)
    return {y: base + (y - first < rest) for y in range(first, last + 1)}


def equal_year_sample(works: DataFrame, first: int, last: int, budget: int, seed: int = 42) -> DataFrame:
    """Up to the year's quota of doc_ids by the hash of id and seed; quotas that can't be filled aren't passed on.

    Years are cut in 64 hash ranges first, so that a year holding most rows never meets one task."""
    quotas = year_quotas(first, last, budget)
    quota = F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))[F.col("year")]
    digest = F.sha2(F.concat_ws(":", "doc_id", F.lit(str(seed))), 256)
    rows = works.where(F.col("year").between(first, last)).withColumn("__h", digest)
    part = Window.partitionBy("year", F.substring("__h", 2, 2)).orderBy("__h", "doc_id")
    cut = rows.withColumn("__k", F.row_number().over(part)).where(F.col("__k") <= quota)
    return cut.withColumn("__k", F.row_number().over(Window.partitionBy("year").orderBy("__h", "doc_id"))).where(F.col("__k") <= quota).drop("__h", "__k")


def coverage(works: DataFrame) -> DataFrame:
    """(year, n_works, n_abstracts, n_dois, n_countries), and year null for the whole corpus."""
    docs = works.rollup("year").agg(F.count("*").alias("n_works"), F.count_if(F.trim("abstract") != "").alias("n_abstracts"), F.count("doi").alias("n_dois"))
    lands = works.select("year", F.explode("countries").alias("c")).where("c <> ''").rollup("year").agg(F.count_distinct("c").alias("n_countries"))
    return docs.join(lands, docs["year"].eqNullSafe(lands["year"]), "left").select(docs["year"], "n_works", "n_abstracts", "n_dois", F.coalesce("n_countries", F.lit(0)).alias("n_countries"))


def first_valid(records: DataFrame, valid, order: list[str], count: int) -> DataFrame:
    """The first ``count`` records for which valid holds; fewer are an error."""
    rows = records.where(valid).orderBy(*order).limit(count)
    if rows.count() < count:
        raise ValueError(f"fewer than {count} valid records")
    return rows


def folds(rows: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """rows with fold 0..k-1, shuffled by hash and balanced within each label."""
    order = F.row_number().over(Window.partitionBy(label).orderBy(F.sha2(F.concat_ws(":", key, F.lit(str(seed))), 256), key))
    return rows.withColumn("fold", (order - 1) % k)
