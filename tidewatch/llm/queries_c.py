"""Queries of problems 3 and 6. Held against held-out texts and brute force in the tests; SQL can't express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import langid, names
from tidewatch.runtime import materialise, read

#: Sources whose title is the name of a repository or model.
NAMED_SOURCES = ["github", "hf"]
FIELDS = {"title": True, "abstract": False}


def _model(spark: SparkSession, d: str) -> langid.PieceModel:
    return langid.fit_on(read(spark, d, "works"), "doc_id", list(FIELDS), "lang")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    masks = langid.work_masks(read(spark, d, "works"), _model(spark, d), "doc_id", FIELDS, "lang", ("source", "title", NAMED_SOURCES))
    return langid.mislabelled(masks)


def p3_passages(spark: SparkSession, d: str) -> DataFrame:
    works = read(spark, d, "works").withColumn("title", F.when(~F.coalesce(F.col("source"), F.lit("")).isin(NAMED_SOURCES), F.col("title")))
    found = langid.label_passages(works, _model(spark, d), "doc_id", FIELDS)
    return found.withColumn("confidence", F.round("confidence", 6))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return materialise(names.link_names(read(spark, d, "works"), {"authors": "author", "institutions": "institution"}, read(spark, d, "nicknames")), "linked")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_pairs(_linked(spark, d))


def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d)


QUERIES = {"p3_found": p3_found, "p3_passages": p3_passages, "p6_found": p6_found, "p6_entities": p6_entities}
