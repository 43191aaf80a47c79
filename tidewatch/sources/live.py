"""A live run: what collectors brought, held to the topic, put beside the history, without duplicates, published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import canonical_url, matches_topic, norm_title, strip_publisher
from tidewatch.operators.select import dedup_live
from tidewatch.runtime import materialise
from tidewatch.sources.publish import merge_rows, publish

AGGREGATOR = "gnews"


def source_rank() -> Column:
    """Trusted sources before others, aggregators last."""
    return F.when(F.col("trust_level") == "trusted", 0).when(F.col("source") == AGGREGATOR, 2).otherwise(1)


def ingest(collected: DataFrame, history: DataFrame, phrases: list[str], path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(works, status) of a run. collected and history are works with unique doc_id.

    Titles off the topic go; a document that comes again takes the place of its older row; of rows of one URL or one title (without
    the publisher an aggregator adds) the first by rank of source, then by id, stays. status (source, collected, on_topic, kept)
    counts what came from each source, what was on the topic and what of it is in the result. With a path the works are
    published there under their contract, whole or not at all."""
    on_topic = collected.where(matches_topic(F.col("title"), phrases))
    pool = materialise(merge_rows(history, on_topic, "doc_id"), "live-pool")
    title = F.when(F.col("source") == AGGREGATOR, strip_publisher(F.col("title"))).otherwise(F.col("title"))
    keys = pool.select("doc_id", source_rank().alias("rank"), canonical_url(F.col("url")).alias("url_key"), F.nullif(norm_title(title), F.lit("")).alias("title_key"))
    kept = materialise(dedup_live(keys).select("doc_id"), "live-kept")
    works = pool.join(kept, "doc_id", "left_semi")
    if path:
        publish(works, "works", path)
    counts = collected.select("source", "doc_id", matches_topic(F.col("title"), phrases).alias("topical")).join(kept.withColumn("in", F.lit(1)), "doc_id", "left")
    status = counts.groupBy("source").agg(F.count("*").alias("collected"), F.count_if("topical").alias("on_topic"), F.count_if(F.col("topical") & (F.col("in") == 1)).alias("kept"))
    return works, status
