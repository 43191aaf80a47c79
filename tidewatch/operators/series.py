"""Documents, links and the counts, spreads and series made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.harvest import Homes, instant

# fixed values: weight of a document by its type; anything else weighs 1.0
TYPE_WEIGHTS = {"model": "1.6", "repo": "1.5", "preprint": "1.4", "article": "1.0", "patent": "0.9", "report": "0.8"}
AGGREGATORS = ("gnews",)


def type_weight(doc_type: str = "doc_type") -> Column:
    """Decimal, so that sums are exact before they are rounded."""
    w = F.when(F.lit(False), F.lit("0").cast("decimal(12,1)"))
    for kind, value in TYPE_WEIGHTS.items():
        w = w.when(F.col(doc_type) == kind, F.lit(value).cast("decimal(12,1)"))
    return w.otherwise(F.lit("1.0").cast("decimal(12,1)"))


def first_harvest(works: DataFrame, *columns: str, homes: Homes | None = None) -> DataFrame:
    """(doc_id, columns), one row a doc_id: its first harvest by the instant that ``harvested_at`` names; null ids are dropped.

    Only the columns asked for (all without any) are scanned and shuffled. Rows of one instant are ordered by these columns;
    harvests without a valid time come last. A minimum, not a window: it is taken before the shuffle too, so a document that
    is repeated a million times doesn't meet one task."""
    kept = [c for c in columns or works.columns if c != "doc_id"]
    when = F.coalesce(instant(homes=homes), F.lit(2**62)).alias("__at")
    first = works.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(when, *kept)).alias("x"))
    return first.select("doc_id", *(F.col(f"x.`{c}`").alias(c) for c in kept))


def links(cand_docs: DataFrame) -> DataFrame:
    """Distinct (cand_id, doc_id): keys aren't unique in what is delivered."""
    return cand_docs.where("cand_id is not null and doc_id is not null").select("cand_id", "doc_id").distinct()


def linked(cand_docs: DataFrame, works: DataFrame, *columns: str) -> DataFrame:
    """links joined with the needed columns of works; the inner join drops links of unknown documents."""
    return links(cand_docs).join(works.select("doc_id", *columns), "doc_id")


def year_counts(joined: DataFrame) -> DataFrame:
    """(cand_id, year, n): weighted documents, rounded half to even."""
    return joined.groupBy("cand_id", "year").agg(F.bround(F.sum(type_weight()), 0).cast("long").alias("n"))


def month_of(date: Column, year: Column) -> Column:
    """YYYY-MM of an ISO date, else the middle of the year."""
    return F.when(date.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])(-|$)"), F.substring(date, 1, 7)).otherwise(F.concat(year.cast("string"), F.lit("-06")))


def month_counts(joined: DataFrame) -> DataFrame:
    """(cand_id, month, n), as year_counts."""
    return joined.groupBy("cand_id", month_of(F.col("date"), F.col("year")).alias("month")).agg(F.bround(F.sum(type_weight()), 0).cast("long").alias("n"))


def country_spread(joined: DataFrame, first: int, last: int) -> DataFrame:
    """(cand_id, n_countries): distinct countries of documents of the years first..last; null and empty lists add none."""
    rows = joined.where(F.col("year").between(first, last)).select("cand_id", F.explode("countries").alias("country")).where("country is not null")
    return rows.groupBy("cand_id").agg(F.count_distinct("country").alias("n_countries"))


def publisher(source: Column, title: Column, url: Column) -> Column:
    """Who published: what follows the last ' - ' of an aggregator's title, else the host without a leading www."""
    tail = F.lower(F.trim(F.substring_index(title, " - ", -1)))
    host = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")
    return F.when(source.isin(*AGGREGATORS) & title.contains(" - "), tail).otherwise(host)


def domain_spread(joined: DataFrame) -> DataFrame:
    return joined.groupBy("cand_id").agg(F.count_distinct(publisher(F.col("source"), F.col("title"), F.col("url"))).alias("n_domains"))


def trusted_share(joined: DataFrame) -> DataFrame:
    """Aggregators count a half, trusted 1, indicators 0, unknown a half."""
    value = F.when(F.col("source").isin(*AGGREGATORS), 0.5).when(F.col("trust_level") == "trusted", 1.0).when(F.col("trust_level") == "indicator", 0.0).otherwise(0.5)
    return joined.groupBy("cand_id").agg(F.avg(value).alias("trusted_share"))


def peer_norm(counts: DataFrame, bucket: str = "year") -> DataFrame:
    """Sum over all candidates of a bucket, 1.0 at least."""
    return counts.groupBy(bucket).agg(F.greatest(F.sum("n").cast("double"), F.lit(1.0)).alias("norm"))


def dense_years(counts: DataFrame, first: int, last: int) -> DataFrame:
    """(cand_id, year, n) with every year of first..last for every candidate of counts, 0 where it has none."""
    frame = counts.select("cand_id").distinct().select("cand_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return frame.join(counts.where(F.col("year").between(first, last)), ["cand_id", "year"], "left").select("cand_id", "year", F.coalesce("n", F.lit(0)).alias("n"))


def frequencies(counts: DataFrame, first: int, last: int) -> DataFrame:
    """dense_years with the frequency per million of the peers' sum; years without peers have norm 1."""
    norm = peer_norm(counts)
    return dense_years(counts, first, last).join(F.broadcast(norm), "year", "left").select("cand_id", "year", "n", (F.col("n") / F.coalesce("norm", F.lit(1.0)) * 1e6).alias("freq"))


def top_docs(joined: DataFrame, since: DataFrame | None = None, limit: int = 20, until: int | None = None) -> DataFrame:
    """(cand_id, place, doc_id): newest first, then most cited (null last), then smaller doc_id; since: (cand_id, takeoff)."""
    rows = joined
    if until is not None:
        rows = rows.where(F.col("year") <= until)
    if since is not None:
        rows = rows.join(since, "cand_id", "left").where(F.col("year") >= F.coalesce("takeoff", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("cand_id").orderBy(F.desc("year"), F.desc_nulls_last("cited_by"), "doc_id"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("cand_id", "place", "doc_id")
