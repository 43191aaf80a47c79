"""Features of candidates in which unknown is null and never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import host_of, strip_publisher
from tidewatch.operators.shape import components, month_index

NEWS_TYPES = ("news", "blog", "press_release", "aggregator")
# fixed values: words of funding and launch events
EVENTS = r"(?i)\b(?:raises|raised|funding|series [abc]|seed|stealth|launches|launched|pilot|acquires|acquired|unveils)\b"


def news_features(joined: DataFrame, as_of: str, months: int = 24, news_sources: tuple[str, ...] = ("gnews", "hackernews"), mentions: DataFrame | None = None) -> DataFrame:
    """joined (cand_id, doc_id, source, source_type, date, url, trust_level, title, lang): one row a candidate.

    as_of (YYYY-MM) includes its month. One undated news document makes all features of its candidate null; an aggregator
    without resolved publisher makes the host features null; unknown trust only the share. mentions (doc_id, company):
    null n_companies unless every document of the window is in it."""
    end = int(as_of[:4]) * 12 + int(as_of[5:7]) - 1
    first = end - months + 1
    is_news = F.coalesce(F.col("source").isin(*news_sources), F.lit(False)) | F.coalesce(F.col("source_type").isin(*NEWS_TYPES), F.lit(False))
    rows = joined.withColumn("news", is_news).withColumn("m", month_index(F.substring("date", 1, 7))).withColumn("host", host_of(F.col("url")))
    past = F.col("news") & (F.col("m") <= end)
    inside = past & (F.col("m") >= first)
    resolved = F.col("host").isNotNull() & ~F.coalesce(F.col("source_type") == "aggregator", F.lit(False)) & ~F.col("source").isin("gnews", "hackernews")
    head = F.when(F.col("source") == "gnews", strip_publisher(F.col("title"))).otherwise(F.col("title"))
    base = rows.groupBy("cand_id").agg(
        F.bool_or(F.col("news") & F.col("m").isNull()).alias("undated"), F.count_if(inside).alias("news_mentions_24m"), F.min(F.when(past, F.col("m"))).alias("first_m"), F.coalesce(F.bool_or(inside & ~resolved), F.lit(False)).alias("unresolved"),
        F.count_if(inside & head.rlike(EVENTS)).alias("funding_mentions"), F.array_sort(F.collect_set(F.when(inside & (F.col("lang") != ""), F.col("lang")))).alias("langs"),
        F.array(*(F.count_if(inside & (F.col("m") == first + k)).cast("int") for k in range(months))).alias("news_mentions_by_month"),
    )
    hosts = rows.where(inside & resolved).groupBy("cand_id", "host").agg(F.bool_and(F.coalesce(F.col("trust_level") == "trusted", F.lit(False))).alias("trusted"), F.bool_and(F.coalesce(F.col("trust_level").isin("trusted", "indicator"), F.lit(False))).alias("known"))
    per = hosts.groupBy("cand_id").agg(F.count("*").alias("n_hosts"), F.bool_and("known").alias("known"), F.avg(F.col("trusted").cast("double")).alias("share"))
    out = base.join(per, "cand_id", "left")
    companies = F.lit(None).cast("int")
    if mentions is not None:
        seen = mentions.groupBy("doc_id").agg(F.collect_set(F.lower(F.trim("company"))).alias("names"))
        found = rows.where(inside).join(seen, "doc_id", "left").groupBy("cand_id").agg(F.bool_and(F.col("names").isNotNull()).alias("all_seen"), F.size(F.array_distinct(F.flatten(F.collect_list("names")))).alias("k"))
        out = out.join(found, "cand_id", "left")
        companies = F.when(F.col("all_seen"), F.col("k"))
    ok = ~F.col("undated")
    return out.select(
        "cand_id", F.when(ok, F.col("news_mentions_24m")).alias("news_mentions_24m"), F.when(ok, F.col("news_mentions_by_month")).alias("news_mentions_by_month"),
        F.when(ok & F.col("first_m").isNotNull(), F.format_string("%04d-%02d", F.floor(F.col("first_m") / 12), F.col("first_m") % 12 + 1)).alias("news_first_month"),
        F.when(ok & ~F.col("unresolved"), F.coalesce("n_hosts", F.lit(0))).alias("n_domains"), F.when(ok & ~F.col("unresolved") & F.col("known"), F.round("share", 6)).alias("trusted_share"), F.when(ok, companies).alias("n_companies"),
        F.when(ok, F.col("funding_mentions")).alias("funding_mentions"), F.when(ok, F.col("langs")).alias("langs"),
    )


def tech_features(counts: DataFrame, as_of: int, lookups: DataFrame) -> DataFrame:
    """Thirteen features of a technology: publications of ten years, their shape against the pool, and looked-up counts.

    lookups (cand_id, countries, company_share, repos, stars, new_share, models): absent rows stay null."""
    past = counts.where(F.col("year").between(as_of - 9, as_of))
    total = past.groupBy("cand_id").agg(F.sum("n").alias("pub_total_10y"), F.sum(F.when(F.col("year") >= as_of - 2, F.col("n")).otherwise(0)).alias("last3"))
    shape = components(past, as_of).select("cand_id", F.col("growth").alias("pub_growth"), F.col("accel").alias("pub_accel"), F.col("burst").alias("pub_burst"), F.least("age", F.lit(30)).alias("pub_age"))
    return total.join(shape, "cand_id").join(lookups, "cand_id", "left").select(
        "cand_id", "pub_total_10y", F.when(F.col("pub_total_10y") > 0, F.col("last3") / F.col("pub_total_10y")).otherwise(0.0).alias("pub_last_3y_share"), "pub_growth", "pub_accel", "pub_burst", "pub_age",
        F.col("countries").alias("pub_countries"), F.col("company_share").alias("pub_company_share"), F.col("repos").alias("github_repos"), F.col("stars").alias("github_stars_max"), F.col("new_share").alias("github_new_share"), F.col("models").alias("hf_models"), F.log1p("pub_total_10y").alias("log_pub_total"),
    )


def alias_fallback(counts: DataFrame, aliases: DataFrame) -> DataFrame:
    """aliases (label, pos, query), counts (query, year, n): the years of the first query of a label that has any."""
    have = counts.where("n > 0").select("query").distinct()
    first = aliases.join(have, "query", "left_semi").groupBy("label").agg(F.min_by("query", "pos").alias("query"))
    return first.join(counts, "query").select("label", "query", "year", "n")
