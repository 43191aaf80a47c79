"""How good were the signals: backtests, precision, recall, baselines, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def backtest(counts: DataFrame, as_of: int, current_year: int) -> DataFrame:
    """(cand_id, bt_at_cutoff, bt_peak_after, bt_growth_x); null where as_of isn't past or nothing follows."""
    rows = counts.groupBy("cand_id").agg(F.coalesce(F.max(F.when(F.col("year") == as_of, F.col("n"))), F.lit(0)).alias("bt_at_cutoff"), F.max(F.when(F.col("year") > as_of, F.col("n"))).alias("bt_peak_after"))
    known = F.lit(as_of < current_year) & F.col("bt_peak_after").isNotNull()
    return rows.select("cand_id", F.when(known, F.col("bt_at_cutoff")).alias("bt_at_cutoff"), F.when(known, F.col("bt_peak_after")).alias("bt_peak_after"), F.when(known, F.bround((F.col("bt_peak_after") + 1) / (F.col("bt_at_cutoff") + 1), 2)).alias("bt_growth_x"))


def lead_time(counts: DataFrame, takeoff: DataFrame) -> DataFrame:
    """(cand_id, lead): year of the first maximum less take-off; null without take-off."""
    peak = counts.groupBy("cand_id").agg(F.min_by("year", F.struct(-F.col("n"), F.col("year"))).alias("peak_year"))
    return peak.join(takeoff, "cand_id", "left").select("cand_id", (F.col("peak_year") - F.col("takeoff")).alias("lead"))


def norm_label(label: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(label), "-", " ")), "s+$", "")


def precision_at_k(ranked: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """One row (k, hits, precision): labels of the first k places that contain a reference label or stand in one.

    The k labels are sent to the reference, which may grow, never the reverse."""
    top = ranked.where(F.col("place") <= k).select("place", norm_label(F.col("label")).alias("a"))
    ref = reference.select(norm_label(F.col("label")).alias("b")).where("b <> ''").distinct()
    few = top.limit(k)
    hit = ref.join(F.broadcast(few), F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))).select("place").distinct().withColumn("hit", F.lit(1))
    both = top.join(hit, "place", "left").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    return both.select(F.lit(k).alias("k"), "hits", F.when(F.col("n") > 0, F.round(F.col("hits") / F.nullif(F.col("n"), F.lit(0)), 4)).otherwise(0.0).alias("precision"))


def reference_match(reference: DataFrame, candidates: DataFrame, generic: list[str]) -> DataFrame:
    """(ref, cand_id, tier): exact label, alias, or all distinctive words inside the label; the first tier, then smaller cand_id.

    Exact and alias are equi-joins; the word tier meets candidates through the rarest distinctive word of the reference."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""))
    ref = reference.select(F.col("label").alias("ref"), F.lower(F.trim("label")).alias("key"), F.filter(words(F.col("label")), lambda w: ~w.isin(*generic)).alias("w")).distinct()
    cand = candidates.select("cand_id", F.lower(F.trim("label")).alias("key"), words(F.col("label")).alias("cw"), "aliases").dropDuplicates(["cand_id"])
    exact = ref.join(cand.select("cand_id", "key"), "key").select("ref", "cand_id", F.lit(1).alias("tier"))
    alias = ref.join(cand.select("cand_id", F.explode("aliases").alias("a")).select("cand_id", F.lower(F.trim("a")).alias("key")), "key").select("ref", "cand_id", F.lit(2).alias("tier"))
    index = cand.select("cand_id", "cw", F.explode("cw").alias("word"))
    df = index.groupBy("word").agg(F.count("*").alias("df"))
    rare = ref.select("ref", "w", F.explode("w").alias("word")).join(df, "word").groupBy("ref", "w").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    soft = rare.join(index, "word").where(F.size(F.array_except("w", "cw")) == 0).select("ref", "cand_id", F.lit(3).alias("tier"))
    first = F.row_number().over(Window.partitionBy("ref").orderBy("tier", "cand_id"))
    return exact.unionByName(alias).unionByName(soft).withColumn("__r", first).where("__r = 1").drop("__r")


def recall(reference: DataFrame, matches: DataFrame) -> DataFrame:
    """One row (found, total, exact, recall)."""
    return reference.select(F.col("label").alias("ref")).distinct().join(matches, "ref", "left").agg(F.count("cand_id").alias("found"), F.count("*").alias("total"), F.count_if(F.col("tier") == 1).alias("exact"), F.coalesce(F.round(F.count("cand_id") / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0)).alias("recall"))


def baseline(counts: DataFrame, as_of: int, k: int, kind: str) -> DataFrame:
    """(place, cand_id, value): largest three-year growth, 'abs' as difference or 'cagr' as rate with a base of 5 or more."""
    rows = counts.groupBy("cand_id").agg(F.coalesce(F.sum(F.when(F.col("year") == as_of, F.col("n"))), F.lit(0)).alias("now"), F.coalesce(F.sum(F.when(F.col("year") == as_of - 3, F.col("n"))), F.lit(0)).alias("then"))
    if kind == "abs":
        rows = rows.withColumn("value", (F.col("now") - F.col("then")).cast("double"))
    else:
        rows = rows.where("then >= 5 and now > 0").withColumn("value", F.round(F.pow(F.col("now") / F.col("then"), F.lit(1 / 3)) - 1, 6))
    place = F.row_number().over(Window.orderBy(F.desc("value"), "cand_id"))
    return rows.orderBy(F.desc("value"), "cand_id").limit(k).withColumn("place", place).select("place", "cand_id", "value")  # the window sees k rows


def report(trends: DataFrame, growth: float = 1.2, mainstream: float = 0.9) -> DataFrame:
    """One row: number of trends, share grown, share mainstream, upper median of lead times. trends: bt_growth_x, maturity_pct, lead."""
    # the median from how often each lead occurs: as many rows as there are different numbers of years
    many = trends.where("lead is not null").groupBy("lead").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("lead"))
    ranked = many.withColumn("upto", upto).crossJoin(F.broadcast(many.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))))
    median = ranked.where(F.col("upto") >= F.floor(F.col("all") / 2) + 1).agg(F.min("lead").alias("median_lead"))
    return trends.agg(
        F.count("*").alias("n_trends"), F.round(F.avg(F.when(F.col("bt_growth_x").isNotNull(), (F.col("bt_growth_x") > growth).cast("double"))), 4).alias("share_grown"),
        F.round(F.avg((F.col("maturity_pct") >= mainstream).cast("double")), 4).alias("share_mainstream"),
    ).crossJoin(F.broadcast(median))


def citations(cards: DataFrame) -> DataFrame:
    """cards (trend_id, claims: array<struct<text, docs>>, allowed: array<string>) -> with unsupported claims blanked and coverage."""
    checked = F.transform("claims", lambda c: F.struct(F.when(F.size(F.array_intersect(c.docs, F.col("allowed"))) > 0, c.text).otherwise("").alias("text"), F.array_intersect(c.docs, F.col("allowed")).alias("docs")))
    return cards.withColumn("claims", checked).withColumn("coverage", F.when(F.size("claims") > 0, F.round(F.size(F.filter("claims", lambda c: c.text != "")) / F.size("claims"), 4)).otherwise(0.0))


def cyrillic_share(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(r"[Ѐ-ӿ]")) / letters)


def preprint_lag(joined: DataFrame, as_of: int) -> DataFrame:
    """(cand_id, lag): take-off year of articles less that of preprints, on plain counts with the threshold max(10, a tenth of the peak)."""
    n = joined.where(F.col("doc_type").isin("article", "preprint") & (F.col("year") <= as_of)).groupBy("cand_id", "doc_type", "year").agg(F.count("*").alias("n"))
    n = n.withColumn("peak", F.max("n").over(Window.partitionBy("cand_id", "doc_type")))
    first = n.where(F.col("n") >= F.greatest(F.lit(10.0), 0.1 * F.col("peak"))).groupBy("cand_id").agg(F.min(F.when(F.col("doc_type") == "article", F.col("year"))).alias("a"), F.min(F.when(F.col("doc_type") == "preprint", F.col("year"))).alias("p"))
    return first.select("cand_id", (F.col("a") - F.col("p")).alias("lag"))
