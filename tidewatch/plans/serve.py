"""What readers ask of published tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import slug
from tidewatch.operators import score


def resolve(domains: DataFrame, query: str) -> DataFrame:
    """(domain, tier): exact slug first, then those that contain the query's slug or stand in it; the best tier only."""
    q = slug(F.lit(query))
    s = slug(F.col("domain"))
    tier = F.when(s == q, 1).when((q != "") & (s.contains(q) | q.contains(s)), 2)
    rows = domains.select("domain").distinct().withColumn("tier", tier).where("tier is not null")
    return rows.join(rows.agg(F.min("tier").alias("tier")), "tier").select("domain", "tier")


def trends(table: DataFrame, domain: str, as_of: int, top: int = 15) -> DataFrame:
    """The first ``top`` (1..50) trends of a pool by rank; an unknown domain or cutoff is an error naming the known ones."""
    if not 1 <= top <= 50:
        raise ValueError("top must be 1..50")
    pool = table.where(F.col("domain") == domain)
    rows = pool.where((F.col("as_of") == as_of) & (F.col("rank") <= top))
    if rows.isEmpty():
        known = [r.as_of for r in pool.select("as_of").distinct().orderBy("as_of").limit(100).collect()]
        raise LookupError(f"no cutoff {as_of} of {domain}; there are {known}" if known else f"unknown domain {domain}")
    return rows.orderBy("rank")


def trend(table: DataFrame, trend_id: str) -> DataFrame:
    return table.where(F.col("trend_id") == trend_id)


def documents(works: DataFrame, ids: list[str]) -> DataFrame:
    """Works in the order asked for, each once."""
    asked = works.sparkSession.createDataFrame([(i, d) for i, d in enumerate(dict.fromkeys(ids))], "pos int, doc_id string")
    return works.join(F.broadcast(asked), "doc_id").orderBy("pos").drop("pos")


def as_model(table: DataFrame) -> DataFrame:
    """(trend_id, body): the nested response in JSON; a backtest only if all three of its values are known."""
    points = F.transform(F.arrays_zip("years", "counts", "freq_per_million"), lambda p: F.struct(p.years.alias("year"), p.counts.alias("count"), F.round(p.freq_per_million.cast("double"), 2).alias("freq")))
    known = F.col("bt_at_cutoff").isNotNull() & F.col("bt_peak_after").isNotNull() & F.col("bt_growth_x").isNotNull()
    body = F.struct("trend_id", "rank", "label", F.struct("c_novelty", "c_growth", "c_accel", "c_burst", "c_diffusion").alias("components"), points.alias("series"), F.coalesce("top_doc_ids", F.array().cast("array<string>")).alias("sources"), F.when(known, F.struct("bt_at_cutoff", "bt_peak_after", "bt_growth_x")).alias("backtest"))
    return table.select("trend_id", F.to_json(body).alias("body"))


def header(trend_rows: DataFrame, rejected: DataFrame, works: DataFrame) -> DataFrame:
    """One row of counts over the answer."""
    n, sure = trend_rows.agg(F.count("*"), F.count_if(F.col("emergence_score") > 0.75)).first()
    return trend_rows.sparkSession.createDataFrame([(n, sure, rejected.count(), works.count())], "n_trends long, n_confident long, n_rejected long, n_sources long")


def methodology(spark: SparkSession) -> DataFrame:
    """(part, name, value) of all weights and thresholds."""
    rows = [("weight", k, float(v)) for k, v in score.WEIGHTS.items()] + [("limit", k, float(v)) for k, v in score.LIMITS.items()] + [("live", k, float(v)) for k, v in score.LIVE.items()] + [("penalty", "maturity", score.MATURITY_PENALTY), ("limit", "maturity", score.MAX_MATURITY)]
    return spark.createDataFrame(rows, "part string, name string, value double")


def page(rows: DataFrame, order: list, first: int, size: int) -> DataFrame:
    """Rows first.. (from 0) of an order, size of them; a sorted take that skips, not a sort of all."""
    return rows.orderBy(*order).offset(first).limit(size)


def domains(table: DataFrame) -> DataFrame:
    """(domain, cutoffs, n_trends, newest)."""
    return table.groupBy("domain").agg(F.count_distinct("as_of").alias("cutoffs"), F.count_distinct("trend_id").alias("n_trends"), F.max("as_of").alias("newest"))


def prompts(trends: DataFrame, works: DataFrame, chars: int = 400) -> DataFrame:
    """(trend_id, prompt): label and documents (at most 20 a trend) in their order, abstracts cut at ``chars`` characters; for one
    document alone a note that nothing more general follows from it."""
    asked = trends.select("trend_id", "label", F.posexplode("top_doc_ids").alias("pos", "doc_id"))
    cut = F.when(F.coalesce("abstract", F.lit("")) != "", F.concat(F.lit("\n  "), F.substring("abstract", 1, chars))).otherwise("")
    line = F.concat(F.lit("["), "doc_id", F.lit("] ("), F.col("year").cast("string"), F.lit(") "), "title", cut)
    found = asked.join(works.select("doc_id", line.alias("line")), "doc_id").groupBy("trend_id", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("d"))
    note = F.when(F.size("d") == 1, "Only one document is known; say so.").otherwise(F.concat(F.size("d").cast("string"), F.lit(" documents; say what several of them support.")))
    return found.select("trend_id", F.concat(F.lit("Topic: "), "label", F.lit("\n"), note, F.lit("\n"), F.array_join(F.transform("d", lambda x: x.line), "\n")).alias("prompt"))


def prompt(label: str, rows: list[dict]) -> str:
    """Numbered context for a card; abstracts are cut at 400 characters."""
    lines = [f"[{i}] {r['title']} ({r['year']})\n{(r.get('abstract') or '')[:400]}" for i, r in enumerate(rows, 1)]
    note = "Only one document is known; say so." if len(rows) == 1 else "Cite documents by number."
    return f"Topic: {label}\n{note}\n\n" + "\n\n".join(lines)


def parse_json(text: str) -> dict | None:
    """A model's answer as JSON, from its first brace to its last if there is text around."""
    for piece in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            got = json.loads(piece)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return None
