"""Index mode and live mode: from links and works to ranked trends and reasoned rejections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.harvest import Homes
from tidewatch.operators import quality, score, select, series, shape
from tidewatch.runtime import materialise

VERSION = "1.0"


@dataclass
class Pool:
    """What one run made: scored survivors and rejected candidates."""

    scored: DataFrame
    rejected: DataFrame
    counts: DataFrame
    joined: DataFrame


def labels_of(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("cand_id").agg(F.min(F.struct("label", "domain")).alias("x")).select("cand_id", "x.label", "x.domain")


def _grouped(counts: DataFrame, labels: DataFrame, group: Sequence[str]) -> DataFrame:
    return counts.join(labels.select("cand_id", *group), "cand_id") if group else counts


def score_index(works: DataFrame, cand_docs: DataFrame, candidates: DataFrame, as_of: int, group: Sequence[str] = (), homes: Homes | None = None) -> Pool:
    """The pool of all candidates at a cutoff, or one pool a group: nothing after it is seen; peers are its linked candidates."""
    joined = materialise(series.linked(cand_docs, series.first_harvest(works, "year", "doc_type", "countries", "cited_by", homes=homes), "year", "doc_type", "countries", "cited_by"), "linked")
    counts = materialise(series.year_counts(joined), "year-counts")
    labels = labels_of(candidates)
    past = _grouped(counts.where(F.col("year") <= as_of), labels, group)
    spread = series.country_spread(joined, as_of - 2, as_of)
    rows = shape.components(past, as_of, group=group).join(labels, "cand_id").join(spread, "cand_id", "left").withColumn("n_countries", F.coalesce("n_countries", F.lit(0)))
    rows = materialise(rows.withColumn("reason", score.reject_reason()), "components")
    kept = rows.where("reason is null")
    survivors = score.score(kept, group, n_rows=kept.count())
    rejected = rows.where("reason is not null").select("cand_id", "label", "domain", "reason", F.col("counts_recent").cast("int").alias("n_docs"), F.lit(as_of).alias("as_of"))
    return Pool(survivors, rejected, counts, joined)


def score_counts(counts: DataFrame, spread: DataFrame, labels: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected) of a given pool: counts (cand_id, year, n), spread (cand_id, n_countries), labels (cand_id, label).

    For replays of fixed pools: no merging of variants, no diversity; what is mainstream counts as rejected."""
    rows = shape.components(counts.where(F.col("year") <= as_of), as_of).join(labels, "cand_id").join(spread, "cand_id", "left").withColumn("n_countries", F.coalesce("n_countries", F.lit(0)))
    rows = rows.withColumn("reason", score.reject_reason())
    scored = score.score(rows.where("reason is null"))
    late = scored.where(F.col("maturity_pct") >= score.MAX_MATURITY).select("cand_id", "label", F.lit("already mainstream").alias("reason"))
    return scored.where(F.col("maturity_pct") < score.MAX_MATURITY).drop("reason"), rows.where("reason is not null").select("cand_id", "label", "reason").unionByName(late)


def index_trends(works: DataFrame, cand_docs: DataFrame, candidates: DataFrame, as_of: int, current_year: int, top: int = 15, vectors: DataFrame | None = None, homes: Homes | None = None) -> tuple[DataFrame, DataFrame]:
    """(trends, rejected): score, merge variants, cut what is mainstream, diversify, add documents and backtest.

    Each domain is a pool of its own and gives up to ``top`` trends; vectors: (cand_id, vector)."""
    pool = score_index(works, cand_docs, candidates, as_of, ["domain"], homes)
    scored = materialise(pool.scored.drop("reason"), "scored")
    kept = select.dedup_lexical(scored.select("domain", "cand_id", "label", "es", F.col("counts_recent").alias("n_docs")), ["domain"]).where("merged_into is null").select("cand_id", F.col("merged_labels").alias("aliases"))
    merged = scored.join(kept, "cand_id")
    mature = merged.where(F.col("maturity_pct") >= score.MAX_MATURITY)
    young = merged.where(F.col("maturity_pct") < score.MAX_MATURITY)
    with_vector = young.select("domain", "cand_id", "es") if vectors is None else young.select("domain", "cand_id", "es").join(vectors, "cand_id", "left")
    if vectors is None:
        with_vector = with_vector.withColumn("vector", F.lit(None).cast("array<double>"))
    chosen = select.mmr(with_vector, top, groups=["domain"]).drop("domain").join(young, "cand_id")
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("es"), "cand_id"))  # over the top rows only
    docs = series.top_docs(pool.joined.join(chosen.select("cand_id"), "cand_id"), chosen.select("cand_id", "takeoff"), until=as_of)
    listed = docs.groupBy("cand_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x.doc_id).alias("top_doc_ids"))
    bt = quality.backtest(pool.counts, as_of, current_year)
    trends = chosen.withColumn("rank", rank).join(listed, "cand_id", "left").join(bt, "cand_id", "left").select(
        F.format_string("t:%s:%d:%02d", "domain", F.lit(as_of), "rank").alias("trend_id"), "domain", F.lit(as_of).alias("as_of"), "rank", "cand_id", "label", "aliases", F.col("es").alias("emergence_score"), "c_novelty", "c_growth", "c_accel", "c_burst", "c_diffusion", "maturity_pct",
        "first_mention", F.col("takeoff").alias("takeoff_year"), "years", "counts", "freq_per_million", F.col("counts_recent").cast("int").alias("n_docs"), F.col("n_countries").cast("int").alias("n_countries"), F.coalesce("top_doc_ids", F.array().cast("array<string>")).alias("top_doc_ids"),
        score.stage(F.col("age"), F.col("maturity_pct")).alias("stage"), score.confidence(F.col("counts_recent"), F.col("n_countries"), F.col("homonym")).alias("confidence"), F.lit(VERSION).alias("methodology_version"), F.lit("year").alias("series_granularity"),
        F.col("bt_at_cutoff").cast("int").alias("bt_at_cutoff"), F.col("bt_peak_after").cast("int").alias("bt_peak_after"), F.col("bt_growth_x").cast("float").alias("bt_growth_x"),
    )
    late = mature.select("cand_id", "label", "domain", F.lit("already mainstream").alias("reason"), F.col("counts_recent").cast("int").alias("n_docs"), F.lit(as_of).alias("as_of"))
    return trends, pool.rejected.unionByName(late)


def score_live(works: DataFrame, cand_docs: DataFrame, candidates: DataFrame, as_of: str, science: DataFrame | None = None, phrases: tuple[str, ...] = (), group: Sequence[str] = (), homes: Homes | None = None) -> Pool:
    """The same by month: publishers stand for countries, trust is needed, maturity doesn't count."""
    needed = ("year", "date", "doc_type", "source", "title", "url", "trust_level", "cited_by")
    joined = materialise(series.linked(cand_docs, series.first_harvest(works, *needed, homes=homes), *needed), "linked-live")
    counts = materialise(series.month_counts(joined), "month-counts")
    labels = labels_of(candidates)
    rows = shape.components_monthly(_grouped(counts, labels, group), as_of, group=group).join(labels, "cand_id")
    rows = rows.join(series.domain_spread(joined), "cand_id", "left").join(series.trusted_share(joined), "cand_id", "left")
    rows = rows.withColumn("n_domains", F.coalesce("n_domains", F.lit(0))).withColumn("trusted_share", F.coalesce("trusted_share", F.lit(0.5)))
    rows = rows.join(science, "label", "left") if science is not None else rows.withColumn("science_10y", F.lit(None).cast("long"))
    rows = materialise(rows.withColumn("reason", score.reject_reason_live(phrases=phrases)), "components-live")
    kept = rows.where("reason is null").withColumn("n_countries", F.col("n_domains"))
    survivors = score.score(kept, group, maturity=False, n_rows=kept.count())
    rejected = rows.where("reason is not null").select("cand_id", "label", "domain", "reason", F.col("counts_recent").cast("int").alias("n_docs"), F.lit(int(as_of[:4])).alias("as_of"))
    return Pool(survivors, rejected, counts, joined)


def live_trends(works: DataFrame, cand_docs: DataFrame, candidates: DataFrame, as_of: str, top: int = 15, **options) -> tuple[DataFrame, DataFrame]:
    """(trends, rejected): each domain is a pool of its own and gives up to ``top`` trends."""
    pool = score_live(works, cand_docs, candidates, as_of, group=["domain"], **options)
    scored = materialise(pool.scored, "scored-live")
    kept = select.dedup_lexical(scored.select("domain", "cand_id", "label", "es", F.col("counts_recent").alias("n_docs")), ["domain"]).where("merged_into is null").select("cand_id", F.col("merged_labels").alias("aliases"))
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("es"), "cand_id"))
    trends = scored.join(kept, "cand_id").withColumn("rank", rank).where(F.col("rank") <= top).select(
        "domain", "rank", "cand_id", "label", "aliases", F.col("es").alias("emergence_score"), "age", "counts_recent", "n_domains", F.round("trusted_share", 6).alias("trusted_share"), "years", "counts",
        score.stage(F.floor(F.col("age") / 12), F.lit(0.0)).alias("stage"), score.confidence_live(F.col("counts_recent"), F.col("n_domains"), F.col("active_months")).alias("confidence"), F.lit("month").alias("series_granularity"),
    )
    return trends, pool.rejected
