"""Ranks, scores, ordered reasons, stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEIGHTS = {"novelty": 0.20, "growth": 0.32, "accel": 0.23, "burst": 0.15, "diffusion": 0.10}
MATURITY_PENALTY, MAX_MATURITY = 0.5, 0.90
LIMITS = {"age": 8, "evidence": 20, "countries": 5, "active_years": 3, "last_year_share": 0.80, "burst_countries": 10}
LIVE = {"age": 24, "evidence": 2, "domains": 2, "soft_evidence": 4, "active_months": 3, "trusted_share": 0.34, "plateau_age": 18, "plateau_growth": 0.03, "science": 10_000}

# fixed values: words that make a label a piece of a title
EDGE_WORDS = "a an the of for and or in on to with by from using based via as at is are its their our this that new towards toward into through under over between during without within".split()
INNER_WORDS = "a an the and or but vs versus".split()
HEADLINE_WORDS = (
    "raises raised raise raising launches launched launch unveils unveiled announces announced secures secured lands closes debuts acquires acquired partners expands first new top best pure-play largest leading biggest latest how why what inside meet says said gets wins hits nears eyes"
).split()


def pct_rank(value: str | Column, group: Sequence[str] = ()) -> Column:
    """Percentile rank in 0..1 with the average rank of ties; a group of one has 0."""
    value = F.col(value) if isinstance(value, str) else value
    keys = list(group) or [F.lit(1)]
    n = F.count("*").over(Window.partitionBy(*keys))
    low = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return (low - 1 + (ties - 1) / 2) / F.greatest(F.lit(1), n - 1)


def spread_rank(rows: DataFrame, value: Column, out: str, cells: int = 256) -> DataFrame:
    """pct_rank over all rows without one task seeing them: counts of distinct values, ranked inside cells of neighbouring
    values and over the cells' totals. Values must not be null."""
    valued = rows.withColumn("__v", value)
    cuts = valued.agg(F.percentile_approx("__v", [i / cells for i in range(1, cells)], 10_000)).first()[0] or []  # 255 numbers
    cell = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("__v"))) if cuts else F.lit(0)
    counted = valued.groupBy("__v").agg(F.count("*").alias("__n")).withColumn("__cell", cell)
    totals = {r["__cell"]: r.s for r in counted.groupBy("__cell").agg(F.sum("__n").alias("s")).collect()}  # 256 numbers
    below, seen = {}, 0
    for c in sorted(totals):
        below[c], seen = seen, seen + totals[c]
    start = F.element_at(F.create_map(*(F.lit(int(x)) for pair in below.items() for x in pair)), F.col("__cell")) if below else F.lit(0)
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.select("__v", ((start + inside + (F.col("__n") - 1) / 2) / max(1, seen - 1)).alias(out))
    return valued.join(ranked, "__v").drop("__v")


#: Beyond so many rows an ungrouped pool is ranked by spread_rank.
ONE_TASK_ROWS = 500_000


def score(rows: DataFrame, group: Sequence[str] = (), maturity: bool = True, n_rows: int | None = None) -> DataFrame:
    """rows with parts, maturity_pct and es. rows has age, growth, accel, burst, n_countries (or what stands for spread), maturity.

    n_rows, where it is known, decides whether an ungrouped pool is ranked by windows or spread over the cluster."""
    near = lambda x: F.round(x, 9)  # noqa: E731  # sums of doubles in another order must not part equal values
    values = {"novelty": -F.col("age"), "growth": near(F.col("growth")), "accel": near(F.col("accel")), "burst": near(F.log(F.col("burst") + 0.01)), "diffusion": F.col("n_countries").cast("double")}
    if maturity:
        values["maturity"] = near(F.col("maturity"))
    wide = not group and n_rows is not None and n_rows > ONE_TASK_ROWS
    for name, value in values.items():
        rows = spread_rank(rows, value, f"r_{name}") if wide else rows.withColumn(f"r_{name}", pct_rank(value, group))
    return _combined(rows if maturity else rows.withColumn("r_maturity", F.lit(0.0)))


def _combined(rows: DataFrame) -> DataFrame:
    raw = sum(F.col(f"r_{name}") * w for name, w in WEIGHTS.items())
    rows = rows.withColumn("es", F.round(raw * (1.0 - MATURITY_PENALTY * F.col("r_maturity")), 4)).withColumn("maturity_pct", F.bround("r_maturity", 3))
    for name in WEIGHTS:
        rows = rows.withColumn(f"c_{name}", F.bround(f"r_{name}", 3))
    return rows.drop(*(f"r_{name}" for name in (*WEIGHTS, "maturity")))


def words(label: Column) -> Column:
    return F.filter(F.split(F.lower(label), r"\s+"), lambda w: w != "")


def is_fragment(label: Column) -> Column:
    """Fewer than two words, an edge word at either end, or an article or conjunction inside."""
    w = words(label)
    inside = F.exists(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))), lambda x: x.isin(*INNER_WORDS))
    return (F.size(w) < 2) | F.try_element_at(w, F.lit(1)).isin(*EDGE_WORDS) | F.try_element_at(w, F.lit(-1)).isin(*EDGE_WORDS) | inside


def is_headline_piece(label: Column) -> Column:
    w = words(label)
    return (F.size(w) > 1) & (F.try_element_at(w, F.lit(1)).isin(*HEADLINE_WORDS) | F.try_element_at(w, F.lit(-1)).isin(*HEADLINE_WORDS))


def stems4(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(F.regexp_replace(F.lower(text), "-", " "), r"\s+"), lambda w: F.length(w) >= 3), lambda w: F.substring(w, 1, 4)))


def is_query_topic(label: Column, phrases: Sequence[str]) -> Column:
    """Whether all stems of the label stand in one phrase of the query."""
    hit = F.lit(False)
    for p in phrases:
        hit = hit | (F.size(F.array_except(stems4(label), stems4(F.lit(p)))) == 0)
    return (F.size(stems4(label)) > 0) & hit


def reject_reason(label: str = "label") -> Column:
    """First reason that holds, in this order; null: kept."""
    c = F.col
    return (
        F.when(is_fragment(c(label)), "phrase fragment").when(c("counts_recent") < LIMITS["evidence"], "too little data").when(c("age") > LIMITS["age"], "too old").when(c("active_years") < LIMITS["active_years"], "one-year spike")
        .when((c("last_year_share") > LIMITS["last_year_share"]) & (c("n_countries") < LIMITS["burst_countries"]), "bulk dump").when(c("n_countries") < LIMITS["countries"], "no geographic spread")
    )


def reject_reason_live(label: str = "label", phrases: Sequence[str] = ()) -> Column:
    """science_10y may be null: unknown isn't zero."""
    c = F.col
    studied = F.concat(F.lit("studied widely: "), F.replace(F.format_number(c("science_10y"), 0), F.lit(","), F.lit(" ")), F.lit(" works in 10 years"))
    return (
        F.when(is_query_topic(c(label), phrases), "the topic of the query").when(is_headline_piece(c(label)), "headline fragment").when(c("science_10y") > LIVE["science"], studied).when(c("counts_recent") < LIVE["evidence"], "single mention").when(c("age") > LIVE["age"], "too old")
        .when(c("n_domains") < LIVE["domains"], "one publisher").when(c("trusted_share") < LIVE["trusted_share"], "indicator sources only").when((c("age") >= LIVE["plateau_age"]) & (c("growth") <= LIVE["plateau_growth"]), "plateau")
    )


def stage(age: Column, maturity_pct: Column) -> Column:
    return F.when(maturity_pct >= MAX_MATURITY, "scaling").when(age <= 3, "emerging").when(age <= 6, "early_growth").otherwise("scaling")


def confidence(n: Column, countries: Column, homonym: Column) -> Column:
    return F.when((n >= 200) & (countries >= 15), F.when(homonym, "medium").otherwise("high")).when((n >= 50) & (countries >= 8), "medium").otherwise("low")


def confidence_live(n: Column, domains: Column, months: Column) -> Column:
    thin = (n < LIVE["soft_evidence"]) | (months < LIVE["active_months"])
    return F.when(thin, "low").when((n >= 15) & (domains >= 8), "high").when((n >= 6) & (domains >= 4), "medium").otherwise("low")
