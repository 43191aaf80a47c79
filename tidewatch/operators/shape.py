"""The shape of a series: segments, break-out, take-off, slopes, burst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.runtime import lookup_join

ACTIVE, MAX_GAP = 5, 3
BREAK_FACTOR, BREAK_YEARS, BASE_YEARS, MIN_BASE = 2.5, 8, 5, 20
FIRST_COUNT, PEAK_SHARE = 5, 0.10


def segments(counts: DataFrame, as_of: int, active: int = ACTIVE, gap: int = MAX_GAP) -> DataFrame:
    """(cand_id, segment, first_year, last_year, n_years): runs of active years with at most ``gap`` years between."""
    w = Window.partitionBy("cand_id").orderBy("year")
    live = counts.where((F.col("year") <= as_of) & (F.col("n") >= active))
    marked = live.withColumn("new", F.coalesce((F.col("year") - F.lag("year").over(w) > gap).cast("int"), F.lit(1)))
    return marked.withColumn("segment", F.sum("new").over(w)).groupBy("cand_id", "segment").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("n_years"))


def current_history(counts: DataFrame, as_of: int) -> DataFrame:
    """(cand_id, year, n, n_segments) of the last segment, whole history where there is none."""
    seg = segments(counts, as_of)
    last = seg.groupBy("cand_id").agg(F.max_by("first_year", "segment").alias("a"), F.max_by("last_year", "segment").alias("b"), F.count("*").alias("n_segments"))
    past = counts.where(F.col("year") <= as_of).join(last, "cand_id", "left")
    return past.where(F.col("a").isNull() | F.col("year").between(F.col("a"), F.col("b"))).select("cand_id", "year", "n", F.coalesce("n_segments", F.lit(0)).alias("n_segments"))


def breakout(counts: DataFrame, as_of: int) -> DataFrame:
    """(cand_id, base, breakout): the first year that exceeds the median of the years before the search by the factor; null
    below the least base. Missing years of the base count 0."""
    first, last = as_of - BREAK_YEARS - BASE_YEARS, as_of - BREAK_YEARS - 1
    ids = counts.select("cand_id").distinct()
    frame = ids.select("cand_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    base = frame.join(counts, ["cand_id", "year"], "left").groupBy("cand_id").agg(F.median(F.coalesce("n", F.lit(0))).alias("base"))
    hits = counts.where(F.col("year").between(as_of - BREAK_YEARS, as_of)).join(base, "cand_id").where((F.col("base") >= MIN_BASE) & (F.col("n") >= F.col("base") * BREAK_FACTOR))
    return base.join(hits.groupBy("cand_id").agg(F.min("year").alias("breakout")), "cand_id", "left")


def first_crossing(history: DataFrame) -> DataFrame:
    """(cand_id, first_mention, takeoff): first year of 5 documents; of twice that and a tenth of the peak."""
    peak = F.max("n").over(Window.partitionBy("cand_id"))
    rows = history.withColumn("peak", peak)
    return rows.groupBy("cand_id").agg(
        F.min(F.when(F.col("n") >= FIRST_COUNT, F.col("year"))).alias("first_mention"),
        F.min(F.when(F.col("n") >= F.greatest(F.lit(FIRST_COUNT * 2.0), PEAK_SHARE * F.col("peak")), F.col("year"))).alias("takeoff"),
    )


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope, 0 where it isn't defined."""
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0))


def _line(values: str, n: int) -> Column:
    """Slope of n values at 0..n-1, as a weighted sum with fixed weights."""
    mean = (n - 1) / 2
    den = sum((i - mean) ** 2 for i in range(n))
    weights = F.array(*(F.lit((i - mean) / den if den else 0.0) for i in range(n)))
    return _dot(F.col(values), weights)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _series(counts: DataFrame, bucket: str, first: int, last: int, group: Sequence[str] = ()) -> DataFrame:
    """One row a candidate: series (bucket, n) in order, and n, freq of each bucket of first..last.

    One shuffle; the peers' sums, one number a bucket, are put into the plan as a literal. With a group, columns of counts
    that a candidate has one value of, its peers are those of its group, and their sums are joined."""
    per = counts.groupBy("cand_id", *group).agg(F.array_sort(F.collect_list(F.struct(F.col(bucket).alias("b"), F.col("n").cast("long").alias("n")))).alias("series"))
    known = F.map_from_entries(F.filter("series", lambda x: x.b.between(first, last)))
    per = per.withColumn("__m", known).withColumn("ns", F.transform(F.sequence(F.lit(first), F.lit(last)), lambda b: F.coalesce(F.try_element_at("__m", b), F.lit(0).cast("long"))))
    if group:
        sums = counts.where(F.col(bucket).between(first, last)).groupBy(*group, bucket).agg(F.sum("n").cast("double").alias("s"))
        sums = sums.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct(F.col(bucket).cast("int"), "s"))).alias("__p"))
        per = lookup_join(per, sums, group, F.col("cand_id"), "left")
        peers = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda b: F.greatest(F.coalesce(F.try_element_at("__p", b), F.lit(1.0)), F.lit(1.0)))
        return per.withColumn("freqs", F.zip_with("ns", peers, lambda n, p: n / p * 1e6)).drop("__m", "__p")
    norm = {r[bucket]: r.s for r in counts.groupBy(bucket).agg(F.sum("n").cast("double").alias("s")).where(F.col(bucket).between(first, last)).collect()}
    peers = F.array(*(F.lit(max(norm.get(b, 1.0), 1.0)) for b in range(first, last + 1)))
    return per.withColumn("freqs", F.zip_with("ns", peers, lambda n, p: n / p * 1e6)).drop("__m")


def components(counts: DataFrame, as_of: int, window: int = 5, group: Sequence[str] = ()) -> DataFrame:
    """One row a candidate: what the score, the reasons and the published row are made of.

    counts holds years up to as_of only; the peers' norm is taken over all its candidates, or those of a group. A candidate's years lie in one
    row, so that all of its shape is worked out there, after a single shuffle."""
    first, half = as_of - window + 1, max(2, window // 2)
    rows = _series(counts, "year", first, as_of, group).withColumn("ys", F.transform("freqs", lambda f: F.log(f + 1.0)))
    rows = rows.withColumn("y1", F.slice("ys", 1, half)).withColumn("y2", F.slice("ys", window - half + 1, half))
    nothing = F.struct(F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        begins = acc.b.isNull() | (x.b - acc.b > MAX_GAP)
        moved = F.struct(F.when(begins, x.b).otherwise(acc.a).alias("a"), x.b.alias("b"), (acc.k + begins.cast("int")).alias("k"))
        return F.when((x.b <= as_of) & (x.n >= ACTIVE), moved).otherwise(acc)

    rows = rows.withColumn("life", F.aggregate("series", nothing, step))
    rows = rows.withColumn("history", F.filter("series", lambda x: (x.b <= as_of) & ((F.col("life.k") == 0) | x.b.between(F.col("life.a"), F.col("life.b")))))
    base_years = F.filter("series", lambda x: x.b.between(as_of - BREAK_YEARS - BASE_YEARS, as_of - BREAK_YEARS - 1))
    padded = F.array_sort(F.concat(F.transform(base_years, lambda x: x.n), F.array_repeat(F.lit(0).cast("long"), F.lit(BASE_YEARS) - F.size(base_years))))
    rows = rows.withColumn("base", F.get(padded, F.lit(BASE_YEARS // 2)).cast("double")).withColumn("peak", F.array_max(F.transform("history", lambda x: x.n)))
    year_of = lambda col, test: F.array_min(F.transform(F.filter(col, test), lambda x: x.b))
    rows = rows.withColumn("breakout", year_of("series", lambda x: x.b.between(as_of - BREAK_YEARS, as_of) & (F.col("base") >= MIN_BASE) & (x.n >= F.col("base") * BREAK_FACTOR)))
    rows = rows.withColumn("f", year_of("history", lambda x: x.n >= FIRST_COUNT)).withColumn("t", year_of("history", lambda x: x.n >= F.greatest(F.lit(FIRST_COUNT * 2.0), PEAK_SHARE * F.col("peak"))))
    last = F.get("freqs", F.lit(window - 1))
    total, before = _total(F.col("freqs")), _total(F.slice("freqs", 1, window - 1))
    takeoff = F.coalesce("breakout", "t")
    return rows.select(
        "cand_id", F.when(F.col("breakout").isNotNull(), F.least(F.coalesce("f", "breakout"), "breakout")).otherwise(F.col("f")).alias("first_mention"), takeoff.alias("takeoff"), F.coalesce(F.lit(as_of) - F.coalesce(takeoff, F.col("f")), F.lit(99)).alias("age"),
        ((F.col("life.k") > 1) | F.col("breakout").isNotNull()).alias("homonym"), _line("ys", window).alias("growth"), (_line("y2", half) - _line("y1", half)).alias("accel"), ((last + 0.1) / (before / max(1, window - 1) + 0.1)).alias("burst"), last.alias("maturity"),
        F.aggregate("ns", F.lit(0).cast("long"), lambda s, x: s + x).alias("counts_recent"), F.size(F.filter("freqs", lambda f: f > 0)).cast("long").alias("active_years"), F.when(total > 0, F.bround(last / total, 3)).otherwise(1.0).alias("last_year_share"),
        F.sequence(F.lit(first), F.lit(as_of)).alias("years"), F.transform("ns", lambda n: n.cast("int")).alias("counts"), F.transform("freqs", lambda f: F.bround(f, 2).cast("float")).alias("freq_per_million"),
    )


def month_index(month: Column) -> Column:
    """Months since year 0; null where it isn't YYYY-MM with a month of 1..12."""
    good = month.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$")
    return F.when(good, F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1)


def components_monthly(counts: DataFrame, as_of: str, window: int = 24, group: Sequence[str] = ()) -> DataFrame:
    """The same on months (cand_id, month, n): slopes of the logarithm of trailing three-month sums, no segments."""
    end = int(as_of[:4]) * 12 + int(as_of[5:7]) - 1
    start, half = end - window + 1, max(2, window // 2)
    past = counts.withColumn("m", month_index(F.col("month"))).where(F.col("m") <= end).select("cand_id", *group, "m", "n")
    rows = _series(past, "m", start, end, group)
    trailing = F.transform(F.sequence(F.lit(1), F.lit(window)), lambda i: F.log(_total(F.slice("freqs", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))) + 1.0))
    rows = rows.withColumn("ys", trailing).withColumn("y1", F.slice("ys", 1, half)).withColumn("y2", F.slice("ys", window - half + 1, half)).withColumn("peak", F.array_max(F.transform("series", lambda x: x.n)))
    month_at = lambda test: F.array_min(F.transform(F.filter("series", test), lambda x: x.b))
    rows = rows.withColumn("f", month_at(lambda x: x.n >= 2)).withColumn("t", month_at(lambda x: x.n >= F.greatest(F.lit(3.0), 0.1 * F.col("peak"))))
    recent, before = _total(F.slice("freqs", window - 2, 3)), _total(F.slice("freqs", 1, window - 3))
    ref = F.coalesce("t", "f")
    return rows.select(
        "cand_id", F.floor(F.col("f") / 12).cast("int").alias("first_mention"), F.floor(F.col("t") / 12).cast("int").alias("takeoff_year"), F.when(ref >= start, F.lit(end) - ref).otherwise(99).alias("age"), _line("ys", window).alias("growth"), (_line("y2", half) - _line("y1", half)).alias("accel"),
        ((recent / 3 + 0.1) / (before / max(1, window - 3) + 0.1)).alias("burst"), (recent / 3).alias("maturity"), F.aggregate("ns", F.lit(0).cast("long"), lambda s, x: s + x).alias("counts_recent"), F.size(F.filter("freqs", lambda f: f > 0)).cast("long").alias("active_months"),
        F.transform(F.sequence(F.lit(start), F.lit(end)), lambda m: (F.floor(m / 12) * 100 + m % 12 + 1).cast("int")).alias("years"), F.transform("ns", lambda n: n.cast("int")).alias("counts"),
    )
