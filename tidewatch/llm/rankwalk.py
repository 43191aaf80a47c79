"""Problem 7: one ranking out of several scores on different scales.

Method: a Markov chain that, at an item, picks one of the scores at random and jumps uniformly to an item which that
score ranks higher (it stays where none is higher). Power iteration uses sorted prefix sums, so a step costs O(n) a
score; with probability 1 - damping the walk restarts anywhere. Items are ordered by their share of the stationary walk.
Only orders enter, never differences, so no score rules by its range.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.runtime import forget, lookup_join, materialise, parallelism

DAMPING, TOLERANCE, STEPS = 0.85, 1e-10, 100
#: Groups of more items than this (8 bytes a score and item) are walked over the cluster instead of in one task.
GROUP_ROWS = 1_000_000


def walk(scores: np.ndarray, damping: float = DAMPING, tolerance: float = TOLERANCE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """scores: items x scores, NaN for none. Returns the stationary shares and, for each score, how many items exceed
    the item (-1 where it has none). An item without a score jumps to any item that has it; a score that nobody has
    leaves everybody in place."""
    n, k = scores.shape
    plans, above = [], np.full((n, k), -1, np.int64)
    for s in range(k):
        has = np.flatnonzero(~np.isnan(scores[:, s]))
        order = has[np.argsort(scores[has, s], kind="stable")]
        v = scores[order, s]
        lower = np.searchsorted(v, v, "left")  # items of a lower score
        higher = len(v) - np.searchsorted(v, v, "right")
        above[order, s] = higher
        plans.append((order, lower, higher))
    p = np.full(n, 1.0 / max(n, 1))
    for _ in range(steps):
        moved = np.zeros(n)
        for order, lower, higher in plans:
            if not len(order):
                moved += p
                continue
            have = p[order]
            sums = np.concatenate(([0.0], np.cumsum(have / np.maximum(higher, 1) * (higher > 0))))
            moved[order] += sums[lower] + have * (higher == 0)
            rest = 1.0 - have.sum() if len(order) < n else 0.0
            moved[order] += max(rest, 0.0) / len(order)
        new = (1 - damping) / n + damping * moved / k
        new /= new.sum()
        done = np.abs(new - p).sum() < tolerance
        p = new
        if done:
            break
    return p, above


def _levels(values: DataFrame, s: str) -> DataFrame:
    """values (grp, s, ...; distinct scores) with b: which of 256 buckets of neighbouring scores of its group each lies in."""
    cuts = values.groupBy("grp").agg(F.percentile_approx(s, [i / 256 for i in range(1, 256)], 10000).alias("cuts"))  # 255 numbers a group
    return values.join(F.broadcast(cuts), "grp").withColumn("b", F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col(s)))).drop("cuts")


def _below(values: DataFrame, s: str, amount: str, out: str) -> DataFrame:
    """values with the sum of amount over the lower scores of the group: inside the bucket and over the buckets' totals."""
    before = Window.partitionBy("grp").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows a group
    totals = values.groupBy("grp", "b").agg(F.sum(amount).alias("__t")).withColumn("__before", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inside = Window.partitionBy("grp", "b").orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    return values.join(F.broadcast(totals), ["grp", "b"]).withColumn(out, F.col("__before") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("__before")


def _spread_walk(rows: DataFrame, k: int, damping: float, steps: int, tolerance: float = TOLERANCE) -> DataFrame:
    """walk() for groups too large for one task, by DataFrame steps. rows: grp, item, s0..

    What an item sends and gets through a score depends on the score alone, so the prefix sums run over distinct scores,
    however many items tie; no task sees a group."""
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    base = rows.join(F.broadcast(sizes), "grp")  # a row a large group
    tables, n_values = [], []
    for s in range(k):
        values = base.where(f"s{s} is not null").groupBy("grp", f"s{s}").agg(F.count("*").alias("c"))
        values = materialise(_levels(values, f"s{s}"), "rankwalk-values")
        have = values.groupBy("grp").agg(F.sum("c").alias(f"have{s}"))  # a row a large group
        ranked = _below(values, f"s{s}", "c", "lower").join(F.broadcast(have), "grp")
        tables.append(materialise(ranked.select("grp", f"s{s}", "b", f"have{s}", (F.col(f"have{s}") - F.col("lower") - F.col("c")).alias(f"above{s}")), "rankwalk-values"))
        n_values.append(tables[-1].count())
        base = base.join(F.broadcast(have), "grp", "left")
    p = materialise(base.withColumn("p", 1.0 / F.col("n")), "rankwalk-step")
    for _ in range(steps):
        total, walked = F.lit(0.0), p.select(*base.columns, "p")
        for s, values in enumerate(tables):
            here = p.groupBy("grp", f"s{s}").agg(F.sum("p").alias("__p"))
            sent = values.join(here.where(f"s{s} is not null"), ["grp", f"s{s}"]).withColumn("__send", F.when(F.col(f"above{s}") > 0, F.col("__p") / F.col(f"above{s}")).otherwise(0.0))
            rest = here.where(f"s{s} is null").select("grp", F.col("__p").alias("__rest"))
            got = _below(sent, f"s{s}", "__send", "__in").join(F.broadcast(rest), "grp", "left")
            got = got.select("grp", f"s{s}", f"above{s}", (F.col("__in") + F.coalesce("__rest", F.lit(0.0)) / F.col(f"have{s}")).alias(f"in{s}"))
            walked = lookup_join(walked, got, ["grp", f"s{s}"], F.col("item"), "left", n_values[s])
            comes = F.coalesce(f"in{s}", F.lit(0.0)) + F.when(F.col(f"above{s}") == 0, F.col("p")).otherwise(0.0)
            total = total + F.when(F.col(f"have{s}").isNull(), F.col("p")).otherwise(comes)  # a score that nobody has leaves everybody in place
        moved = walked.withColumn("old", F.col("p")).withColumn("p", (1 - damping) / F.col("n") + damping * total / k)
        new = materialise(moved.select(*base.columns, "p", "old", *(f"above{s}" for s in range(k))), "rankwalk-step")
        change = new.groupBy("grp").agg(F.sum(F.abs(F.col("p") - F.col("old"))).alias("d")).agg(F.max("d")).first()[0]  # one number
        forget(p)
        p = new
        if change is None or change < tolerance:
            break
    for values in tables:
        forget(values)
    return p.select("grp", "item", F.col("n").cast("int").alias("size"), F.col("p").alias("stationary"), *(F.coalesce(f"above{s}", F.lit(-1)).cast("long").alias(f"above{s}") for s in range(k)))


def _spread_places(walked: DataFrame) -> DataFrame:
    """walked with place by falling share and item in each group, without a task that sees a group: rows lie in ranges of
    that order, are numbered inside each, and go on from the counts of the ranges before."""
    order = ["grp", F.desc("stationary"), "item"]
    ranges = materialise(walked.repartitionByRange(parallelism(walked.sparkSession), *order).withColumn("__part", F.spark_partition_id()), "rankwalk-places")
    counts = ranges.groupBy("grp", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("grp").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("grp", "__part").orderBy(F.desc("stationary"), "item"))
    return ranges.join(F.broadcast(offsets), ["grp", "__part"]).withColumn("place", (inside + F.col("__before")).cast("int")).drop("__part", "__before")


def rank_walk(df: DataFrame, groups: Sequence[str], item: str, scores: Sequence[str], damping: float = DAMPING, group_rows: int = GROUP_ROWS, steps: int = STEPS) -> DataFrame:
    """groups, item, place, size (of the group), stationary and above_<score> (how many items of the group exceed it; -1: it has no score).

    place counts from 1 by falling stationary share (rounded to 12 digits), ties by smaller item. Null and NaN are no
    score and exceed nothing. Null items are left out; null group values form a group of their own; of repeated
    (group, item) rows the highest of each score counts. An empty df gives no rows; other columns are ignored."""
    k = len(scores)
    keys = [F.col(f"`{g}`") for g in groups]
    clean = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double") + F.lit(0.0)) for c in scores]
    rows = df.where(F.col(f"`{item}`").isNotNull()).select(F.struct(*keys).alias("grp"), F.col(f"`{item}`").cast("string").alias("item"), *(c.alias(f"s{i}") for i, c in enumerate(clean)))
    rows = rows.groupBy("grp", "item").agg(*(F.max(f"s{i}").alias(f"s{i}") for i in range(k)))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("size"))
    huge = [r.grp for r in sizes.where(F.col("size") > group_rows).collect()]  # fewer than all rows / group_rows
    schema = T.StructType([rows.schema["grp"], T.StructField("item", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("stationary", T.DoubleType()), *(T.StructField(f"above{i}", T.LongType()) for i in range(k)), T.StructField("place", T.IntegerType())])

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("item", kind="stable")
        p, above = walk(f[[f"s{i}" for i in range(k)]].to_numpy(np.float64, na_value=np.nan), damping, steps=steps)
        p = np.round(p, 12)
        place = np.empty(len(f), np.int32)
        place[np.argsort(-p, kind="stable")] = np.arange(1, len(f) + 1)  # items are in order
        return pd.DataFrame({"grp": [key[0]] * len(f), "item": f["item"], "size": np.int32(len(f)), "stationary": p, **{f"above{i}": above[:, i] for i in range(k)}, "place": place})

    if huge:
        is_huge = F.lit(False)
        for g in huge:
            same = F.lit(True)
            for name, value in zip(groups, g):
                same = same & F.col(f"grp.`{name}`").eqNullSafe(F.lit(value))
            is_huge = is_huge | same
        spread = _spread_walk(rows.where(is_huge), k, damping, steps).withColumn("stationary", F.round("stationary", 12))
        walked = rows.where(~is_huge).groupBy("grp").applyInPandas(one, schema).unionByName(_spread_places(spread))
    else:
        walked = rows.groupBy("grp").applyInPandas(one, schema)
    return walked.select(*(F.col(f"grp.`{g}`").alias(g) for g in groups), F.col("item").alias(item), "place", "size", "stationary", *(F.col(f"above{i}").alias(f"above_{c}") for i, c in enumerate(scores)))


def leaders(ranked: DataFrame, groups: Sequence[str], item: str, scores: Sequence[str], least: int = 10, exceeded: int = 3, of: int = 3) -> DataFrame:
    """Items that at least ``of`` scores see exceeded by fewer than ``exceeded`` others, in groups of ``least`` or more.

    These counts are those by which the walk jumps; the ranking of the same result puts the leaders into the first places of
    their group (see the tests)."""
    close = sum(((F.col(f"above_{c}") >= 0) & (F.col(f"above_{c}") < exceeded)).cast("int") for c in scores)
    return ranked.where((F.col("size") >= least) & (close >= of)).select(*groups, item)
