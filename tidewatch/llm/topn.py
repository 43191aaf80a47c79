"""Problem 2: the N highest-scoring items of every group.

Method: sorted runs (every partition ordered by group and score, cut to N items a group), stored, bucketed by group in
the shuffle, merged by a loser tree that seeks to the next group after N outputs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.runtime import materialise, parallelism

#: Rows of runs that one merging task should hold.
BUCKET_ROWS = 100_000
RUN = T.StructType([T.StructField("grp", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("item", T.StringType()), T.StructField("run", T.IntegerType())])
PLACED = T.StructType([T.StructField("grp", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("score", T.DoubleType())])


class LoserTree:
    """Tournament over k sorted runs of (group, -score, item) keys; inner nodes keep the losers, so a pop costs log2 k
    comparisons. An exhausted run has key None and loses to everything."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.keys = [r[0] if r else None for r in runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            held = self.tree[node]
            if held < 0:
                self.tree[node] = winner
                return
            if self._beats(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def top(self) -> tuple | None:
        return self.keys[self.tree[0]]

    def advance(self) -> None:
        r = self.tree[0]
        self.at[r] += 1
        self._settle(r)

    def _settle(self, r: int) -> None:
        run, i = self.runs[r], self.at[r]
        self.keys[r] = run[i] if i < len(run) else None
        self._replay(r)

    def seek_past(self, group: str) -> None:
        """Every run that stands in the group jumps behind it."""
        while (top := self.top()) is not None and top[0] == group:
            r = self.tree[0]
            self.at[r] = bisect_right(self.runs[r], group, self.at[r], key=itemgetter(0))
            self._settle(r)


def _cut_runs(n: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen = None, 0
        for f in frames:
            place = f.groupby("grp", sort=False).cumcount()
            if len(f) and f["grp"].iat[0] == last:
                place = place + seen * (f["grp"] == last)
            if len(f):
                tail = f["grp"].iat[-1]
                seen = int(place.iat[-1]) + 1
                last = tail
            yield f[place < n]

    return cut


def _merge(n: int):
    def merged(runs: dict[int, list[tuple]]) -> pd.DataFrame:
        tree, out = LoserTree([runs[k] for k in sorted(runs)]), []
        group, place = None, 0
        while (top := tree.top()) is not None:
            if top[0] != group:
                group, place = top[0], 0
            place += 1
            out.append((group, place, top[2], -top[1]))
            if place == n:
                tree.seek_past(group)
            else:
                tree.advance()
        return pd.DataFrame(out, columns=["grp", "place", "item", "score"])

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, runs = None, {}
        for f in frames:
            for bucket, run, grp, score, item in zip(f["bucket"].tolist(), f["run"].tolist(), f["grp"].tolist(), f["score"].tolist(), f["item"].tolist()):
                if bucket != now:
                    if runs:
                        yield merged(runs)
                    now, runs = bucket, {}
                runs.setdefault(run, []).append((grp, -score, item))
        if runs:
            yield merged(runs)

    return merge


def top_n(df: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """(grp, place, item, score): the n highest-scoring distinct items of every group, place from 1, ties by smaller item.

    Null and NaN scores, null items and null groups take no place; of repeated (group, item) rows the highest score
    counts; -0.0 equals 0.0; groups of fewer items give fewer rows, an empty df none. Other columns are ignored."""
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(f"`{group}`").cast("string").alias("grp"), (F.col(f"`{score}`").cast("double") + F.lit(0.0)).alias("score"), F.col(f"`{item}`").cast("string").alias("item"))
    rows = rows.where("grp is not null and item is not null and score is not null and not isnan(score)")
    best = rows.groupBy("grp", "item").agg(F.max("score").alias("score")).select("grp", "score", "item")
    # the shuffle of the aggregation spreads a hot group by item; each of its partitions is one sorted run
    runs = best.sortWithinPartitions("grp", F.desc("score"), "item").withColumn("run", F.spark_partition_id())
    runs = materialise(runs.mapInPandas(_cut_runs(n), RUN), "runs")
    buckets = max(parallelism(df.sparkSession), -(-runs.count() // BUCKET_ROWS))  # a count of file footers
    stored = runs.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket")
    return stored.sortWithinPartitions("bucket", "run", "grp", F.desc("score"), "item").mapInPandas(_merge(n), PLACED)


def latest_scoring(trends: DataFrame) -> DataFrame:
    """Of the rows of one trend_id those of the highest methodology_version, whose numbers compare as numbers.
    A version without numbers is the lowest; exact copies are kept once."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(F.col("methodology_version"), F.lit("")), F.lit(r"\d+"), 0), lambda x: x.cast("decimal(38,0)"))
    versioned = trends.withColumn("__version", numbers)
    newest = versioned.groupBy(F.col("trend_id").alias("__trend")).agg(F.max("__version").alias("__newest"))
    kept = versioned.join(newest, F.col("trend_id").eqNullSafe(F.col("__trend")) & (F.col("__version") == F.col("__newest")))
    return kept.drop("__trend", "__newest", "__version").distinct()
