"""Problem 9: texts into containers of a fixed capacity with little room unused.

Method: sum-of-squares online packing. Each text goes to the fill level that minimises the sum of the squared counts of
partially filled containers, which an array by level holds. Shards of texts are packed independently, by hash of their id;
what a shard leaves open is a few containers of its thousands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.runtime import parallelism

CAPACITY = 2048
#: Texts of one shard, about.
SHARD_DOCS = 10_000


class SumOfSquares:
    """open_[h]: the containers filled to level h, 0 < h < capacity; count[h] is their number."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.open_: list[list[int]] = [[] for _ in range(capacity)]

    def place(self, size: int) -> tuple[int, int]:
        """(container, level at which the text begins). Of equal sums the fullest level is taken."""
        c, n = self.capacity, self.count
        if size >= c:
            self.made += 1
            return self.made - 1, 0
        # moving one container from h to h + size changes the sum by 2 (n[h + size] - n[h] + 1), or by 1 - 2 n[h] if it is then full;
        # a new container changes it by 2 n[size] + 1
        levels = np.flatnonzero(n[1 : c - size + 1]) + 1
        best, at = 2 * int(n[size]) + 1, 0
        if len(levels):
            ends = levels + size
            change = np.where(ends == c, 1 - 2 * n[levels], 2 * (n[np.minimum(ends, c)] - n[levels] + 1))
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                best, at = int(change[k]), int(levels[k])
        if at:
            box = self.open_[at].pop()
            n[at] -= 1
        else:
            box = self.made
            self.made += 1
        end = at + size
        if end < c:
            self.open_[end].append(box)
            n[end] += 1
        return box, at


def _pack(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, packer = None, SumOfSquares(capacity)
        for f in frames:
            out = []
            for s, key, n in zip(f["shard"].tolist(), f["key"].tolist(), f["n_tokens"].tolist()):
                if s != shard:
                    shard, packer = s, SumOfSquares(capacity)
                part, start = 0, 0
                while True:
                    take = min(capacity, n - start)
                    if n == 0:
                        out.append((key, 0, None, 0, 0, 0))
                        break
                    box, at = packer.place(take)
                    out.append((key, part, (s << 40) + box, at, start, take))
                    part, start = part + 1, start + take
                    if start >= n:
                        break
            yield pd.DataFrame(out, columns=["key", "part", "container", "begins_at", "from_token", "n_tokens"]).astype({"container": "Int64"})

    return run


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (containers, tokens, share): how many containers are used, what they hold, and which share of their room that is."""
    used = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), (F.sum("n") / (F.count("*") * capacity)).alias("share"))


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(key, part, container, begins_at, from_token, n_tokens): where each text, or each part of one that is longer than a
    container, lies. Parts of a longer text fill containers of their own but for the last, which is packed as a text.

    A text of no tokens, null or negative size needs no room: one row with container null. Repeated keys are packed one by
    one; the result depends on nothing but the keys and sizes; an empty table gives no rows; other columns are ignored."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = sizes.select(F.col(f"`{key}`").alias("key"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    shards = max(1, -(-rows.count() // shard_docs))
    h = F.coalesce(F.xxhash64("key"), F.lit(0))
    rows = rows.withColumn("h", h).withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("long"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("part", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("container", "begins_at", "from_token", "n_tokens"))])
    ordered = rows.repartition(max(1, min(shards, 4 * parallelism(sizes.sparkSession))), "shard").sortWithinPartitions("shard", "h", "key", "n_tokens")
    return ordered.select("shard", "key", "n_tokens").mapInPandas(_pack(capacity), schema).withColumnRenamed("key", key)
