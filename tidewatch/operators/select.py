"""Greedy choices over pools that have been scored and cut: they are sequential, so one task walks a pool.

The pool of a (domain, as_of) is what survives the reasons; POOL_ROWS bounds it, and a larger one is refused, not cut. Only the
duplicates of a live run, whose pool grows with the data, are settled in rounds; one task walks what is left of it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import lemma
from tidewatch.runtime import BROADCAST_ROWS, forget, lookup_join, materialise

POOL_ROWS = 200_000
#: A key that more than one in so many rows hold is told apart in a join.
HEAD = 50_000

def _check(f: pd.DataFrame) -> None:
    if len(f) > POOL_ROWS:
        raise ValueError(f"a pool of {len(f)} rows; reasons should leave at most {POOL_ROWS}")


def dedup_lexical(rows: DataFrame, groups: Sequence[str] = (), jaccard: float = 0.6, volume: float = 3.0) -> DataFrame:
    """rows (groups, cand_id, label, es, n_docs) -> the kept ones with merged_labels, and for each merged row merged_into.

    By falling es (ties by cand_id) a row merges into the first kept row of similar words (Jaccard, or one set inside the
    other) and comparable volume. Candidates for a merge come from an index of words, so rows without a common word never
    meet."""
    schema = T.StructType([*(rows.schema[g] for g in groups), *(T.StructField(c, T.StringType()) for c in ("cand_id", "label", "merged_into")), T.StructField("merged_labels", T.ArrayType(T.StringType()))])

    def walk(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        _check(f)
        f = f.sort_values(["es", "cand_id"], ascending=[False, True])
        kept: list[dict] = []
        by_word: dict[str, list[int]] = {}
        out = []
        for cand, label, lemmas, n in zip(f["cand_id"], f["label"], f["__words"], f["n_docs"]):
            words = set(lemmas)
            into = None
            for i in sorted({i for w in words for i in by_word.get(w, ())}):
                other = kept[i]
                both = len(words & other["words"])
                alike = both / len(words | other["words"]) >= jaccard or both == len(words) or both == len(other["words"])
                near = pd.isna(n) or pd.isna(other["n"]) or min(n, other["n"]) * volume >= max(n, other["n"])
                if alike and near:
                    into = other
                    break
            row = {"cand_id": cand, "label": label, "words": words, "n": n, "merged": []}
            if into is None:
                for w in words:
                    by_word.setdefault(w, []).append(len(kept))
                kept.append(row)
            else:
                into["merged"].append(label)
            out.append((row, into))
        return pd.DataFrame([(*key, r["cand_id"], r["label"], None if into is None else into["cand_id"], r["merged"] if into is None else []) for r, into in out], columns=schema.names)

    split = F.filter(F.split(F.coalesce("label", F.lit("")), r"\s+"), lambda w: w != "")
    rows = rows.withColumn("__words", F.array_distinct(F.transform(split, lemma)))
    return (rows.groupBy(*groups) if groups else rows.groupBy(F.lit(1).alias("__all"))).applyInPandas(walk if groups else (lambda key, f: walk((), f)), schema)


def mmr(rows: DataFrame, k: int = 15, weight: float = 0.7, groups: Sequence[str] = ()) -> DataFrame:
    """rows (groups, cand_id, es, vector) -> (groups, cand_id, place): each step takes the largest
    weight * es - (1 - weight) * (largest dot product with what is taken); without a vector that product is 0. Ties: cand_id."""
    schema = T.StructType([*(rows.schema[g] for g in groups), T.StructField("cand_id", T.StringType()), T.StructField("place", T.IntegerType())])

    def pick(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        _check(f)
        f = f.sort_values(["es", "cand_id"], ascending=[False, True]).reset_index(drop=True)
        size = max((len(v) for v in f["vector"] if v is not None), default=1)
        m = np.array([np.asarray(v, np.float64) if v is not None else np.zeros(size) for v in f["vector"]]).reshape(len(f), -1)
        has = np.array([v is not None for v in f["vector"]])
        near, free = np.full(len(f), -np.inf), np.ones(len(f), bool)
        out = []
        for place in range(1, min(k, len(f)) + 1):
            value = np.round(weight * f["es"].to_numpy(np.float64) - (1 - weight) * np.where(has & np.isfinite(near), near, 0.0), 12)
            i = int(np.argmax(np.where(free, value, -np.inf)))
            free[i] = False
            out.append((*key, f["cand_id"][i], place))
            if has[i]:
                near = np.maximum(near, m @ m[i])
        return pd.DataFrame(out, columns=schema.names)

    return (rows.groupBy(*groups) if groups else rows.groupBy(F.lit(1).alias("__all"))).applyInPandas(pick if groups else (lambda key, f: pick((), f)), schema)


def dedup_live(rows: DataFrame, keys: Sequence[str] = ("url_key", "title_key"), order: Sequence[str] = ("rank", "doc_id")) -> DataFrame:
    """rows without those whose URL or title was kept before, in the given order (ties by the keys); a dropped row registers neither key.

    Only rows that share a key with others are decided. In a round the rows that come first under each of their keys stay, and
    what shares a key with them goes. Once POOL_ROWS or fewer are open one task walks them in order; it also walks the first
    POOL_ROWS where a round settled fewer than that, as along a chain of rows. The result is that of a walk over all rows."""
    ids = [f"__k{i}" for i in range(len(keys))]
    # a sort's partitions are ranges of it, so these numbers rise along the order
    placed = materialise(rows.orderBy(*(F.asc_nulls_last(c) for c in order), *keys).withColumn("__at", F.monotonically_increasing_id()), "live-placed")
    shared = [_shared(placed, c).select("__at", *(F.col("__first").alias(i) if i == own else F.lit(None).cast("long").alias(i) for i in ids)) for c, own in zip(keys, ids)]
    first = opened = materialise(reduce(DataFrame.unionByName, shared).groupBy("__at").agg(*(F.max(i).alias(i) for i in ids)), "live-open")
    kept, n, slow = [], opened.count(), False
    while n:
        if n <= POOL_ROWS:
            new = _walked(opened, ids)
        elif slow:
            new = _walked(opened.orderBy("__at").limit(POOL_ROWS), ids)
        else:
            firsts = reduce(DataFrame.unionByName, (opened.where(F.col(i).isNotNull()).groupBy(i).agg(F.min("__at").alias("__at")).select("__at") for i in ids))
            held = sum((F.col(i).isNotNull().cast("int") for i in ids), F.lit(0))
            new = opened.join(firsts.groupBy("__at").agg(F.count("*").alias("__n")), "__at").where(F.col("__n") == held).select("__at", *ids)
        kept.append(materialise(new, "live-chosen"))
        if n <= POOL_ROWS:
            break
        rest = opened
        for i in ids:
            rest = lookup_join(rest, kept[-1].where(F.col(i).isNotNull()).select(i), [i], F.col("__at"), "left_anti")
        rest = materialise(rest, "live-open")
        left = rest.count()
        slow = n - left < POOL_ROWS
        if opened is not first:
            forget(opened)
        opened, n = rest, left
    gone = first.select("__at")
    if kept:
        gone = gone.join(reduce(DataFrame.unionByName, kept).select("__at"), "__at", "left_anti")
    return placed.join(gone, "__at", "left_anti").select(*rows.columns)


def _shared(placed: DataFrame, key: str) -> DataFrame:
    """(__at, __first) of the rows that share the key with others; __first, the first of these places, stands for the key.

    Keys meet as digests, so their texts' lengths don't count. Beyond BROADCAST_ROWS shared keys only those of more than one in
    HEAD of all rows are broadcast, the others are joined."""
    keyed = placed.where(F.col(key).isNotNull()).select("__at", F.unhex(F.sha2(F.col(key).cast("string"), 256)).alias("__key"))
    groups = materialise(keyed.groupBy("__key").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).where("__n > 1"), "live-keys")
    if groups.count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(groups), "__key").select("__at", "__first")
    often = F.col("__n") > placed.count() // HEAD
    head = F.broadcast(groups.where(often))
    seldom = keyed.join(F.broadcast(groups.where(often).select("__key")), "__key", "left_anti").join(groups.where(~often), "__key")
    return keyed.join(head, "__key").unionByName(seldom).select("__at", "__first")


def _walked(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Of POOL_ROWS rows at most those that a walk along __at keeps."""

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__at")
        seen: list[set] = [set() for _ in ids]
        keep = []
        for values in f[list(ids)].itertuples(index=False, name=None):
            new = not any(v in s for v, s in zip(values, seen))
            keep.append(new)
            if new:
                for v, s in zip(values, seen):
                    if v >= 0:
                        s.add(v)
        return f[keep]

    plain = rows.select("__at", *(F.coalesce(i, F.lit(-1).cast("long")).alias(i) for i in ids))  # whole numbers stay so in pandas
    return plain.groupBy(F.lit(1).alias("__all")).applyInPandas(walk, plain.schema).select("__at", *(F.nullif(F.col(i), F.lit(-1)).alias(i) for i in ids))
