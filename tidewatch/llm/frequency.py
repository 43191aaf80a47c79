"""Problem 1: how often every distinct term occurs, and in how many records.

Method: a global integer dictionary (identifier range, place in the range), terms encoded through it, blockwise count
arrays for occurrences and record presence, and those arrays summed by identifier range.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.runtime import BROADCAST_ROWS, materialise

#: Identifiers of one range; a range's two arrays take 16 bytes an identifier.
RANGE = 16_384
#: Parts that the rows of one range are spread over, so that a term which holds a third of all rows meets as many tasks.
PARTS = 16
#: A text of more bytes is compared by its SHA-256; a key so takes 65 bytes at most, and the dictionary is narrow whatever the terms are.
KEY_BYTES = 64
#: Where the dictionary is too large to broadcast, spellings that hold more than this part of all rows are: HEAD of them at most.
HEAD = 50_000

ARRAYS = T.StructType([
    T.StructField("range_id", T.IntegerType()), T.StructField("slots", T.ArrayType(T.IntegerType())),
    T.StructField("occurrences", T.ArrayType(T.LongType())), T.StructField("records", T.ArrayType(T.LongType())),
])
TOTALS = T.StructType([T.StructField(n, t) for n, t in (("range_id", T.IntegerType()), ("slot", T.IntegerType()), ("occurrences", T.LongType()), ("records", T.LongType()))])


def normal_form(term: str | None) -> str | None:
    """Lower case, composed (NFC), single spaces; any Unicode white space separates. None for null and blank."""
    if term is None:
        return None
    lowered = unicodedata.normalize("NFC", unicodedata.normalize("NFC", term).lower())
    return " ".join(lowered.split()) or None


@F.pandas_udf(T.StringType())
def normal_form_udf(terms: pd.Series) -> pd.Series:
    return terms.map(normal_form)


def text_key(text: str) -> Column:
    """The text itself, or # and 64 hex digits of its SHA-256: more bytes than any text that stands for itself."""
    return F.when(F.octet_length(text) <= KEY_BYTES, F.col(text)).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))


def dictionary(spellings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spelling, rows) -> codes (key, range_id, slot, leads) and names (key, term, rows), keys being those of spellings: every
    distinct normal form gets one integer identifier, range_id * RANGE + slot at least as dense as the ranges are filled, and
    one of its spellings leads. Only names holds whole texts; its term is null for a blank spelling, which has no code."""
    names = materialise(spellings.select(text_key("spelling").alias("key"), normal_form_udf("spelling").alias("term"), "rows"), "spellings")
    ranges = max(1, -(-names.count() * 2 // RANGE))
    keyed = names.where("term is not null").select("key", text_key("term").alias("term_key"))
    order = Window.partitionBy("range_id").orderBy("term_key")
    ids = (
        keyed.groupBy("term_key").agg(F.min("key").alias("lead"))
        .withColumn("range_id", F.pmod(F.xxhash64("term_key"), F.lit(ranges)).cast("int"))
        .withColumn("slot", F.row_number().over(order) - 1)
    )
    codes = keyed.join(ids, "term_key").select("key", "range_id", "slot", (F.col("key") == F.col("lead")).alias("leads"))
    return materialise(codes, "dictionary"), names


def encode(rows: DataFrame, codes: DataFrame, names: DataFrame) -> DataFrame:
    """(record, key, n) -> (record, n, range_id, slot), without the rows of blank terms.

    A dictionary of at most BROADCAST_ROWS keys is broadcast. Of a larger one only the keys that hold more than one in HEAD of
    all rows are, blank ones too; the rows of the others meet the rest of it by key, at most one in HEAD of all rows in one place."""
    codes = codes.select("key", "range_id", "slot")
    if codes.count() <= BROADCAST_ROWS:
        encoded = rows.join(F.broadcast(codes), "key")
    else:
        cut = names.select(F.sum("rows")).first()[0] // HEAD  # one number
        head = names.where(F.col("rows") > cut).select("key")
        often = codes.join(F.broadcast(head), "key", "left_semi")
        seldom = rows.join(F.broadcast(head), "key", "left_anti").join(codes.join(F.broadcast(head), "key", "left_anti"), "key")
        encoded = rows.join(F.broadcast(often), "key").unionByName(seldom)
    return encoded.select("record", "n", "range_id", "slot")


def block_arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count arrays of one block, whose rows come ordered by range_id: one range's arrays are open at a time.

    Each row is one (record, identifier), so presence is a plain count. The arrays are used again for the next
    range, cleared where they were filled, so the cost of a row doesn't grow with the number of ranges."""
    now, top, acc = None, 0, np.zeros((2, RANGE), np.int64)
    ranges, slots, occurrences, records = [], [], [], []

    def close() -> None:
        nonlocal top
        if now is not None:
            at = np.flatnonzero(acc[0, :top])
            ranges.append(now)
            slots.append(at.astype(np.int32))
            occurrences.append(acc[0][at])
            records.append(acc[1][at])
            acc[:, at] = 0
        top = 0

    for f in frames:
        rid, slot, n, rec = (f[c].to_numpy() for c in ("range_id", "slot", "n", "present"))
        cuts = [0, *(np.flatnonzero(np.diff(rid)) + 1).tolist(), len(rid)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if rid[a] != now:
                close()
                now = int(rid[a])
            part = slot[a:b]
            top = max(top, int(part.max()) + 1)
            if top > acc.shape[1]:
                acc = np.pad(acc, ((0, 0), (0, max(RANGE, top - acc.shape[1]))))
            np.add.at(acc[0], part, n[a:b])
            np.add.at(acc[1], part, rec[a:b])
        if ranges:
            yield pd.DataFrame({"range_id": ranges, "slots": slots, "occurrences": occurrences, "records": records})
            ranges, slots, occurrences, records = [], [], [], []
    close()
    if ranges:
        yield pd.DataFrame({"range_id": ranges, "slots": slots, "occurrences": occurrences, "records": records})


def sum_arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come ordered by range_id; one range's arrays are open at a time."""
    now, acc = None, np.zeros((2, RANGE), np.int64)

    def out() -> pd.DataFrame:
        at = np.flatnonzero(acc[0])
        return pd.DataFrame({"range_id": np.full(len(at), now, np.int32), "slot": at.astype(np.int32), "occurrences": acc[0][at], "records": acc[1][at]})

    for f in frames:
        for r, slots, occ, rec in zip(f["range_id"], f["slots"], f["occurrences"], f["records"]):
            if r != now:
                if now is not None:
                    yield out()
                now, acc = r, np.zeros((2, RANGE), np.int64)
            if len(slots) and slots.max() >= acc.shape[1]:
                acc = np.pad(acc, ((0, 0), (0, int(slots.max()) + 1 - acc.shape[1])))
            acc[0][slots] += occ
            acc[1][slots] += rec
    if now is not None:
        yield out()


def term_frequencies(df: DataFrame, record: str = "doc_id", term: str = "term", n: str | None = "n", min_records: int = 3, max_share: float = 0.2) -> DataFrame:
    """One row for each distinct term: term, term_id, occurrences, records, share, mark.

    A row is an occurrence if n > 0 and the term is neither null nor blank (n=None: every row counts once); repeated
    rows add up. records counts distinct non-null records, share divides it by all distinct records of df, also those
    without an occurrence. mark is 'rare' below min_records, 'common' above max_share, else null; a term that would be
    both is 'rare'. Other columns of df are ignored; an empty df gives no rows."""
    amount: Column = F.lit(1).cast("long") if n is None else F.col(f"`{n}`").cast("long")
    rows = df.select(F.col(f"`{record}`").cast("string").alias("record"), F.col(f"`{term}`").alias("spelling"), amount.alias("n"))
    total = rows.select(F.count_distinct("record")).first()[0]  # one number
    occurring = rows.where("n > 0 and spelling is not null")
    codes, names = dictionary(occurring.groupBy("spelling").agg(F.count("*").alias("rows")))
    encoded = encode(occurring.select("record", text_key("spelling").alias("key"), "n"), codes, names)
    # a block is a range and a part of the records: rows of one (record, identifier) meet there, and those of a range lie together
    part = F.pmod(F.xxhash64("record"), F.lit(PARTS)).cast("int")
    spread = encoded.withColumn("part", part).repartition("range_id", "part")
    pairs = spread.groupBy("range_id", "part", "record", "slot").agg(F.sum("n").alias("n")).select("range_id", "slot", "n", F.col("record").isNotNull().cast("long").alias("present"))
    blocks = pairs.sortWithinPartitions("range_id").mapInPandas(block_arrays, ARRAYS)
    totals = blocks.repartition("range_id").sortWithinPartitions("range_id").mapInPandas(sum_arrays, TOTALS)
    leads = codes.where("leads").select("key", "range_id", "slot")
    share = F.col("records") / F.lit(max(total, 1))
    return (
        totals.join(leads, ["range_id", "slot"]).join(names, "key")
        .select("term", (F.col("range_id").cast("long") * F.lit(1 << 32) + F.col("slot")).alias("term_id"), "occurrences", "records", share.alias("share"))
        .withColumn("mark", F.when(F.col("records") < min_records, "rare").when(F.col("share") > max_share, "common"))
    )
