"""Queries of problem 10, held against marked sentences and brute force in the tests."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import names, pii, pii_training
from tidewatch.runtime import read

#: Fields fitted with different seeds, a task each; the mean of their weights is used.
FITS = 3
_known: dict[tuple[str, ...], pii.SegmentField] = {}


def fitted(spark: SparkSession, words: tuple[str, ...]) -> pii.SegmentField:
    """The field, fitted on the fixed number of made sentences; once a process for one list of given names."""
    if words not in _known:

        def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for seed in f["id"].tolist():
                    field = pii.SegmentField(pii.Lexicon(words)).train(pii_training.examples(words), seed=7 + seed)
                    yield pd.DataFrame({"seed": [seed], "field": [pickle.dumps(field)]})

        rows = spark.range(0, FITS, 1, FITS).mapInPandas(fit, "seed long, field binary").collect()  # FITS rows of some MB
        if len(_known) > 4:
            _known.clear()
        _known[words] = pii.SegmentField.mean([pickle.loads(r.field) for r in sorted(rows)])
    return _known[words]


def field_of(spark: SparkSession, d: str) -> pii.SegmentField:
    """The field with the given names, full and short, of the table nicknames, which is a short list: longer ones are an error."""
    rows = read(spark, d, "nicknames").select("nick", "given").limit(names.NICKNAMES + 1).collect()
    if len(rows) > names.NICKNAMES:
        raise ValueError(f"the table of nicknames has more than {names.NICKNAMES} rows")
    return fitted(spark, tuple(sorted({x for r in rows for x in r if x})))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal(read(spark, d, "documents"), field_of(spark, d)).select("doc_id", "kind", "start_at", "end_at").distinct()


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.mask_personal(read(spark, d, "documents").select("doc_id", "text"), field_of(spark, d))


QUERIES = {"p10_found": p10_found, "p10_masked": p10_masked}
