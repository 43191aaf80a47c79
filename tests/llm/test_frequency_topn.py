import random
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.oracle import connect, same
from tidewatch.llm import catalog, frequency, topn


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    folder = str(DATA / "sf0.001")
    same(catalog.QUERIES[name](spark, folder), connect(folder), catalog.SQL[name])


def test_normal_form():
    assert frequency.normal_form(" A  b\tC ") == "a b c"
    assert frequency.normal_form("BATERÍAS") == frequency.normal_form("baterías")
    assert frequency.normal_form("   \n") is None and frequency.normal_form(None) is None and frequency.normal_form("") is None


def test_frequencies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(frequency, "RANGE", 8)
    r = random.Random(2)
    rows = [(r.choice(["d1", "d2", "d3", "d4", None]), r.choice(["AI", "ai", " a i", "Big  Data", "big data", None, "", "hot", "hot", "HOT", "x" * 5000]), r.choice([1, 2, 0, None, -3])) for _ in range(400)]
    df = spark.createDataFrame([(*x, "clash", 7) for x in rows], "doc_id string, term string, n int, record string, slot int").repartition(5)
    occ, docs = Counter(), defaultdict(set)
    for d, t, n in rows:
        f = frequency.normal_form(t)
        if f and n and n > 0:
            occ[f] += n
            docs[f] |= {d} - {None}
    got = {x.term: x for x in frequency.term_frequencies(df, min_records=2, max_share=0.5).collect()}
    assert {t: x.occurrences for t, x in got.items()} == dict(occ)
    assert {t: x.records for t, x in got.items()} == {t: len(docs[t]) for t in occ}
    assert len({x.term_id for x in got.values()}) == len(got)
    assert all(x.mark == ("rare" if x.records < 2 else "common" if x.records / 4 > 0.5 else None) for x in got.values())


def test_long_terms_stay_out_of_the_dictionary(spark, monkeypatch):
    """What may be broadcast is bound in bytes too: at most 100,000 rows, each narrow."""
    tables, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda table: tables.append(table) or broadcast(table))
    long = "x" * 5000
    rows = [("d1", f"{long}A", 2), ("d1", f" {long}a", 1), ("d2", f"{long}b", 5), ("d3", "é" * 32, 1), ("d3", "É" * 32, 1), ("d3", "é" * 33, 4), ("d2", " " * 100, 9), ("d2", "short", 3)]
    got = frequency.term_frequencies(spark.createDataFrame(rows, "doc_id string, term string, n int"))
    assert {(r.term, r.occurrences, r.records) for r in got.collect()} == {(f"{long}a", 3, 1), (f"{long}b", 5, 1), ("é" * 32, 2, 1), ("é" * 33, 4, 1), ("short", 3, 1)}
    (table,) = tables
    assert max(len(str(v).encode()) for r in table.collect() for v in r) <= 65


def test_large_dictionary_isn_t_copied(spark, monkeypatch):
    """Frequent keys are broadcast, blank ones too; the rest of the dictionary is joined once, without copies for salts."""
    monkeypatch.setattr(frequency, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(frequency, "HEAD", 10)
    rows = [(f"d{i % 50}", ["hot", "Hot", "  ", "warm"][i % 4], 1) for i in range(200)] + [(f"d{i}", f"t{i} {'x' * (i % 3 * 60)}", i) for i in range(40)] + [("d1", "T2", 5), (None, "t3", 1)]
    tables, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda table: tables.append(table) or broadcast(table))
    df = frequency.term_frequencies(spark.createDataFrame(rows, "doc_id string, term string, n int"))
    occ, docs = Counter(), defaultdict(set)
    for d, t, n in rows:
        if (f := frequency.normal_form(t)) and n > 0:
            occ[f] += n
            docs[f] |= {d} - {None}
    assert {r.term: (r.occurrences, r.records) for r in df.collect()} == {t: (occ[t], len(docs[t])) for t in occ}
    assert {r.key for t in tables for r in t.collect()} == {"hot", "Hot", "  ", "warm"}
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_block_arrays_don_t_slow_down_with_ranges():
    def took(ranges):
        rid = np.sort(np.random.default_rng(1).integers(0, ranges, 40_000)).astype(np.int32)
        f = pd.DataFrame({"range_id": rid, "slot": np.random.default_rng(2).integers(0, frequency.RANGE, len(rid)), "n": 2, "present": 1})
        began = time.perf_counter()
        out = pd.concat(frequency.block_arrays(iter([f.iloc[:11_111], f.iloc[11_111:]])))
        spent = time.perf_counter() - began
        assert sum(x.sum() for x in out["occurrences"]) == 80_000 and sum(x.sum() for x in out["records"]) == 40_000
        assert out["range_id"].nunique() == len(np.unique(rid)) and len(out) <= len(np.unique(rid)) + 1
        return spent

    took(14)
    assert took(10_000) < 1.5  # 10,000 arrays are handed on instead of 14


def test_frequencies_of_nothing(spark):
    assert frequency.term_frequencies(spark.createDataFrame([], "doc_id string, term string, n int")).count() == 0


def test_loser_tree_merges_and_seeks():
    r = random.Random(3)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted((r.choice("abc"), r.randrange(50), str(i)) for i in range(r.randrange(0, 30))) for _ in range(k)]
        tree, out = topn.LoserTree(runs), []
        while (t := tree.top()) is not None:
            out.append(t)
            tree.advance()
        assert out == sorted(x for run in runs for x in run)
        tree = topn.LoserTree(runs)
        tree.seek_past(next((x[0] for x in sorted(y for run in runs for y in run)), "a"))
        left = tree.top()
        assert left is None or left[0] > "a" or not any(x[0] == "a" for run in runs for x in run)


def test_top_n_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topn, "BUCKET_ROWS", 50)
    r = random.Random(4)
    nan = float("nan")
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([1.0, 0.5, -0.0, 0.0, nan, None, r.random()]), r.choice([f"i{r.randrange(60)}", "é", None])) for _ in range(900)]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "g string, s double, i string, run int, grp string").repartition(7)
    best = defaultdict(dict)
    for g, s, i in rows:
        if g and i and s is not None and s == s:
            best[g][i] = max(best[g].get(i, -9.0), s)
    expected = {(g, p, i) for g, items in best.items() for p, (i, _) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:7], 1)}
    assert {(x.grp, x.place, x.item) for x in topn.top_n(df, "g", "s", "i", 7).collect()} == expected
    assert topn.top_n(df.limit(0), "g", "s", "i", 7).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "g", "s", "i", 0)


def test_latest_scoring_compares_numbers(spark):
    df = spark.createDataFrame([("t", "1.9", 1), ("t", "1.10", 2), ("t", "1.10", 2), ("u", None, 3), ("u", "1", 4)], "trend_id string, methodology_version string, x int")
    assert sorted((r.trend_id, r.x) for r in topn.latest_scoring(df).collect()) == [("t", 2), ("u", 4)]
