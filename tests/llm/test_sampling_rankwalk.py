import numpy as np
import pytest

from tidewatch.llm import rankwalk, sampling


def rows_of(spark, ids, year=2020):
    return spark.createDataFrame([(i, year, "x") for i in ids], "doc_id string, year int, sample_u string")


def test_sample_keeps_members_and_whole_ids(spark, tmp_path):
    s = sampling.PermanentSample(spark, f"{tmp_path}/r")
    first = [f"d{i}" for i in range(400)]
    a = {r.doc_id for r in s.sample(rows_of(spark, first), "doc_id", "year", 0.2).collect()}
    assert 40 < len(a) < 120
    more = rows_of(spark, [*first, *(f"e{i}" for i in range(400)), None], 2021).unionByName(rows_of(spark, first[:50]))
    b = s.sample(more.repartition(9), "doc_id", "year", 0.1).collect()  # a lower wish doesn't lower the threshold
    assert a <= {r.doc_id for r in b} and None not in {r.doc_id for r in b}
    assert sum(r.doc_id in a and r.doc_id in first[:50] for r in b) == 2 * len(a & set(first[:50]))
    assert s.numbers().count() == 800
    other = sampling.PermanentSample(spark, f"{tmp_path}/other")
    assert {r.doc_id for r in other.sample(rows_of(spark, first), "doc_id", "year", 0.2).collect()} == a


def test_two_writers_double_no_row(spark, tmp_path):
    s = sampling.PermanentSample(spark, f"{tmp_path}/r")
    rows = rows_of(spark, [(f"d{i}", 2020) for i in range(200)])
    once = {r.doc_id for r in s.sample(rows, "doc_id", "year", 0.3).collect()}
    s.numbers().write.mode("append").parquet(f"{tmp_path}/again")  # what another writer saw before the first had finished
    spark.read.parquet(f"{tmp_path}/again").write.mode("append").parquet(f"{tmp_path}/r/numbers")
    again = [r.doc_id for r in s.sample(rows, "doc_id", "year", 0.3).collect()]
    assert sorted(again) == sorted(once) and s.numbers().count() == 200


def test_thresholds_by_year_never_fall(spark, tmp_path):
    s = sampling.PermanentSample(spark, f"{tmp_path}/r")
    assert s.raise_thresholds(0.1, {2020: 0.5}) == {None: 0.1, 2020: 0.5}
    assert s.raise_thresholds(0.2, {2020: 0.3, 2021: 0.25}) == {None: 0.2, 2020: 0.5, 2021: 0.25}
    assert s.raise_thresholds(0.0)[2021] == 0.25
    assert s.sample(rows_of(spark, []), "doc_id", "year", 0.5).count() == 0


def dense_chain(scores, damping=rankwalk.DAMPING):
    """The chain as a full matrix."""
    n, k = scores.shape
    m = np.zeros((n, n))
    for i in range(n):
        for s in range(k):
            col = scores[:, s]
            have = ~np.isnan(col)
            if not have.any():
                to = [i]
            elif np.isnan(col[i]):
                to = list(np.flatnonzero(have))
            else:
                to = [j for j in range(n) if have[j] and col[j] > col[i]] or [i]
            m[i, to] += 1 / len(to) / k
    m = (1 - damping) / n + damping * m
    p = np.full(n, 1 / n)
    for _ in range(500):
        p = p @ m
    return p


def test_walk_equals_dense_chain():
    r = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        x = r.integers(0, 6, (n, 4)).astype(float)
        x[r.random((n, 4)) < 0.2] = np.nan
        p, above = rankwalk.walk(x)
        assert p == pytest.approx(dense_chain(x), abs=1e-7)
        for s in range(4):
            for i in range(n):
                assert above[i, s] == (-1 if np.isnan(x[i, s]) else int((x[:, s] > x[i, s]).sum()))


def test_no_score_rules_by_range(spark):
    rows = [("g", f"i{i}", float(i) * 1e9, float(10 - i)) for i in range(10)] + [("g", "top", 9.5e9, 9.5)]
    df = spark.createDataFrame(rows, "g string, item string, a double, b double")
    scaled = df.withColumn("a", df.a / 1e12 - 5)
    a, b = (sorted((r.place, r.item) for r in rankwalk.rank_walk(x, ["g"], "item", ["a", "b"]).collect()) for x in (df, scaled))
    assert a == b and {a[0][1], a[1][1]} == {"i0", "top"}  # best by one score, and second by it


def test_rank_walk_edges(spark):
    nan = float("nan")
    df = spark.createDataFrame([("g", 1, "a", 1.0, nan), ("g", 1, "a", 0.5, None), ("g", 1, "b", 1.0, 2.0), (None, 1, "c", nan, None), ("g", 1, None, 5.0, 5.0)], "g string, y int, item string, s double, t double").selectExpr("*", "1 as stationary", "2 as place", "3 as size")
    got = {(r.g, r.item): r for r in rankwalk.rank_walk(df, ["g", "y"], "item", ["s", "t"]).collect()}
    assert set(got) == {("g", "a"), ("g", "b"), (None, "c")}
    assert got["g", "a"].above_s == 0 and got["g", "a"].above_t == -1 and got[None, "c"].above_s == -1
    assert rankwalk.rank_walk(df.limit(0), ["g", "y"], "item", ["s", "t"]).count() == 0


def test_spread_walk_equals_local(spark):
    r = np.random.default_rng(6)
    rows = [(g, f"i{i}", float(r.integers(0, 9)), None if r.random() < 0.2 else float(r.random()), 7.0 if i % 3 else None, None if g == "g" else 1.0 * i) for g in ("g", "h") for i in range(60)]
    df = spark.createDataFrame(rows, "g string, item string, s double, t double, u double, v double")
    a, b = ({(x.g, x.item): x for x in rankwalk.rank_walk(df, ["g"], "item", ["s", "t", "u", "v"], group_rows=n, steps=6).collect()} for n in (10**6, 5))
    for i in a:
        assert a[i].stationary == pytest.approx(b[i].stationary, abs=1e-9) and a[i].place == b[i].place and (a[i].above_s, a[i].above_t, a[i].above_u, a[i].above_v) == (b[i].above_s, b[i].above_t, b[i].above_u, b[i].above_v)


def test_steps_of_a_spread_walk_are_removed_and_it_stops_when_still(spark):
    from pathlib import Path

    from tidewatch.runtime import work_dir

    df = spark.createDataFrame([("g", f"i{i}", float(i), float(i)) for i in range(12)], "g string, item string, s double, t double")
    folder = Path(work_dir(spark).removeprefix("file:")) / "tidewatch"
    before = {p.name for p in folder.glob("rankwalk-*")} if folder.exists() else set()
    got = rankwalk.rank_walk(df, ["g"], "item", ["s", "t"], group_rows=5)
    local = rankwalk.rank_walk(df, ["g"], "item", ["s", "t"])
    assert {(r.item, r.place) for r in got.collect()} == {(r.item, r.place) for r in local.collect()}
    left = {p.name for p in folder.glob("rankwalk-*")} - before
    assert len([n for n in left if "step" in n]) == 1 and not [n for n in left if n.startswith("rankwalk-values") and len(left) > 4]


def test_ranking_equals_dense_chain_at_several_sizes(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for n in (3, 11, 30, 90):
        x = r.integers(0, n, (n, 4)).astype(float)
        x[r.random((n, 4)) < 0.1] = np.nan
        for i, p in enumerate(dense_chain(x)):
            want[f"g{n}", f"i{i:02d}"] = p
        rows += [(f"g{n}", f"i{i:02d}", *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, item string, a double, b double, c double, d double")
    got = rankwalk.rank_walk(df, ["g"], "item", ["a", "b", "c", "d"]).collect()
    for x in got:
        assert x.stationary == pytest.approx(want[x.g, x.item], abs=1e-7)
    for n in (3, 11, 30, 90):
        ours = [x.item for x in sorted((x for x in got if x.g == f"g{n}"), key=lambda x: x.place)]
        assert ours[0] == max((i for g, i in want if g == f"g{n}"), key=lambda i: want[f"g{n}", i])


def test_leaders_stand_in_the_first_places(spark):
    """The found items of sf0.1 lead their group's ranking by the walk."""
    from tests.conftest import DATA
    from tidewatch.llm import queries_a

    folder = f"{DATA}/sf0.1"
    ranked = rankwalk.rank_walk(queries_a.pools(spark, folder, *queries_a.SCORES), ["domain", "as_of"], "cand_id", queries_a.SCORES).cache()
    found = rankwalk.leaders(ranked, ["domain", "as_of"], "cand_id", queries_a.SCORES)
    places = found.join(ranked, ["domain", "as_of", "cand_id"]).join(ranked.groupBy("domain", "as_of").count(), ["domain", "as_of"]).collect()
    assert len(places) > 100 and all(p.place <= max(8, 0.15 * p["count"]) for p in places)
