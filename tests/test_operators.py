"""Exact expectations on small inputs."""

import pytest
from pyspark.sql import functions as F

from tidewatch import contracts
from tidewatch.functions import text
from tidewatch.operators import candidates, features, quality, sampling, score, select, series, shape
from tidewatch.sources import publish, records


def counts_of(spark, series_):
    return spark.createDataFrame([(c, y, n) for c, s in series_.items() for y, n in s.items()], "cand_id string, year int, n long")


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*df.columns).collect()]


def test_year_series_and_spread(spark):
    works = spark.createDataFrame([("d1", 2020, "article", ["RU", "US"], 5), ("d2", 2021, "article", ["US"], None), ("d3", 2021, "article", ["CN"], 1)], "doc_id string, year int, doc_type string, countries array<string>, cited_by int")
    docs = spark.createDataFrame([("c1", "d1"), ("c1", "d2"), ("c1", "d2"), ("c2", "d3"), ("c2", "dx")], "cand_id string, doc_id string")
    j = series.linked(docs, works, "year", "doc_type", "countries", "cited_by")
    assert one(series.year_counts(j), "cand_id", "year", "n") == [("c1", 2020, 1), ("c1", 2021, 1), ("c2", 2021, 1)]
    assert one(series.country_spread(j, 2020, 2021), "cand_id", "n_countries") == [("c1", 2), ("c2", 1)]
    assert [r.doc_id for r in series.top_docs(j).where("cand_id = 'c1'").orderBy("place").collect()] == ["d2", "d1"]


def test_weights_round_half_even(spark):
    j = spark.createDataFrame([("p", 2024, "preprint")] * 2 + [("a", 2024, "article")] * 2 + [("h", 2024, "patent"), ("h", 2024, "model")], "cand_id string, year int, doc_type string")
    assert one(series.year_counts(j), "cand_id", "n") == [("a", 2), ("h", 2), ("p", 3)]  # 2.5 goes to 2, 2.8 to 3


G5 = {2003: 40, 2004: 55, 2005: 60, 2006: 30, 2019: 20, 2020: 90, 2021: 300}


def test_segments_and_current_life(spark):
    c = counts_of(spark, {"x": G5})
    assert one(shape.segments(c, 2021), "first_year", "last_year") == [(2003, 2006), (2019, 2021)]
    row = shape.components(c, 2021).first()
    assert (row.first_mention, row.takeoff, row.age, row.homonym) == (2019, 2020, 1, True)
    assert shape.components(c.where("year <= 2005"), 2005).first().takeoff == 2003


def test_takeoff_and_last_year_share(spark):
    c = counts_of(spark, {"x": {2005: 1, 2006: 2, 2019: 40, 2020: 120, 2021: 300}, "y": {2021: 1314}})
    rows = {r.cand_id: r for r in shape.components(c, 2021).collect()}
    assert (rows["x"].takeoff, rows["x"].age) == (2019, 2)
    assert rows["y"].last_year_share == 1.0


def test_breakout(spark):
    ssm = {2013: 330, 2014: 354, 2015: 360, 2016: 370, 2017: 380, 2018: 390, 2024: 534, 2025: 1166, 2026: 1349}
    steady = {y: 1000 + (y - 2014) * 120 for y in range(2010, 2027)}
    got = {r.cand_id: r.breakout for r in shape.breakout(counts_of(spark, {"ssm": ssm, "steady": steady, "young": {2022: 8, 2026: 1100}}), 2026).collect()}
    assert got == {"ssm": 2025, "steady": None, "young": None}


def test_no_look_ahead(spark):
    c = counts_of(spark, {"x": G5, "y": {2003: 10, 2021: 5}})
    past = shape.components(c.where("year <= 2006"), 2006).orderBy("cand_id").collect()
    assert past == shape.components(c.where("year <= 2006").unionByName(c.where("year > 2030")), 2006).orderBy("cand_id").collect()


@pytest.mark.parametrize("values,expected", [([1, 2, 3, 1000], [0, 1 / 3, 2 / 3, 1]), ([5, 5], [0.5, 0.5]), ([1, 7, 7, 9], [0, 0.5, 0.5, 1]), ([3], [0])])
def test_percentile_rank(spark, values, expected):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").withColumn("r", score.pct_rank("v"))
    assert [r.r for r in df.orderBy("i").collect()] == pytest.approx(expected)


def test_spread_rank_equals_window(spark):
    import random

    r = random.Random(9)
    df = spark.createDataFrame([(i, r.choice([r.random(), 0.25, -1.0, 3.0])) for i in range(500)], "i int, v double")
    a = {x.i: x.r for x in score.spread_rank(df, F.col("v"), "r", 16).collect()}
    b = {x.i: x.r for x in df.withColumn("r", score.pct_rank("v")).collect()}
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-12) for i in a)
    assert score.spread_rank(df.limit(0), F.col("v"), "r").count() == 0


def test_score_is_the_same_spread(spark, monkeypatch):
    rows = spark.createDataFrame([(f"c{i}", i % 9, i * 0.1, (i * 7 % 11) * 0.2, 1.0 + i % 5, i % 13, float(i % 17)) for i in range(60)], "cand_id string, age int, growth double, accel double, burst double, n_countries int, maturity double")
    a = {r.cand_id: r.es for r in score.score(rows).collect()}
    monkeypatch.setattr(score, "ONE_TASK_ROWS", 10)
    assert a == {r.cand_id: r.es for r in score.score(rows, n_rows=60).collect()}


def test_fragments(spark):
    bad = ["algorithms for fault tolerance of", "management a machine learning", "reduction and deep learning", "learning", "the model"]
    good = ["mixture of experts", "retrieval augmented generation", "vision transformer", "graph neural network", "federated learning"]
    df = spark.createDataFrame([(x,) for x in bad + good], "label string")
    assert [r[0] for r in df.select(score.is_fragment(F.col("label"))).collect()] == [True] * 5 + [False] * 5


def test_lemma(spark):
    words = ["networks", "studies", "analysis", "bus", "boxes", "class"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(text.lemma(F.col("w"))).collect()] == ["network", "study", "analysis", "bus", "box", "class"]


def test_ngrams(spark):
    df = spark.createDataFrame([("The neural networks of the mind",), (None,), ("",), ("a",)], "t string")
    assert [sorted(r[0]) for r in df.select(text.ngrams(F.col("t"))).collect()] == [["networks of the mind", "neural networks"], [], [], []]


def test_dedup_keeps_better_and_comparable(spark):
    rows = spark.createDataFrame([("a", "vision transformers", 0.9, 100), ("b", "vision transformer", 0.8, 90), ("c", "graph neural network", 0.7, 5696), ("d", "physics-informed graph neural networks", 0.75, 69), ("e", "quantum sensing", 0.5, None)], "cand_id string, label string, es double, n_docs long")
    got = {r.cand_id: r.merged_into for r in select.dedup_lexical(rows).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": None, "e": None}


def test_mmr(spark):
    rows = spark.createDataFrame([("a", 0.9, [1.0, 0.0]), ("b", 0.85, [0.99, 0.14]), ("c", 0.5, [0.0, 1.0])], "cand_id string, es double, vector array<double>")
    assert [r.cand_id for r in select.mmr(rows, 2).orderBy("place").collect()] == ["a", "c"]
    assert select.mmr(rows.limit(0), 2).count() == 0


def test_dedup_live_greedy(spark):
    rows = spark.createDataFrame([("1", 0, "u1", "t1"), ("2", 1, "u1", "t2"), ("3", 2, "u3", "t2"), ("4", 3, None, "t9"), ("5", 4, "u4", "t1")], "doc_id string, rank int, url_key string, title_key string")
    assert sorted(r.doc_id for r in select.dedup_live(rows).collect()) == ["1", "3", "4"]  # 2 went, so its title doesn't count


def test_dedup_live_beyond_a_pool(spark):
    n = select.POOL_ROWS + 1000
    rows = spark.range(n).select(F.format_string("%07d", "id").alias("doc_id"), F.lit(1).alias("rank"), F.concat(F.lit("u"), F.floor(F.col("id") / 2)).alias("url_key"), F.concat(F.lit("t"), F.col("id") % 50).alias("title_key"))
    assert sorted(int(r.doc_id) for r in select.dedup_live(rows).collect()) == [*range(0, 50, 2), *range(51, 100, 2)]


@pytest.mark.parametrize("shape", ["random", "chain", "alike", "none"])
def test_dedup_live_rounds_equal_a_walk(spark, monkeypatch, shape):
    import random
    from functools import partial

    monkeypatch.setattr(select, "POOL_ROWS", 12)
    monkeypatch.setattr(select, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(select, "lookup_join", partial(select.lookup_join, limit=5))
    rng = random.Random(7)
    some = lambda k: rng.choice([None, "", *(f"k{i}" for i in range(k))])
    rows = {
        "random": [(f"d{i % 70}", rng.randrange(3), some(30), some(20)) for i in range(90)],
        "chain": [(f"d{i:03}", 1, f"u{i // 2}", f"t{(i + 1) // 2}") for i in range(60)],  # each row meets the one before and the one after
        "alike": [("d1", 1, "u1", None)] * 20 + [("d2", 1, None, None)] * 3,
        "none": [],
    }[shape]
    place = lambda r: (r[1], r[0], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    seen, want = (set(), set()), []
    for r in sorted(rows, key=place):
        if r[2] not in seen[0] and r[3] not in seen[1]:
            want.append(r)
            seen[0].update({r[2]} - {None})
            seen[1].update({r[3]} - {None})
    got = select.dedup_live(spark.createDataFrame(rows, "doc_id string, rank int, url_key string, title_key string")).collect()
    assert sorted(map(tuple, got), key=place) == want


def test_ctf_idf(spark):
    import math

    docs = spark.createDataFrame([(0, "laser laser optics"), (1, "quantum optics optics")], "label int, text string")
    got = {(r.label, r.term): r.score for r in candidates.ctf_idf(docs, "label", "text", ["the"]).collect()}
    assert got[0, "laser"] == pytest.approx(2 / 3 * math.log(2.5)) and got[1, "quantum"] == pytest.approx(1 / 3 * math.log(4))


def test_extract_terms_order_invariant(spark):
    rows = [("1", "Neural networks for vision"), ("2", "Robust neural networks"), ("3", "Bread baking at home")]
    a, b = (sorted(map(tuple, candidates.extract_terms(spark.createDataFrame(x, "doc_id string, title string"), "d", 2)[0].collect())) for x in (rows, rows[::-1]))
    assert a == b and [x[1] for x in a] == ["neural networks"]


def test_news_features_honest_nulls(spark):
    schema = "cand_id string, doc_id string, source string, source_type string, date string, url string, trust_level string, title string, lang string"
    rows = [
        ("ok", "1", "feed", "news", "2024-09-10", "https://a.example/1", "trusted", "X raises money", "en"), ("ok", "2", "feed", "news", "2026-08-10", "https://a.example/2", "trusted", "X", "en"), ("agg", "3", "gnews", "aggregator", "2026-08-10", "https://n.example/2", "trusted", "X", "en"),
        ("undated", "4", "feed", "news", None, "https://a.example/4", "trusted", "X", "en"), ("unknown", "5", "feed", "news", "2026-08-10", "https://b.example/5", "unknown", "X", None),
    ]
    got = {r.cand_id: r for r in features.news_features(spark.createDataFrame(rows, schema), "2026-08").collect()}
    assert (got["ok"].news_mentions_24m, got["ok"].news_mentions_by_month, got["ok"].n_domains, got["ok"].trusted_share, got["ok"].funding_mentions) == (2, [1] + [0] * 22 + [1], 1, 1.0, 1)
    assert got["agg"].n_domains is None and got["agg"].news_mentions_24m == 1
    assert got["undated"].news_mentions_24m is None and got["undated"].langs is None
    assert got["unknown"].trusted_share is None and got["unknown"].n_domains == 1


def test_quality(spark):
    c = counts_of(spark, {"a": {2021: 50, 2026: 148}, "b": {2021: 0, 2025: 50}, "c": {2021: 5, 2024: 2}})
    got = {r.cand_id: r.bt_growth_x for r in quality.backtest(c, 2021, 2026).collect()}
    assert got == {"a": 2.92, "b": 51.0, "c": 0.5}
    assert all(r.bt_growth_x is None for r in quality.backtest(c, 2026, 2026).collect())
    cards = spark.createDataFrame([("t", [("p", ["d1"]), ("q", ["dx"]), ("r", ["d2", "dx"])], ["d1", "d2"])], "trend_id string, claims array<struct<text: string, docs: array<string>>>, allowed array<string>")
    row = quality.citations(cards).first()
    assert [x.text for x in row.claims] == ["p", "", "r"] and row.coverage == pytest.approx(0.6667)


def test_sample_quota(spark):
    rows = [(f"d{y}{i}", y) for y, n in ((2020, 2), (2022, 5), (2023, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, year int")
    picked = {r.doc_id for r in sampling.equal_year_sample(df, 2022, 2023, 6).collect()}
    assert len(picked) == 6 and picked == {r.doc_id for r in sampling.equal_year_sample(df.repartition(7), 2022, 2023, 6).collect()}
    assert sampling.year_quotas(2022, 2026, 7) == {2022: 2, 2023: 2, 2024: 1, 2025: 1, 2026: 1}


def test_contract_problems(spark):
    df = spark.createDataFrame([("a", "d", 1.0, 1), (None, "d", None, 2)], "cand_id string, doc_id string, weight double, extra int")
    assert {r.problem for r in contracts.problems(df, "cand_docs").collect()} == {"extra: extra", "type: weight", "null: cand_id"}
    assert contracts.problems(contracts.project(df.limit(1).drop("extra"), "cand_docs"), "cand_docs").count() == 0
    assert "weight REAL" in contracts.ddl("cand_docs") and "INTEGER[]" in contracts.ddl("trends")


def test_publish_refuses_bad_and_existing(spark, tmp_path):
    good = spark.createDataFrame([("a", "d", 1.0)], "cand_id string, doc_id string, weight float")
    publish.publish(good, "cand_docs", f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    with pytest.raises(FileExistsError):
        publish.publish(good, "cand_docs", f"{tmp_path}/t")
    with pytest.raises(ValueError):
        publish.publish(good.unionByName(good), "cand_docs", f"{tmp_path}/u")
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    assert publish.fingerprint(df).first() == publish.fingerprint(df.repartition(9).orderBy(F.desc("x"))).first()


def test_trust_longest_rule(spark):
    df = spark.createDataFrame([("https://news.google.com/x",), ("https://blog.github.com/x",), ("https://user@evil.example/x",), ("https://notgithub.com/",), (None,)], "url string")
    got = [(r.rule, r.trust_level) for r in records.with_trust(df.withColumn("i", F.monotonically_increasing_id()), "url", records.rules_table(spark)).orderBy("i").collect()]
    assert got == [("news.google.com", "indicator"), ("github.com", "trusted"), (None, "unknown"), (None, "unknown"), (None, "unknown")]


def test_feed_and_sheet(spark, tmp_path):
    import zipfile

    body = "<rss><channel><item><title>A</title><link>https://a.example/1</link><pubDate>Thu, 16 Apr 2026 01:27:37 GMT</pubDate></item><item><title>B</title><link>https://a.example/2</link></item></channel></rss>"
    got = records.feed_entries(spark.createDataFrame([("s", body)], "source string, body string")).collect()
    assert [(r.title, r.link) for r in got] == [("A", "https://a.example/1")]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="B1"><v>0</v></c></row><row r="2"><c r="B2"><v>7</v></c><c r="C2" t="s"><v>0</v></c></row></sheetData></worksheet>')
    assert records.read_sheet(str(tmp_path / "a.xlsx"), {"B": "number", "C": "query"}) == [{"number": "7", "query": "hello"}]


def test_paged_source_resumes(spark, tmp_path):
    from tidewatch.sources import paged

    for y, n, lines in ((2024, 1, ['{"id": 1}', "broken"]), (2024, 2, ['{"id": 2}']), (2025, 1, ['{"id": 3}'])):
        (tmp_path / "in" / str(y)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / str(y) / f"{n}.jsonl").write_text("\n".join(lines))
    paged.register(spark)
    assert spark.read.format("paged_records").load(f"{tmp_path}/in").count() == 3


def test_empty_tables(spark):
    c = spark.createDataFrame([], "cand_id string, year int, n long")
    assert shape.components(c, 2024).count() == 0 and shape.breakout(c, 2024).count() == 0 and quality.backtest(c, 2024, 2026).count() == 0
    assert select.dedup_lexical(spark.createDataFrame([], "cand_id string, label string, es double, n_docs long")).count() == 0


def test_pipelines_take_each_domain_alone(spark):
    """A domain gives the same trends beside a larger one, though that holds a candidate of the same words."""
    from tidewatch.plans import pipeline

    names = {"big": ["quantum sensing", "neural imaging", "swarm robotics"], "small": ["quantum sensing", "edge learning"]}
    works, links, cands = [], [], []
    for k, (domain, label) in enumerate((d, x) for d, xs in names.items() for x in xs):
        cands.append((f"t:{domain}:{k}", label, domain))
        for i in range(48 + 8 * k):
            doc, year = f"{k}-{i:03}", 2020 + (i % (5 - k % 3))
            works.append((doc, year, f"2024-{1 + i % 12:02}-01", "article", "openalex", f"{label} {i}", f"https://p{i % 5}.example/{doc}", ["RU", "US", "CN", "DE", "FR", "IT"], i, "trusted", "2026-01-01", "a", ["b"], ["c"], domain))
            links.append((f"t:{domain}:{k}", doc))
    schema = "doc_id string, year int, date string, doc_type string, source string, title string, url string, countries array<string>, cited_by int, trust_level string, harvested_at string, abstract string, institutions array<string>, authors array<string>, domain string"
    works, links, cands = spark.createDataFrame(works, schema), spark.createDataFrame(links, "cand_id string, doc_id string"), spark.createDataFrame(cands, "cand_id string, label string, domain string")

    def runs(c):
        a = pipeline.index_trends(works, links.join(c.select("cand_id"), "cand_id"), c, 2024, 2026, top=2)[0].collect()
        b = pipeline.live_trends(works, links.join(c.select("cand_id"), "cand_id"), c, "2024-12", top=2)[0].collect()
        return {(r.domain, r.rank, r.cand_id, r.emergence_score) for r in a}, {(r.cand_id.split(":")[1], r.rank, r.cand_id, r.emergence_score) for r in b}

    together, small = runs(cands), runs(cands.where("domain = 'small'"))
    for t, y in zip(together, small):
        assert y and {x for x in t if x[0] == "small"} == y and {x[0] for x in t} == {"big", "small"}
