import json
import time

import pytest

from tidewatch.plans import cards, serve
from tidewatch.sources import poll, publish


class Fake:
    name = "fake"

    def __init__(self, answers):
        self.answers, self.prompts = list(answers), []

    def write(self, prompt):
        self.prompts.append(prompt)
        return self.answers.pop(0)


def test_cards(spark):
    trends = spark.createDataFrame([("t1", "swarm control", ["d2", "d1"]), ("t2", "crop monitoring", ["d1"])], "trend_id string, label string, top_doc_ids array<string>")
    works = spark.createDataFrame([("d1", "One", "a" * 900, 2024), ("d2", "Two", None, 2023)], "doc_id string, title string, abstract string, year int")
    good = {"title_ru": "", "problem": "p", "problem_docs": ["d2", "dx"], "advantage": "a", "advantage_docs": ["dx"], "case_type": "gossip", "case_name": "n", "case_text": "c", "case_docs": ["d1"]}
    writer = Fake(["Sure: " + json.dumps(good) + " bye", "no json", "still none"])
    got = cards.build(trends.orderBy("trend_id"), works, writer, {"swarm control": "Schwarm"}).collect()
    assert len(got) == 1 and got[0].title_ru == "Schwarm" and got[0].case_type == "research"
    assert (got[0].problem, got[0].problem_docs, got[0].advantage, got[0].advantage_docs) == ("p", ["d2"], "", [])
    assert got[0].citation_coverage == pytest.approx(2 / 3)
    assert writer.prompts[0].index("[1] Two") < writer.prompts[0].index("[2] One") and "a" * 401 not in writer.prompts[0]
    assert "Only one document" in writer.prompts[1]


def test_poll_keeps_what_came(spark):
    def broken():
        raise OSError("down")

    def partial():
        raise poll.Partial([("p", 1)], "page 2")

    rows, status = poll.poll(spark, {"ok": lambda: [("a", 1), ("b", 2)], "bad": broken, "half": partial, "slow": lambda: time.sleep(3) or [("late", 1)]}, 0.5, "name string, n int")
    assert sorted(r.name for r in rows.collect()) == ["a", "b", "p"]
    assert {r.source: (r.status, r.n_docs) for r in status.collect()} == {"ok": ("complete", 2), "bad": ("error", None), "half": ("partial", 1), "slow": ("timeout", None)}


def test_manifest(spark, tmp_path):
    df = spark.range(10)
    publish.write_manifest(df, str(tmp_path), domain="x")
    publish.check_manifest(df.repartition(3), str(tmp_path), domain="x")
    with pytest.raises(ValueError):
        publish.check_manifest(spark.range(9), str(tmp_path), domain="x")
    with pytest.raises(ValueError):
        publish.check_manifest(df, str(tmp_path), domain="y")


def test_datasets_and_status(spark, tmp_path):
    for n in ("a/one", "b/one", "b/two", "b/Bad Name"):
        (tmp_path / n).mkdir(parents=True)
    got = publish.datasets(spark, [f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/none"])
    assert [n for n, _ in got] == ["one", "two"] and got[0][1].endswith("/a/one")
    assert publish.status(spark, f"{tmp_path}/loads").count() == 0


def test_replace_dataset(spark, tmp_path):
    path = f"{tmp_path}/t"
    publish.replace_dataset(spark, spark.range(3), "x", path)
    publish.replace_dataset(spark, spark.range(5), "y", path)
    publish.replace_dataset(spark, spark.range(1), "x", path)
    assert {r.dataset: r["count"] for r in spark.read.parquet(path).groupBy("dataset").count().collect()} == {"x": 1, "y": 5}


def test_serving(spark):
    t = spark.createDataFrame([("t1", "ai", 2024, 1), ("t2", "ai", 2024, 2), ("t3", "ai", 2023, 1)], "trend_id string, domain string, as_of int, rank int")
    assert [r.trend_id for r in serve.trends(t, "ai", 2024, 1).collect()] == ["t1"]
    with pytest.raises(LookupError, match="2023, 2024"):
        serve.trends(t, "ai", 2020)
    with pytest.raises(LookupError, match="unknown domain"):
        serve.trends(t, "bio", 2024)
    with pytest.raises(ValueError):
        serve.trends(t, "ai", 2024, 51)
    assert serve.parse_json("x {\"a\": 1} y") == {"a": 1} and serve.parse_json("none") is None
