import pytest

from tidewatch.functions.text import technology_reason
from tidewatch.operators import entities
from pyspark.sql import functions as F


def live(spark, titles, min_docs=2, extra=()):
    rows = [(f"d{i}", t, s) for i, (t, s) in enumerate((x, "rss") if isinstance(x, str) or x is None else x for x in titles)]
    found, links = entities.extract_live(spark.createDataFrame(rows, "doc_id string, title string, source string"), "x", min_docs, extra)
    ids = {r.cand_id: r for r in found.collect()}
    docs = {}
    for r in links.collect():
        docs.setdefault(ids[r.cand_id].key, set()).add(r.doc_id)
    assert all(len(docs[r.key]) == r.n_docs for r in ids.values())
    return {r.key: (r.kind, r.label, sorted(r.aliases), sorted(docs[r.key])) for r in ids.values()}


def test_technologies_of_the_catalogue_and_open_terms(spark):
    got = live(spark, ["RAG beats rag rugs", "Retrieval-augmented generation works", "New quantum sensors", "A Quantum-sensor array", "deep learning", "Deep Learning again", "LLMs and an LLM", None])
    assert got["retrieval augmented generation"] == ("technology", "retrieval augmented generation", ["RAG", "Retrieval-augmented generation"], ["d0", "d1"])
    assert got["quantum sensor"][3] == ["d2", "d3"] and got["deep learning"][3] == ["d4", "d5"] and "large language model" not in got


def test_a_name_seen_once_before_a_verb_is_found_in_other_titles(spark):
    got = live(spark, ["Kadovik unveils quantum chips", "Robotics at kadovik grows", "Sensors of Kadovik-based labs", "Kadovik.io sells sensors", "Kadovik opens a cafe"])
    assert got["kadovik"] == ("entity", "Kadovik", ["kadovik"], ["d0", "d1"])  # not inside longer names, nor in titles without technology


def test_possessives_products_and_what_is_no_company(spark):
    got = live(spark, ["Brumetas’s robotics lab", "Robotics by Brumetas", "Zolvi launches Norvik X1 sensors", "Norvik X1 sensors sell", "Germany launches quantum plan", "Germany and quantum", "Senator Holt unveils robotics bill", "Senator Holt on robotics", "The Company raises robotics funds", "Company for robotics"])
    assert set(got) == {"brumetas", "norvik x1"} and got["norvik x1"][3] == ["d2", "d3"]


def test_descriptions_persons_and_publishers_fall_away(spark):
    got = live(spark, ["French Robotics Startup Zolvi raises money for sensors", "Zolvi and sensors", ("Quantum networks grow - Zolvi News", "gnews"), "Elon Musk launches robots with sensors", "Elon Musk sensors"])
    assert got["zolvi"] == ("entity", "Zolvi", [], ["d0", "d1"]) and not any("musk" in k for k in got)


def test_ambiguous_names_need_a_verb_and_owned_products_their_owner(spark):
    got = live(spark, ["Humanoid raises robotics money", "Humanoid robot learning", "Humanoid’s robotics lab", "NVIDIA Isaac robotics", "NVIDIA’s Isaac sensors", "Isaac unveils robotics"])
    assert got["humanoid"][3] == ["d0", "d2"] and got["nvidia isaac"][3] == ["d3", "d4"] and "isaac" not in got


def test_asked_terms_count_word_by_word(spark):
    got = live(spark, ["swarm controls", "Swarm control for all", "swarm-control", "ai agents", "Agentic AI"], extra=["swarm control", "ai agent"])
    assert got["swarm control"][3] == ["d0", "d1"] and got["AI agent"][3] == ["d3", "d4"]


def test_nothing_and_too_few(spark):
    assert live(spark, []) == {}
    with pytest.raises(ValueError):
        entities.extract_live(spark.createDataFrame([], "doc_id string, title string, source string"), "x", 1)


def test_reasons_of_russian_labels(spark):
    rows = [("квантовые вычисления", None), ("Роботизированная хирургия", None), ("эпидемия гриппа", "event"), ("рак лёгких", "disease"), ("раковина", "no technology marker"), ("университет Китая", "entity"), ("редактирование генома", None), ("сверточная neural", "terminal modifier"), ("machine learning", None), ("zero trust", "no technology marker")]
    got = {r.t: r for r in spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", technology_reason(F.col("t")).alias("a"), entities.live_technology_reason(F.col("t")).alias("b")).collect()}
    assert {t: got[t].a for t, _ in rows} == dict(rows)
    assert got["zero trust"].b is None and got["раковина"].b == "no technology marker"
