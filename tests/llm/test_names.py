import itertools

import pytest

from tests.conftest import DATA
from tidewatch.llm import names

NICKS = [("Bob", "Robert"), ("Lena", "Helena"), ("Lena", "Yelena"), ("Kolya", "Nikolai"), ("Winnie", "Winifred"), ("Tom", "Thomas"), ("Katya", "Ekaterina"), ("Liz", "Elizabeth"), ("Jenny", "Jennifer")]


@pytest.fixture(scope="module")
def lexicon():
    return names.GivenNames(NICKS)


@pytest.mark.parametrize("name,expected", [
    ("Dr. Robert  Kadovik, PhD", ("kadovik", ["robert"], [], "")), ("Kadovik, Bob T.", ("kadovik", ["robert"], [], "t")), ("KADOVIK RT", None), ("Kadovik RT", ("kadovik", [], ["r"], "t")), ("R.T. Kadovik", ("kadovik", [], ["r"], "t")), ("Kadovik Robert", ("kadovik", ["robert"], [], "")),
    ("Rob. Kadovik", ("kadovik", [], ["rob"], "")), ("Roebrt Kadovik", ("kadovik", ["robert"], [], "")), ("Lena Kadovik", ("kadovik", ["helena", "yelena"], [], "")), ("Кадовик Николай", ("kadovik", ["nikolai"], [], "")), ("Елена Тебурекс", ("tebureks", ["yelena"], [], "")), ("Winifred Drösavox", ("drosavoks", ["winifred"], [], "")),
])
def test_parse(lexicon, name, expected):
    got = names.parse_person(name, lexicon)
    assert expected is None or got == expected


@pytest.mark.parametrize("name,expected", [
    ("Kekeralf Acad. Sci.", ("kekeralf", "academy science")), ("Acad. of Sci., Kekeralf", ("kekeralf", "academy science")), ("University of Tiskikir, Department of Physics", ("tiskikir", "university")), ("Dept. of Statistics, University of Tiskikir", ("tiskikir", "university")), ("Université de Tiskikir", ("tiskikir", "university")),
    ("Nat'l Lab for Robotics (Selmuhex)", ("selmuheks", "laboratory national robotics")), ("Nelijev Institute of Technolgy", ("nelijev", "institute technology")), ("Pomedor SYSTEMS INC.", ("pomedor", "systems")),
])
def test_parse_institution(name, expected):
    assert names.parse_institution(name) == expected


def test_lcs_equals_brute_force():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for a, b in itertools.product(["", "a", "kadovik", "kdaovik", "kaddovk", "zzz", "ovik"], repeat=2):
        assert names.lcs(a, b) == slow(a, b)
    assert names.one_slip("ivan", "iavn") and names.one_slip("susan", "ssan") and not names.one_slip("ivan", "anna")


PEOPLE = [
    ["Robert T. Kadovik", "Bob Kadovik", "Kadovik, R.", "R.T. Kadovik", "Robert Kdaovik", "robert kadovik"], ["Elizabeth Kadovik", "Liz Kadovik", "E. Kadovik"], ["Nikolai Brumetas", "Kolya Brumetas", "Николай Бруметас", "Brumetas Nikolai"],
    ["Helena Zolvinek"], ["Yelena Zolvinek"], ["Jennifer Brumetas", "Jenny Brumetsa"],
]
PLACES = [["University of Tiskikir", "Tiskikir, University of", "Univ. of Tiskikri", "Universität Tiskikir"], ["Tiskikir Medical Center", "Tiskikir Med. Ctr."], ["Dovanel Medical Centre"]]


@pytest.mark.parametrize("block", [300, 1])
def test_links(spark, monkeypatch, block):
    """block=1 sends every block through the exact refinement."""
    monkeypatch.setattr(names, "BLOCK_HEADS", block)
    rows = []
    for group in PEOPLE:
        for i, n in enumerate(group):
            rows += [([n, None, "", "  "], None, "extra")] * (1 if i else 8)
    for group in PLACES:
        for i, n in enumerate(group):
            rows += [(None, [n], "extra")] * (1 if i else 8)
    rows.append((["Lena Zolvinek"], [], "extra"))  # fits two
    df = spark.createDataFrame(rows, "authors array<string>, institutions array<string>, entity string").repartition(5)
    nick = spark.createDataFrame(NICKS, "nick string, given string")
    linked = names.link_names(df, {"authors": "author", "institutions": "institution"}, nick)
    got = {(r.kind, r.name_a, r.name_b) for r in names.spelling_pairs(linked).collect()}
    expected = {("author", *sorted(p)) for g in PEOPLE for p in itertools.combinations(g, 2)} | {("institution", *sorted(p)) for g in PLACES for p in itertools.combinations(g, 2)}
    assert got == expected
    assert names.link_names(df.limit(0), {"authors": "author"}, nick).count() == 0


def test_block_size_changes_no_link(spark):
    """A block of 300 heads and one of 301 (and of 700) link a head that differs by two slips, ratio 0.8."""
    letters = "bcdfghjklmnpqrst"
    filler = [f"{a}{b}{c}" for a, b, c in itertools.product(letters, repeat=3)]
    for n in (300, 301, 700):
        heads = [("zamotelink", 8), ("zimotulink", 1)] + [(f"{w}olink", 1) for w in filler[: n - 2]]
        rows = [("author", f"R. {h}", k, h, ["robert"], [], "", ["r"]) for h, k in heads]
        got = [(r.head, r.target) for r in names.head_targets(spark.createDataFrame(rows, names.PARSED)).collect()]
        assert ("zimotulink", "zamotelink") in got, n


def test_blocks_lose_no_link_against_all_pairs(spark):
    """Every head of sf0.1 follows the same head as if all heads of a refinement were compared."""
    from pyspark.sql import functions as F

    works = spark.read.parquet(f"{DATA}/sf0.1/works.parquet")
    rows = works.select(F.lit("author").alias("kind"), F.explode("authors").alias("name")).unionByName(works.select(F.lit("institution").alias("kind"), F.explode("institutions").alias("name")))
    counted = rows.where("trim(name) <> ''").groupBy("kind", "name").agg(F.count("*").alias("n"))
    people = names.parsed(counted, names.GivenNames.load(spark.read.parquet(f"{DATA}/sf0.1/nicknames.parquet"))).where("head <> ''").cache()
    got = {(r.kind, r.r, r.head): r.target for r in names.head_targets(people).collect()}
    often, heads = {}, {}
    for r in people.select("kind", "head", "n", F.explode("refine").alias("r")).collect():
        often[r.kind, r.head] = often.get((r.kind, r.head), 0) + r.n
        heads.setdefault((r.kind, r.r), set()).add(r["head"])
    want = {}
    for (kind, r), some in heads.items():
        for head, target, ratio, m in names._follow([(h, often[kind, h], 0) for h in some]):
            want[kind, r, head] = max(want.get((kind, r, head), (0.0, 0, "")), (ratio, m, target))
    assert len(want) > 50 and sum(got.get(k) == v[2] for k, v in want.items()) >= 0.99 * len(want)


def test_chains_of_any_length_end_at_one_head(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "f")]
    targets = spark.createDataFrame([("author", "r", h, t) for h, t in links], "kind string, r string, head string, target string")
    assert {(r["head"], r.target) for r in names._ends_of(targets).collect()} == {(h, "f") for h, _ in links}
