import pytest

from tests.conftest import DATA
from tidewatch.llm import langid

HELD_OUT = {
    "de": "Die Werkstatt bleibt am Montag geschlossen, weil das Dach erneuert wird.", "en": "The workshop stays closed on Monday because the roof is being replaced.", "es": "El taller permanece cerrado el lunes porque se cambia el tejado.",
    "fr": "L’atelier reste fermé lundi parce que le toit est remplacé.", "it": "L’officina resta chiusa lunedì perché si rifà il tetto.", "pl": "Warsztat jest zamknięty w poniedziałek, ponieważ wymieniany jest dach.",
    "pt": "A oficina fica fechada na segunda-feira porque o telhado está a ser trocado.", "ru": "Мастерская закрыта в понедельник, потому что меняют крышу.", "uk": "Майстерня зачинена в понеділок, бо міняють дах.", "zh": "因为要更换屋顶，车间星期一关闭。",
}


@pytest.fixture(scope="module")
def works(spark):
    return spark.read.parquet(str(DATA / "sf0.01" / "works.parquet"))


@pytest.fixture(scope="module")
def model(works):
    return langid.fit_on(works, "doc_id", ["title", "abstract"], "lang")


def test_held_out_sentences(model):
    assert {k: model.classify(t)[0] for k, t in HELD_OUT.items()} == {k: k for k in HELD_OUT}


def test_forward_sums_all_segmentations(model):
    """Against enumeration of the segmentations of a short word."""
    word = "▁test"

    def total(i):
        if i == len(word):
            return 1.0
        arcs = [(j, model.row.get(word[i:j])) for j in range(i + 1, len(word) + 1)]
        known = [(j, r) for j, r in arcs if r is not None]
        if not any(j == i + 1 for j, _ in known):
            known.append((i + 1, len(model.p) - 1))
        return sum(model.p[r] * total(j) for j, r in known)

    assert model.forward(word)[-1] == pytest.approx(total(0), rel=1e-9)


def test_foreign_terms_in_brackets_dont_count(model):
    assert model.classify("Код и описание опытов будут опубликованы позднее (homomorphic tactile sensors).")[0] == "ru"


def test_passages_of_mixed_text(model):
    text = HELD_OUT["de"] + " " + HELD_OUT["fr"] + " " + HELD_OUT["de"]
    got = langid.passages(text, model, False)
    assert [g[2] for g in got] == ["de", "fr", "de"]
    assert all(text[a:b].strip() for a, b, _, _ in got)
    assert langid.passages("1234 !!! ...", model, False) == []


def test_frames(spark, model):
    schema = "doc_id string, source string, lang string, title string, abstract string, mask int, key string"
    rows = [("a", "x", "en", HELD_OUT["en"], None, 1, "k"), ("b", "x", "EN", HELD_OUT["en"], "", 1, "k"), ("c", "x", None, None, HELD_OUT["fr"], 1, "k"), ("d", "x", "de", HELD_OUT["de"], HELD_OUT["fr"], 1, "k"), ("e", "github", "en", "foo/bar-baz", None, 1, "k"), ("f", "x", "it", "", "   ", 1, "k"), ("a", "x", "en", HELD_OUT["en"], None, 1, "k"), ("g", "x", "es", (HELD_OUT["es"] + " ") * 2000, None, 1, "k")]
    df = spark.createDataFrame(rows, schema)
    masks = langid.work_masks(df, model, "doc_id", {"title": True, "abstract": False}, "lang", ("source", "title", ["github", "hf"]))
    assert sorted((r.doc_id, r.lang) for r in langid.mislabelled(masks).collect()) == [("b", "en"), ("c", "fr"), ("d", "de"), ("d", "fr")]
    assert langid.label_passages(df, model, "doc_id", {"title": True, "abstract": False}).where("doc_id = 'f'").count() == 0
    empty = langid.work_masks(df.limit(0), model, "doc_id", {"title": True}, "lang", ("source", "title", []))
    assert langid.mislabelled(empty).count() == 0
    assert langid.fit_on(df.limit(0), "doc_id", ["title"], "lang").classify(HELD_OUT["en"])[0] == "en"


def test_words_of_any_length_are_summed_whole(model, monkeypatch):
    """Rescaled sums equal plain ones on short words, and logs of sums on long ones; nothing is cut."""
    import numpy as np

    for word in ("▁werkstatt", "▁" + "данные" * 5, "▁目前还不清楚这种方法"):
        lattice = model._lattice(word)
        assert model.logs(lattice) == pytest.approx(np.log(model.forward(word, lattice)), abs=1e-9)
    word = "▁" + "thequickbrownmethodизмерение方法" * 60
    lattice, n = model._lattice(word), len(word)
    a = np.full((n + 1, len(model.languages)), -np.inf)
    a[0] = 0.0
    for i, arcs in enumerate(lattice):
        for j, r in arcs:
            a[j] = np.logaddexp(a[j], a[i] + np.log(model.p[r]))
    assert model.log_word(word) == pytest.approx(a[-1], rel=1e-9) and np.isfinite(a[-1]).all()
    whole = model.log_word("▁" + "method" * 9)
    parts = model.log_word(("▁" + "method" * 9)[:40]) + model.log_word(("▁" + "method" * 9)[40:])
    assert (whole > parts).all()  # segmentations across a cut count too
    counts = {"▁" + "method" * 5: np.ones(len(model.languages))}
    plain = model.expected(counts)
    monkeypatch.setattr(langid, "PLAIN", 3)
    assert model.expected(counts) == pytest.approx(plain, abs=1e-9)
