import itertools
import re
import time

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA
from tidewatch.llm import pii, pii_training, queries_d

GIVEN = tuple("Anna Boris Christopher Ekaterina Elizabeth Francesca Gabriela Johannes Konstantin Lawrence Maria Nikolai Oscar Pavel Robert Susan Tatiana Thomas Victoria Yuri Zachary".split())


@pytest.fixture(scope="module")
def model(spark):
    return queries_d.fitted(spark, GIVEN)


def counted(model, examples):
    hit = miss = wrong = 0
    for (_, gold), found in zip(examples, model.find_all([t for t, _ in examples])):
        found, gold = set(found), set(gold)
        hit, miss, wrong = hit + len(found & gold), miss + len(gold - found), wrong + len(found - gold)
    return hit / (hit + miss), hit / (hit + wrong)


def test_sentences_of_another_seed(model):
    recall, precision = counted(model, pii_training.examples(GIVEN, 1500, seed=99))
    assert recall > 0.94 and precision > 0.94  # same templates: no measure of other texts


# sentences worded unlike the templates, people mostly outside every list; what is in [[kind ]] is to be found. About a third
# of them were looked at while the templates were written; what those of HELD showed changed nothing
OTHER = [
    "Yesterday [[name Siobhan Fitzgerald]] joined us for lunch.", "I spoke to [[name Priya Raman]] about the outage.", "It is a thoughtful paper by [[name Lars Holmgren]], I think.", "Our plumber, [[name Gareth Pugh]], charges too much.", "Ballots were counted by [[name Maeve Brannigan]] and [[name Robert Ellery]].",
    "Judge [[name Thomas Aldous]] adjourned the trial.", "[[name Susan Tremlett]]’s bakery won again.", "Nominees: [[name Victoria Stroud]], [[name Oscar Lindgren]]", "Dr. [[name Pavel Hrubý]] prescribed rest.", "thesis advisor [[name M. Okonkwo]] left", "Signed, [[name J. R. Hartley]]", "Goal by [[name Elizabeth Cray]]!",
    "My passport number is [[identity X1234567]], keep it safe.", "Use SSN [[identity 078-05-1120]] on the return.", "the CPF [[identity 123.456.789-09]] was invalid", "Her DNI is [[identity 12345678Z]].", "Ihr Personalausweis [[identity L01X00T47]] liegt bereit.", "PESEL [[identity 44051401359]] podano w umowie.", "Укажите СНИЛС [[identity 112-233-445 95]] в анкете.", "他的身份证号码是[[identity 11010519491231002X]]。",
    "We moved to [[address 45 Elm Way, Springfield]].", "Send it to [[address 7 Sunset Parkway, Reno, NV 89501]] please", "Wir wohnen in der [[address Rosenheimer Straße 12, 81669 München]].", "Le cabinet se trouve [[address 14 rue des Lilas, 31000 Toulouse]].", "Studio legale, [[address via Garibaldi 8, 20121 Milano]]", "Nos vemos en la [[address Calle Mayor 21, 28013 Madrid]].", "Приезжайте: [[address г. Казань, ул. Баумана, д. 7, кв. 12]].", "Paczkę wysłano na [[address ul. Szewska 5/3, 31-009 Kraków]].", "公司在[[address 中山路88号302室]]办公。",
    "Just call [[phone (212) 736-5000]] after six.", "My number: [[phone +44 20 7946 0958]]", "Zu erreichen unter [[phone +49 89 123456]].", "Appelez le [[phone 06 12 34 56 78]] ce soir.", "Перезвоните: [[phone +7 (495) 123-45-67]].", "手机[[phone 138 1234 5678]]。", "Numer [[phone 601 234 567]] nie odpowiada.",
    "You may write to [[email jane.doe@mail.example.org]] anytime.", "mine is [[email jane.doe at example dot com]]", "Email me: [[email bob_smith[at]mail[dot]co[dot]uk]]!", "resume to [[email HR@BIGCORP.EXAMPLE]] asap", "пишите на [[email ivan.k@pochta.example]], отвечу",
    "The New York Times reported on Tuesday.", "University of Cambridge and Harvard Medical School", "Deep Learning for Graph Neural Networks: A Survey", "ISBN 978-3-16-148410-0 is sold out.", "IP 192.168.0.1 port 8080, version 2.14.7", "order 4155550313 shipped", "Dear Sir or Madam", "Anna laughed and Boris left.", "The Riemann hypothesis and Gödel's theorem remain famous.", "The Golden Gate Bridge carries 110,000 cars.",
    "Er kauft Brot, Milch und Käse.", "人工智能模型的方法和数据。", "Реки Сибири текут на север.", "GTX 4090 and RTX 3080 cards", "Grant DE-AC02-05CH11231 paid for it.", "See https://site.example/@user/123456789 for more.", "uptime 1728394756 ms", "pip install torch==2.1.0",
]


HELD = [
    "The ferry captain, [[name Dimitra Kostas]], refused to sail.", "Could [[name Nadia Petrosyan]] or [[name Owen Gallagher]] open the store tomorrow?", "[[name Ravi Shankaran]] came third in the marathon.", "Applause for [[name Hannelore Voigt]], our oldest member!", "the estate of [[name G. W. Thornbury]]", "Coach [[name Matías Quiroga]] resigned on Sunday.", "Story and drawings: [[name Saoirse Kinsella]]", "[[name Pavel Dolezal]] sold the barn to [[name Thomas Greaves]].",
    "Тренер [[name Виталий Сорокин]] доволен игрой.", "Билеты купили [[name Гордеев П. С.]] и [[name Лыкова Н. А.]]", "Die Geigerin [[name Mechthild Osterkamp]] spielte Bach.", "Le maire, [[name Thibault Garnier]], a promis un pont.", "La panadera [[name Asunción Robles]] abre a las seis.", "Il fornaio [[name Ettore Bellandi]] chiude presto.", "Piekarz [[name Zdzisław Krupa]] wstaje o trzeciej.", "O padeiro [[name Anselmo Queirós]] acorda cedo.", "经理[[name 徐志远]]批准了预算。",
    "Mail the cheque to [[address 1200 Pinecrest Drive, Boise, ID 83702]].", "She rents [[address Flat 3, 9 Abbey Crescent, York]] with two friends.", "Treffpunkt ist die [[address Lindenallee 44, 10115 Berlin]].", "Nous sommes au [[address 3 place Carnot, 69002 Lyon]].", "La farmacia di [[address corso Italia 15, 50123 Firenze]] è aperta.", "Склад находится по адресу [[address ул. Садовая, 18, оф. 5]].", "Biuro: [[address al. Jerozolimskie 99/12, 02-001 Warszawa]]", "快递送到[[address 海宁区文化路120号5栋301室]]了。",
    "If lost, ring [[phone 0117 496 0123]] please.", "Office line [[phone +1-303-555-0147]], ext. none", "Chiama [[phone 347 1234567]] dopo cena.", "Llama al [[phone 612 34 56 78]] mañana.", "Звонить [[phone 8 (812) 555-35-35]].", "Durchwahl [[phone (0711) 34 56 78]]",
    "Replies go to [[email t.marsh+jobs@hollow-oak.co.uk]], no calls.", "reach us: [[email help (at) sunflower (dot) org]]", "Scrivi a [[email lucia.ferri@posta.example]] subito.", "her contact is [[email k.ivanova at bigmail dot net]]",
    "Kennitala aside, her passport no. [[identity PA4471902]] was copied.", "Numéro de sécurité sociale : [[identity 2 84 05 75 116 042]].", "Il codice fiscale [[identity RSSMRA80A01H501U]] non è valido.", "ИНН [[identity 772012345678]] указан в договоре.", "Quote NI number [[identity QQ123456C]] on the form.",
    "The Brandenburg Gate was lit up in blue.", "Chapter 12: The Long Road Home", "Ticket 88231-7 was refunded.", "Ada said that Grace was late again.", "Version 3.12.4 fixes bug 10233.", "Mount Rainier National Park reopens in June.", "Der Rhein und die Elbe führen Hochwasser.", "La Tour Eiffel attire les foules.", "The Hubble constant is disputed.", "invoice 20230914-77 is overdue", "GET /api/v2/users/48213 HTTP/1.1", "Общий объём составил 12 450 000 рублей.", "The Stern-Gerlach experiment came first.", "Follow @northern_lights42 for pictures.", "2023-11-05 14:22:10 WARN disk 91% full", "本届大会在上海召开，参会人数超过三千。",
]


def marked(text):
    out, spans, at = "", [], 0
    for m in re.finditer(r"\[\[(\w+) (.*?)\]\](?![A-Za-z0-9\[])", text):
        out += text[at : m.start()]
        spans.append((len(out), len(out) + len(m[2]), m[1]))
        out += m[2]
        at = m.end()
    return out + text[at:], spans


def test_other_texts(model):
    examples = [marked(t) for t in OTHER]
    recall, precision = counted(model, examples)
    print("recall", recall, "precision", precision)
    assert recall >= 0.9 and precision >= 0.9


def test_texts_never_looked_at(model):
    """Measured after the field was finished: recall 0.81, precision 1.00, here; what is missed are people of no list without a
    title, a verb of speech or the like beside them."""
    recall, precision = counted(model, [marked(t) for t in HELD])
    assert recall >= 0.75 and precision >= 0.9


def test_training_text_is_not_that_of_the_documents():
    """No piece of 12 letters or more between the slots of a template stands in the documents of sf0.1."""
    texts = "\n".join(x for (x,) in duckdb.sql(f"SELECT text FROM '{DATA}/sf0.1/documents.parquet' WHERE text IS NOT NULL").fetchall())
    for template in (*pii_training.POSITIVE, *pii_training.NEGATIVE, *pii_training.THINGS):
        for piece in re.split(r"\{\{|\}\}|\{\w+\}", template):
            assert len(re.findall(r"[^\W\d_]", piece)) < 12 or piece.strip() not in texts, piece


@pytest.mark.parametrize("text,expected", [
    ("Ask Robert van Kadovik at r.kadovik@mail.brul.example.", [("name", "Robert van Kadovik"), ("email", "r.kadovik@mail.brul.example")]), ("My SSN 219-41-5087 was lost; order #4155550313 wasn't.", [("identity", "219-41-5087")]), ("Thomas, the robot, and the Maria-689 lander.", []), ("Install tiny-vec@1.833.0, ping @lab12, see 192.0.2.12", []),
    ("anna [at] mail [dot] brul [dot] example", [("email", "anna [at] mail [dot] brul [dot] example")]), ("Dr. SUSAN HOLAHER’s unit", [("name", "SUSAN HOLAHER")]), ("the Anna Kadovik theorem", []),
])
def test_cases(model, text, expected):
    assert [(k, text[s:e]) for s, e, k in model.find(text)] == expected


def segmentations(n, longest):
    """All sets of non-overlapping (kind, start, length)."""
    def run(at):
        if at == n:
            yield ()
            return
        yield from run(at + 1)
        for k, kind in enumerate(pii.KINDS):
            for size in range(1, min(longest[kind], n - at) + 1):
                for rest in run(at + size):
                    yield ((k, at, size), *rest)

    return list(run(0))


def test_marginals_and_best_equal_enumeration():
    longest = {"email": 2, "phone": 2, "identity": 1, "address": 3, "name": 2}
    field = pii.SegmentField(pii.Lexicon(GIVEN), longest).train([("Ask Anna Berg now", [(4, 13, "name")]), ("at 4 Elm Way", [(3, 12, "address")]), ("no 5551234", [(3, 10, "phone")])], rounds=3, drop=0.0)
    for text in ("Ask Anna Elm", "4 Elm Way 5551234"):
        tokens, starts, ends, gap, read = pii.cut(text)
        ids, n = field._ids(tokens), len(tokens)
        score = {}
        flat, gaps = np.concatenate([[0] * 6, ids, [0] * 6]), np.concatenate([[0] * 6, gap, [0] * 6])
        a, b, cls = field._ends(flat, gaps)
        sums = np.concatenate([np.zeros((1, len(pii._COUNTERS)), int), np.cumsum(field._known()[1][flat], 0)])
        spaces = np.concatenate([[0], np.cumsum(gaps > 0)])
        for k, kind in enumerate(pii.KINDS):
            for size in range(1, longest[kind] + 1):
                for i in range(n - size + 1):
                    extra, _ = field._span_scores(k, np.array([i + 6]), np.array([size]), cls, gaps, sums, spaces, [])
                    score[k, i, size] = a[i + 6, k] + b[i + 5 + size, k] + extra[0]
        every = segmentations(n, longest)
        totals = np.array([sum(score[x] for x in s) for s in every])
        z = np.logaddexp.reduce(totals)
        truth = [(4, 0, 1)]
        likelihood, _ = field.gradient([(ids, gap, truth, read)])
        assert likelihood == pytest.approx(score[4, 0, 1] - z, abs=1e-6)
        row, place, length, kind, p = field.marginals
        for i, size, k, q in zip(place, length, kind, p):
            assert q == pytest.approx(sum(np.exp(t - z) for s, t in zip(every, totals) if (k, i, size) in s), abs=1e-6)
        best = every[int(np.argmax(totals))]
        found = field.find(text)
        assert sorted(found) == sorted((int(starts[i]), int(ends[i + size - 1]), pii.KINDS[k]) for k, i, size in best)


def test_gradient_is_the_slope_of_the_likelihood(monkeypatch):
    monkeypatch.setattr(pii, "LEAST", 1)
    field = pii.SegmentField(pii.Lexicon(GIVEN)).train([("Ask Anna Berg now", [(4, 13, "name")]), ("no 555 1234", [(3, 11, "phone")])], rounds=2, drop=0.0)
    tokens, _, _, gap, read = pii.cut("Ask Anna Berg 555 now")
    data = [(field._ids(tokens), gap, [(4, 1, 2)], read)]
    field.tables = {name: x.astype(float) for name, x in field.tables.items()}
    _, grads = field.gradient(data)
    rng = np.random.default_rng(1)
    for name, g in grads.items():
        for at in rng.choice(np.flatnonzero(np.abs(g.ravel()) > 1e-6), 3) if (np.abs(g) > 1e-6).any() else ():
            flat, h = field.tables[name].reshape(-1), 1e-5
            was = flat[at]
            flat[at] = was + h
            up = field.gradient(data)[0]
            flat[at] = was - h
            down = field.gradient(data)[0]
            flat[at] = was
            assert (up - down) / (2 * h) == pytest.approx(g.ravel()[at], rel=1e-3, abs=1e-6), name


def test_best_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        start = rng.integers(0, 12, 8)
        stop, score = start + rng.integers(1, 5, 8), rng.random(8)
        sets = [c for n in range(9) for c in itertools.combinations(range(8), n) if all(stop[a] <= start[b] or stop[b] <= start[a] for a, b in itertools.combinations(c, 2))]
        assert sum(score[i] for i in pii.SegmentField.best(start.tolist(), stop.tolist(), score.tolist())) == pytest.approx(max(sum(score[i] for i in c) for c in sets))


def test_texts_together_equal_texts_alone(model):
    texts = [t for t, _ in pii_training.examples(GIVEN, 120, seed=4)] + ["", " \n", "Robert Kadovik"]
    assert list(model.find_all(texts)) == [model.find(t) for t in texts]


def test_masked_leaves_the_rest(model):
    text = "\tAsk Robert Kadovik \U0001f600\r\nnow: r.k@mail.example.org "
    assert pii.masked(text, model.find(text)) == "\tAsk [NAME] \U0001f600\r\nnow: [EMAIL] "


def test_frames(spark, model):
    schema = "doc_id long, text string, kind string, start_at int, key string"
    rows = [(1, "\U0001f600 by Robert Kadovik", "x", 1, "k"), (1, "\U0001f600 by Robert Kadovik", "x", 1, "k"), (2, None, "x", 1, "k"), (3, "", "x", 1, "k"), (4, " \n", "x", 1, "k"), (5, "word " * 50_000 + "r.k@mail.example.org", "x", 1, "k"), (None, "r.k@mail.example.org", "x", 1, "k")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, pii.find_personal(df, model).collect()), key=repr)
    assert got == sorted([(1, "name", 5, 19), (1, "name", 5, 19), (5, "email", 250_000, 250_020), (None, "email", 0, 20)], key=repr)
    assert pii.find_personal(df.limit(0), model).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask_personal(df.where("doc_id < 4"), model).collect()}
    assert masked == {1: "\U0001f600 by [NAME]", 2: None, 3: ""}


def test_long_garbage_is_quick(model):
    began = time.time()
    for text in ("A. " * 30_000, "Robert " * 30_000, "1 " * 50_000, "+1 (" * 30_000, "a@" * 50_000, "x" * 300_000, "Aa-" * 50_000, "ул. " * 30_000):
        model.find(text)
    assert time.time() - began < 60


def test_long_author_list_is_read_whole(model):
    families = [f"{a}{b}ovik" for a in ("Kad", "Bru", "Zol", "Tem", "Mar", "Dov") for b in "abdefgiklm"]
    people = [f"{chr(65 + i % 26)}. {f}" for i, f in enumerate(families)]
    text = "; ".join(people)
    found = [text[s:e] for s, e, kind in model.find(text) if kind == "name"]
    assert found == people


def test_too_long_a_list_of_nicknames_is_an_error(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("Bob", "Robert")] * 3, "nick string, given string").write.parquet(f"{tmp_path}/nicknames.parquet")
    monkeypatch.setattr(queries_d.names, "NICKNAMES", 2)
    with pytest.raises(ValueError):
        queries_d.field_of(spark, str(tmp_path))


def test_fit_is_the_same_in_every_process():
    import os
    import subprocess
    import sys

    code = "from tidewatch.llm import pii, pii_training as t; m = pii.SegmentField(pii.Lexicon(['Anna'])).train(t.examples(['Anna'], 120), rounds=2); print(round(float(abs(m.tables['token']).sum()), 3), len(m.features))"
    out = {subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONHASHSEED": seed}, cwd=os.getcwd(), capture_output=True, text=True).stdout for seed in ("1", "2")}
    assert len(out) == 1 and out != {""}


def test_mean_of_fields_scores_the_mean():
    texts = [("Ask Anna Berg now", [(4, 13, "name")]), ("no 555 1234", [(3, 11, "phone")])] * 4
    a, b = (pii.SegmentField(pii.Lexicon(GIVEN)).train(texts, rounds=2, seed=s) for s in (1, 2))
    m = pii.SegmentField.mean([a, b])
    assert all(np.allclose(m.tables[k], (a.tables[k] + b.tables[k]) / 2, atol=1e-6) for k in m.tables if not k.startswith("bound"))
    assert m.find("Ask Anna Berg now") == [(4, 13, "name")]
    with pytest.raises(ValueError):
        pii.SegmentField.mean([a, pii.SegmentField(pii.Lexicon(GIVEN)).train(texts[:1], rounds=1)])
