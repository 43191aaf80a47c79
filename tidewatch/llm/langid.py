"""Problem 3: the language of every work and of every passage of a mixed one, with a confidence.

Method: segmentation-marginalised unigrams. For each language, probabilities of the pieces of a fixed public vocabulary;
the forward algorithm sums over all segmentations of a word, and a passage's score is the product over its words (pieces
never span white space). Probabilities come from expectation-maximisation on seed texts and a bounded sample of labelled
works, relabelled by the model between rounds, so wrong labels wash out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "piece_bpe_32k.model"
#: Labelled works a language that the model is fitted on, at most; taken by the smallest hash of their id.
SAMPLE_WORKS = 400
LANGUAGES = ("de", "en", "es", "fr", "it", "pl", "pt", "ru", "uk", "zh")
#: A passage counts as written in a language from this confidence on.
SURE = 0.8
LONGEST, CACHE = 16, 200_000
#: Words of at most so many letters stay in the range of doubles; sums of longer ones are rescaled as they go, to the same result.
PLAIN = 40
#: A sentence that comes again and again in the sample counts so many times at most.
MOST = 20

# Seed texts, written for this purpose: they anchor each language before noisy labels come in.
SEEDS = {
    "de": "Der Bericht zeigt, dass die neue Methode mit wenigen Daten gut funktioniert und nicht viel kostet. Wir haben sie an mehreren Orten geprüft. Es ist noch nicht klar, ob sich das Verfahren durchsetzen wird, weil die Geräte sehr teuer sind. Eine Übersicht über den Stand der Dinge seit einigen Jahren. Außerdem werden die Ergebnisse bald veröffentlicht.",
    "en": "The report shows that the new method works well with little data and does not cost much. We have tested it at several places. It is not yet clear whether the approach will last, because the devices are very expensive. An overview of what has been done for some years. The results of this work will also be released soon.",
    "es": "El informe muestra que el nuevo método funciona bien con pocos datos y no cuesta mucho. Lo hemos probado en varios lugares. Todavía no está claro si el enfoque va a durar, porque los aparatos son muy caros. Una visión general de lo que se ha hecho desde hace algunos años. Además, los resultados de este trabajo se publicarán pronto.",
    "fr": "Le rapport montre que la nouvelle méthode fonctionne bien avec peu de données et ne coûte pas cher. Nous l’avons essayée dans plusieurs endroits. On ne sait pas encore si cette approche va durer, car les appareils sont très chers. Un aperçu de ce qui a été fait depuis quelques années. Les résultats de ce travail seront aussi publiés bientôt.",
    "it": "Il rapporto mostra che il nuovo metodo funziona bene con pochi dati e non costa molto. Lo abbiamo provato in diversi luoghi. Non è ancora chiaro se questo approccio durerà, perché gli apparecchi sono molto cari. Una panoramica di ciò che è stato fatto negli ultimi anni. Inoltre i risultati di questo lavoro saranno pubblicati presto.",
    "pl": "Raport pokazuje, że nowa metoda działa dobrze przy niewielkiej liczbie danych i nie kosztuje dużo. Sprawdziliśmy ją w kilku miejscach. Nie wiadomo jeszcze, czy to podejście się przyjmie, ponieważ urządzenia są bardzo drogie. Przegląd tego, co zrobiono od kilku lat. Wyniki tej pracy zostaną wkrótce opublikowane.",
    "pt": "O relatório mostra que o novo método funciona bem com poucos dados e não custa muito. Nós o testamos em vários lugares. Ainda não está claro se esta abordagem vai durar, porque os aparelhos são muito caros. Uma visão geral do que foi feito há alguns anos. Além disso, os resultados deste trabalho serão publicados em breve.",
    "ru": "Отчёт показывает, что новый метод хорошо работает при малом числе данных и стоит недорого. Мы проверили его в нескольких местах. Пока неясно, приживётся ли этот подход, потому что приборы очень дорогие. Обзор того, что было сделано за последние годы. Результаты этой работы скоро будут опубликованы.",
    "uk": "Звіт показує, що новий метод добре працює за малої кількості даних і коштує недорого. Ми перевірили його в кількох місцях. Поки що невідомо, чи приживеться цей підхід, бо прилади дуже дорогі. Огляд того, що було зроблено за останні роки. Результати цієї роботи незабаром буде опубліковано.",
    "zh": "报告表明，新方法在数据很少的情况下也能很好地工作，而且成本不高。我们在几个地方做了测试。目前还不清楚这种方法能否长期使用，因为设备非常昂贵。本文回顾了近年来所做的工作，并将很快公布结果。",
}

_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’)]*\s+|(?<=[。！？])\s*|[\r\n]+")
_ASIDE = re.compile(r"\([^()]*\)|（[^（）]*）|«[^«»]*»|„[^„”]*”|“[^“”]*”|\"[^\"]*\"")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+(?:[’'ʼ-][^\W\d_]+)*")
_PASSAGE_LETTERS = re.compile(r"[^\W\d_]")


def load_pieces(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{vocabulary}")
    return [p for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and len(p := model.id_to_piece(i)) <= LONGEST]


def words_of(text: str) -> list[str]:
    """Lower-case words, each opened by the word mark of the vocabulary."""
    return ["▁" + w for w in _WORD.findall(text.lower().replace("ʼ", "’").replace("'", "’"))]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Places of the sentences that hold a letter; with the gaps between them they cover the whole text."""
    at = 0
    for m in _SENTENCE.finditer(text):
        if _PASSAGE_LETTERS.search(text, at, m.start()):
            yield at, m.start()
        at = m.end()
    if _PASSAGE_LETTERS.search(text, at):
        yield at, len(text)


def main_part(passage: str) -> str:
    """The passage without what stands in brackets and quotes, if three words remain: foreign terms stand there."""
    bare = _ASIDE.sub(" ", passage)
    return bare if len(_WORD.findall(bare)) >= 3 or re.search(r"[぀-鿿]{4}", bare) else passage


@dataclass
class PieceModel:
    """log probabilities of words under each language."""

    languages: tuple[str, ...]
    row: dict[str, int]
    p: np.ndarray  # piece x language; the last row is a character that no piece covers
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}}

    def _lattice(self, word: str) -> list[list[tuple[int, int]]]:
        """For each start the (end, row) of the pieces there; a character without any takes the last row."""
        n, out = len(word), []
        for i in range(n):
            arcs = [(j, r) for j in range(i + 1, min(n, i + LONGEST) + 1) if (r := self.row.get(word[i:j])) is not None]
            if not any(j == i + 1 for j, _ in arcs):
                arcs.append((i + 1, len(self.p) - 1))
            out.append(arcs)
        return out

    def forward(self, word: str, lattice: list | None = None) -> np.ndarray:
        a = np.zeros((len(word) + 1, len(self.languages)))
        a[0] = 1.0
        for i, arcs in enumerate(lattice or self._lattice(word)):
            for j, r in arcs:
                a[j] += a[i] * self.p[r]
        return a

    def logs(self, lattice: list[list[tuple[int, int]]]) -> np.ndarray:
        """Logs of the forward sums at each place, for words of any length: small sums are raised as they go, together with
        all places that later pieces still reach."""
        n = len(lattice)
        a, out, scale = np.zeros((n + 1, len(self.languages))), np.empty((n + 1, len(self.languages))), np.zeros(len(self.languages))
        a[0] = 1.0
        with np.errstate(divide="ignore"):
            for i, arcs in enumerate([*lattice, []]):
                small = a[i] < 1e-60
                if small.any():
                    a[i : i + LONGEST + 1, small] *= 1e60
                    scale[small] -= 60 * np.log(10.0)
                out[i] = np.log(a[i]) + scale
                for j, r in arcs:
                    a[j] += a[i] * self.p[r]
        return out

    def log_word(self, word: str) -> np.ndarray:
        got = self.seen.get(word)
        if got is None:
            got = np.log(self.forward(word)[-1]) if len(word) <= PLAIN else self.logs(self._lattice(word))[-1]
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[word] = got
        return got

    def expected(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        """Expected uses of each piece by language, over words counted by language."""
        out = np.zeros_like(self.p)
        for word, c in counts.items():
            lattice, n = self._lattice(word), len(word)
            if n > PLAIN:
                back: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                for i, arcs in enumerate(lattice):
                    for j, r in arcs:
                        back[n - j].append((n - i, r))
                a, b = self.logs(lattice), self.logs(back)[::-1]
                for i, arcs in enumerate(lattice):
                    for j, r in arcs:
                        out[r] += np.exp(a[i] + b[j] - a[n]) * self.p[r] * c
                continue
            a = self.forward(word, lattice)
            b = np.zeros_like(a)
            b[-1] = 1.0
            for i in range(n - 1, -1, -1):
                for j, r in lattice[i]:
                    b[i] += self.p[r] * b[j]
            share = c / a[-1]
            for i, arcs in enumerate(lattice):
                for j, r in arcs:
                    out[r] += a[i] * self.p[r] * b[j] * share
        return out

    def scores(self, passage: str) -> np.ndarray | None:
        """Log probability of the passage under each language, None if it has no word."""
        words = words_of(passage)
        if not words:
            return None
        get = self.seen.get
        return np.sum([v if (v := get(w)) is not None else self.log_word(w) for w in words], axis=0)

    def classify(self, passage: str) -> tuple[str, float] | None:
        """(language, confidence), the posterior under equal priors."""
        s = self.scores(main_part(passage))
        if s is None:
            return None
        k = int(s.argmax())
        return self.languages[k], float(1.0 / np.exp(np.minimum(s - s[k], 0)).sum())


def fit(labelled: Iterable[tuple[str, str]], pieces: list[str], languages: tuple[str, ...] = LANGUAGES, rounds: int = 3, steps: int = 2) -> PieceModel:
    """labelled: (text, language), labels may be wrong. The first round counts each sentence under the labels it comes with,
    in shares; each later one under the language the model of the round before gives it, so outvoted labels wash out."""
    model = PieceModel(languages, {p: i for i, p in enumerate(pieces)}, np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1)))
    votes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for t, label in labelled:
        if label in languages:
            for a, b in sentences(t):
                votes[_DIGITS.sub("0", main_part(t[a:b]))][languages.index(label)] += 1
    for turn in range(rounds):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
        for i, lang in enumerate(languages):
            for w in words_of(SEEDS[lang]):
                counts[w][i] += 1
        for s, v in votes.items():
            weight = min(v.sum(), MOST)
            share = v / v.sum()
            if turn and (got := model.classify(s)):
                share = np.eye(len(languages))[languages.index(got[0])] * (got[1] >= SURE)
            for w in words_of(s):
                counts[w] += weight * share
        for _ in range(steps):
            e = model.expected(counts)
            e /= np.maximum(e.sum(0), 1e-9)
            common = 0.5 * e.mean(1, keepdims=True) + 0.5 / len(e)
            model = PieceModel(languages, model.row, 0.9 * e + 0.1 * common)
    return model


def fit_on(works: DataFrame, key: str, texts: list[str], label: str, folder: str = TOKENIZERS, sample: int = SAMPLE_WORKS) -> PieceModel:
    """Fit on at most ``sample`` works a language label, those of the smallest hash; each text is read whole."""
    rows = works.where(F.col(f"`{label}`").isin(*LANGUAGES)).select(F.col(f"`{label}`").alias("l"), F.struct(F.xxhash64(F.col(f"`{key}`")).alias("h"), F.concat_ws("\n", *(F.col(f"`{t}`") for t in texts)).alias("t")).alias("s"))
    first = Window.partitionBy("l", F.pmod(F.col("s.h"), F.lit(64))).orderBy("s.h")  # a hot label is cut in 64 parts before it meets one task
    cut = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample)
    top = cut.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("s.h"))).where(F.col("k") <= sample)
    return fit(((r.t, r.l) for r in top.select("l", F.col("s.t").alias("t")).collect()), load_pieces(folder))


PASSAGE = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("field", T.StringType()), T.StructField("start_at", T.IntegerType()),
    T.StructField("end_at", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()),
])


def passages(text: str, model: PieceModel, whole: bool) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence), neighbouring sentences of one language joined; whole: the text is one passage.
    A sentence the model isn't sure of joins the passage before it, or else the one after it."""
    found: list[list] = []
    pending: int | None = None
    for a, b in [(0, len(text))] if whole else sentences(text):
        got = model.classify(text[a:b])
        if got is None:
            continue
        lang, conf = got
        if conf < SURE and not whole:
            if found:
                found[-1][1] = b
            elif pending is None:
                pending = a
            continue
        if found and found[-1][2] == lang:
            found[-1][1], found[-1][3] = b, min(found[-1][3], conf)
        else:
            found.append([a if pending is None or found else pending, b, lang, conf])
    if not found and pending is not None:
        s = model.classify(text)
        found.append([pending, len(text), *s])
    return [tuple(x) for x in found]


def label_passages(df: DataFrame, model: PieceModel, key: str, fields: dict[str, bool]) -> DataFrame:
    """Rows of PASSAGE. fields: name -> whether the text is one passage (titles) or sentences (abstracts).

    Null, empty and letterless texts give no row; a null key stays null; repeated rows repeat; other columns are ignored."""
    names = list(fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for values in zip(f["key"].tolist(), *(f[n].tolist() for n in names)):
                for n, text in zip(names, values[1:]):
                    if text:
                        out += [(values[0], n, *p) for p in passages(text, model, fields[n])]
            yield pd.DataFrame(out, columns=PASSAGE.names)

    return df.select(F.col(f"`{key}`").cast("string").alias("key"), *(F.col(f"`{n}`").cast("string").alias(n) for n in names)).mapInPandas(run, PASSAGE)


def work_masks(df: DataFrame, model: PieceModel, key: str, fields: dict[str, bool], label: str, skip_title: tuple[str, str, list[str]]) -> DataFrame:
    """(key, label, mask): one row a row of df; bit i of mask stands for languages[i]. skip_title: (source column, field,
    sources whose field is a name, not text)."""
    names = list(fields)
    src, named, sources = skip_title
    index = {lang: 1 << i for i, lang in enumerate(model.languages)}
    result = T.StructType([T.StructField("key", T.StringType()), T.StructField("label", T.StringType()), T.StructField("mask", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            masks = []
            for source, *values in zip(f["source"].tolist(), *(f[n].tolist() for n in names)):
                mask = 0
                for n, text in zip(names, values):
                    if text and not (n == named and source in sources):
                        for _, _, lang, conf in passages(text, model, fields[n]):
                            mask |= index[lang] if conf >= SURE else 0
                masks.append(mask)
            yield pd.DataFrame({"key": f["key"], "label": f["label"], "mask": np.array(masks, np.int64)})

    need = [F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{src}`").alias("source")]
    return df.select(*need, *(F.col(f"`{n}`").cast("string").alias(n) for n in names)).mapInPandas(run, result)


def mislabelled(masks: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(doc_id, lang) of the works in several languages, or of which a row's label isn't exactly the code of the one."""
    works = masks.groupBy("key").agg(
        F.bit_or("mask").alias("mask"), F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.col("label").isNull()).alias("unlabelled")
    )
    spoken = F.filter(F.array(*(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.lit(x)) for i, x in enumerate(languages))), lambda x: x.isNotNull())
    works = works.withColumn("langs", spoken).where(F.size("langs") > 0)
    one = F.get("langs", F.lit(0))
    wrong = (F.size("langs") > 1) | F.col("unlabelled") | (F.col("low") != one) | (F.col("high") != one)
    return works.where(wrong).select(F.col("key").alias("doc_id"), F.explode("langs").alias("lang"))
