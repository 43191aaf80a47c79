"""Problem 6: spellings of names that mean the same person or organisation.

Method: suffix blocking. Names are parsed into a head (surname, place) and the other fields (given names or initials, kind
of institution). The end of every head, and the end of its mirror image (its start), index it; such a suffix is refined by
the other field (initial or kind), and blocks that are still large are compared in pieces, each with each, so the size of
a block changes no link. Inside a block heads are compared by the ratio of their longest common subsequence, and a rarer
spelling follows the more frequent one. Given names, nicknames and initials then settle the entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewatch.runtime import SALTS, materialise, parallelism

#: Letters of an indexed suffix, least ratio of two heads that are one, heads of a block before it is compared in pieces.
SUFFIX, RATIO, BLOCK_HEADS = 3, 0.8, 300
#: How much more frequent than a variant the spelling it follows has to be.
MORE = 2.0
NICKNAMES = 10_000  # most rows of the table of short forms

# fixed values: Cyrillic letters in Latin
LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", ["a", "b", "v", "g", "d", "e", "yo", "j", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "ts", "ch", "sh", "sch", "", "y", "", "e", "yu", "ya", "i", "yi", "ye", "g"]))
# fixed values: words that tell the kind of an institution, with other forms of them
KINDS = {
    "university": "univ u uni universitat universite universidad universita universidade uniwersytet universitet universytet",
    "academy": "acad akademie academie academia akademia akademiya", "science": "sci sciences", "national": "natl nat'l nat", "laboratory": "lab laboratories labs",
    "robotics": "robot", "institute": "inst institut instituto istituto", "technology": "technol tech technologies", "medical": "med", "center": "ctr centre centers cntr",
    "systems": "sys system", "college": "coll", "hospital": "hosp krankenhaus hopital ospedale szpital", "polytechnic": "polytech politecnico politechnika", "foundation": "fdn fondation fondazione stiftung", "agency": "agence agencia agenzia", "ministry": "min ministere ministerio", "observatory": "obs observatoire observatorio", "museum": "mus musee museo", "clinic": "klinik clinique clinica", "society": "soc societe sociedad gesellschaft", "association": "assoc asociacion", "research": "res", "school": "sch",
}
KIND_OF = {form: kind for kind, forms in KINDS.items() for form in (kind, *forms.split())}
LEGAL = set("inc incorporated ltd limited corp corporation gmbh llc co company plc ag sa".split())
SMALL = set("the of for de la le du des der die das and in at und et e y di da do".split())
_UNIT = re.compile(r"^\s*(?:dept|department|faculty|fac|division|div|chair|section)\b", re.I)
_TITLE = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|sir|dipl|ing)\b\.?\s*)+", re.I)
_DEGREE = re.compile(r"[,\s]+(?:[Pp][Hh]\.?\s?[Dd]|M\.D\.|D\.?Sc|M\.?Sc|Jr|Sr|Esq)\.?$|,\s*MD$")


def latin(text: str) -> str:
    """Lower case, Latin letters without marks."""
    low = unicodedata.normalize("NFKD", unicodedata.normalize("NFC", text).lower().replace("й", "и").replace("ё", "ё"))
    low = "".join(LATIN.get(c, c) for c in unicodedata.normalize("NFC", "".join(c for c in low if not unicodedata.combining(c) or c == "̈")))
    low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return low.translate(str.maketrans({"ł": "l", "ø": "o", "ß": "s", "đ": "d", "’": "'"}))


@lru_cache(200_000)
def sound(word: str) -> str:
    """One spelling for letters that transliteration doesn't keep apart, without doubled letters."""
    for a, b in (("x", "ks"), ("th", "t"), ("ph", "f"), ("ck", "k"), ("zh", "j"), ("w", "v")):
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^a-z0-9]", "", word))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel columns."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


def one_slip(a: str, b: str) -> bool:
    """Whether one letter was changed, left out or added, or two neighbours were exchanged."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[n:], b[n:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and x[1::-1] + x[2:] == y)


class GivenNames:
    """Given names and their short forms."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.full = {latin(g) for _, g in pairs}
        self.short: dict[str, set[str]] = {}
        for n, g in pairs:
            self.short.setdefault(latin(n), set()).add(latin(g))
        self.cache: dict[str, tuple[tuple[str, ...], float]] = {}

    @classmethod
    def load(cls, nicknames: DataFrame) -> GivenNames:
        rows = nicknames.select("nick", "given").where("nick is not null and given is not null").limit(NICKNAMES + 1).collect()
        if len(rows) > NICKNAMES:
            raise ValueError(f"the table of nicknames has more than {NICKNAMES} rows")
        return cls(sorted((r.nick, r.given) for r in rows))

    def find(self, token: str) -> tuple[tuple[str, ...], float]:
        """The given names a token may stand for, and how sure it is one."""
        got = self.cache.get(token)
        if got is None:
            hits = ({token} & self.full) | self.short.get(token, set())
            if hits:
                got = tuple(sorted(hits)), 1.0
            else:
                s = sound(token)
                near = sorted(((max(ratio(s, sound(g)), ratio(token, g), RATIO * (len(g) > 3 and one_slip(token, g))), g) for g in self.full if abs(len(g) - len(token)) <= 2), reverse=True)
                near += sorted(((ratio(s, sound(n)) - 0.01, g) for n, gs in self.short.items() if abs(len(n) - len(token)) <= 1 and len(n) > 3 for g in gs), reverse=True)
                best = max((r for r, _ in near), default=0.0)
                got = (tuple(sorted({g for r, g in near if r == best})), best) if best >= RATIO else ((token,), 0.0)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[token] = got
        return got


def initial_of(letter: str) -> list[str]:
    """Cyrillic е begins both Ekaterina and Yelena."""
    return {"е": ["e", "y"], "є": ["e", "y"], "ю": ["y", "u"], "я": ["y"], "ё": ["y", "f"]}.get(letter.lower()) or [latin(letter)[:1]]


def parse_person(name: str, lexicon: GivenNames) -> tuple[str, list[str], list[str], str] | None:
    """(surname by sound, given names, prefixes of given names, middle initial); the second or the third is empty."""
    s = " ".join(name.replace(" ", " ").split())
    s = _TITLE.sub("", s)
    while (t := _DEGREE.sub("", s)) != s:
        s = t
    s = s.strip(" ,")
    if "," in s:
        left, _, right = s.partition(",")
        surname, rest = left.strip(), right.strip()
    else:
        tokens = s.split()
        if len(tokens) < 2:
            return (sound(latin(s)), [], [], "") if s else None
        dotted = lambda t: "." in t
        capitals = lambda t: t.isupper() and len(t) <= 3 and not tokens[0].isupper()
        if dotted(tokens[-1]) or capitals(tokens[-1]) or len(tokens[-1]) == 1:
            k = next((i for i in range(1, len(tokens)) if dotted(tokens[i]) or capitals(tokens[i]) or len(tokens[i]) == 1), len(tokens) - 1)
            head, tail = tokens[:k], tokens[k:]
            if len(head) > 1:  # surname given initial
                a, b = lexicon.find(latin(head[0]))[1], lexicon.find(latin(head[-1]))[1]
                surname, rest = (head[-1], " ".join([head[0], *tail])) if a > b else (head[0], " ".join([*head[1:], *tail]))
            else:
                surname, rest = head[0], " ".join(tail)
        elif dotted(tokens[0]) or len(tokens[0]) == 1 or len(tokens) > 2:
            surname, rest = tokens[-1], " ".join(tokens[:-1])
            if not dotted(tokens[0]) and lexicon.find(latin(tokens[-1]))[1] > lexicon.find(latin(tokens[0]))[1]:
                surname, rest = tokens[0], " ".join(tokens[1:])
        else:
            a, b = lexicon.find(latin(tokens[0]))[1], lexicon.find(latin(tokens[1]))[1]
            surname, rest = (tokens[1], tokens[0]) if a >= b else (tokens[0], tokens[1])
    head = sound(latin(surname))
    parts = [p for p in re.split(r"(?<=\.)|\s+", rest) if p and p.strip(". ")]
    if not head:
        return None
    if not parts:
        return head, [], [], ""
    first = parts[0]
    if "." not in first and first.isupper() and 2 <= len(first) <= 3 and len(parts) == 1 and not surname.isupper():
        return head, [], initial_of(first[0]), latin(first[1])[:1]  # initials without points
    middle = next((latin(p)[:1] for p in parts[1:] if len(p.strip(".")) == 1), "")
    bare = first.strip(".")
    if len(bare) == 1:
        return head, [], initial_of(bare), middle
    if first.endswith("."):
        return head, [], [latin(bare)], middle
    word = latin(bare)
    if bare[0] in "ЕЄеє":
        options = [lexicon.find("y" + word), lexicon.find(word)]
        return head, list(max(options, key=lambda o: o[1])[0]), [], middle
    return head, list(lexicon.find(word)[0]), [], middle


@lru_cache(200_000)
def kind_word(token: str) -> str | None:
    bare = token.replace("'", "")
    if (k := KIND_OF.get(token) or KIND_OF.get(bare)) is not None:
        return k
    near = [(ratio(bare, k), k) for k in KINDS if len(bare) >= 5 and bare[0] == k[0]]
    best = max(near, default=(0.0, ""))
    return best[1] if best[0] >= 0.85 else None


def parse_institution(name: str) -> tuple[str, str] | None:
    """(place by sound, kind): the kind is its words in alphabetic order; departments fall away."""
    segments = [s for s in re.split(r"[,;()]", name) if s.strip() and not _UNIT.match(s)] or [name]
    place, kinds = [], set()
    for token in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", " ".join(segments)):
        t = latin(token)
        if t in SMALL or t in LEGAL:
            continue
        k = kind_word(t)
        if k:
            kinds.add(k)
        else:
            place.append(sound(t))
    head = "".join(place)
    return (head, " ".join(sorted(kinds))) if head or kinds else None


PARSED = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("n", T.LongType()), T.StructField("head", T.StringType()),
    T.StructField("given", T.ArrayType(T.StringType())), T.StructField("prefixes", T.ArrayType(T.StringType())), T.StructField("middle", T.StringType()), T.StructField("refine", T.ArrayType(T.StringType())),
])


def parsed(names: DataFrame, lexicon: GivenNames) -> DataFrame:
    """names: kind, name, n. refine: what a suffix is refined by, one or more initials or the kind of institution."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for kind, name, n in zip(f["kind"].tolist(), f["name"].tolist(), f["n"].tolist()):
                if kind == "author":
                    if got := parse_person(name, lexicon):
                        head, given, prefixes, middle = got
                        out.append((kind, name, n, head, given, prefixes, middle, sorted({g[0] for g in (*given, *prefixes)}) or [""]))
                elif got := parse_institution(name):
                    out.append((kind, name, n, got[0], [got[1]], [], "", [got[1]]))
            yield pd.DataFrame(out, columns=PARSED.names)

    return names.mapInPandas(run, PARSED)


def _follow(rows: list[tuple[str, int, int]]) -> list[tuple[str, str, float, int]]:
    """(head, head it may follow, ratio, how frequent that is) inside one block. rows: head, frequency, piece of the block;
    of two pieces only heads of different ones are compared.

    What heads have in common as bags of letters bounds their subsequence, so most pairs need no more than that."""
    out = []
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    heads = [r[0] for r in rows]
    often, piece = np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows])
    length = np.array([len(h) for h in heads])
    across = len(set(piece.tolist())) > 1
    bags = np.zeros((len(rows), 64), np.int16)
    for i, h in enumerate(heads):
        for c in h:
            bags[i, ord(c) % 64] += 1
    for i, b in enumerate(heads):
        near = (often[:i] >= MORE * often[i]) & (np.abs(length[:i] - length[i]) <= 2)
        if across:
            near &= piece[:i] != piece[i]
        at = np.flatnonzero(near)
        common = np.minimum(bags[at], bags[i]).sum(axis=1)
        for j in at[2 * common / (length[at] + length[i]) >= RATIO].tolist():
            if (r := ratio(heads[j], b)) >= RATIO:
                out.append((b, heads[j], r, rows[j][1]))
    return out


def head_targets(people: DataFrame) -> DataFrame:
    """(kind, r, head, target): the spelling each head follows, under each of its refinements; only heads that follow one."""
    units = materialise(people.select("kind", "head", "n", F.explode("refine").alias("r")).groupBy("kind", "r", "head").agg(F.sum("n").alias("n")), "heads")
    totals = units.groupBy("kind", "head").agg(F.sum("n").alias("n"))  # a head is as frequent as all who bear it
    units = units.drop("n").join(totals, ["kind", "head"])
    ends = F.array(F.concat(F.lit(">"), F.substring(F.reverse("head"), 1, SUFFIX)), F.concat(F.lit("<"), F.substring("head", 1, SUFFIX)))
    keyed = units.where("head <> ''").select("*", F.explode(ends).alias("block"))
    sizes = keyed.groupBy("kind", "r", "block").agg(F.count("*").alias("size"))
    keyed = keyed.join(sizes, ["kind", "r", "block"])
    # a suffix too common even when refined: its heads are split in pieces, and every two pieces meet in one task
    pieces = F.ceil(F.col("size") / BLOCK_HEADS).cast("int")
    keyed = keyed.where(F.col("size") > 1).withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("head"), "pieces").cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: F.struct(F.least(i, "piece").alias("x"), F.greatest(i, "piece").alias("y")))
    blocks = keyed.select("kind", "r", "head", "n", "block", "piece", F.explode(cells).alias("cell"))
    schema = "kind string, r string, head string, target string, ratio double, m long"

    def compare(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        got = _follow(list(zip(f["head"].tolist(), f["n"].tolist(), f["piece"].tolist())))
        return pd.DataFrame([(*key[1:3], *g) for g in got], columns=["kind", "r", "head", "target", "ratio", "m"])

    # as many parts as were asked for: small blocks must not be put together in one task, their cost is their pairs
    parts = 4 * parallelism(people.sparkSession)
    spread = blocks.withColumn("part", F.pmod(F.xxhash64("kind", "r", "block", "cell"), F.lit(parts)).cast("int")).repartition(parts, "part")
    pairs = spread.groupBy("part", "kind", "r", "block", "cell").applyInPandas(compare, schema)
    best = F.max_by("target", F.struct("ratio", "m", F.col("target")))
    return pairs.groupBy("kind", "r", "head").agg(best.alias("target"))


def _ends_of(targets: DataFrame) -> DataFrame:
    """(kind, r, head, target) with every target at the end of its chain. Along a chain heads are at least MORE times as
    frequent as the one before, so the rounds, each of which doubles the steps, are few."""
    while True:
        on = targets.select("kind", "r", F.col("head").alias("target"), F.col("target").alias("next"))
        moved = materialise(targets.join(on, ["kind", "r", "target"], "left"), "chains")
        if moved.where("next is not null").isEmpty():
            return targets
        targets = moved.select("kind", "r", "head", F.coalesce("next", "target").alias("target"))


def _meet(rows: DataFrame, others: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Join of two tables that may both hold many rows of one key: rows lie in SALTS parts, others stand in each."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = others.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "__salt"]).drop("__salt")


def link_names(df: DataFrame, columns: dict[str, str], nicknames: DataFrame) -> DataFrame:
    """(kind, name, entity) for every distinct string of the array columns; columns: array column -> author or institution.

    Null and blank strings, and strings without letters, give no row; a string that fits several people of a surname
    (an initial two of them share) is an entity of its own; an empty df gives no rows; other columns are ignored."""

    def named(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"`{column}`"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    lists = [named(c, k) for c, k in columns.items()]
    names = df.select(F.explode(F.concat(*lists)).alias("x")).select("x.*").where("name is not null and trim(name) <> ''").groupBy("kind", "name").agg(F.count("*").alias("n"))
    people = materialise(parsed(names, GivenNames.load(nicknames)), "names").where("head <> ''")
    targets = materialise(head_targets(people), "targets")
    final = _ends_of(targets)
    each = people.select("*", F.explode("refine").alias("r"))  # an ambiguous initial follows one head under each reading
    headed = each.join(final, ["kind", "r", "head"], "left").withColumn("root", F.coalesce("target", "head"))
    headed = materialise(headed.drop("target"), "headed")
    sure = headed.where(F.size("given") == 1).withColumn("person", F.get("given", F.lit(0)))
    people_of = sure.groupBy("kind", "root", "person").agg(F.collect_set(F.when(F.col("middle") != "", F.col("middle"))).alias("middles"), F.sum("n").alias("n"))
    people_of = people_of.withColumn("r", F.when(F.col("kind") == "author", F.substring("person", 1, 1)).otherwise(F.col("person")))
    vague = headed.where(F.size("given") != 1)
    fits = (F.array_contains("given", F.col("person")) | F.exists("prefixes", lambda p: F.col("person").startswith(p))) & (
        (F.col("middle") == "") | (F.size("middles") == 0) | F.array_contains("middles", F.col("middle"))
    )
    options = _meet(vague, people_of.drop("n"), ["kind", "root", "r"], F.col("name")).where(fits)
    agreed = F.col("middle").isin("") == F.lit(False)
    options = options.withColumn("strong", (agreed & F.array_contains("middles", F.col("middle"))).cast("int"))
    best = Window.partitionBy("kind", "name")
    options = options.withColumn("top", F.max("strong").over(best)).where(F.col("strong") == F.col("top"))
    picked = options.groupBy("kind", "name").agg(F.collect_set(F.struct("root", "person")).alias("p")).where(F.size("p") == 1)
    picked = picked.select("kind", "name", F.get("p", F.lit(0))["root"].alias("root"), F.get("p", F.lit(0))["person"].alias("person"))
    entity = lambda: F.concat_ws("|", "kind", "root", "person").alias("entity")
    rest = vague.join(picked.select("kind", "name"), ["kind", "name"], "left_anti").join(options.select("kind", "name").distinct(), ["kind", "name"], "left_anti")
    # nobody of that surname fits: equal initials are one person
    rest = rest.groupBy("kind", "name").agg(F.min(F.struct("root", F.concat_ws("/", F.array_sort(F.concat("given", "prefixes")), "middle").alias("w"))).alias("x"))
    alone = options.join(picked.select("kind", "name"), ["kind", "name"], "left_anti").select("kind", "name").distinct()
    return (
        sure.select("kind", "name", entity()).unionByName(picked.select("kind", "name", entity()))
        .unionByName(rest.select("kind", "name", F.concat_ws("|", "kind", "x.root", F.lit("?"), "x.w").alias("entity")))
        .unionByName(alone.select("kind", "name", F.concat_ws("|", "kind", F.lit("!"), "name").alias("entity")))
    )


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """Each pair of strings of one entity, name_a < name_b."""
    rows = linked.select("kind", "entity", F.col("name").alias("name_a"))
    pairs = _meet(rows, linked.select("entity", F.col("name").alias("name_b")), ["entity"], F.col("name_a"))
    return pairs.where(F.col("name_a") < F.col("name_b")).select("kind", "name_a", "name_b").distinct()
