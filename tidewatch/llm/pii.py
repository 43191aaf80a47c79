"""Problem 10: personal data in free text, found and replaced by typed placeholders.

Method: a semi-Markov conditional random field. A text is cut into tokens; every span of tokens up to the longest of each
kind is a segment that may be chosen, whatever it looks like. Its score is the sum of weights of what its tokens are, what
stands at and around its ends, how many digits, words, initials it holds and the order of its token classes. Dynamic
programming chooses boundaries and kinds jointly, with plain text scoring zero. Weights come from maximum likelihood on the
sentences of ``pii_training``; a list of given names is a feature, not a condition.

Segments of negative score stand in no best choice, so after all are scored the programme runs over the others only; an
upper bound of the counts' weights spares the exact score of most."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.names import latin
from tidewatch.llm.pii_training import HAN_FAMILIES

KINDS = ("email", "phone", "identity", "address", "name")
#: Tokens that a segment of each kind spans at most: words, digit runs, single signs and Chinese characters; blanks are none.
LONGEST = {"email": 26, "phone": 18, "identity": 14, "address": 30, "name": 10}
#: Tokens that are scored at once; bounds the memory of a worker. A longer text is scored whole.
CHUNK = 200_000
#: Tokens to the left that a segment's score looks at; so many breaks part two texts.
REACH = 6
#: Tokens of the training texts that a feature must occur in to have a weight.
LEAST = 3

Span = tuple[int, int, str]

_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+|\d+|[ \t ]+|\s+|.", re.DOTALL)
# fixed values: words of streets, particles of family names, and capitalised words that open sentences or name days and months
STREETS = set("street road avenue lane drive way court place square close terrace boulevard crescent parkway grove gardens row hill st rd ave ln dr blvd rue allée quai impasse chemin cours bd av calle avenida avda plaza paseo camino carretera rua travessa largo praça alameda estrada via viale piazza corso vicolo ul al os pl ulica ул улица пр проспект пер просп бул вул вулиця пров бульвар переулок 路 街 道 巷 号".split())
LOW_STREETS = set("rue via viale piazza corso vicolo largo calle avenida rua ul al os avenue boulevard place quai impasse chemin allée cours bd av".split())
PARTS = set("apt apto apartment flat unit suite floor room кв оф офис д дом буд будинок г м пос piso int interno esc p.o box 室 栋 单元 楼 市 区 县".split())
_STREET_END = re.compile(r"(?:straße|strasse|str|weg|gasse|allee|platz|ring|ufer|damm|straat|laan|gracht|plein)$")
PARTICLES = set("van von de der den des del della di da do dos das du la le el al bin ibn ter ten zu zur af".split())
COMMON = set(
    "the a an this that these those in on at of to for from by with and or but if as we our he she it they there here both either thanks contact since each every some no not yes dear hello hi re cc dr prof mr mrs ms sir madam herr frau monsieur madame señor señora pan pani new old north south east west great "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december university institute laboratory academy center centre department company bank city river lake mount bay port "
    "und die der das ein eine ist le les un une et el los una y o os um uma il lo i w z na и в на по от для с за не".split()
)
_SIGNS = ".,-'@/:;()[]<>+#_=\"*&%°№‑–—|{}!?«»“”„、，。：；（）＠＋$\\~"
CLASSES = {c: i for i, c in enumerate(["break", "line", "I", "C", "U", "w", "a", "G", "GU", "g", "K", "p", "S", "Sa", "s", "A", "at", "dot", "H", "Hs", *(f"D{n}" for n in range(1, 13)), "sign", *_SIGNS])}
N_CLASS = len(CLASSES)
_BREAK, _LINE, _SIGN = CLASSES["break"], CLASSES["line"], CLASSES["sign"]
#: Classes as the coarse order of a segment sees them.
_COARSE = np.array([{"U": CLASSES["C"], "GU": CLASSES["G"], "g": CLASSES["w"], "a": CLASSES["w"], "Hs": CLASSES["H"]}.get(c, CLASSES["D1"] if c[0] == "D" and c[1:].isdigit() else i) for c, i in CLASSES.items()])
_SAME_SIGN = {"’": "'", "ʼ": "'", "`": "'"}

ROLES = ("in", "start", "prev1", "prev2", "bag", "end", "next1", "next2")
PAIRS = ("in", "enter", "leave", "first", "last")
TRIPLES, N_TRIPLE = ("enter", "leave", "before", "after"), 1 << 14
#: What is counted in a segment of each kind, with the highest count told apart.
COUNTED = {"email": {"at": 2, "dot": 5, "gap": 6}, "phone": {"digit": 18, "run": 8, "gap": 6}, "identity": {"digit": 20, "run": 6, "letter": 8}, "address": {"run": 6, "street": 2, "cap": 7, "comma": 5}, "name": {"cap": 5, "given": 3, "initial": 4, "han": 4}}
_COUNTERS = ("at", "dot", "gap", "digit", "run", "letter", "street", "cap", "comma", "given", "initial", "han")


@lru_cache(200_000)
def _lat(word: str) -> str:
    return latin(word)


class Lexicon:
    """Given names, in full and short, in Latin letters; transliterations count if they differ by the usual endings."""

    def __init__(self, words: Iterable[str]):
        self.words = {latin(w) for w in words}
        self.loose = {self._loose(w) for w in self.words}

    @staticmethod
    def _loose(w: str) -> str:
        w = re.sub(r"^y(?=[eu])", "", w)
        return re.sub(r"(?<=.)[yij]+", "i", w).replace("x", "ks").replace("h", "").removesuffix("i")

    def has(self, word: str) -> bool:
        w = _lat(word)
        return w in self.words or (not word.isascii() and self._loose(w) in self.loose)


def describe(token: str, lexicon: Lexicon) -> tuple[int, list[str], list[int]]:
    """(class, features, counters) of a token that is no blank."""
    c = token[0]
    low = token.lower()
    counts = dict.fromkeys(_COUNTERS, 0)
    if c.isspace():
        return _LINE, ["line"], list(counts.values())
    if c.isdigit() and token.isdecimal():
        n = min(len(token), 12)
        counts["digit"], counts["run"] = len(token), 1
        return CLASSES[f"D{n}"], [f"D{n}", "digits", *([f"lead:{n}{'0' if c == '0' else ''}"] if n not in (4, 5) else []), *([f"year:{token[:2]}"] if len(token) == 4 and token[:2] in ("19", "20") else []), *([f"v:{token}"] if n < 3 else [])], list(counts.values())
    if "㐀" <= c <= "鿿":
        kind = "Hs" if c in HAN_FAMILIES else "H"
        counts["han"], counts["street"] = 1, int(c in STREETS)
        return CLASSES[kind], [kind, f"w:{c}"], list(counts.values())
    if not (c.isalpha() or token.isalpha()):
        sign = _SAME_SIGN.get(c, c)
        kind = CLASSES.get(sign, _SIGN) if sign in _SIGNS else _SIGN
        counts.update({"at": int(c in "@＠"), "dot": int(c == "."), "comma": int(c in ",，")})
        return kind, [f"sign:{sign}", "signs"], list(counts.values())
    upper = c.isupper()
    street = low in STREETS and (upper or c > "ɐ" or low in LOW_STREETS) or bool(len(low) > 4 and _STREET_END.search(low))
    given = len(token) > 1 and lexicon.has(token)
    if low in ("at", "собака", "dot", "точка"):
        kind = "at" if low in ("at", "собака") else "dot"
    elif street:
        kind = "Sa" if low in ("st", "rd", "ave", "ln", "dr", "blvd", "av", "avda", "bd", "str", "ул", "пр", "просп", "пер", "бул", "вул", "пров", "ul", "al", "os", "pl") else "S" if upper or low in ("via", "viale", "piazza", "corso", "vicolo", "largo", "calle", "avenida", "rua", "ul", "al", "os") or c > "ɐ" else "s"
    elif low in PARTICLES and not token.isupper():
        kind = "p"
    elif low in PARTS and (upper or not token.isascii() or len(token) == 1 or low in ("apt", "apto", "piso", "int")):
        kind = "A"
    elif low in COMMON and upper:
        kind = "K"
    elif given:
        kind = "GU" if token.isupper() else "G" if upper else "g"
    elif len(token) == 1:
        kind = "I" if upper else "a"
    else:
        kind = "U" if token.isupper() else "C" if upper else "w"
    script = "cyr" if "Ѐ" <= c <= "ӿ" else "lat"
    features = [kind, f"{kind}:{script}", f"w:{low[:24]}", f"len:{kind}{min(len(low), 9)}"]
    if len(low) > 3:
        features += [f"s3:{low[-3:]}", f"s2:{low[-2:]}", f"p3:{low[:3]}"]
    counts.update({"at": int(low in ("at", "собака")), "dot": int(low in ("dot", "точка")), "letter": min(len(token), 8), "street": int(street), "cap": int(upper and len(token) > 1), "given": int(given and upper), "initial": int(len(token) == 1 and upper)})
    return CLASSES[kind], features, list(counts.values())


# whole segments of a known grammar: a feature of the segment, which the weights may outvote
_AT, _DOT = r"(?: ?[@＠] ?| ?[\[({<] ?(?:at|AT|@|собака) ?[\])}>] ?| (?:at|AT|собака) )", r"(?:\.| ?[\[({] ?(?:dot|DOT|\.|точка) ?[\])}] ?| (?:dot|DOT|точка) )"
_GRAMMAR = {
    "email": [re.compile(r"(?<![\w.+@-])[A-Za-z0-9](?:[\w.+-]{0,60}\w)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@-])"), re.compile(rf"(?<![\w.+@-])[A-Za-z0-9](?:[\w.+-]{{0,60}}\w)?{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@-])")],
    "phone": [re.compile(r"(?<![\w+.])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?![\w-])")],
}
# what a text that a grammar reads holds at least
_HINTS = {"email": [re.compile(r"\w@\w"), re.compile(r"＠| @|@ |[\[({<] ?(?:at|AT|@|собака) ?[\])}>]| (?:dot|DOT|точка) ")], "phone": [re.compile(r"\+\d")]}


def grammar(text: str, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(kind, grammar from 1, first token, tokens) of the segments that a grammar reads whole."""
    out = []
    for k, kind in enumerate(KINDS):
        for n, (pattern, hint) in enumerate(zip(_GRAMMAR.get(kind, ()), _HINTS.get(kind, ())), 1):
            if hint.search(text):
                for m in pattern.finditer(text):
                    i, j = np.searchsorted(starts, m.start()), np.searchsorted(ends, m.end())
                    if j < len(ends) and starts[i] == m.start() and ends[j] == m.end() and j - i < LONGEST[kind]:
                        out.append((k, n, int(i), int(j - i + 1)))
    return out


class _Blanks(dict):
    """Whether a token is a blank, by the token."""

    def __missing__(self, token: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        self[token] = token[0] in " \t\u00a0"
        return self[token]


_blank = _Blanks()


def cut(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """(tokens without blanks, their starts, their ends, 0 no blank before, 1 one, 2 more; segments of a grammar)."""
    parts = _TOKEN.findall(text)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size)
    blank = np.fromiter(map(_blank.__getitem__, parts), bool, len(parts))
    keep = np.flatnonzero(~blank)
    starts = ends - size
    gap = np.zeros(len(keep), np.int64)
    before = keep[keep > 0] - 1
    gap[keep > 0] = np.where(blank[before], np.minimum(size[before], 2), 0)
    starts, ends = starts[keep], ends[keep]
    return [parts[i] for i in keep], starts, ends, gap, grammar(text, starts, ends)


_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _orders(classes: np.ndarray, gaps: np.ndarray, start: np.ndarray, length: np.ndarray, coarse: bool) -> np.ndarray:
    """A hash of the classes and gaps of each segment."""
    c = (_COARSE[classes] if coarse else classes).astype(np.uint64)
    code = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for m in range(int(length.max()) if len(length) else 0):
            on = np.flatnonzero(length > m)
            at = start[on] + m
            step = c[at] * np.uint64(3) + (gaps[at].astype(np.uint64) if m else np.uint64(0)) + np.uint64(1)
            code[on] = (code[on] ^ step) * _P
            code[on] ^= code[on] >> np.uint64(29)
        return code * _Q + length.astype(np.uint64)


def _triples(classes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """A hash of the coarse classes of each token and its neighbours and of the blanks between them."""
    c = np.concatenate([[0], _COARSE[classes], [0]]).astype(np.uint64)
    g = np.append(gaps, 0).astype(np.uint64)
    with np.errstate(over="ignore"):
        code = (((c[:-2] * np.uint64(3) + g[:-1]) * np.uint64(N_CLASS) + c[1:-1]) * np.uint64(3) + g[1:]) * np.uint64(N_CLASS) + c[2:]
        return ((code * _P) >> np.uint64(50)).astype(np.int64)


class SegmentField:
    """The weights, how they are fitted, and the best choice of segments of a text."""

    def __init__(self, lexicon: Lexicon, longest: dict[str, int] | None = None):
        self.lexicon, self.longest = lexicon, longest or LONGEST
        self.features: dict[str, int] = {"": 0}  # row 0 weighs nothing
        self.growing = True
        self.orders: list[dict[int, int]] = [{}, {}]  # fine and coarse
        self.tables: dict[str, np.ndarray] = {}
        self._seen: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self._seen.clear()
        self._class, self._feats, self._counts = [_BREAK], [[0]], [[0] * len(_COUNTERS)]
        self._arrays, self._filled = self._empty(), 0

    @staticmethod
    def _empty() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.int64), np.zeros((0, len(_COUNTERS)), np.int64), np.zeros((0, len(ROLES), len(KINDS)))

    def __getstate__(self):
        state = dict(self.__dict__)
        state.pop("_order_cache", None)
        state.pop("marginals", None)
        return state | {"_seen": {}, "_class": [_BREAK], "_feats": [[0]], "_counts": [[0] * len(_COUNTERS)], "_arrays": self._empty(), "_filled": 0}

    # ---- tokens
    def _ids(self, tokens: list[str]) -> np.ndarray:
        seen = self._seen
        for t in sorted(set(tokens).difference(seen)):  # features are numbered alike in every process
            kind, names, counts = describe(t, self.lexicon)
            if self.growing:
                rows = [self.features.setdefault(n, len(self.features)) for n in names]
            else:
                rows = [self.features[n] for n in names if n in self.features]
            seen[t] = len(self._class)
            self._class.append(kind)
            self._feats.append(rows)
            self._counts.append(counts)
        return np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))

    def _known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class; counters; role and kind scores) of all tokens met so far; only new ones are worked out."""
        n, (classes, counts, scores) = len(self._class), self._arrays
        if self._filled < n:
            if n > len(classes):
                room = max(1024, 2 * n)
                classes, counts, scores = (np.concatenate([x, np.zeros((room - len(x), *x.shape[1:]), x.dtype)]) for x in (classes, counts, scores))
                self._arrays = (classes, counts, scores)
            new = slice(self._filled, n)
            classes[new], counts[new] = self._class[new], self._counts[new]
            if "token" in self.tables:
                w = self.tables["token"]
                for i in range(self._filled, n):
                    if self._feats[i] and self._feats[i] != [0]:
                        scores[i] = w[:, self._feats[i]].sum(1)
            self._filled = n
        return classes[:n], counts[:n], scores[:n]

    # ---- all segments of a run of texts
    def _ends(self, ids: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, classes): the score of tokens i..j as kind k without length, counts and order is a[i, k] + b[j, k]."""
        n = len(ids)
        classes, _, scores = self._known()
        cls = classes[ids]
        shifted = lambda x, by: np.concatenate([np.zeros_like(x[:by]), x[: n - by]]) if n > by else np.zeros_like(x)
        ahead = lambda x, by: np.concatenate([x[by:], np.zeros_like(x[:by])]) if n > by else np.zeros_like(x)
        role = lambda r: scores[ids, ROLES.index(r)]
        pair = np.empty(n, np.int64)  # of a token and the one before it
        pair[0] = cls[0]
        pair[1:] = (cls[:-1] * 3 + gaps[1:]) * N_CLASS + cls[1:]
        following = np.append(pair[1:], 0)
        p = {name: self.tables["pair"][i] for i, name in enumerate(PAIRS)}
        triple = _triples(cls, gaps)
        t = self.tables["triple"]
        bag = role("bag")
        start = role("start") + shifted(role("prev1"), 1) + shifted(role("prev2"), 2) + p["enter"][pair] + p["first"][following]
        for by in range(3, REACH + 1):
            start += shifted(bag, by)
        start += t[0][triple] + shifted(t[2][triple], 1)
        end = role("end") + ahead(role("next1"), 1) + ahead(role("next2"), 2) + p["leave"][following] + p["last"][pair]
        end += t[1][triple] + ahead(t[3][triple], 1)
        inside = role("in")
        inside[cls == _BREAK] = -1e4
        both = np.cumsum(inside, 0)
        pairs = np.cumsum(p["in"][pair], 0)
        return start - (both - inside) - pairs, end + both + pairs, cls

    def _spans(self, ids: np.ndarray, gaps: np.ndarray, read: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, ...]:
        """(start, length, kind, score) of all segments that score more than nothing."""
        n = len(ids)
        a, b, cls = self._ends(ids, gaps)
        sums = np.concatenate([np.zeros((1, len(_COUNTERS)), np.int64), np.cumsum(self._known()[1][ids], 0)])
        spaces = np.concatenate([[0], np.cumsum(gaps > 0)])
        found = []
        for k, kind in enumerate(KINDS):
            bound = self.tables[f"bound:{kind}"]
            ak, bk = np.ascontiguousarray(a[:, k]), np.ascontiguousarray(b[:, k])
            parts = []
            for length in range(1, min(self.longest[kind], n) + 1):
                s = ak[: n - length + 1] + bk[length - 1 :]
                at = np.flatnonzero(s > -bound[length])
                if len(at):
                    parts.append((at, np.full(len(at), length), s[at]))
            if not parts:
                continue
            i, length, s = (np.concatenate(x) for x in zip(*parts))
            s = s + self._span_scores(k, i, length, cls, gaps, sums, spaces, read)[0]
            good = s > 0
            found.append((i[good], length[good], np.full(int(good.sum()), k), s[good]))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _order_rows(self, which: int, i: np.ndarray, length: np.ndarray, cls: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        keys, values = self._order_arrays(which)
        if not len(keys):
            return np.zeros(len(i), np.int64)
        code = _orders(cls, gaps, i, length, bool(which))
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        return np.where(keys[at] == code, values[at], 0)

    def _span_scores(self, k: int, i: np.ndarray, length: np.ndarray, cls, gaps, sums, spaces, read, orders: list[np.ndarray] | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(score, rows) of length, counts and order of the segments; rows name the places of the tables."""
        kind = KINDS[k]
        rows = {f"len:{kind}": length}
        for name, most in COUNTED[kind].items():
            value = spaces[i + length] - spaces[i + 1] if name == "gap" else sums[i + length, _COUNTERS.index(name)] - sums[i, _COUNTERS.index(name)]
            rows[f"{name}:{kind}"] = np.minimum(value, most)
        rows[f"grammar:{kind}"] = np.zeros(len(i), np.int64)
        if mine := [(at * 64 + size, which) for kind_of, which, at, size in read if kind_of == k]:
            codes, which = (np.array(x) for x in zip(*sorted(mine)))
            at = np.minimum(np.searchsorted(codes, i * 64 + length), len(codes) - 1)
            rows[f"grammar:{kind}"] = np.where(codes[at] == i * 64 + length, which[at], 0)
        for which in (0, 1):
            rows[f"order{which}:{kind}"] = orders[which] if orders else self._order_rows(which, i, length, cls, gaps)
        return sum(self.tables[name][at] for name, at in rows.items()), rows

    def _order_arrays(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        cache = self.__dict__.setdefault("_order_cache", {})
        known = self.orders[which]
        if which not in cache or len(cache[which][0]) != len(known):
            keys = np.array(sorted(known), np.uint64)
            cache[which] = (keys, np.array([known[int(x)] for x in keys], np.int64))
        return cache[which]

    def _bounds(self) -> None:
        for kind in KINDS:
            rest = sum(self.tables[f"{c}:{kind}"].max() for c in (*COUNTED[kind], "grammar", "order0", "order1"))
            self.tables[f"bound:{kind}"] = self.tables[f"len:{kind}"] + rest

    # ---- the best choice
    @staticmethod
    def best(start: Sequence[int], stop: Sequence[int], score: Sequence[float]) -> list[int]:
        """Indices of the segments [start, stop) that don't overlap and score most together."""
        order = sorted(range(len(start)), key=lambda i: (stop[i], start[i]))
        ends = [stop[i] for i in order]
        value, keep = [0.0], [-1]
        for n, i in enumerate(order):
            k = bisect_right(ends, start[i], 0, n)
            take = value[k] + score[i]
            if take > value[-1]:
                value.append(take)
                keep.append(k)
            else:
                value.append(value[-1])
                keep.append(-1)
        out, n = [], len(order)
        while n:
            if keep[n] < 0:
                n -= 1
            else:
                out.append(order[n - 1])
                n = keep[n]
        return out[::-1]

    def find_all(self, texts: Iterable[str]) -> Iterator[list[Span]]:
        """(start, end, kind) of the personal data of each text, in order; texts are read whole."""
        waiting, size = [], 0
        for t in texts:
            waiting.append(cut(t))
            size += len(waiting[-1][0]) + 1
            if size >= CHUNK:
                yield from self._find(waiting)
                waiting, size = [], 0
        yield from self._find(waiting)

    def find(self, text: str) -> list[Span]:
        return next(self.find_all([text]))

    def _find(self, texts: list[tuple]) -> list[list[Span]]:
        if not texts:
            return []
        if len(self._class) > 200_000:
            self._reset()
        breaks = np.zeros(REACH, np.int64)
        ids, gaps, begin = [breaks], [breaks], []
        at = REACH
        read = []
        for tokens, _, _, gap, found in texts:
            begin.append(at)
            read += [(k, n, at + i, size) for k, n, i, size in found]
            ids += [self._ids(tokens), breaks]
            gaps += [gap, breaks]
            at += len(tokens) + REACH
        i, length, k, s = self._spans(np.concatenate(ids), np.concatenate(gaps), read)
        chosen = self.best(i.tolist(), (i + length).tolist(), s.tolist())
        doc = np.searchsorted(np.array(begin), i, "right") - 1
        out: list[list[Span]] = [[] for _ in texts]
        for x in chosen:
            d = int(doc[x])
            first = int(i[x]) - begin[d]
            out[d].append((int(texts[d][1][first]), int(texts[d][2][first + int(length[x]) - 1]), KINDS[int(k[x])]))
        return out

    # ---- fitting
    def train(self, examples: list[tuple[str, list[Span]]], rounds: int = 6, rate: float = 0.4, l2: float = 3e-4, batch: int = 200, drop: float = 0.25, seed: int = 7) -> SegmentField:
        """Maximum likelihood by AdaGrad over batches of texts of like length, in a fixed order.

        In each batch a share ``drop`` of the rows of the large tables is left out, so that no single word or order decides; the
        weights are the mean of those after the last three rounds."""
        cutted = [(cut(t), gold) for t, gold in examples]
        data = []
        for (tokens, starts, ends, gap, found), gold in cutted:
            ids = self._ids(tokens)
            first, last = {int(x): n for n, x in enumerate(starts)}, {int(x): n for n, x in enumerate(ends)}
            truth = [(KINDS.index(k), first[a], last[b] - first[a] + 1) for a, b, k in gold if a in first and b in last and last[b] - first[a] < self.longest[k]]
            data.append((ids, gap, truth, found))
        self.growing = False
        seen = np.bincount(np.concatenate([ids for ids, *_ in data]), minlength=len(self._class))
        often = np.zeros(len(self.features), np.int64)
        for n, rows in zip(seen, self._feats):
            often[rows] += n
        new = np.where(often >= LEAST, np.cumsum(often >= LEAST), 0)  # rare features tell nothing about other texts
        self.features = {name: int(new[row]) for name, row in self.features.items() if new[row]}
        self._feats = [[int(new[row]) for row in rows if new[row]] for rows in self._feats]
        cls_of = np.array(self._class)
        for ids, gap, truth, _ in data:  # the orders of marked segments
            for _, i, n in truth:
                for which in (0, 1):
                    code = int(_orders(cls_of[ids], gap, np.array([i]), np.array([n]), bool(which))[0])
                    self.orders[which].setdefault(code, len(self.orders[which]) + 1)
        t = self.tables
        t["token"] = np.zeros((len(ROLES), len(self.features) + 1, len(KINDS)))
        t["pair"] = np.zeros((len(PAIRS), N_CLASS * 3 * N_CLASS, len(KINDS)))
        t["triple"] = np.zeros((len(TRIPLES), N_TRIPLE, len(KINDS)))
        for kind in KINDS:
            t[f"len:{kind}"] = np.full(self.longest[kind] + 1, -3.0)
            for c, most in COUNTED[kind].items():
                t[f"{c}:{kind}"] = np.zeros(most + 1)
            t[f"grammar:{kind}"] = np.zeros(len(_GRAMMAR.get(kind, ())) + 1)
            for which in (0, 1):
                t[f"order{which}:{kind}"] = np.zeros(len(self.orders[which]) + 1)
        square = {name: np.full_like(x, 1e-2) for name, x in t.items()}
        order = sorted(range(len(data)), key=lambda x: len(data[x][0]))
        batches = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng, kept = np.random.default_rng(seed), [{} for _ in batches]
        mean: dict[str, np.ndarray] = {}
        for turn in range(rounds):
            for n in rng.permutation(len(batches)):
                held = {}
                for name in t:
                    if name in ("token", "triple") or name.startswith("order"):
                        out = rng.random(t[name].shape[-2] if t[name].ndim > 1 else len(t[name])) < drop
                        held[name] = (out, t[name][..., out, :].copy() if t[name].ndim > 1 else t[name][out])
                        t[name][(..., out, slice(None)) if t[name].ndim > 1 else out] = 0.0
                grads = self.gradient([data[x] for x in batches[n]], kept[n])[1]
                for name, g in grads.items():
                    g -= l2 * len(batches[n]) * t[name]
                    if name in held:
                        out, was = held[name]
                        where = (..., out, slice(None)) if g.ndim > 1 else out
                        g[where] = 0.0
                        t[name][where] = was
                    square[name] += g * g
                    t[name] += rate * g / np.sqrt(square[name])
            if turn >= rounds - 3:
                mean = {name: x.copy() + mean.get(name, 0.0) for name, x in t.items()}
        t.update({name: x / min(rounds, 3) for name, x in mean.items()})
        for name in ("token", "triple", *(f"order{w}:{k}" for w in (0, 1) for k in KINDS)):
            t[name] *= 1 - drop
        t.update({name: x.astype(np.float32) for name, x in t.items()})
        self._bounds()
        self._reset()
        return self

    @classmethod
    def mean(cls, fields: Sequence[SegmentField]) -> SegmentField:
        """The field of the mean weights of fields that were fitted to the same texts with different seeds."""
        first = fields[0]
        if any(f.features != first.features or f.orders != first.orders for f in fields):
            raise ValueError("fields of different texts")
        out = cls(first.lexicon, first.longest)
        out.features, out.orders, out.growing = first.features, first.orders, False
        out.tables = {name: np.mean([f.tables[name] for f in fields], axis=0, dtype=np.float32) for name in first.tables}
        out._bounds()
        return out

    def gradient(self, texts: list[tuple], kept: dict | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Log likelihood of marked texts [(token ids, gaps, [(kind, start, length)], segments of a grammar)] and its gradient by table.

        kept holds between rounds which segments of these texts have a known order."""
        kept = {} if kept is None else kept
        width = max(len(x[0]) for x in texts) + REACH
        rows = len(texts)
        ids, gaps = np.zeros((rows, width), np.int64), np.zeros((rows, width), np.int64)
        read = []
        for r, (i, g, _, found) in enumerate(texts):
            read += [(k, n, REACH + r * width + at, size) for k, n, at, size in found]
            ids[r, : len(i)], gaps[r, : len(g)] = i, g
        flat, flat_gaps = np.concatenate([[0] * REACH, ids.ravel()]), np.concatenate([[0] * REACH, gaps.ravel()])
        used, back = np.unique(flat, return_inverse=True)
        feats = np.zeros((len(used), max(1, *(len(self._feats[u]) for u in used))), np.int64)
        for n, u in enumerate(used):
            feats[n, : len(self._feats[u])] = self._feats[u]
        self._known()[2][used] = self.tables["token"][:, feats].sum(2).transpose(1, 0, 2)
        a, b, cls = self._ends(flat, flat_gaps)
        counts = self._known()[1][flat]
        sums = np.concatenate([np.zeros((1, len(_COUNTERS)), np.int64), np.cumsum(counts, 0)])
        spaces = np.concatenate([[0], np.cumsum(flat_gaps > 0)])
        real = cls != _BREAK
        run = np.concatenate([[0], np.cumsum(~real)])
        segs = []
        for k, kind in enumerate(KINDS):
            for length in range(1, min(self.longest[kind], width) + 1):
                at = np.flatnonzero(real[: len(flat) - length + 1] & (run[length:] == run[: len(run) - length]))
                segs.append((at, np.full(len(at), length), np.full(len(at), k)))
        at, length, kind = (np.concatenate(x) for x in zip(*segs))
        score = a[at, kind] + b[at + length - 1, kind]
        where = []
        for k in range(len(KINDS)):
            mine = np.flatnonzero(kind == k)
            if k not in kept:
                found = [self._order_rows(which, at[mine], length[mine], cls, flat_gaps) for which in (0, 1)]
                kept[k] = [(np.flatnonzero(x).astype(np.int32), x[x > 0].astype(np.int32)) for x in found]
            orders = []
            for to, value in kept[k]:
                orders.append(np.zeros(len(mine), np.int64))
                orders[-1][to] = value
            extra, names = self._span_scores(k, at[mine], length[mine], cls, flat_gaps, sums, spaces, read, orders)
            score[mine] += extra
            where.append((mine, names))
        # forward and backward over the places of all texts at once
        row, place = (at - REACH) // width, (at - REACH) % width
        stop = place + length
        forward, backward = np.full((rows, width + 1), -np.inf), np.full((rows, width + 1), -np.inf)
        forward[:, 0], backward[:, width] = 0.0, 0.0
        by_stop, by_start = np.argsort(stop, kind="stable"), np.argsort(place, kind="stable")
        cuts_stop, cuts_start = np.searchsorted(stop[by_stop], np.arange(width + 2)), np.searchsorted(place[by_start], np.arange(width + 2))
        for x in range(1, width + 1):
            mine = by_stop[cuts_stop[x] : cuts_stop[x + 1]]
            forward[:, x] = _logsum(rows, forward[:, x - 1], row[mine], forward[row[mine], place[mine]] + score[mine])
        for x in range(width - 1, -1, -1):
            mine = by_start[cuts_start[x] : cuts_start[x + 1]]
            backward[:, x] = _logsum(rows, backward[:, x + 1], row[mine], backward[row[mine], stop[mine]] + score[mine])
        total = forward[:, width]
        p = np.exp(forward[row, place] + score + backward[row, stop] - total[row])
        self.marginals = (row, place, length, kind, p)
        likelihood = -total.sum()
        key = (row * (width + 1) + place) * 64 + length
        key = key * 8 + kind
        sorter = np.argsort(key)
        residual = -p
        for r, (_, _, truth, _) in enumerate(texts):
            for k, i, n in truth:
                x = sorter[np.searchsorted(key, ((r * (width + 1) + i) * 64 + n) * 8 + k, sorter=sorter)]
                residual[x] += 1
                likelihood += score[x]
        # from segments to tokens
        n, kinds = len(flat), len(KINDS)
        cell = lambda place: np.bincount(place * kinds + kind, residual, n * kinds).reshape(n, kinds)
        begins, finishes = cell(at), cell(at + length - 1)
        leaves = np.concatenate([np.zeros((1, kinds)), finishes[:-1]])
        inside = np.cumsum(begins - leaves, 0)
        grads = {name: np.zeros_like(x) for name, x in self.tables.items() if not name.startswith("bound")}
        shift = lambda x, by: np.concatenate([x[by:], np.zeros_like(x[:by])])
        roles = {"in": inside, "start": begins, "prev1": shift(begins, 1), "prev2": shift(begins, 2), "bag": sum(shift(begins, d) for d in range(3, REACH + 1)), "end": finishes, "next1": np.concatenate([np.zeros((1, kinds)), finishes[:-1]]), "next2": np.concatenate([np.zeros((2, kinds)), finishes[:-2]])}
        for i, name in enumerate(ROLES):
            per = np.zeros((len(used), kinds))
            np.add.at(per, back, roles[name])
            for f in range(feats.shape[1]):
                np.add.at(grads["token"][i], feats[:, f], per)
            grads["token"][i, 0] = 0
        pair = np.empty(n, np.int64)
        pair[0] = cls[0]
        pair[1:] = (cls[:-1] * 3 + flat_gaps[1:]) * N_CLASS + cls[1:]
        following = np.append(pair[1:], 0)
        for i, (g, to) in enumerate(((inside - begins, pair), (begins, pair), (finishes, following), (begins, following), (finishes, pair))):
            np.add.at(grads["pair"][i], to, g)
        triple = _triples(cls, flat_gaps)
        for i, g in enumerate((begins, finishes, shift(begins, 1), leaves)):
            np.add.at(grads["triple"][i], triple, g)
        for mine, names in where:
            for name, to in names.items():
                grads[name] += np.bincount(to, residual[mine], len(grads[name]))
        return float(likelihood), grads


def _logsum(rows: int, base: np.ndarray, row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """log(exp(base) + sum of exp(value) by row)."""
    top = base.copy()
    np.maximum.at(top, row, value)
    safe = np.where(np.isfinite(top), top, 0.0)
    total = np.exp(base - safe) + np.bincount(row, np.exp(value - safe[row]), rows)
    with np.errstate(divide="ignore"):
        return safe + np.log(total)


def masked(text: str, spans: list[Span]) -> str:
    """The text with [EMAIL], [PHONE], [IDENTITY], [ADDRESS] and [NAME] in place of the spans, else unchanged."""
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


FOUND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType())])


def find_personal(df: DataFrame, model: SegmentField, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, start_at, end_at) for each piece of personal data, by code points from 0, end exclusive.

    Null, empty and blank texts give no row; texts are read whole; repeated rows repeat; an empty df gives no rows; other
    columns are ignored."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), *FOUND.fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["text"].notna()]
            out = [(k, what, s, e) for k, spans in zip(f["key"].tolist(), model.find_all(f["text"].tolist())) for s, e, what in spans]
            yield pd.DataFrame(out, columns=schema.names)

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInPandas(run, schema).withColumnRenamed("key", key)


def mask_personal(df: DataFrame, model: SegmentField, text: str = "text") -> DataFrame:
    """df with the text column masked; null stays null."""

    @F.pandas_udf(T.StringType())
    def mask(texts: pd.Series) -> pd.Series:
        known = [t for t in texts if t is not None]
        done = iter([masked(t, spans) for t, spans in zip(known, model.find_all(known))])
        return pd.Series([None if t is None else next(done) for t in texts], dtype=object)

    return df.withColumn(text, mask(F.col(f"`{text}`").cast("string")))
