"""Column functions on text: tokens, n-grams, normal forms, hosts, URLs, identifiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: stop words of n-grams, English and Russian
STOP = (
    "a an the of in on for to and or with by from at as is are was were this that these those using based study analysis approach new via into "
    "и в во на для с со к по из от о об а но или это как при исследование анализ новый новая новые"
).split()
TOKEN = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
TITLE_CHARS, TITLE_TOKENS = 4096, 128
# fixed values: the longer English stop list and the ASCII tokens of the first prototype
PROTOTYPE_STOP = (
    "a an the of for and or in on to with by from using based via as at is are was were be been this that these those we our their its it his her they he she you your not no non can could may might "
    "new novel study studies research analysis approach method methods model models system systems paper article review survey towards toward use uses used case cases results result data "
    "between during under over about into through than then them us all any each more most other others such which who whom whose what when where why how have has had do does did but if than so "
    "one two three first second third high low large small good better best big application applications framework technique techniques design development evaluation performance "
    "comparison comparative effect effects impact role state art review overview introduction chapter"
).split()
PROTOTYPE_TOKEN = r"[a-z][a-z0-9\-\+]{1,}"
# fixed values: English words that end in s without being plurals
SINGULAR = "analysis bus gas lens series bias physics mathematics statistics genesis basis corpus".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: inside a lambda an outer expression is evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case words, joined by inner hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def ngrams(title: Column, low: int = 2, high: int = 4, stop: Sequence[str] = STOP, token: str = TOKEN) -> Column:
    """Distinct contiguous n-grams of the bounded title: no stop word at an edge, at most size - 2 inside, not all words of one
    or two letters. Null and short titles give the empty list."""
    t = F.slice(F.regexp_extract_all(F.lower(F.substring(F.coalesce(title, F.lit("")), 1, TITLE_CHARS)), F.lit(token), F.lit(0)), 1, TITLE_TOKENS)

    def of(w: Column, size: int) -> Column:
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))
        good = F.filter(
            F.transform(starts, lambda i: F.slice(w, i, size)),
            lambda g: ~F.get(g, F.lit(0)).isin(*stop) & ~F.get(g, F.lit(size - 1)).isin(*stop) & (F.size(F.filter(g, lambda x: x.isin(*stop))) <= size - 2) & F.exists(g, lambda x: F.length(x) > 2),
        )
        return F.transform(good, lambda g: F.array_join(g, " "))

    return F.array_distinct(let(t, lambda w: F.flatten(F.array(*(of(w, n) for n in range(low, high + 1))))))


def lemma(word: Column) -> Column:
    """Crude singular of an English word."""
    w = F.lower(word)
    n = F.length(w)
    return (
        F.when(w.isin(*SINGULAR) | (n <= 3), w).when(w.endswith("ies") & (n > 4), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when(w.rlike("(s|x|z|ch|sh)es$"), F.substring(w, F.lit(1), n - 2)).when(w.endswith("ss"), w).when(w.endswith("s"), F.substring(w, F.lit(1), n - 1)).otherwise(w)
    )


def strip_publisher(title: Column) -> Column:
    """Title before its last ' - '."""
    return F.regexp_replace(title, r"^(.*) - .*$", "$1")


def norm_title(title: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def norm_entity(label: Column) -> Column:
    """Without a leading article or demonstrative and a nationality or Startup before the name."""
    return F.regexp_replace(F.trim(label), r"(?i)^(?:(?:the|new|this|a|an)\s+)?(?:(?:american|british|chinese|french|german|indian|israeli|russian|european|ai|fintech|biotech|startup)\s+)?(?=\S)", "")


def host_of(url: Column) -> Column:
    """Lower-case ASCII host of an http(s) URL or bare domain; null for credentials, white space, backslashes, bad labels or ports."""
    plain = F.when(~url.rlike(r"[\s\\]") & (url != ""), url)
    rest = F.when(plain.rlike(r"(?i)^https?://"), F.regexp_replace(plain, r"(?i)^https?://", "")).when(~plain.contains("://"), F.regexp_replace(plain, r"^//", ""))
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(authority, r"^([^:]*)", 1), r"\.$", ""))
    port = F.regexp_extract(authority, r":(.*)$", 1)
    good_port = ~authority.contains(":") | (port.rlike(r"^[0-9]{0,5}$") & F.coalesce(F.try_to_number(F.nullif(port, F.lit("")), F.lit("99999")), F.lit(1)).between(1, 65535))
    label = r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
    return F.when(~authority.contains("@") & good_port & (F.length(host) <= 253) & host.rlike(rf"^{label}(\.{label})*$"), host)


@F.pandas_udf(T.StringType())
def host_idna(urls: pd.Series) -> pd.Series:
    """As host_of for hosts with letters beyond ASCII, which only a codec can map."""
    from urllib.parse import urlsplit

    def one(value: str | None) -> str | None:
        if not value or any(c.isspace() for c in value) or "\\" in value:
            return None
        try:
            parts = urlsplit(value if "://" in value else "//" + value)
            if (parts.scheme and parts.scheme.lower() not in ("http", "https")) or parts.username is not None or parts.port == 0:
                return None
            return (parts.hostname or "").rstrip(".").encode("idna").decode("ascii").lower() or None
        except (ValueError, UnicodeError):
            return None

    return urls.map(one)


def norm_host(url: Column) -> Column:
    """host_of, and for hosts with letters beyond ASCII their IDNA form; no ASCII URL leaves the JVM."""
    return F.coalesce(host_of(url), host_idna(F.when(url.rlike(r"[^\x00-\x7f]"), url)))


def suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: for an equi-join with rules by domain."""
    return let(F.split(host, r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p) - i + 1), ".")))


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no fragment, no tracking or blank parameters, the others sorted."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    head = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda q: q.rlike(r"^[^=]+=.+") & ~q.rlike(r"^(utm_[^=]*|fbclid|gclid)=")))
    return F.when(F.size(kept) > 0, F.concat(head, path, F.lit("?"), F.array_join(kept, "&"))).otherwise(F.concat(head, path))


def is_public_url(url: Column) -> Column:
    """An http(s) URL whose host isn't local, private or a service name."""
    host = host_of(url)
    return url.rlike(r"(?i)^https?://") & host.contains(".") & ~host.rlike(r"^(localhost|.*\.(local|internal|localdomain|home|lan))$") & ~host.rlike(r"^(10|127|0|169\.254|192\.168|172\.(1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\.")


def clean_term(term: Column, business: tuple[str, ...] = ("market", "funding", "startup", "company", "industry", "report", "news", "business")) -> Column:
    """Trimmed, lower, single spaces; null unless 1..4 words, 4 letters or more and no business word."""
    t = F.regexp_replace(F.trim(F.lower(term)), r"\s+", " ")
    w = F.split(t, " ")
    return F.when(F.size(w).between(1, 4) & (F.length(t) >= 4) & ~F.exists(w, lambda x: x.isin(*business)), t)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def hash_id(prefix: str, domain: Column, value: Column, digits: int = 24) -> Column:
    """prefix:domain:digest, which depends on domain and value only."""
    return F.concat(F.lit(prefix + ":"), domain, F.lit(":"), F.substring(F.sha2(F.concat(domain, F.lit("\0"), value), 256), 1, digits))


def term_pattern(term: str) -> str:
    """Whole words, with an optional plural s, whatever the case; for Java."""
    import re

    return rf"(?iU)(?<![\w-]){re.escape(term)}s?(?![\w-])"


def abstract_of(index: Column) -> Column:
    """Text of an inverted index word -> positions; null stays null."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x.w), " ")


# fixed values: words that mark a technology, an event, a disease, an entity, English and Russian
TECHNOLOGY = r"\b(?:neural|networks?|computing|quantum|algorithms?|learning|robotics?|transformers?|semiconductors?|sensors?|photonic\w*|nanotech\w*|bioprint\w*|crispr|immunotherap\w*|vaccin\w*|sequencing|gene editing|genome editing|gene therapy|drug delivery|cybersecurity|cyber[- ]security|encryption|cryptograph\w*|кибербезопасност\w*|криптограф\w*|шифрован\w*|нейрон\w*|нейросет\w*|квантов\w*|вычислен\w*|алгоритм\w*|робот\w*|сенсор\w*|полупроводник\w*|фотон\w*|редактирован\w* геном\w*|генн\w* терап\w*|вакцин\w*|иммунотерап\w*|секвенирован\w*)\b"
EVENT = r"\b(?:pandemic|epidemic|war|пандеми\w*|эпидеми\w*)\b"
DISEASE = r"\b(?:covid(?:-19)?|cancer|diabetes|alzheimer\w*|disease\w*|рак|диабет\w*|болезн\w*)\b"
ENTITY = r"\b(?:united states|united kingdom|china|russia|university|organization|росси\w*|китай\w*|университет\w*|организаци\w*)\b"
TERMINAL = "neural artificial convolutional recurrent".split()


def technology_reason(text: Column, technology: str = TECHNOLOGY) -> Column:
    """Null: accepted; else why not, in this order."""
    t = F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")
    last = F.try_element_at(tokens(t), F.lit(-1))
    has = lambda p: t.rlike("(?U)" + p)
    return (
        F.when(t == "", "empty").when(last.isin(*TERMINAL), "terminal modifier").when(has(technology), None).when(has(EVENT), "event").when(has(DISEASE), "disease").when(has(ENTITY), "entity").otherwise("no technology marker")
    )


def matches_topic(title: Column, phrases: list[str], stop: tuple[str, ...] = ("the", "of", "and", "for", "in", "on", "a", "an", "to", "with")) -> Column:
    """A phrase stands in the title as a token sequence, or two of its words that are no stop words do, or its only one."""
    t = tokens(title)
    joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    hit = F.lit(False)
    for p in phrases:
        w = tokens(F.lit(p))
        content = F.filter(w, lambda x: ~x.isin(*stop))
        both = F.size(F.array_intersect(t, content))
        hit = hit | joined.contains(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))) | (both >= F.when(F.size(content) > 1, 2).otherwise(1))
    return hit


def is_gibberish(text: str) -> bool:
    """Whether a query is a run of neighbouring keys; one value, on the driver."""
    rows = ["qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю"]
    spot = {c: (r, i) for r, row in enumerate(rows) for i, c in enumerate(row)}
    words_ = text.lower().split()
    if len("".join(words_)) < 2:
        return True

    def longest(w: str) -> int:
        best = run = 1
        way = 0
        for a, b in zip(w, w[1:]):
            d = spot[b][1] - spot[a][1] if a in spot and b in spot and spot[a][0] == spot[b][0] else 0
            run = run + 1 if abs(d) == 1 and d == (way or d) else 2 if abs(d) == 1 else 1
            way = d if abs(d) == 1 else 0
            best = max(best, run)
        return best

    return any(len(w) >= 4 and longest(w) >= max(4, 0.6 * len(w)) for w in words_)
