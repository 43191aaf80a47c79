"""Problem 5: timestamps of mixed form, precision and zone as one unambiguous UTC form.

Method: every value is tokenised into a mask of character classes with run lengths; each distinct mask is compiled once
into a plan of fixed positions; all values of a mask are then read with NumPy slices, and local times are converted by
searching versioned tables of zone transitions, which the driver builds once and ships with the plan.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
import zoneinfo
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a table of sources or zone abbreviations may have; both are small lists kept by people.
SMALL_TABLE = 10_000
FIRST_YEAR, LAST_YEAR = 1970, 2100
#: A bare number of at least so many digits is Unix time, in the unit that gives a year of this span.
UNIX_DIGITS, UNIX_YEARS = 9, (2010, 2030)
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2}Z)?\z"  # of Java

# fixed values: month names in their written forms, English and Russian (nominative, genitive), lower case
MONTHS = {
    1: "january jan январь января янв", 2: "february feb февраль февраля фев", 3: "march mar март марта мар",
    4: "april apr апрель апреля апр", 5: "may май мая", 6: "june jun июнь июня июн", 7: "july jul июль июля июл",
    8: "august aug август августа авг", 9: "september sep sept сентябрь сентября сен сент", 10: "october oct октябрь октября окт",
    11: "november nov ноябрь ноября ноя", 12: "december dec декабрь декабря дек",
}
WEEKDAYS = "monday mon tuesday tue tues wednesday wed thursday thu thur thurs friday fri saturday sat sunday sun понедельник пн вторник вт среда ср четверг чт пятница пт суббота сб воскресенье вс"
MONTH_OF = {w: m for m, words in MONTHS.items() for w in words.split()}
CLASSES = {**{w: "M" for w in MONTH_OF}, **{w: "W" for w in WEEKDAYS.split()}, "am": "P", "pm": "P", "t": "T", "г": "G", "года": "G", "at": "@", "в": "@", "st": "O", "nd": "O", "rd": "O", "th": "O"}

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
_REGION = re.compile(r"\s*\[([^\]]*)\]$")
_DATE = [
    re.compile(p)
    for p in (
        r"(?P<y>D4)(?P<sep>[-/.])(?P<m>D[12])(?P=sep)(?P<d>D[12])",
        r"(?P<ymd>D8)(?=$|T1| )",
        r"(?P<a>D[12])/(?P<b>D[12])/(?P<y>D4)",
        r"(?P<a>D[12])-(?P<b>D[12])-(?P<y>D4)",
        r"(?P<d>D[12])\.(?P<m>D[12])\.(?P<y>D4)",
        r"(?P<d>D[12])(?:O2)?\.?(?: |-)(?P<mon>M\d+)\.?,?(?: |-)(?P<y>D4)(?: ?G\d+\.?)?",
        r"(?P<mon>M\d+)\.? (?P<d>D[12])(?:O2)?,? (?P<y>D4)",
        r"(?P<y>D4)(?: |-)(?P<mon>M\d+)(?: |-)(?P<d>D[12])",
    )
]
_TIME = re.compile(r"(?:T1|,? (?:@\d )?)(?:(?P<H>D[12]):(?P<M>D2)(?::(?P<S>D2)(?:[.,]D\d+)?)?|(?P<hms>D6)(?:[.,]D\d+)?|(?P<hm>D4))(?: ?(?P<p>P2))?")
_ZONE = re.compile(r" ?(?:(?P<z>Z\d+)?(?P<sign>[-+])(?:(?P<oh>D2):?(?P<om>D2)|(?P<ohm>D4)|(?P<o>D[12]))|(?P<name>Z\d+))")
_UNIX = re.compile(r"(?P<n>D(?:9|[1-9]\d+))(?:[.,]D\d+)?$")


def zone_version() -> str:
    """Version of the zone rules in use."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            if (p := Path(folder, name)).exists():
                return p.open(encoding="utf-8").readline().removeprefix("# version ").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    """Offsets of one zone. local[i] is the first local second at which offsets[i + 1] holds. At both kinds of change the
    offset before it is kept, which takes the first of two equal local times and moves skipped ones on by the gap."""

    zone: str
    version: str
    local: np.ndarray
    offsets: np.ndarray

    @classmethod
    def build(cls, name: str) -> ZoneTable:
        zone = zoneinfo.ZoneInfo(name)
        seconds = lambda t: int(zone.utcoffset(dt.datetime.fromtimestamp(t, zone)).total_seconds())
        t, end = int(dt.datetime(FIRST_YEAR, 1, 1, tzinfo=dt.UTC).timestamp()), int(dt.datetime(LAST_YEAR, 1, 1, tzinfo=dt.UTC).timestamp())
        offsets, local = [seconds(t)], []
        while t < end:
            new = seconds(t + 86_400)
            if new != offsets[-1]:
                low, high = t, t + 86_400
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (mid, high) if seconds(mid) == offsets[-1] else (low, mid)
                local.append(high + max(new, offsets[-1]))
                offsets.append(new)
            t += 86_400
        return cls(name, zone_version(), np.array(local, np.int64), np.array(offsets, np.int64))

    def utc(self, local: np.ndarray) -> np.ndarray:
        return local - self.offsets[np.searchsorted(self.local, local, "right")]


@dataclass
class Rules:
    """What the parsers need besides the value: zone tables, each source's zone and order, abbreviations in minutes."""

    zones: dict[str, ZoneTable]
    sources: dict[str, tuple[str | None, bool | None]]
    names: dict[str, int]
    plans: dict[str, Plan | None] = field(default_factory=dict)

    @classmethod
    def load(cls, sources: DataFrame, zone_names: DataFrame) -> Rules:
        """From the tables sources (source, zone, day_first) and zone_names (abbr, offset_min), both short."""
        src, abbr = (t.limit(SMALL_TABLE + 1).collect() for t in (sources.select("source", "zone", "day_first"), zone_names.select("abbr", "offset_min")))
        if max(len(src), len(abbr)) > SMALL_TABLE:
            raise ValueError(f"a table of sources or zone names has more than {SMALL_TABLE} rows")
        zones = {z: ZoneTable.build(z) for z in sorted({r.zone for r in src if r.zone})}
        names = {"z": 0, "utc": 0, "gmt": 0, **{r.abbr.lower(): r.offset_min for r in abbr if r.abbr is not None and r.offset_min is not None}}
        return cls(zones, {r.source: (r.zone, r.day_first) for r in src if r.source is not None}, names)


@dataclass
class Plan:
    """Fixed positions of the parts in all values of one mask."""

    at: dict[str, tuple[int, int]]
    by_day_first: bool = False
    unix: bool = False
    time: bool = False


def mask_of(value: str, names: dict[str, int]) -> str:
    """Runs of digits as D and their length; known words as their class and length; other letters a and length; white space
    as one blank and its length if longer; all else as it is."""
    out = []
    for tok in _TOKEN.findall(value):
        c = tok[0]
        if "0" <= c <= "9":
            out.append(f"D{len(tok)}")
        elif c.isalpha():
            low = tok.lower()
            out.append(f"{'Z' if low in names else CLASSES.get(low, 'a')}{len(tok)}")
        elif c.isspace():
            out.append(" " if len(tok) == 1 else f"_{len(tok)}")
        else:
            out.append("-" if c == "−" else c)
    return "".join(out)


def compile_mask(mask: str) -> Plan | None:
    """The plan of a mask, None if it names no day."""
    # places of the mask's tokens in the value
    spots, at = {}, 0
    for m in re.finditer(r"([DMWPTGOZa@_])(\d+)|(.)", mask, re.DOTALL):
        spots[m.start()] = at
        at += int(m[2]) if m[1] else 1
    shape = re.sub(r"_\d+", " ", mask)
    if shape != mask:  # longer white space: positions come from the mask, the grammar sees one blank
        moved, s = {}, 0
        for m in re.finditer(r"_(\d+)|[DMWPTGOZa@]\d+|.", mask, re.DOTALL):
            moved[s] = spots[m.start()]
            s += 1 if m[1] else len(m[0])
        spots = moved
    span = lambda m, g: (spots[m.start(g)], spots[m.start(g)] + int(m[g][1:]))
    if m := _UNIX.match(shape):
        return Plan({"n": span(m, "n")}, unix=True)
    start = re.match(r"(?:W\d+\.?,? )?", shape).end()
    for p in _DATE:
        if not (m := p.match(shape, start)):
            continue
        parts = {g: span(m, g) for g, v in m.groupdict().items() if v and g != "sep"}
        end, timed = m.end(), False
        if t := _TIME.match(shape, end):
            parts |= {g: span(t, g) for g, v in t.groupdict().items() if v}
            end, timed = t.end(), True
            if z := _ZONE.match(shape, end):
                parts |= {g: (spots[z.start(g)],) * 2 if g == "sign" else span(z, g) for g, v in z.groupdict().items() if v}
                end = z.end()
        if end == len(shape):
            return Plan(parts, by_day_first="a" in parts, time=timed)
    return None


def _number(chars: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    digits = chars[:, at[0] : at[1]].astype(np.int64) - 48
    return digits @ (10 ** np.arange(digits.shape[1] - 1, -1, -1, dtype=np.int64))


def _words(values: list[str], at: tuple[int, int], table: dict[str, int]) -> np.ndarray:
    return np.array([table.get(v[at[0] : at[1]].lower(), -(10**6)) for v in values], np.int64)


_LENGTHS = np.array([[calendar.monthrange(y, m)[1] if m else 0 for m in range(13)] for y in (2023, 2024)])


def _run(plan: Plan, values: list[str], sources: list[str | None], regions: list[str | None], rules: Rules) -> np.ndarray:
    n = len(values)
    chars = np.array(values).view(np.uint32).reshape(n, -1)
    at, out = plan.at, np.full(n, None, object)
    if plan.unix:
        x = _number(chars, at["n"]) if at["n"][1] - at["n"][0] <= 18 else np.array([min(int(v[: at["n"][1]]), 2**62) for v in values], np.int64)
        low, high = (int(dt.datetime(y, 1, 1, tzinfo=dt.UTC).timestamp()) for y in (UNIX_YEARS[0], UNIX_YEARS[1] + 1))
        found = np.zeros(n, bool)
        secs = np.zeros(n, np.int64)
        for unit in (1, 10**3, 10**6, 10**9):
            s = x // unit
            hit = ~found & (s >= low) & (s < high)
            secs[hit], found = s[hit], found | hit
        out[found] = [f"{t}Z" for t in secs[found].astype("datetime64[s]").astype(str)]
        return out
    if "ymd" in at:
        x = _number(chars, at["ymd"])
        y, m, d = x // 10_000, x // 100 % 100, x % 100
    else:
        y = _number(chars, at["y"])
        if plan.by_day_first:
            a, b = _number(chars, at["a"]), _number(chars, at["b"])
            first = [rules.sources.get(s, (None, None))[1] for s in sources]
            day_leads, known = np.array([f is True for f in first]), np.array([f is not None for f in first])
            d, m = np.where(day_leads, a, b), np.where(known, np.where(day_leads, b, a), 0)
        else:
            m = _words(values, at["mon"], MONTH_OF) if "mon" in at else _number(chars, at["m"])
            d = _number(chars, at["d"])
    good = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    m = np.where(good, m, 1)
    leap = ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))).astype(int)
    good &= d <= _LENGTHS[leap, m]
    months = (np.where(good, y, 1970) - 1970) * 12 + m - 1
    days = months.astype("datetime64[M]").astype("datetime64[D]") + np.where(good, d - 1, 0)
    if not plan.time:
        out[good] = days[good].astype(str)
        return out
    zero = np.zeros(n, np.int64)
    if "hms" in at:
        x = _number(chars, at["hms"])
        hh, mm, ss = x // 10_000, x // 100 % 100, x % 100
    elif "hm" in at:
        x = _number(chars, at["hm"])
        hh, mm, ss = x // 100, x % 100, zero
    else:
        hh, mm, ss = _number(chars, at["H"]), _number(chars, at["M"]), _number(chars, at["S"]) if "S" in at else zero
    if "p" in at:
        good &= (hh >= 1) & (hh <= 12)
        hh = hh % 12 + 12 * np.array([v[at["p"][0]] in "pP" for v in values])
    good &= (mm < 60) & (ss <= 60) & ((hh < 24) | ((hh == 24) & (mm == 0) & (ss == 0)))
    local = days.astype("datetime64[s]").astype(np.int64) + hh * 3600 + mm * 60 + ss
    if "sign" in at:
        sign = np.where(chars[:, at["sign"][0]] == ord("+"), 1, -1)
        if "ohm" in at:
            x = _number(chars, at["ohm"])
            minutes = x // 100 * 60 + x % 100
        elif "oh" in at:
            minutes = _number(chars, at["oh"]) * 60 + _number(chars, at["om"])
        else:
            minutes = _number(chars, at["o"]) * 60
        good &= minutes <= 18 * 60
        utc = local - sign * minutes * 60
    elif "name" in at:
        minutes = _words(values, at["name"], rules.names)
        good &= minutes > -(10**6)
        utc = local - minutes * 60
    else:
        utc = np.zeros(n, np.int64)
        home = [r or rules.sources.get(s, (None, None))[0] for s, r in zip(sources, regions)]
        for z in set(home):
            mine = np.array([h == z for h in home])
            if z and z not in rules.zones:
                try:
                    rules.zones[z] = ZoneTable.build(z)
                except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
                    rules.zones[z] = None
            if table := rules.zones.get(z):
                utc[mine] = table.utc(local[mine])
            else:
                good &= ~mine
    out[good] = [f"{t}Z" for t in utc[good].astype("datetime64[s]").astype(str)]
    return out


def convert(values: pd.Series, sources: pd.Series, rules: Rules) -> pd.Series:
    """The UTC form of each value, None where it is null or names no valid day."""
    groups: dict[str, list[int]] = {}
    texts, regions = [], []
    for i, v in enumerate(values):
        v = "" if v is None else v.strip()
        region = None
        if v.endswith("]") and (m := _REGION.search(v)):
            v, region = v[: m.start()], m[1]
        texts.append(v)
        regions.append(region)
        if v:
            groups.setdefault(mask_of(v, rules.names), []).append(i)
    out = np.full(len(texts), None, object)
    src = list(sources)
    for mask, rows in groups.items():
        plan = rules.plans.get(mask, ...)
        if plan is ...:
            if len(rules.plans) > 100_000:  # masks of garbage; compiled again when met again
                rules.plans.clear()
            plan = compile_mask(mask)
            if len(mask) <= 256:
                rules.plans[mask] = plan
        if plan:
            out[rows] = _run(plan, [texts[i] for i in rows], [src[i] for i in rows], [regions[i] for i in rows], rules)
    return pd.Series(out, dtype=object)


def normalise_instants(df: DataFrame, key: str, fields: list[str], source: str, rules: Rules) -> DataFrame:
    """(doc_id, field, raw, utc) for every value of the fields that isn't null: utc is YYYY-MM-DD for a day, else
    YYYY-MM-DDTHH:MM:SSZ, null if the value names no valid day or needs a zone or order its source doesn't give.

    Values in canonical form pass unchanged, without leaving the JVM. Rows repeat as in df; empty df: no rows; columns
    of df besides those named are ignored."""

    @F.pandas_udf(T.StringType())
    def parse(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, s in frames:
            yield convert(v, s, rules)

    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("raw")) for c in fields)))
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), pairs.alias("x")).select("doc_id", "source", "x.field", "x.raw").where("raw is not null")
    plain = F.col("raw").rlike(CANONICAL)
    kept = rows.where(plain).select("doc_id", "field", "raw", F.col("raw").alias("utc"))
    parsed = rows.where(~plain).select("doc_id", "field", "raw", parse("raw", "source").alias("utc"))
    return kept.unionByName(parsed)


def changed_instants(df: DataFrame, key: str, fields: list[str], source: str, rules: Rules) -> DataFrame:
    """Distinct (doc_id, field, utc) of the values that weren't canonical and name a day."""
    found = normalise_instants(df, key, fields, source, rules).where(~F.col("raw").rlike(CANONICAL) & F.col("utc").isNotNull())
    return found.select("doc_id", "field", "utc").distinct()
