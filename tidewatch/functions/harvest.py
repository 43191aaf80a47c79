"""Time of a harvest as a number the JVM works out, to order the rows of one document.

The strings have the forms that ``instants`` reads; here only their order counts, so everything is an expression: no value
leaves the JVM, and a query that needs three columns of works scans four."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.instants import MONTH_OF, SMALL_TABLE, UNIX_DIGITS
from tidewatch.functions.text import let

DAY = 86_400


@dataclass(frozen=True)
class Homes:
    """Zone and order of day and month of each source, and minutes of each zone abbreviation; both tables are short."""

    zones: dict[str, str]
    day_first: dict[str, bool]
    minutes: dict[str, int]

    @classmethod
    def load(cls, sources: DataFrame, zone_names: DataFrame) -> Homes:
        src, abbr = (t.limit(SMALL_TABLE + 1).collect() for t in (sources.select("source", "zone", "day_first"), zone_names.select("abbr", "offset_min")))
        if max(len(src), len(abbr)) > SMALL_TABLE:
            raise ValueError(f"a table of sources or zone names has more than {SMALL_TABLE} rows")
        return cls({r.source: r.zone for r in src if r.source and r.zone}, {r.source: r.day_first for r in src if r.source and r.day_first is not None}, {r.abbr.lower(): r.offset_min for r in abbr if r.abbr and r.offset_min is not None})


def _lookup(table: dict, key: Column, kind: str) -> Column:
    if not table:
        return F.lit(None).cast(kind)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair)), key).cast(kind)


def _number(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


# one pass over a string cuts it into year|month|day|hour|minute|second|half of the day|zone|what parts day and month
_TIME = r"(?:(?:[tT]|,? ?(?:at |в )?)(\d{1,2}):?(\d{2})(?::?(\d{2}))?(?:[.,]\d+)?(?: ?([aApP][mM])(?!\p{L}))?)? ?((?:\p{L}{1,5})?(?:[-+]\d{1,2}:?(?:\d{2})?)?)$"
_FORMS = [  # how a form begins, all of it, and the cut
    (r"^\d{4}", r"^(\d{4})([-/.]?)(\d{1,2})\2(\d{1,2})(?!\d)" + _TIME, "$1|$3|$4|$5|$6|$7|$8|$9|-"),
    (r"^\d{1,2}[-/.]\d", r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?!\d)" + _TIME, "$4|$3|$1|$5|$6|$7|$8|$9|$2"),
    (r"^(?:\p{L}+\.?,? )?\d{1,2}(?:\p{Ll}\p{Ll})?\.?[ -]\p{L}", r"^(?:\p{L}+\.?,? )?(\d{1,2})(?:st|nd|rd|th)?\.?[ -](\p{L}+)\.?,?[ -](\d{4})(?!\d)(?: ?(?:г|года)\.?)?" + _TIME, "$3|$2|$1|$4|$5|$6|$7|$8|-"),
    (r"^\p{L}", r"^(?:\p{L}+\.?,? )?(\p{L}+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?!\d)" + _TIME, "$3|$1|$2|$4|$5|$6|$7|$8|-"),
]
_OFFSET = r"([-+])(\d{1,2}):?(\d{2})?$"


def instant(value: str = "harvested_at", source: str = "source", homes: Homes | None = None) -> Column:
    """Seconds since 1970 in UTC of a string in any of the known forms, null if it names no day; a day counts from its midnight.

    Without homes, local times are taken as UTC and slashes as day first."""
    homes = homes or Homes({}, {}, {})
    raw = F.col(f"`{value}`")
    canonical = F.when(raw.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z"), _seconds(F.try_to_date(F.substring(raw, 1, 10)), _number(F.substring(raw, 12, 2)), _number(F.substring(raw, 15, 2)), _number(F.substring(raw, 18, 2))))
    v = F.regexp_replace(F.regexp_replace(raw, r"\s*\[[^\]]*\]\s*$", ""), r"^\s+|\s+$", "")
    return F.coalesce(canonical, let(F.regexp_replace(v, r"\s+", " "), lambda v: F.when(v.rlike(rf"^\d{{{UNIX_DIGITS},}}([.,]\d+)?$"), _unix(v)).otherwise(_written(v, F.col(f"`{source}`"), homes))))


def _unix(v: Column) -> Column:
    n = F.regexp_extract(v, r"^\d+", 0)
    size = F.length(n)
    return F.substring(n, F.lit(1), F.when(size <= 11, size).when(size <= 14, size - 3).when(size <= 17, size - 6).otherwise(size - 9)).cast("long")


def _seconds(day: Column, h: Column, m: Column, s: Column) -> Column:
    return F.date_diff(day, F.lit("1970-01-01").cast("date")).cast("long") * DAY + F.coalesce(h, F.lit(0)) * 3600 + F.coalesce(m, F.lit(0)) * 60 + F.coalesce(s, F.lit(0))


def _written(v: Column, source: Column, homes: Homes) -> Column:
    cut = F.when(F.lit(False), v)
    for begins, whole, parts in _FORMS:
        cut = cut.when(v.rlike(begins), F.regexp_replace(v, whole, parts))
    return let(F.split(cut, r"\|"), lambda p: F.when(F.size(p) == 9, _moved(p, source, homes)))


def _moved(p: Column, source: Column, homes: Homes) -> Column:
    """Seconds of the parts of a string."""
    part = lambda i: F.get(p, F.lit(i))
    second, third = part(1), part(2)
    swap = (part(8) == "/") & ~F.coalesce(_lookup(homes.day_first, source, "boolean"), F.lit(True))  # month before day
    month, day = F.when(swap, third).otherwise(second), F.when(swap, second).otherwise(third)
    month = F.when(month.rlike(r"^\d"), _number(month)).otherwise(_lookup(MONTH_OF, F.lower(month), "int"))
    date = F.try_to_date(F.format_string("%s-%02d-%02d", part(0), month, _number(day)))
    half = F.lower(part(6))
    hour = F.when(half == "", _number(part(3))).otherwise(_number(part(3)) % 12 + F.when(half == "pm", 12).otherwise(0))
    local, zone = _seconds(date, hour, _number(part(4)), _number(part(5))), part(7)
    sign = F.when(F.regexp_extract(zone, _OFFSET, 1) == "-", -1).otherwise(1)
    minutes = (_number(F.regexp_extract(zone, _OFFSET, 2)) * 60 + F.coalesce(_number(F.regexp_extract(zone, _OFFSET, 3)), F.lit(0))) * sign
    offset = F.when(F.lower(zone).isin("z", "utc", "gmt"), 0).when(zone.rlike(_OFFSET), minutes).otherwise(_lookup(homes.minutes, F.lower(zone), "int"))
    # a local second of a zone, moved to UTC by the JVM's rules: the first of two equal ones, a skipped one on by the gap
    wall = F.timestamp_add("SECOND", local, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    moved = F.convert_timezone(_lookup(homes.zones, source, "string"), F.lit("UTC"), wall)
    at_home = F.when((part(3) != "") & (zone == ""), _seconds(moved.cast("date"), F.hour(moved), F.minute(moved), F.second(moved)))
    return F.coalesce(local - offset.cast("long") * 60, at_home, local)
