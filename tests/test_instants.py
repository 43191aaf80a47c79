import datetime as dt
import random
import zoneinfo

import pandas as pd
import pytest

from tidewatch.functions.instants import ZoneTable, changed_instants, convert, mask_of, normalise_instants, Rules

SOURCES = {"ny": ("America/New_York", False), "be": ("Europe/Berlin", True), "sy": ("Australia/Sydney", True), "utc": ("UTC", True)}
NAMES = {"z": 0, "utc": 0, "gmt": 0, "cet": 60, "msk": 180, "мск": 180, "edt": -240}


@pytest.fixture(scope="module")
def rules():
    return Rules({z: ZoneTable.build(z) for z, _ in SOURCES.values()}, SOURCES, NAMES)


CASES = [
    ("utc", "2024-02-29", "2024-02-29"), ("utc", "2023-02-29", None), ("utc", "20240131", "2024-01-31"), ("ny", "03/04/2024", "2024-03-04"), ("be", "03/04/2024", "2024-04-03"), ("ny", "2024/03/04", "2024-03-04"), ("ny", "04.03.2024", "2024-03-04"),
    ("utc", "12 Jul 2026", "2026-07-12"), ("utc", "July 12, 2026", "2026-07-12"), ("utc", "16 июня 2025 г.", "2025-06-16"), ("utc", "7 мая 2025 г. 00:52 МСК", "2025-05-06T21:52:00Z"), ("utc", "Thu, 16 Apr 2026 01:27:37 GMT", "2026-04-16T01:27:37Z"), ("utc", "Wed, 8 Apr 2026 22:52:15 -0400", "2026-04-09T02:52:15Z"),
    ("utc", " 2026-05-18t01:33:06z ", "2026-05-18T01:33:06Z"), ("utc", "2026-04-11T00:58:56,287-04", "2026-04-11T04:58:56Z"), ("utc", "2024-10-06 15:22:56.176880+05:30", "2024-10-06T09:52:56Z"), ("utc", "2025-09-13T06:00:21+01:00[Europe/London]", "2025-09-13T05:00:21Z"), ("utc", "20240927T105152Z", "2024-09-27T10:51:52Z"),
    ("utc", "2024-04-29 18:56:18 CET", "2024-04-29T17:56:18Z"), ("utc", "1768901156", "2026-01-20T09:25:56Z"), ("utc", "1507198521603", "2017-10-05T10:15:21Z"), ("utc", "1737900660419110", "2025-01-26T14:11:00Z"), ("utc", "1780260940.257", "2026-05-31T20:55:40Z"),
    ("ny", "2024-03-10 02:30:00", "2024-03-10T07:30:00Z"), ("ny", "2024-11-03 01:30:00", "2024-11-03T05:30:00Z"), ("be", "2024-03-31T02:10:00", "2024-03-31T01:10:00Z"), ("ny", "03/10/2024 12:05 AM", "2024-03-10T05:05:00Z"), ("ny", "03/10/2024 12:05 PM", "2024-03-10T16:05:00Z"), ("sy", "28/10/2023 23:30", "2023-10-28T12:30:00Z"),
    ("utc", "2024", None), ("utc", "2024-05", None), ("utc", "", None), ("utc", "   ", None), ("utc", None, None), ("utc", "soon", None), ("utc", "2024-05-01T25:00:00Z", None), ("utc", "x" * 100_000, None), ("nowhere", "2024-05-01 10:00", None), ("nowhere", "2024-05-01 10:00 +02:00", "2024-05-01T08:00:00Z"), ("utc", "99999999999999999999999", None),
]


@pytest.mark.parametrize("source,value,expected", CASES)
def test_forms(rules, source, value, expected):
    assert convert(pd.Series([value], dtype=object), pd.Series([source]), rules)[0] == expected


def test_local_times_equal_brute_force(rules):
    """Every hour of several years against the definition: the first of two, moved on by the gap."""
    r = random.Random(1)
    for name in ("America/New_York", "Europe/Berlin", "Australia/Sydney"):
        zone, table = zoneinfo.ZoneInfo(name), rules.zones[name]
        for _ in range(3000):
            local = dt.datetime(2010, 1, 1) + dt.timedelta(minutes=30 * r.randrange(48 * 365 * 20))
            first = local.replace(tzinfo=zone, fold=0).astimezone(dt.UTC)  # fold 0 takes the offset before a change
            assert int(table.utc(pd.Series([int(local.replace(tzinfo=dt.UTC).timestamp())]).to_numpy())[0]) == int(first.timestamp())


def test_masks_are_few(rules):
    assert mask_of("2024-01-02T03:04:05Z", NAMES) == mask_of("1999-12-31t23:59:59z", NAMES)
    assert mask_of("5 May 2023", NAMES) == mask_of("7 Jun 2021", NAMES)


def test_frames(spark, rules):
    schema = "doc_id string, source string, date string, harvested_at string, utc string, field int"
    df = spark.createDataFrame([("a", "ny", "03/04/2024", "2024-01-01T00:00:00Z", "x", 1), ("a", "ny", "03/04/2024", None, "x", 1), (None, None, "2024-01-05\n", "2024-01-05", None, None)], schema)
    rows = {(r.doc_id, r.field, r.utc) for r in changed_instants(df, "doc_id", ["date", "harvested_at"], "source", rules).collect()}
    assert rows == {("a", "date", "2024-03-04"), (None, "date", "2024-01-05")}
    assert normalise_instants(df, "doc_id", ["date", "harvested_at"], "source", rules).count() == 5
    assert changed_instants(df.limit(0), "doc_id", ["date"], "source", rules).count() == 0


def test_values_of_any_length_are_read(rules):
    wide = "2024-03-10" + " " * 90 + "12:30:00" + " " * 70 + "+01:00"
    assert list(convert(pd.Series([wide, "x" * 200_000, "1 " * 50_000, "2024-03-10T10:00:00." + "7" * 120 + "Z"]), pd.Series(["utc"] * 4), rules)) == ["2024-03-10T11:30:00Z", None, None, "2024-03-10T10:00:00Z"]
