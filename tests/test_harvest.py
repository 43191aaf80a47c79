import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidewatch.functions import harvest, instants
from tidewatch.operators import series
from tidewatch.plans import reference_queries as q

FOLDER = str(DATA / "sf0.001")


def test_instant_equals_the_parser_of_all_forms(spark):
    table = lambda n: spark.read.parquet(f"{FOLDER}/{n}.parquet")
    homes, rules = harvest.Homes.load(table("sources"), table("zone_names")), instants.Rules.load(table("sources"), table("zone_names"))
    rows = table("works").select("harvested_at", "date", "source").unionByName(
        spark.createDataFrame([(v, "", "gnews") for v in ("12/31/2024 11:05 PM", "2024-02-30", "soon", "", " 5 мая 2026 г. 12:26 МСК", "2024-03-10 02:30:00", "Jan. 3rd, 2025 at 4:05 pm", "2025-01-02T03:04:05+05:30[Asia/Kolkata]", "1700000000", "1700000000123456789", "3 Oct 2025", "2024/7/9 5:06")], "harvested_at string, date string, source string")
    )
    for field in ("harvested_at", "date"):
        got = rows.select(field, "source", harvest.instant(field, homes=homes).alias("t")).distinct().collect()
        for r in got:
            (want,) = instants.convert([r[field]], [r.source], rules) if r[field] is not None else (None,)
            seconds = None if want is None else int(dt.datetime.fromisoformat(want if "T" in want else want + "T00:00:00+00:00").timestamp())
            assert r.t == seconds, (r, want)


def test_first_harvest_by_instant(spark):
    rows = [("a", "2025-03-01T00:00:00Z", "s", 1), ("a", "1700000000", "s", 2), ("a", "28.02.2025 10:00", "s", 3), ("b", "later", "s", 4), ("b", "2025-03-01 00:00 +05:00", "s", 5), ("b", "2025-02-28T20:00:00Z", "s", 6), (None, "2025-03-01T00:00:00Z", "s", 7), ("c", None, "s", 9), ("c", "??", "s", 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id string, harvested_at string, source string, x int, n string")
    got = {r.doc_id: r.x for r in series.first_harvest(df, "x").collect()}
    assert got == {"a": 2, "b": 5, "c": 8}
    assert series.first_harvest(df).columns == ["doc_id", "harvested_at", "source", "x", "n"]
    assert series.first_harvest(df.limit(0), "x").count() == 0


def test_counts_scan_only_what_they_need(spark):
    plan = series.year_counts(q.joined(spark, FOLDER, "year", "doc_type"))._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line and "harvested_at" in line]
    assert scans and all("ReadSchema: struct<doc_id:string,source:string,doc_type:string,year:int,harvested_at:string>" in s for s in scans)


def test_equal_instants_are_ordered_by_content(spark):
    df = spark.createDataFrame([("a", "2025-03-01T00:00:00Z", "s", 2), ("a", "2025-03-01 00:00 +00:00", "s", 1)] * 3, "doc_id string, harvested_at string, source string, x int")
    assert series.first_harvest(df.repartition(4), "x").where(F.col("x") == 1).count() == 1
