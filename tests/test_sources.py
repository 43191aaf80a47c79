import pytest

from tidewatch.sources import paged, records


def put(folder, year, page, lines):
    (folder / str(year)).mkdir(parents=True, exist_ok=True)
    (folder / str(year) / f"{page}.jsonl").write_text("\n".join(lines))


def drained(spark, folder, work):
    q = spark.readStream.format("paged_records").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", f"{work}/c").option("path", f"{work}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.read.schema(paged.SCHEMA).parquet(f"{work}/out").collect()))


def test_stream_goes_on_where_it_stopped_and_waits_for_late_pages(spark, tmp_path):
    paged.register(spark)
    folder, work = tmp_path / "in", tmp_path / "work"
    put(folder, 2024, 1, ['{"id": 1}', "broken", "[1]"])
    put(folder, 2024, 3, ['{"id": 3}'])  # page 2 is late
    put(folder, 2025, 0, ['{"id": 9}'])
    assert drained(spark, folder, work) == [(2024, 1, '{"id": 1}'), (2025, 0, '{"id": 9}')]
    assert drained(spark, folder, work) == [(2024, 1, '{"id": 1}'), (2025, 0, '{"id": 9}')]
    put(folder, 2024, 2, ['{"id": 2}'])
    put(folder, 2023, 1, ['{"id": 0}'])  # an earlier year
    assert [r[2] for r in drained(spark, folder, work)] == ['{"id": 0}', '{"id": 1}', '{"id": 2}', '{"id": 3}', '{"id": 9}']


def test_batch_reads_every_page_in_a_task_of_its_own(spark, tmp_path):
    paged.register(spark)
    for n in range(1, 5):
        put(tmp_path / "in", 2024, n, [f'{{"id": {n}}}'])
    df = spark.read.format("paged_records").load(str(tmp_path / "in"))
    assert df.rdd.getNumPartitions() == 4 and df.count() == 4
    (tmp_path / "none").mkdir()
    assert spark.read.format("paged_records").load(str(tmp_path / "none")).count() == 0


def test_sheet_by_headings_and_matrix(spark, tmp_path):
    import zipfile

    import numpy as np

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda at, text: f'<c r="{at}" t="inlineStr"><is><t>{text}</t></is></c>'
    rows = {1: {"A": "notes"}, 2: {"B": "name", "D": " kind "}, 3: {"B": "x", "D": "1"}, 4: {"A": "only a note"}, 5: {"D": "2"}}
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{n}">' + "".join(cell(f"{c}{n}", v) for c, v in r.items()) + "</row>" for n, r in rows.items()) + "</sheetData></worksheet>")
    assert records.read_table(str(tmp_path / "a.xlsx"), ["kind", "name"]) == [{"kind": "1", "name": "x"}, {"kind": "2", "name": None}]
    with pytest.raises(ValueError):
        records.read_table(str(tmp_path / "a.xlsx"), ["absent"])
    m = np.random.default_rng(1).random((7, 3)).astype(np.float32)
    np.save(tmp_path / "m.npy", m)
    got = {r.row: r.vector for r in records.read_matrix(spark, str(tmp_path / "m.npy"), 3).collect()}
    assert sorted(got) == list(range(7)) and all(np.allclose(got[i], m[i]) for i in got)


@pytest.mark.parametrize("body,want", [
    ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">A</title><link rel="self" href="https://a.example/self"/><link href="https://a.example/1"/><updated>2026-04-16T01:27:37Z</updated></entry><entry><title>B</title><link rel="alternate" href="https://a.example/2"/><published>2026-04-15T00:00:00Z</published><updated>2026-04-16T01:27:37Z</updated></entry><entry><title>C</title><link href="https://a.example/3"/></entry></feed>',
     [("A", "https://a.example/1", "2026-04-16T01:27:37Z"), ("B", "https://a.example/2", "2026-04-15T00:00:00Z")]),
    ('<?xml version="1.0"?><rss version="2.0"><channel><item><title>A</title><link>https://a.example/1</link><pubDate>Thu, 16 Apr 2026 01:27:37 GMT</pubDate></item></channel></rss>', [("A", "https://a.example/1", "Thu, 16 Apr 2026 01:27:37 GMT")]),
    ("no feed at all", []), (None, []), ("", []), ("<feed><entry>", []),
])
def test_feeds(spark, body, want):
    got = records.feed_entries(spark.createDataFrame([("s", body)], "source string, body string")).collect()
    assert sorted((r.title, r.link, r.published) for r in got) == want


def test_live_run_keeps_the_topic_and_no_duplicates(spark):
    from tidewatch.sources import live

    schema = "doc_id string, source string, trust_level string, title string, url string"
    new = [("n1", "rss", "trusted", "Swarm control of drones", "https://a.example/1?utm_source=x"), ("n2", "gnews", None, "Swarm control of drones - Paper", "https://g.example/9"), ("n3", "rss", None, "Cooking", "https://a.example/2"), ("h1", "rss", None, "Swarm control, newer", "https://h.example/1"), ("n4", "rss", None, None, None)]
    old = [("h1", "rss", None, "Swarm control, older", "https://h.example/1"), ("h2", "rss", None, "Anything", "https://a.example/1")]
    works, status = live.ingest(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema), ["swarm control"])
    assert {(r.doc_id, r.title) for r in works.collect()} == {("n1", "Swarm control of drones"), ("h1", "Swarm control, newer")}
    assert {tuple(r) for r in status.collect()} == {("rss", 4, 2, 2), ("gnews", 1, 1, 0)}
    empty = spark.createDataFrame([], schema)
    assert [x.count() for x in live.ingest(empty, empty, ["swarm control"])] == [0, 0]


def test_live_run_beyond_a_pool(spark):
    from pyspark.sql import functions as F

    from tidewatch.operators.select import POOL_ROWS
    from tidewatch.sources import live

    n = POOL_ROWS + 1000
    rows = spark.range(n).select(F.format_string("%07d", "id").alias("doc_id"), F.lit("rss").alias("source"), F.lit("trusted").alias("trust_level"), F.concat(F.lit("Swarm control "), F.col("id") % 50).alias("title"), F.concat(F.lit("https://a.example/"), F.floor(F.col("id") / 2)).alias("url"))
    works, status = live.ingest(rows.where("id >= 20"), rows.where("id < 20"), ["swarm control"])
    assert sorted(int(r.doc_id) for r in works.collect()) == [*range(0, 50, 2), *range(51, 100, 2)]
    assert [tuple(r) for r in status.collect()] == [("rss", n - 20, n - 20, 40)]
