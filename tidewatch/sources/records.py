"""Readers of raw records and their projections to works."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import abstract_of, host_of, suffixes
from tidewatch.runtime import lookup_join

# fixed values: trust and type of sources by domain
RULES = {
    "arxiv.org": ("trusted", "preprint"), "openalex.org": ("trusted", "article"), "nature.com": ("trusted", "article"), "github.com": ("trusted", "repo"), "huggingface.co": ("trusted", "model"), "techcrunch.com": ("trusted", "news"),
    "siliconangle.com": ("trusted", "news"), "venturebeat.com": ("trusted", "news"), "theregister.com": ("trusted", "news"), "eetimes.com": ("trusted", "news"), "prnewswire.com": ("indicator", "press_release"), "medium.com": ("indicator", "blog"),
    "x.com": ("indicator", "blog"), "reddit.com": ("indicator", "aggregator"), "news.ycombinator.com": ("indicator", "aggregator"), "news.google.com": ("indicator", "aggregator"),
}
_S, _I = T.StringType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_PAGE = _struct(landing_page_url=_S)
_AUTHORSHIP = _struct(author=_struct(display_name=_S), countries=T.ArrayType(_S), institutions=T.ArrayType(_struct(display_name=_S, country_code=_S)))
RECORD = _struct(
    id=_S, title=_S, type=_S, publication_year=_I, publication_date=_S, language=_S, doi=_S, primary_location=_PAGE, best_oa_location=_PAGE, locations=T.ArrayType(_PAGE), cited_by_count=_I,
    authorships=T.ArrayType(_AUTHORSHIP), concepts=T.ArrayType(_struct(display_name=_S)), abstract_inverted_index=T.MapType(_S, T.ArrayType(_I)),
)


def scan_with_file(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Rows with the name of their file in file_name."""
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).select("*", F.col("_metadata.file_name").alias("file_name"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue records from JSON lines or files; malformed ones are left out."""
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)


def first_url(urls: Column) -> Column:
    """The first http(s) URL with a host of an array, null without one."""
    return F.try_element_at(F.filter(urls, lambda u: u.rlike(r"^https?://[^/?#\s]+")), F.lit(1))


def normalise_records(records: DataFrame, domain: str, harvested_at: str) -> DataFrame:
    """Catalogue records to works: lists are distinct and sorted, countries upper case of two letters, the first http(s) URL
    with a host wins, abstracts are rebuilt from the inverted index. Records without title, year or id go."""
    names = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (F.trim(x) != ""))))
    authorships = F.coalesce("authorships", F.array().cast(RECORD["authorships"].dataType))
    countries = F.flatten(F.transform(authorships, lambda a: F.concat(F.coalesce(a.countries, F.array().cast("array<string>")), F.coalesce(F.transform(a.institutions, lambda i: i.country_code), F.array().cast("array<string>")))))
    urls = F.concat(F.array("doi", "primary_location.landing_page_url", "best_oa_location.landing_page_url"), F.coalesce(F.transform("locations", lambda x: x.landing_page_url), F.array().cast("array<string>")))
    short = F.substring_index("id", "/", -1)
    works = records.where(short.rlike(r"^W[0-9]+$") & F.col("title").isNotNull() & F.col("publication_year").isNotNull()).select(
        F.concat(F.lit("openalex:"), short).alias("doc_id"), F.lit("openalex").alias("source"), F.coalesce("type", F.lit("article")).alias("doc_type"), "title", abstract_of(F.col("abstract_inverted_index")).alias("abstract"),
        F.col("publication_year").alias("year"), F.col("publication_date").alias("date"), F.col("language").alias("lang"), F.regexp_replace("doi", r"^https?://(dx\.)?doi\.org/", "").alias("doi"),
        first_url(urls).alias("url"), F.col("cited_by_count").alias("cited_by"),
        names(F.filter(F.transform(countries, F.upper), lambda c: c.rlike("^[A-Z]{2}$"))).alias("countries"), names(F.flatten(F.transform(authorships, lambda a: F.coalesce(F.transform(a.institutions, lambda i: i.display_name), F.array().cast("array<string>"))))).alias("institutions"),
        names(F.transform(authorships, lambda a: a.author.display_name)).alias("authors"), names(F.transform("concepts", lambda x: x.display_name)).alias("concepts"), F.lit(domain).alias("domain"), F.lit(harvested_at).alias("harvested_at"),
    )
    return works.where("url is not null")


def rules_table(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """(rule, trust_level, source_type); extra (same columns) goes before the built-in rules."""
    built = spark.createDataFrame([(d, a, b) for d, (a, b) in RULES.items()], "rule string, trust_level string, source_type string")
    return built if extra is None else extra.unionByName(built.join(extra, "rule", "left_anti"))


def with_trust(df: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """df with host, rule, trust_level and source_type of the longest rule whose domain is the host or a suffix of it."""
    hosts = df.select(host_of(F.col(url)).alias("host")).where("host is not null").distinct()
    hit = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule"))
    hit = lookup_join(hit, rules, ["rule"], F.col("host"))
    best = hit.groupBy("host").agg(F.max_by(F.struct("rule", "trust_level", "source_type"), F.length("rule")).alias("r")).select("host", "r.*")
    rest = df.drop("rule", "trust_level", "source_type").withColumn("host", host_of(F.col(url)))
    return rest.join(best, "host", "left").withColumn("trust_level", F.coalesce("trust_level", F.lit("unknown")))


def single_targets(spark: SparkSession, path: str, key: str, target: str) -> DataFrame:
    """Keys of a folder of JSON files that name exactly one target; bad files are skipped."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col(key).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.collect_set(target).alias("t")).where(F.size("t") == 1).select("key", F.get("t", F.lit(0)).alias("target"))


def feed_entries(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Items of RSS and entries of Atom (source, title, link, published) from XML bodies; of an Atom entry the alternate link
    and, where it was never published, its last change count. Entries without a date or link are left out, bad bodies too."""
    rss = "channel struct<item: array<struct<title: string, link: string, pubDate: string>>>"
    atom = "entry array<struct<title: string, link: array<struct<_href: string, _rel: string, _VALUE: string>>, published: string, updated: string>>"
    read = lambda schema, tag: F.from_xml(F.col(body), F.lit(schema), {"rowTag": tag, "mode": "PERMISSIVE"})
    kind = F.regexp_extract(F.col(body), r"<(rss|feed)[\s>]", 1)
    items = feeds.where(kind == "rss").select("source", F.explode(read(rss, "rss").getField("channel").getField("item")).alias("i")).select("source", "i.title", "i.link", F.col("i.pubDate").alias("published"))
    entries = feeds.where(kind == "feed").select("source", F.explode(read(atom, "feed").getField("entry")).alias("i"))
    link = F.get(F.filter("i.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    entries = entries.select("source", "i.title", link.alias("link"), F.coalesce("i.published", "i.updated").alias("published"))
    return items.unionByName(entries).where("published is not null and link is not null")


def news_works(rows: DataFrame, domain: str, harvested_at: str) -> DataFrame:
    """(source, title, url, date) to works with an id from the URL; rows without title or http(s) URL go."""
    good = rows.where(F.col("title").isNotNull() & (F.trim("title") != "") & F.col("url").rlike(r"^https?://[^/\s]+"))
    return good.select(
        F.concat("source", F.lit(":"), F.substring(F.sha1("url"), 1, 16)).alias("doc_id"), "source", F.lit("article").alias("doc_type"), F.trim("title").alias("title"), F.coalesce(F.try_to_number(F.substring("date", 1, 4), F.lit("9999")).cast("int"), F.lit(int(harvested_at[:4]))).alias("year"),
        "date", "url", F.lit(domain).alias("domain"), F.lit(harvested_at).alias("harvested_at"),
    )


def read_table(path: str, names: list[str], header_row: int = 2) -> list[dict[str, str | None]]:
    """Rows of the first sheet below a row of headings, by heading; a missing heading is an error, blank rows go."""
    letters = [chr(65 + i) for i in range(26)] + [chr(65 + i) + chr(65 + j) for i in range(26) for j in range(26)]
    rows = read_sheet(path, {x: x for x in letters}, header_row)
    at = {(rows[0].get(x) or "").strip(): x for x in letters} if rows else {}
    if missing := [n for n in names if n not in at]:
        raise ValueError(f"{path} has no column {missing}")
    out = [{n: r[at[n]] for n in names} for r in rows[1:]]
    return [r for r in out if any(r.values())]


def read_matrix(spark: SparkSession, path: str, rows_a_part: int = 50_000) -> DataFrame:
    """(row, vector) of a two-dimensional .npy file in a shared folder; each task reads a range of its rows."""
    import numpy as np

    rows, width = np.load(path, mmap_mode="r").shape
    parts = max(1, -(-rows // rows_a_part))

    def run(frames):
        matrix = np.load(path, mmap_mode="r")
        for f in frames:
            for first in f["id"].tolist():
                block = np.asarray(matrix[first * rows_a_part : (first + 1) * rows_a_part], np.float32)
                yield pd.DataFrame({"row": np.arange(len(block), dtype=np.int64) + first * rows_a_part, "vector": list(block)})

    return spark.range(0, parts, 1, parts).mapInPandas(run, "row long, vector array<float>")


def read_sheet(path: str, columns: dict[str, str], first_row: int = 2) -> list[dict[str, str | None]]:
    """Rows of the first sheet of an .xlsx file, by column letter; shared and inline strings. For lists kept by people."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{ns}row"):
            if int(row.get("r", "0")) < first_row:
                continue
            got: dict[str, str | None] = {}
            for c in row.iter(f"{ns}c"):
                letter = re.match(r"[A-Z]+", c.get("r", ""))[0]
                if letter in columns:
                    v, inline = c.find(f"{ns}v"), c.find(f"{ns}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{ns}t")) if inline is not None else v.text if v is not None else None
                    got[columns[letter]] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            if any(got.values()):
                out.append({name: got.get(name) for name in columns.values()})
    return out
