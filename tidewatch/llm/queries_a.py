"""Queries of problems 1, 2, 4 and 7, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import frequency, rankwalk, sampling, topn
from tidewatch.runtime import read

POOL_TOP, WORKS_TOP = 15, 10
SAMPLE_SHARE = 0.1
SCORES = ("c_novelty", "c_growth", "c_burst", "c_diffusion")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(read(spark, d, "counts")).select("term", "occurrences", "records", F.round("share", 9).alias("share"), "mark")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.term_frequencies(read(spark, d, "counts")).where("mark is not null").select("term", "mark")


def pools(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    need = ["trend_id", "methodology_version", "domain", "as_of", "cand_id", *columns]
    return topn.latest_scoring(read(spark, d, "trends").select(*need))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    trends = pools(spark, d, "emergence_score").withColumn("grp", F.concat_ws("/", F.col("domain"), F.col("as_of").cast("string")))
    best = topn.top_n(trends, "grp", "emergence_score", "cand_id", POOL_TOP)
    works = topn.top_n(read(spark, d, "cand_docs"), "cand_id", "weight", "doc_id", WORKS_TOP)
    return best.unionByName(works).select("grp", "place", "item")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    works = read(spark, d, "works").select("doc_id", "year")
    registry = sampling.PermanentSample(spark, sampling.registry_of(spark, d))
    return registry.sample(works, "doc_id", "year", SAMPLE_SHARE).select("doc_id", "year", F.round("sample_u", 9).alias("u"))


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = rankwalk.rank_walk(pools(spark, d, *SCORES), ["domain", "as_of"], "cand_id", SCORES)
    return ranked.select("domain", "as_of", "cand_id", "place", "stationary")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    ranked = rankwalk.rank_walk(pools(spark, d, *SCORES), ["domain", "as_of"], "cand_id", SCORES)
    return rankwalk.leaders(ranked, ["domain", "as_of"], "cand_id", SCORES)


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p2_found": p2_found, "p4_sample": p4_sample, "p7_found": p7_found, "p7_ranking": p7_ranking}

_TERMS = r"""
WITH occ AS (SELECT doc_id, n, nfc_normalize(lower(nfc_normalize(trim(regexp_replace(term, '[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{b}]+', ' ', 'g'))))) AS term FROM counts WHERE n > 0 AND term IS NOT NULL),
t AS (SELECT term, sum(n)::BIGINT AS occurrences, count(DISTINCT doc_id) AS records FROM occ WHERE term <> '' GROUP BY term),
m AS (SELECT *, records / (SELECT count(DISTINCT doc_id) FROM counts)::DOUBLE AS s FROM t)
SELECT term, occurrences, records, round(s, 9) AS share, CASE WHEN records < 3 THEN 'rare' WHEN s > 0.2 THEN 'common' END AS mark FROM m"""
_LATEST = r"""
WITH v AS (SELECT *, list_transform(regexp_extract_all(methodology_version, '\d+'), lambda x: x::BIGINT) AS ver FROM trends),
latest AS (SELECT * FROM v QUALIFY ver = max(ver) OVER (PARTITION BY trend_id))"""
SQL = {
    "p1_terms": _TERMS,
    "p1_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p2_found": _LATEST + r""",
a AS (SELECT concat(domain, '/', as_of) AS grp, cand_id AS item, max(emergence_score) AS s FROM latest WHERE emergence_score IS NOT NULL AND emergence_score::VARCHAR <> 'nan' GROUP BY 1, 2),
b AS (SELECT cand_id AS grp, doc_id AS item, max(weight) AS s FROM cand_docs WHERE weight IS NOT NULL AND weight::VARCHAR <> 'nan' GROUP BY 1, 2)
SELECT grp, place::INTEGER AS place, item FROM (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY s DESC, item) AS place FROM a) WHERE place <= 15
UNION ALL SELECT grp, place::INTEGER AS place, item FROM (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY s DESC, item) AS place FROM b) WHERE place <= 10""",
    "p4_sample": r"""
WITH u AS (SELECT doc_id, year, ('0x' || substr(sha256('tidewatch-sample-1' || chr(31) || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM works)
SELECT doc_id, year, round(u, 9) AS u FROM u WHERE u < 0.1""",
    "p7_found": _LATEST + ", g AS (SELECT DISTINCT domain, as_of, cand_id, c_novelty, c_growth, c_burst, c_diffusion FROM latest),\nr AS (SELECT domain, as_of, cand_id, count(*) OVER (PARTITION BY domain, as_of) AS size, " + ", ".join(f"CASE WHEN {c} IS NULL OR {c}::VARCHAR = 'nan' THEN 0 WHEN rank() OVER (PARTITION BY domain, as_of ORDER BY CASE WHEN {c}::VARCHAR = 'nan' THEN NULL ELSE {c} END DESC NULLS LAST) <= 3 THEN 1 ELSE 0 END AS x{i}" for i, c in enumerate(SCORES)) + " FROM g)\nSELECT domain, as_of, cand_id FROM r WHERE size >= 10 AND x0 + x1 + x2 + x3 >= 3",
}
