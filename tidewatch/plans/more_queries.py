"""Streams, learning, clusters, entities and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import clusters, entities, learn, select
from tidewatch.plans.reference_queries import DOMAIN, _pool, joined, works
from tidewatch.plans.reference_sql import _BASE, _POOL, _W, _with
from tidewatch.runtime import materialise, read
from tidewatch.sources import publish, records
from tidewatch.streaming import events

FEATURES = ["c_novelty", "c_growth", "c_accel", "c_burst", "c_diffusion", "maturity_pct", "n_docs", "n_countries"]


EXTRA_MIN_DOCS, EXTRA_TERMS = 2, ("swarm control", "fraud detection", "edge inference")


def _stream(s: SparkSession, d: str) -> DataFrame:
    return events.source(s, f"{d}/events.parquet")


def stream_tumbling_counts(s, d):
    return events.drain(s, events.tumbling_counts(_stream(s, d)), "tumbling").select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "event_type", "n", F.round("value", 2).alias("value"))


def stream_sliding_counts(s, d):
    return events.drain(s, events.sliding_counts(_stream(s, d)), "sliding").select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "event_type", "n")


def stream_session_activity(s, d):
    return events.drain(s, events.session_activity(_stream(s, d)), "session").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


def stream_dedup_watermark(s, d):
    return events.drain(s, events.dedup(_stream(s, d)), "dedup").select("event_id", "user_id", "event_type")


def stream_static_trust_join(s, d):
    stream = _stream(s, d)
    levels = stream.sparkSession.createDataFrame([("click", "trusted"), ("view", "trusted"), ("error", "indicator")], "event_type string, trust_level string")
    rows = events.with_trust(stream.withWatermark("ts", "2 days"), levels)
    counts = rows.groupBy(F.window("ts", "7 days"), "trust_level").agg(F.count("*").alias("n")).select(F.col("window.start").alias("week"), "trust_level", "n")
    return events.drain(s, counts, "trust").select(F.date_format("week", "yyyy-MM-dd").alias("week"), "trust_level", "n")


def stream_burst_state(s, d):
    return events.drain(s, events.bursts(_stream(s, d)), "burst", "update").select("event_type", "hours", F.round("burst", 6).alias("burst"))


def _training(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "trends").groupBy("trend_id").agg(*(F.max(c).cast("double").alias(c) for c in FEATURES), F.max(F.when(F.col("stage") == "emerging", 1.0).otherwise(0.0)).alias("label"))
    return materialise(t.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in FEATURES}), "training")


def _cv(kind: str, repeats: int):
    def run(s: SparkSession, d: str) -> DataFrame:
        return learn.report(materialise(learn.cross_validate(_training(s, d), kind, FEATURES, "trend_id", repeats=repeats), "predictions"))

    return run


#: Five folds each; the trees repeat less, as a hundred fits of theirs take many minutes whatever the rows.
REPEATS = {"logreg": 20, "forest": 1, "gboost": 1}
learn_logreg = _cv("logreg", REPEATS["logreg"])
learn_forest = _cv("forest", REPEATS["forest"])
learn_gboost = _cv("gboost", REPEATS["gboost"])


def _once(s: SparkSession, d: str, kind: str) -> DataFrame:
    return materialise(learn.cross_validate(_training(s, d), kind, FEATURES, "trend_id", repeats=1, seed=42), "predictions")


def learn_vote(s, d):
    return learn.report(learn.vote(_once(s, d, "forest"), _once(s, d, "logreg"), "trend_id"))


def learn_confusion(s, d):
    return learn.confusion(_once(s, d, "logreg"))


def learn_errors(s, d):
    return learn.errors(_once(s, d, "logreg"), "trend_id").select("trend_id", "label", F.round("p", 6).alias("p"))


def learn_ablation(s, d):
    return s.createDataFrame(learn.ablation(_training(s, d), "logreg", FEATURES, "trend_id", repeats=1), "feature string, lost double")


def learn_choice(s, d):
    reports = [learn.report(_once(s, d, kind)).withColumn("model", F.lit(kind)) for kind in ("logreg", "forest")]
    return learn.choose(reports[0].unionByName(reports[1]), ["logreg", "forest"], enough=0.6, least=0.5).select("model", "accuracy")


def union_training(s, d):
    """Labelled rows of two lists with the features both have; of an item in both the first list's row counts."""
    t = _training(s, d)
    first, second = t.where("label = 1"), t.where("n_docs >= 20")
    return publish.merge_rows(second, first, "trend_id").select("trend_id", "label", "n_docs")


def learn_importance(s, d):
    return s.createDataFrame(learn.importance(_training(s, d), "logreg", FEATURES), "feature string, weight double")


def cluster_docs(s, d):
    return clusters.cluster_docs(read(s, d, "embeddings"))


def extract_live(s, d):
    found = entities.extract_live(works(s, d, "title", "source"), DOMAIN, EXTRA_MIN_DOCS, EXTRA_TERMS)[0]
    return found.select("cand_id", "kind", "key", "label", F.array_join(F.array_sort("aliases"), "|").alias("aliases"), "n_docs")


def evidence_rescan(s, d):
    return entities.extract_live(works(s, d, "title", "source"), DOMAIN, EXTRA_MIN_DOCS, EXTRA_TERMS)[1]


def pred_live_technology(s, d):
    return works(s, d, "title").select("doc_id", entities.live_technology_reason(F.col("title")).alias("reason"))


def fn_noun_label(s, d):
    return works(s, d, "title").select("doc_id", F.explode(F.regexp_extract_all("title", F.lit(entities.NOUN), F.lit(0))).alias("surface")).select("doc_id", "surface", entities.noun_label(F.col("surface")).alias("label")).distinct()


def pred_gibberish(s, d):
    words = ["asdfgh", "quantum sensors", "qwertyuiop", "йцукен", "x", "robotics"]
    return s.createDataFrame([(w, text.is_gibberish(w)) for w in words], "query string, gibberish boolean")


def fn_normalise_record(s, d):
    w = works(s, d, "title", "doc_type", "year", "date", "lang", "url", "cited_by", "authors", "institutions", "countries", "concepts", "source").where("source = 'openalex'")
    page = lambda c: F.struct(c.alias("landing_page_url"))
    authors = F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"), F.col("countries").alias("countries"), F.transform("institutions", lambda i: F.struct(i.alias("display_name"), F.lit(None).cast("string").alias("country_code"))).alias("institutions")))
    raw = w.select(
        F.concat(F.lit("https://x.example/"), F.substring_index("doc_id", ":", -1)).alias("id"), "title", F.col("doc_type").alias("type"), F.col("year").alias("publication_year"), F.col("date").alias("publication_date"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("doi"), page(F.col("url")).alias("primary_location"),
        page(F.lit(None).cast("string")).alias("best_oa_location"), F.lit(None).cast("array<struct<landing_page_url: string>>").alias("locations"), F.col("cited_by").alias("cited_by_count"), authors.alias("authorships"),
        F.transform("concepts", lambda c: F.struct(c.alias("display_name"))).alias("concepts"), F.lit(None).cast("map<string, array<int>>").alias("abstract_inverted_index"),
    )
    got = records.normalise_records(raw, DOMAIN, "2026-01-01T00:00:00Z")
    return got.select("doc_id", "year", "url", F.array_join("authors", "|").alias("authors"), F.size("countries").alias("n_countries"))


def union_sources(s, d):
    w = works(s, d, "title", "url", "source")
    a, b = w.where("source = 'arxiv'").select("doc_id", "title"), w.where("source = 'github'").select("doc_id", "url")
    return a.unionByName(b, allowMissingColumns=True)


def union_live_rejected(s, d):
    pool = _pool(s, d)
    late = pool.scored.where("maturity_pct >= 0.9").select("cand_id", F.lit("already mainstream").alias("reason"))
    return pool.rejected.select("cand_id", "reason").unionByName(late)


def agg_rollup(s, d):
    return works(s, d, "source", "doc_type").rollup("source", "doc_type").agg(F.count("*").alias("n"))


def agg_cube(s, d):
    return joined(s, d, "doc_type", "trust_level").cube("doc_type", "trust_level").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("g"))


def dedup_titles(s, d):
    news = works(s, d, "domain", "source", "title", "year").where("source = 'gnews'")
    rows = news.select("domain", F.col("doc_id").alias("cand_id"), F.col("title").alias("label"), F.col("year").cast("double").alias("es"), F.lit(None).cast("long").alias("n_docs"))
    return select.dedup_lexical(rows, ["domain"]).select("domain", "cand_id", "merged_into")


NAMES = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and f.__code__.co_argcount == 2]
QUERIES = {n: globals()[n] for n in NAMES}

_TRUSTED = "CASE WHEN event_type IN ('click', 'view') THEN 'trusted' WHEN event_type = 'error' THEN 'indicator' ELSE 'unknown' END"
SQL = {
    "stream_tumbling_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)",
    "stream_sliding_counts": "SELECT strftime(date_trunc('day', ts) - to_days(k::INTEGER), '%Y-%m-%d') AS bucket, event_type, count(*) AS n FROM events, range(3) r(k) GROUP BY 1, 2, date_trunc('day', ts) - to_days(k::INTEGER) HAVING date_trunc('day', ts) - to_days(k::INTEGER) + INTERVAL 3 DAY <= (SELECT max(ts) - INTERVAL 4 DAY FROM events)",
    "stream_session_activity": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), s AS (SELECT user_id, k, count(*) AS n FROM g GROUP BY 1, 2 HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS n FROM s GROUP BY 1",
    "stream_dedup_watermark": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1",
    "stream_static_trust_join": f"SELECT strftime(week, '%Y-%m-%d') AS week, trust_level, n FROM (SELECT TIMESTAMP '1970-01-01' + to_days((epoch(ts)::BIGINT // 604800 * 7)::INTEGER) AS week, {_TRUSTED} AS trust_level, count(*) AS n FROM events GROUP BY 1, 2) WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)",
    "stream_burst_state": "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT event_type, max(h) AS last, count(*) AS hours FROM h GROUP BY 1) SELECT event_type, hours, round((sum(CASE WHEN h = last THEN n ELSE 0 END) + 0.1) / (sum(CASE WHEN h < last THEN n ELSE 0 END) / greatest(1, hours - 1) + 0.1), 6) AS burst FROM h JOIN m USING (event_type) GROUP BY 1, 2",
    "union_training": "WITH t AS (SELECT trend_id, max(CASE WHEN stage = 'emerging' THEN 1.0 ELSE 0.0 END)::DOUBLE AS label, max(n_docs)::DOUBLE AS n_docs FROM trends GROUP BY 1) SELECT * FROM t WHERE label = 1 UNION ALL SELECT * FROM t WHERE n_docs >= 20 AND label <> 1",
    "union_sources": _with(_W) + "SELECT doc_id, title, NULL AS url FROM w WHERE source = 'arxiv' UNION ALL SELECT doc_id, NULL, url FROM w WHERE source = 'github'",
    "union_live_rejected": _POOL + "SELECT cand_id, reason FROM rr WHERE reason IS NOT NULL UNION ALL SELECT cand_id, 'already mainstream' FROM sc WHERE maturity_pct >= 0.9::DOUBLE",
    "agg_rollup": _with(_W) + "SELECT source, doc_type, count(*) AS n FROM w GROUP BY ROLLUP (source, doc_type)",
    "agg_cube": _BASE + "SELECT doc_type, trust_level, count(*) AS n, grouping_id(doc_type, trust_level)::INTEGER AS g FROM j GROUP BY CUBE (doc_type, trust_level)",
    "fn_normalise_record": _with(_W) + "SELECT doc_id, year, url, coalesce(array_to_string(list_sort(list_distinct(list_filter(authors, lambda x: trim(x) <> ''))), '|'), '') AS authors, CASE WHEN len(authors) > 0 THEN coalesce(len(list_distinct(list_filter(countries, lambda x: x IS NOT NULL))), 0) ELSE 0 END::INTEGER AS n_countries FROM w WHERE source = 'openalex' AND regexp_full_match(doc_id, 'openalex:W[0-9]+')",
    "pred_gibberish": "SELECT * FROM (VALUES ('asdfgh', true), ('quantum sensors', false), ('qwertyuiop', true), ('йцукен', true), ('x', true), ('robotics', false)) t(query, gibberish)",
}
