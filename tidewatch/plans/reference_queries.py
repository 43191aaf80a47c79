"""One query for each operator, over whole tables. Named as the operators are in the survey."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch import contracts
from tidewatch.functions import text
from tidewatch.functions.harvest import Homes
from tidewatch.operators import candidates as cand
from tidewatch.operators import features, quality, sampling, score, select, series, shape
from tidewatch.plans import pipeline, serve
from tidewatch.runtime import materialise, read
from tidewatch.sources import publish, records

AS_OF, LIVE_AS_OF, CURRENT_YEAR = 2024, "2026-06", 2026
DOMAIN = "artificial-intelligence"
PHRASES = ["crop monitoring", "quantum sensing methods"]
GENERIC = ["of", "the", "for", "and", "data", "systems", "models"]
STOP = ["the", "of", "and", "in", "is", "to", "for", "that", "with", "on", "we", "this", "are", "as", "an", "by", "from", "has", "it"]


@lru_cache(16)
def _homes(s: SparkSession, d: str) -> Homes:
    return Homes.load(read(s, d, "sources"), read(s, d, "zone_names"))


def works(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each work once, with the columns named."""
    return series.first_harvest(read(s, d, "works"), *columns, homes=_homes(s, d))


def joined(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return series.linked(read(s, d, "cand_docs"), works(s, d, *columns), *columns)


def counts(s: SparkSession, d: str) -> DataFrame:
    return materialise(series.year_counts(joined(s, d, "year", "doc_type")), "year-counts")


def month_counts(s: SparkSession, d: str) -> DataFrame:
    return materialise(series.month_counts(joined(s, d, "year", "date", "doc_type")), "month-counts")


def labels(s: SparkSession, d: str) -> DataFrame:
    return pipeline.labels_of(read(s, d, "candidates"))


# ---- scans and sinks
def scan_parquet(s, d):
    return read(s, d, "works").select("doc_id", "source", "year", "cited_by")


def scan_multi_with_filename(s, d):
    return records.scan_with_file(s, f"{d}/candidates.parquet").groupBy(F.regexp_replace("file_name", "part-.*", "candidates.parquet").alias("file_name")).agg(F.count("*").alias("n"))


def scan_projected_batches(s, d):
    return read(s, d, "works").select("title").where(F.length("title") > 60).agg(F.count("*").alias("n"), F.sum(F.length("title")).alias("chars"))


def scan_metadata(s, d):
    return read(s, d, "counts").agg(F.count("*").alias("n_rows"))


def scan_json_cache(s, d):
    path = f"{_folder(s)}/json-cache"
    read(s, d, "works").where("doi is not null").select(F.lower("url").alias("target"), F.col("doi").alias("key")).write.mode("overwrite").json(path)
    return records.single_targets(s, path, "key", "target")


def _folder(s: SparkSession) -> str:
    import uuid

    from tidewatch.runtime import work_dir

    return f"{work_dir(s)}/tidewatch/{uuid.uuid4().hex}"


def src_concept(s, d):
    asked = read(s, d, "candidates").select(F.lower(F.trim("label")).alias("concept")).distinct()
    known = read(s, d, "works").select(F.explode("concepts").alias("concept"), "domain").where("concept is not null")
    return known.groupBy(F.lower(F.trim("concept")).alias("concept")).agg(F.count("*").alias("n"), F.count_distinct("domain").alias("n_domains")).join(asked, "concept", "left_semi")


def src_science_base(s, d):
    science = works(s, d, "concepts").select(F.explode("concepts").alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("science_10y"))
    return labels(s, d).join(science, "label", "left").select("cand_id", "science_10y")


def upsert_journal(s, d):
    rows = read(s, d, "trends").select(F.col("domain").alias("dataset"), F.col("cand_id").alias("tbl"), F.col("as_of").alias("version"), F.col("n_docs").cast("long").alias("n_rows"))
    rows = rows.groupBy("dataset", "tbl", "version").agg(F.max("n_rows").alias("n_rows"))
    return publish.journal(rows.where("version <= 2021"), rows.where("version > 2021"), version="version")


def sink_cards_merge(s, d):
    t = read(s, d, "trends").select("trend_id", "as_of").distinct()
    return publish.merge_rows(t.where("as_of <= 2023").withColumn("made", F.lit("old")), t.where("as_of % 2 = 0").withColumn("made", F.lit("new")), "trend_id").select("trend_id", "made")


def status_listing(s, d):
    rows = publish.loaded(s, "index", "trends", read(s, d, "trends").select("trend_id"), "query")
    return rows.select("dataset", "tbl", "n_rows")


def fingerprint(s, d):
    return publish.fingerprint(read(s, d, "cand_docs").select("cand_id", "doc_id"))


def mock_export(s, d):
    return read(s, d, "candidates").groupBy("cand_id").agg(F.min("label").alias("label"), F.max("n_docs").alias("n_docs")).select("cand_id", F.to_json(F.struct("label", "n_docs")).alias("body"))


def sink_parquet_zstd(s, d):
    path = f"{_folder(s)}/cand_docs"
    links = read(s, d, "cand_docs").groupBy("cand_id", "doc_id").agg(F.max("weight").alias("weight"))
    publish.publish(links, "cand_docs", path)
    return s.read.parquet(path)


# ---- projections, filters, predicates
def filter_as_of(s, d):
    return counts(s, d).where(F.col("year") <= AS_OF).select("cand_id", "year", "n")


def filter_year_between(s, d):
    return works(s, d, "year").where(F.col("year").between(2020, 2022)).select("doc_id", "year")


def filter_since(s, d):
    first = read(s, d, "trends").groupBy("cand_id").agg(F.max("takeoff_year").alias("takeoff"))
    return joined(s, d, "year").join(first, "cand_id", "left").where(F.col("year") >= F.coalesce("takeoff", F.lit(0))).groupBy("cand_id").agg(F.count("*").alias("n"))


def filter_eq_as_of(s, d):
    return read(s, d, "trends").where(F.col("as_of") == AS_OF).select("trend_id", "rank", "cand_id").distinct()


def filter_like_doc(s, d):
    has = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("crop monitoring")
    return works(s, d, "title", "abstract", "year").where(F.col("year").between(2018, 2026) & (has(F.col("title")) | has(F.col("abstract")))).select("doc_id", "year")


def filter_in_list(s, d):
    t = read(s, d, "trends").groupBy("trend_id").agg(F.min_by("top_doc_ids", F.struct("rank", "emergence_score", "methodology_version")).alias("ids"))
    ids = t.select("trend_id", F.posexplode(F.array_distinct("ids")).alias("pos", "doc_id"))
    return ids.join(works(s, d, "year").select("doc_id", "year"), "doc_id").select("trend_id", "pos", "doc_id", "year")


def pred_invalid_rows(s, d):
    bad = (~F.col("domain").eqNullSafe(F.lit(DOMAIN))) | (F.col("year") > AS_OF) | F.col("doi").isNull()
    return read(s, d, "works").where(bad).agg(F.count("*").alias("n"))


def pred_fragment(s, d):
    return labels(s, d).select("cand_id", score.is_fragment(F.col("label")).alias("fragment"))


def pred_headline_fragment(s, d):
    return works(s, d, "title").select("doc_id", score.is_headline_piece(F.col("title")).alias("piece"))


def pred_technology(s, d):
    return labels(s, d).select("cand_id", text.technology_reason(F.col("label")).alias("reason"))


def pred_query_topic(s, d):
    return labels(s, d).select("cand_id", score.is_query_topic(F.col("label"), PHRASES).alias("topic"))


def pred_topic_match(s, d):
    return works(s, d, "title").where(text.matches_topic(F.col("title"), PHRASES)).select("doc_id")


def pred_public_url(s, d):
    return works(s, d, "url").select("doc_id", text.is_public_url(F.col("url")).alias("public"))


def pred_phrases(s, d):
    ok = F.size("aliases").between(1, 3) & F.forall("aliases", lambda a: a.rlike(r"^[\x20-\x7e]{1,200}$") & a.rlike("[A-Za-z]"))
    return read(s, d, "candidates").select("cand_id", F.coalesce(ok, F.lit(False)).alias("valid")).distinct()


def pred_dataset_name(s, d):
    return read(s, d, "works").select("domain").distinct().select("domain", F.col("domain").rlike(r"^[a-z0-9][a-z0-9-]{0,63}$").alias("valid"))


def validate_contract(s, d):
    return contracts.problems(read(s, d, "cand_docs"), "cand_docs")


def project_contract(s, d):
    return contracts.project(read(s, d, "candidates").drop("aliases", "top_terms"), "candidates").select("cand_id", "kind", "label", "n_docs", F.col("aliases").isNull().alias("no_aliases"))


def project_api_trend(s, d):
    t = read(s, d, "trends").groupBy("trend_id").agg(F.min_by(F.struct("years", "counts", "bt_at_cutoff", "bt_peak_after", "bt_growth_x"), F.struct("rank", "emergence_score", "methodology_version", "c_novelty", "c_growth")).alias("x")).select("trend_id", "x.*")
    points = F.transform(F.arrays_zip("years", "counts"), lambda p: F.concat(p.years.cast("string"), F.lit(":"), p.counts.cast("string")))
    known = F.col("bt_at_cutoff").isNotNull() & F.col("bt_peak_after").isNotNull() & F.col("bt_growth_x").isNotNull()
    return t.select("trend_id", F.array_join(points, " ").alias("series"), known.alias("backtest"))


# ---- joins
def join_links_works(s, d):
    return joined(s, d, "year").select("cand_id", "doc_id", "year")


def join_labels(s, d):
    return counts(s, d).join(labels(s, d), "cand_id").select("cand_id", "label", "year", "n")


def join_quota(s, d):
    return sampling.equal_year_sample(works(s, d, "year"), 2022, 2026, 500).groupBy("year").agg(F.count("*").alias("n"))


def join_selected(s, d):
    picked = sampling.equal_year_sample(works(s, d, "year"), 2022, 2026, 300).select("doc_id")
    return works(s, d, "year", "title").join(picked, "doc_id", "left_semi").select("doc_id", "year", "title")


def join_incoming_accepted(s, d):
    terms = cand.title_terms(works(s, d, "title"))
    return terms.join(cand.doc_frequency(terms, 20), "term").select("term", "doc_id")


def check_left_join(s, d):
    n = series.links(read(s, d, "cand_docs")).groupBy("cand_id").agg(F.count("*").alias("n"))
    c = read(s, d, "candidates").groupBy("cand_id").agg(F.max("n_docs").alias("n_docs"))
    return c.join(n, "cand_id", "left").where("n_docs <> coalesce(n, 0)").select("cand_id", "n_docs", F.coalesce("n", F.lit(0)).alias("n"))


def anti_unknown_fk(s, d):
    clusters = read(s, d, "candidates").where("kind = 'cluster'").select("cand_id").distinct()
    linked = series.links(read(s, d, "cand_docs")).join(clusters, "cand_id").select(F.col("doc_id").alias("work_id")).distinct()
    return read(s, d, "documents").where("work_id is not null").join(linked, "work_id", "left_anti").select("doc_id")


def anti_merge(s, d):
    old = read(s, d, "candidates").select("cand_id").distinct()
    return old.join(read(s, d, "trends").select("cand_id").distinct(), "cand_id", "left_anti")


def left_defaults(s, d):
    return labels(s, d).join(series.country_spread(joined(s, d, "year", "countries"), 2022, 2024), "cand_id", "left").select("cand_id", F.coalesce("n_countries", F.lit(0)).alias("n_countries"))


def unnest_lateral(s, d):
    return works(s, d, "countries").select("doc_id", F.explode("countries").alias("country"))


def lateral_top_docs(s, d):
    return filter_in_list(s, d).groupBy("trend_id").agg(F.count("*").alias("n"), F.max("year").alias("newest"))


def suffix_join_trust(s, d):
    docs = materialise(works(s, d, "url"), "urls")
    rules = docs.select(text.host_of(F.col("url")).alias("h")).distinct().select(F.col("h").alias("rule"), F.when(F.col("h") < "m", "trusted").otherwise("indicator").alias("trust_level"), F.lit("article").alias("source_type"))
    rules = rules.where("rule >= 'g'").unionByName(s.createDataFrame([("example", "unknown", None)], "rule string, trust_level string, source_type string"))
    return records.with_trust(docs, "url", rules).select("doc_id", "rule", "trust_level")


def term_title_match(s, d):
    return cand.term_matches(works(s, d, "title"), read(s, d, "candidates").where("kind = 'term'").select(F.lower("label").alias("term")).distinct())


def reference_match(s, d):
    return quality.reference_match(_references(s, d), read(s, d, "candidates"), GENERIC)


def _references(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "works").select(F.explode("concepts").alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n")).where("n >= 5").select("label")


# ---- aggregates
def agg_year_counts(s, d):
    return counts(s, d)


def agg_month_counts(s, d):
    return series.month_counts(joined(s, d, "year", "date", "doc_type"))


def agg_country_spread(s, d):
    return series.country_spread(joined(s, d, "year", "countries"), AS_OF - 2, AS_OF)


def agg_domain_spread(s, d):
    return series.domain_spread(joined(s, d, "source", "title", "url"))


def agg_trusted_share(s, d):
    return series.trusted_share(joined(s, d, "source", "trust_level")).select("cand_id", F.round("trusted_share", 6).alias("trusted_share"))


def agg_peer_norm(s, d):
    return series.peer_norm(counts(s, d))


def agg_doc_frequency(s, d):
    return cand.doc_frequency(cand.title_terms(works(s, d, "title")), 20)


def agg_upsert_counter(s, d):
    return read(s, d, "counts").where("n > 0").groupBy("term").agg(F.sum("n").alias("n"))


def agg_filtered(s, d):
    return works(s, d, "year", "abstract", "doi").groupBy("year").agg(F.count_if(F.trim("abstract") != "").alias("n_abstracts"), F.count("doi").alias("n_dois"))


def agg_distinct_per_year(s, d):
    return sampling.coverage(works(s, d, "year", "abstract", "doi", "countries")).select("year", "n_works", "n_countries")


def agg_rejected_summary(s, d):
    return _pool(s, d).rejected.groupBy("reason").agg(F.count("*").alias("n"))


def agg_evidence(s, d):
    m = read(s, d, "candidates").where("aliases is not null").select(F.col("cand_id").alias("key"), F.explode("aliases").alias("surface"), F.col("domain").alias("doc_id"))
    return cand.evidence(m.where("surface is not null"), 1).select("key", "label", F.array_join("aliases", "|").alias("aliases"), "n_docs")


def agg_news_features(s, d):
    r = features.news_features(joined(s, d, "source", "source_type", "date", "url", "trust_level", "title", "lang"), LIVE_AS_OF)
    return r.select("cand_id", "news_mentions_24m", F.array_join("news_mentions_by_month", ",").alias("by_month"), "news_first_month", "n_domains", "trusted_share", "funding_mentions", F.array_join("langs", ",").alias("langs"))


def agg_host_trust(s, d):
    per = works(s, d, "url", "trust_level").select(text.host_of(F.col("url")).alias("host"), "trust_level").groupBy("host").agg(F.bool_and(F.coalesce(F.col("trust_level") == "trusted", F.lit(False))).alias("trusted"), F.count("*").alias("n"))
    return per


def agg_status_counts(s, d):
    return works(s, d, "trust_level").groupBy(F.coalesce("trust_level", F.lit("none")).alias("trust_level")).agg(F.count("*").alias("n"))


def agg_cluster_centroid(s, d):
    return cand.cluster_centroids(read(s, d, "embeddings")).select("label", "n_docs", "pos", F.round("value", 6).alias("value"))


def agg_ctf_idf(s, d):
    docs = read(s, d, "documents").where("text is not null").withColumn("cls", F.substring("source", 1, 3))
    return cand.ctf_idf(docs, "cls", "text", STOP, 10).select("label", "place", "term", F.round("score", 6).alias("score"))


def agg_backtest(s, d):
    return quality.backtest(counts(s, d), AS_OF, CURRENT_YEAR)


def agg_lead_time(s, d):
    return quality.lead_time(counts(s, d), read(s, d, "trends").groupBy("cand_id").agg(F.min("takeoff_year").alias("takeoff")))


def agg_precision_at_k(s, d):
    place = F.row_number().over(Window.orderBy(F.desc("n_docs"), "cand_id"))
    top = read(s, d, "candidates").groupBy("cand_id").agg(F.max("n_docs").alias("n_docs"), F.min("label").alias("label")).orderBy(F.desc("n_docs"), "cand_id").limit(15)
    return quality.precision_at_k(top.withColumn("place", place), _references(s, d), 15)


def agg_report(s, d):
    t = counts(s, d)
    rows = quality.backtest(t, AS_OF, CURRENT_YEAR).join(quality.lead_time(t, read(s, d, "trends").groupBy("cand_id").agg(F.min("takeoff_year").alias("takeoff"))), "cand_id").join(read(s, d, "trends").groupBy("cand_id").agg(F.max("maturity_pct").alias("maturity_pct")), "cand_id")
    return quality.report(rows)


def agg_recall(s, d):
    return quality.recall(_references(s, d), reference_match(s, d))


def agg_stats_header(s, d):
    t = read(s, d, "trends").where(F.col("as_of") == AS_OF)
    return serve.header(t.where("not isnan(emergence_score)"), t.where("rank > 15"), works(s, d, "year"))


def _cards(s: SparkSession, d: str) -> DataFrame:
    t = read(s, d, "trends").groupBy("trend_id").agg(F.min_by(F.struct("top_doc_ids", "cand_id"), F.struct("rank", "emergence_score", "methodology_version", "c_novelty", "c_growth")).alias("x")).select("trend_id", "x.*")
    claims = F.array(F.struct(F.lit("problem").alias("text"), F.slice("top_doc_ids", 1, 1).alias("docs")), F.struct(F.lit("advantage").alias("text"), F.array(F.lit("nowhere")).alias("docs")))
    return t.select("trend_id", claims.alias("claims"), F.col("top_doc_ids").alias("allowed"))


def agg_citation_coverage(s, d):
    return quality.citations(_cards(s, d)).select("trend_id", F.col("claims")[0]["text"].alias("first"), F.col("claims")[1]["text"].alias("second"), "coverage")


def agg_cyrillic_share(s, d):
    return works(s, d, "title").select("doc_id", F.round(quality.cyrillic_share(F.col("title")), 6).alias("share"))


def agg_preprint_lag(s, d):
    return quality.preprint_lag(joined(s, d, "year", "doc_type"), CURRENT_YEAR)


def agg_text_concat(s, d):
    """The text of each domain as its lines, kept exploded: how many, how long joined, and a digest that no order changes."""
    line = F.concat_ws(" ", "doc_id", "title")
    part = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return works(s, d, "domain", "title").groupBy("domain").agg(F.count("*").alias("lines"), (F.sum(F.length(line) + 1) - 1).alias("chars"), F.sum(part).cast("string").alias("digest"))


# ---- windows, sorts, top-k
def win_dedup_first(s, d):
    return works(s, d, "year", "harvested_at").select("doc_id", "year", "harvested_at")


def win_stratified_hash(s, d):
    return sampling.equal_year_sample(works(s, d, "year"), 2022, 2026, 250).select("doc_id", "year")


def win_pct_rank(s, d):
    return labels(s, d).join(read(s, d, "candidates").groupBy("cand_id").agg(F.max("n_docs").alias("n_docs")), "cand_id").select("cand_id", F.round(score.pct_rank("n_docs"), 9).alias("r"))


def win_rank_output(s, d):
    pool = _pool(s, d).scored
    return pool.select("cand_id", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("es"), "cand_id")).alias("rank"))


def win_moving_sum_3(s, d):
    dense = series.dense_years(counts(s, d), 2015, 2026)
    return dense.select("cand_id", "year", F.sum("n").over(Window.partitionBy("cand_id").orderBy("year").rowsBetween(-2, 0)).alias("n3"))


def win_segments(s, d):
    return shape.segments(counts(s, d), CURRENT_YEAR, 5, 1)


def win_first_crossing(s, d):
    return shape.first_crossing(shape.current_history(counts(s, d), AS_OF))


def win_breakout(s, d):
    return shape.breakout(counts(s, d).withColumn("n", F.col("n") * 10), CURRENT_YEAR)


def win_ols_slope(s, d):
    return counts(s, d).groupBy("cand_id").agg(F.round(shape.slope(F.col("n").cast("double"), F.col("year").cast("double")) + 1e-9, 6).alias("slope"))  # exact halves occur


def win_accel(s, d):
    return _components(s, d).select("cand_id", F.round("accel", 6).alias("accel"))


def win_burst(s, d):
    return _components(s, d).select("cand_id", F.round("burst", 6).alias("burst"))


def sort_top_docs(s, d):
    return series.top_docs(joined(s, d, "year", "cited_by"), read(s, d, "trends").groupBy("cand_id").agg(F.min("takeoff_year").alias("takeoff")), 20, AS_OF)


def sort_headlines(s, d):
    news = works(s, d, "source", "title", "date").where("source = 'gnews'").select("doc_id", text.strip_publisher(F.col("title")).alias("title"), F.coalesce("date", F.lit("")).alias("date"))
    return news.orderBy(F.desc("date"), "doc_id").limit(300)


def topk_baseline_abs(s, d):
    return quality.baseline(counts(s, d), AS_OF, 15, "abs")


def topk_cagr(s, d):
    return quality.baseline(counts(s, d), AS_OF, 15, "cagr")


def topk_ngrams(s, d):
    return cand.title_terms(works(s, d, "title")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(40)


# ---- sets, samples
def union_candidates(s, d):
    c = read(s, d, "candidates")
    return c.where("kind = 'term'").select("cand_id", "kind").unionByName(c.where("kind = 'cluster'").select("cand_id", "kind")).distinct()


def set_intersect(s, d):
    return read(s, d, "candidates").select("cand_id", F.size(F.array_intersect(text.tokens(F.col("label")), text.tokens(F.array_join(F.coalesce("top_terms", F.array().cast("array<string>")), " ")))).alias("n")).distinct()


def set_except(s, d):
    return read(s, d, "candidates").select("cand_id", F.array_join(F.array_sort(F.array_except(F.coalesce("aliases", F.array().cast("array<string>")), F.array("label"))), "|").alias("rest")).distinct()


def set_subset(s, d):
    return read(s, d, "candidates").select("cand_id", (F.size(F.array_except(text.tokens(F.array_join(F.coalesce("top_terms", F.array().cast("array<string>")), " ")), text.tokens(F.col("label")))) == 0).alias("inside")).distinct()


def distinct_ordered(s, d):
    return read(s, d, "trends").select("trend_id", F.array_join(F.array_distinct("top_doc_ids"), ",").alias("ids")).distinct()


def dedup_live(s, d):
    rows = read(s, d, "works").where("source in ('gnews', 'hackernews') or source like 'rss%'").select("doc_id", F.when(F.col("trust_level") == "trusted", 0).when(F.col("source") == "gnews", 2).otherwise(1).alias("rank"), text.canonical_url(F.col("url")).alias("url_key"), text.norm_title(text.strip_publisher(F.col("title"))).alias("title_key"))
    return select.dedup_live(rows.distinct())


def sample_equal_year_quota(s, d):
    return sampling.equal_year_sample(works(s, d, "year"), 2022, 2026, 997).select("doc_id", "year")


def sample_first_valid(s, d):
    return sampling.first_valid(works(s, d, "doi", "abstract", "year"), F.col("doi").isNotNull() & F.col("abstract").isNotNull(), ["year", "doc_id"], 20).select("doc_id", "year")


def split_stratified_kfold(s, d):
    rows = works(s, d, "source_type").select("doc_id", F.when(F.col("source_type") == "preprint", 1).otherwise(0).alias("label"))
    return sampling.folds(rows, "doc_id", "label", 5, 7).groupBy("label", "fold").agg(F.count("*").alias("n"))


# ---- functions
def fn_tokens(s, d):
    return works(s, d, "title").select("doc_id", F.array_join(text.tokens(F.col("title")), " ").alias("t"))


def fn_ngrams(s, d):
    return works(s, d, "title").select("doc_id", F.explode(text.ngrams(F.col("title"))).alias("term"))


def fn_lemma(s, d):
    return read(s, d, "candidates").select(F.explode(text.tokens(F.col("label"))).alias("w")).distinct().select("w", text.lemma(F.col("w")).alias("lemma"))


def fn_publisher(s, d):
    return works(s, d, "source", "title", "url").select("doc_id", series.publisher(F.col("source"), F.col("title"), F.col("url")).alias("publisher"))


def fn_strip_publisher(s, d):
    return works(s, d, "title").select("doc_id", text.strip_publisher(F.col("title")).alias("t"))


def fn_norm_host(s, d):
    return works(s, d, "url").select("doc_id", text.norm_host(F.col("url")).alias("host"))


def fn_canonical_url(s, d):
    return works(s, d, "url").select("doc_id", text.canonical_url(F.concat(F.col("url"), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("b=2&utm_medium=x&a=1&c=#part"))).alias("url"))


def fn_norm_title(s, d):
    return works(s, d, "title").select("doc_id", text.norm_title(F.col("title")).alias("t"))


def fn_norm_entity(s, d):
    return works(s, d, "title").select("doc_id", text.norm_entity(F.col("title")).alias("t"))


def fn_clean_term(s, d):
    return read(s, d, "candidates").select("cand_id", text.clean_term(F.col("label")).alias("t")).distinct()


def fn_slug(s, d):
    return works(s, d, "title").select("doc_id", text.slug(F.col("title")).alias("slug"))


def fn_stems4(s, d):
    return labels(s, d).select("cand_id", F.array_join(F.array_sort(score.stems4(F.col("label"))), " ").alias("stems"))


def fn_hash_ids(s, d):
    return labels(s, d).select("cand_id", text.hash_id("t", F.col("domain"), F.col("label")).alias("made"))


def fn_month_number(s, d):
    return works(s, d, "date").select("doc_id", shape.month_index(F.substring("date", 1, 7)).alias("m"))


def fn_month_coalesce(s, d):
    return works(s, d, "date", "year").select("doc_id", series.month_of(F.col("date"), F.col("year")).alias("month"))


def fn_abstract_rebuild(s, d):
    w = works(s, d, "abstract").where("abstract is not null").withColumn("ws", F.split("abstract", " "))
    pairs = F.transform("ws", lambda x, i: F.struct(x.alias("w"), i.alias("i")))
    index = F.map_from_entries(F.transform(F.array_distinct("ws"), lambda x: F.struct(x, F.transform(F.filter(F.col("p"), lambda q: q.w == x), lambda q: q.i))))
    return w.withColumn("p", pairs).withColumn("index", index).select("doc_id", (text.abstract_of(F.col("index")) == F.col("abstract")).alias("same"))


# ---- composites
def _pool(s: SparkSession, d: str) -> pipeline.Pool:
    return pipeline.score_index(read(s, d, "works"), read(s, d, "cand_docs"), read(s, d, "candidates"), AS_OF, homes=_homes(s, d))


def _components(s: SparkSession, d: str) -> DataFrame:
    return shape.components(counts(s, d).where(F.col("year") <= AS_OF), AS_OF)


def components_yearly(s, d):
    c = _components(s, d)
    return c.select("cand_id", "first_mention", "takeoff", "age", "homonym", F.round("growth", 6).alias("growth"), F.round("accel", 6).alias("accel"), F.round("burst", 6).alias("burst"), F.round("maturity", 4).alias("maturity"), "counts_recent", "active_years", "last_year_share", F.array_join("counts", ",").alias("counts"))


def components_monthly(s, d):
    c = shape.components_monthly(month_counts(s, d), LIVE_AS_OF)
    return c.select("cand_id", "first_mention", "takeoff_year", "age", F.round("growth", 6).alias("growth"), F.round("accel", 6).alias("accel"), F.round("burst", 6).alias("burst"), "counts_recent", "active_months", F.array_join("counts", ",").alias("counts"))


def emergence_score(s, d):
    return _pool(s, d).scored.select("cand_id", "es", "maturity_pct", "c_novelty", "c_growth", "c_accel", "c_burst", "c_diffusion")


def reject_reason_index(s, d):
    return _pool(s, d).rejected.select("cand_id", "reason", "n_docs")


def reject_mature(s, d):
    return _pool(s, d).scored.where(F.col("maturity_pct") >= score.MAX_MATURITY).select("cand_id", "maturity_pct")


def _live(s: SparkSession, d: str) -> pipeline.Pool:
    return pipeline.score_live(read(s, d, "works"), read(s, d, "cand_docs"), read(s, d, "candidates"), LIVE_AS_OF, phrases=tuple(PHRASES), homes=_homes(s, d))


def reject_reason_live(s, d):
    return _live(s, d).rejected.select("cand_id", "reason", "n_docs")


def emergence_score_live(s, d):
    return _live(s, d).scored.select("cand_id", "es", "c_novelty", "c_growth")


def stage_confidence(s, d):
    r = _pool(s, d).scored
    return r.select("cand_id", score.stage(F.col("age"), F.col("maturity_pct")).alias("stage"), score.confidence(F.col("counts_recent"), F.col("n_countries"), F.col("homonym")).alias("confidence"))


def dedup_lexical(s, d):
    rows = read(s, d, "candidates").groupBy("cand_id", "domain").agg(F.min("label").alias("label"), F.max("n_docs").alias("n_docs")).withColumn("es", F.col("n_docs").cast("double"))
    return select.dedup_lexical(rows, ["domain"]).select("domain", "cand_id", "merged_into")


def mmr_topk(s, d):
    v = read(s, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("cand_id"), (F.col("vec_id") % 101 / 101.0).alias("es"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return select.mmr(v, 15)


def build_trends(s, d):
    t, _ = pipeline.index_trends(read(s, d, "works"), read(s, d, "cand_docs"), read(s, d, "candidates"), AS_OF, CURRENT_YEAR, homes=_homes(s, d))
    return contracts.project(t, "trends")


def build_live(s, d):
    return pipeline.live_trends(read(s, d, "works"), read(s, d, "cand_docs"), read(s, d, "candidates"), LIVE_AS_OF, homes=_homes(s, d))[0]


def extract_terms(s, d):
    kept, links, _ = cand.extract_terms(works(s, d, "title", "domain").where(F.col("domain") == DOMAIN), DOMAIN, 2)
    return kept.join(links.groupBy("cand_id").agg(F.count("*").alias("n_links")), "cand_id").select("cand_id", "label", "n_docs", "n_links")


def cluster_candidates(s, d):
    v = read(s, d, "embeddings")
    return cand.cluster_links(v, cand.cluster_centroids(v)).select("label", "vec_id", F.round("weight", 6).alias("weight"))


def validate_index(s, d):
    return cand.integrity(read(s, d, "candidates"), read(s, d, "cand_docs"), read(s, d, "works"))


def tech_features(s, d):
    look = read(s, d, "candidates").groupBy("cand_id").agg(F.lit(3).alias("countries"), F.lit(0.5).alias("company_share"), F.max("n_docs").alias("repos"), F.lit(None).cast("int").alias("stars"), F.lit(None).cast("double").alias("new_share"), F.lit(None).cast("int").alias("models"))
    r = features.tech_features(counts(s, d), AS_OF, look)
    return r.select("cand_id", "pub_total_10y", F.round("pub_last_3y_share", 6).alias("pub_last_3y_share"), "pub_age", F.round("log_pub_total", 6).alias("log_pub_total"), "github_repos")


def resolve_query(s, d):
    return serve.resolve(read(s, d, "works").select("domain"), "Artificial Intelligence")


def api_trends(s, d):
    t = read(s, d, "trends").where("rank between 1 and 15").groupBy("domain", "as_of", "rank").agg(F.min("trend_id").alias("trend_id"))
    return serve.trends(t, DOMAIN, int(t.where(F.col("domain") == DOMAIN).agg(F.max("as_of")).first()[0]), 15)


def api_methodology(s, d):
    return serve.methodology(s)


NAMES = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and f.__code__.co_argcount == 2 and n not in ("works", "joined", "counts", "month_counts", "labels")]
QUERIES = {n: globals()[n] for n in NAMES}
