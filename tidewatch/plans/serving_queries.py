"""Pages, analysts' questions, prompts, fixed pools, clusters by their titles, exported terms, terms counted as works come in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import candidates, sampling, score
from tidewatch.plans import serve
from tidewatch.plans.reference_queries import DOMAIN, PHRASES, _pool, works
from tidewatch.plans.reference_sql import _FRAG, _HEADWORDS, _TOK, _WORDS, _NGRAM, _ONE, _POOL, _W, _marker, _with
from tidewatch.operators import series
from tidewatch.runtime import read
from tidewatch.sources import live, publish, records
from tidewatch.streaming import events

TERM, POOL, CUTOFFS = "swarm control", ["swarm control", "tactile sensors", "edge inference", "nothing of the kind"], (2024, 2026)
WORKS = "doc_id string, source string, title string, year int, harvested_at string"


def _one(s, d):
    """Each trend once."""
    order = F.struct("rank", "emergence_score", "methodology_version", "c_novelty", "c_growth")
    t = read(s, d, "trends")
    kept = ["domain", "as_of", "rank", "cand_id", "label", "top_doc_ids", "n_docs", "stage", "takeoff_year", "bt_at_cutoff", "bt_peak_after", "bt_growth_x"]
    return t.groupBy("trend_id").agg(F.min_by(F.struct(*kept), order).alias("x")).select("trend_id", "x.*")


def limit_top(s, d):
    return _one(s, d).where(F.col("rank") <= 5).select("trend_id", "rank")


def page_slice(s, d):
    return serve.page(_one(s, d).select("trend_id", "rank"), ["rank", "trend_id"], 5, 40)


def api_trend(s, d):
    first = _one(s, d).agg(F.min("trend_id")).first()[0]
    return serve.trend(_one(s, d), first).select("trend_id", "domain", "rank", "label")


def api_domains(s, d):
    return serve.domains(read(s, d, "trends"))


def analyst_top(s, d):
    pool = _one(s, d).where(F.col("domain") == DOMAIN)
    newest = pool.agg(F.max("as_of")).first()[0]
    return pool.where(F.col("as_of") == newest).select("rank", "label", "takeoff_year", "stage")


def analyst_backtest(s, d):
    rows = _one(s, d).where((F.col("as_of") == 2021) & F.col("bt_growth_x").isNotNull() & ~F.isnan("bt_growth_x"))
    return serve.page(rows.select("trend_id", "label", "bt_at_cutoff", "bt_peak_after", F.round("bt_growth_x", 3).alias("bt_growth_x")), [F.desc("bt_growth_x"), "trend_id"], 0, 100)


def analyst_rejected(s, d):
    return serve.page(_pool(s, d).rejected.select("cand_id", "label", "n_docs", "reason"), [F.desc("n_docs"), "cand_id"], 0, 20)


def sample_year_alloc(s, d):
    return s.createDataFrame(list(sampling.year_quotas(2015, 2026, 5000).items()), "year int, quota int")


def fn_ngrams_prototype(s, d):
    return works(s, d, "title").select("doc_id", F.explode(text.ngrams(F.col("title"), stop=text.PROTOTYPE_STOP, token=text.PROTOTYPE_TOKEN)).alias("term"))


def fn_term_pattern(s, d):
    return works(s, d, "title").where(F.col("title").rlike(text.term_pattern(TERM))).select("doc_id")


def fn_first_valid_url(s, d):
    tried = F.array(F.col("doi"), F.concat(F.lit("ftp:"), "url"), F.lit("https:///none"), F.col("url"))
    return works(s, d, "doi", "url").select("doc_id", records.first_url(tried).alias("url"))


def fn_doc_id_strip(s, d):
    return works(s, d, "source").where("source = 'openalex'").select("doc_id", F.substring_index("doc_id", ":", -1).alias("short"))


def fn_prompt_render(s, d):
    return serve.prompts(_one(s, d), works(s, d, "year", "title", "abstract"))


def filter_clusters(s, d):
    c = read(s, d, "candidates").where("kind = 'cluster'").groupBy("cand_id").agg(F.min("label").alias("label"), F.min("emb_row").alias("emb_row"))
    kept, rejected = candidates.filter_clusters(c, series.links(read(s, d, "cand_docs")), works(s, d, "title"))
    return kept.select("cand_id", "emb_row", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("cand_id", F.lit(None).cast("int").alias("emb_row"), "reason"))


def _made_pool(s, d):
    """A row a candidate with figures made from it, so that every reason holds somewhere."""
    n, k = F.col("n_docs"), F.length("label")
    rows = read(s, d, "candidates").groupBy("cand_id").agg(F.min("label").alias("label"), F.max("n_docs").alias("n_docs"))
    return rows.select("cand_id", F.when(k % 9 == 0, F.concat(F.lit("the "), "label")).otherwise(F.col("label")).alias("label"), (n * 3).alias("counts_recent"), (k % 11).alias("age"), (k % 7).alias("active_years"), (n % 11 / 10).alias("last_year_share"), (n % 13).alias("n_countries"), (k % 5).alias("n_domains"), (n % 4 / 4).alias("trusted_share"), (k % 30).alias("months"), ((n % 9) / 50).alias("growth"), (n * 700).cast("long").alias("science_10y"))


def reject_rules(s, d):
    return _made_pool(s, d).select("cand_id", score.reject_reason().alias("reason"))


def reject_rules_live(s, d):
    rows = _made_pool(s, d).withColumn("age", F.col("months")).withColumn("counts_recent", F.floor(F.col("counts_recent") / 30))
    return rows.select("cand_id", score.reject_reason_live(phrases=("crop monitoring",)).alias("reason"), score.confidence_live(F.col("counts_recent"), F.col("n_domains"), F.col("active_years")).alias("confidence"))


def embed_guard(s, d):
    """Digest of what vectors were made of, in the order of their rows: vectors of another digest don't fit."""
    rows = read(s, d, "candidates").where("emb_row is not null").groupBy("emb_row").agg(F.min("cand_id").alias("cand_id"), F.min("label").alias("label"))
    return publish.fingerprint(rows.select(F.concat_ws("|", F.col("emb_row").cast("string"), "cand_id", "label").alias("line")))


def run_live_ingest(s, d):
    rows = works(s, d, "source", "trust_level", "title", "url", "year")
    status = live.ingest(rows.where("year >= 2025"), rows.where("year < 2025"), PHRASES)[1]
    return status.select("source", "collected", "on_topic", (F.col("kept") <= F.col("on_topic")).alias("bounded"))


def export_terms(s, d):
    kept, links, _ = candidates.extract_terms(works(s, d, "title", "domain").where(F.col("domain") == DOMAIN), DOMAIN, 2)
    return candidates.check_terms(kept, links)


def demo_documents(s, d):
    """The newest, most cited works whose title or abstract holds a term of a fixed pool, at two cutoffs. The pool is a list in the
    plan: each work names the terms it holds, no work is paired with a term it hasn't."""
    held = F.concat_ws("\n", F.lower("title"), F.lower("abstract"))
    rows = works(s, d, "year", "cited_by", "title", "abstract").select("doc_id", "year", "cited_by", F.explode(F.filter(F.array(*map(F.lit, POOL)), lambda p: held.contains(p))).alias("term"))
    cut = rows.select("*", F.explode(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: F.col("year") <= c)).alias("as_of"))
    top = series.top_docs(cut.withColumn("cand_id", F.concat_ws("@", "term", F.col("as_of").cast("string"))))
    return top.select(F.substring_index("cand_id", "@", 1).alias("term"), F.substring_index("cand_id", "@", -1).cast("int").alias("as_of"), "place", "doc_id")


def stream_term_counts(s, d):
    """Titles' terms counted as works come in; each batch hands on the counts it changed, the newest of a term counts."""
    titles = events.rows_of(s, f"{d}/works.parquet", WORKS)
    counts = titles.select(F.explode(text.ngrams(F.col("title"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return events.drain(s, counts, "terms", "update").groupBy("term").agg(F.max("n").alias("n")).where("n >= 20")


NAMES = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")]
QUERIES = {n: globals()[n] for n in NAMES}
_P = f"regexp_extract_all(lower(substr(title, 1, 4096)), '{text.PROTOTYPE_TOKEN}')"
_PS = "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(text.PROTOTYPE_STOP)) + ")"
_MADE = f"""c AS (SELECT cand_id, min(label) AS l, max(n_docs) AS n FROM candidates GROUP BY 1), d AS (SELECT *, length(l) AS k, CASE WHEN length(l) % 9 = 0 THEN concat('the ', l) ELSE l END AS label FROM c),
made AS (SELECT cand_id, label, n * 3 AS counts_recent, k % 11 AS age, k % 7 AS active_years, (n % 11) / 10.0::DOUBLE AS last_year_share, n % 13 AS n_countries, k % 5 AS n_domains, (n % 4) / 4.0::DOUBLE AS trusted_share, k % 30 AS months, (n % 9) / 50.0::DOUBLE AS growth, (n * 700)::BIGINT AS science, {_WORDS} AS ws FROM d)"""
SQL = {
    "limit_top": _with(_ONE) + "SELECT trend_id, rank FROM t1 WHERE rank <= 5",
    "page_slice": _with(_ONE) + "SELECT trend_id, rank FROM t1 ORDER BY rank, trend_id LIMIT 40 OFFSET 5",
    "api_trend": _with(_ONE) + "SELECT trend_id, domain, rank, label FROM t1 ORDER BY trend_id LIMIT 1",
    "api_domains": "SELECT domain, count(DISTINCT as_of) AS cutoffs, count(DISTINCT trend_id) AS n_trends, max(as_of) AS newest FROM trends GROUP BY 1",
    "analyst_top": _with(_ONE) + f"SELECT rank, label, takeoff_year, stage FROM t1 WHERE domain = '{DOMAIN}' AND as_of = (SELECT max(as_of) FROM t1 WHERE domain = '{DOMAIN}')",
    "analyst_backtest": _with(_ONE) + "SELECT trend_id, label, bt_at_cutoff, bt_peak_after, round(bt_growth_x, 3) AS bt_growth_x FROM t1 WHERE as_of = 2021 AND bt_growth_x IS NOT NULL AND NOT isnan(bt_growth_x) ORDER BY round(bt_growth_x, 3) DESC, trend_id LIMIT 100",
    "analyst_rejected": _POOL + "SELECT cand_id, label, counts_recent::INTEGER AS n_docs, reason FROM rr WHERE reason IS NOT NULL ORDER BY n_docs DESC, cand_id LIMIT 20",
    "sample_year_alloc": "SELECT y::INTEGER AS year, CASE WHEN y < 2015 + 5000 % 12 THEN 417 ELSE 416 END AS quota FROM range(2015, 2027) r(y)",
    "fn_ngrams_prototype": _with(_W) + f""", tok AS (SELECT doc_id, list_slice({_P}, 1, 128) AS t FROM w), tp AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM tok)
SELECT DISTINCT doc_id, array_to_string(list_slice(t, i, i + n - 1), ' ') AS term FROM tp, range(2, 5) r(n) WHERE i + n - 1 <= len(t) AND t[i] NOT IN {_PS} AND t[i + n - 1] NOT IN {_PS} AND len(list_filter(list_slice(t, i, i + n - 1), lambda x: x IN {_PS})) <= n - 2 AND len(list_filter(list_slice(t, i, i + n - 1), lambda x: length(x) > 2)) > 0""".replace("\n, tok", ", tok"),
    "fn_term_pattern": _with(_W) + rf"SELECT doc_id FROM w WHERE regexp_matches(lower(title), '(^|[^\p{{L}}\p{{N}}_-]){TERM}s?($|[^\p{{L}}\p{{N}}_-])')",
    "fn_first_valid_url": _with(_W) + r"SELECT doc_id, list_filter([doi, 'ftp:' || url, 'https:///none', url], lambda u: regexp_matches(u, '^https?://[^/?#\s]+'))[1] AS url FROM w",
    "fn_doc_id_strip": _with(_W) + "SELECT doc_id, regexp_replace(doc_id, '^.*:', '') AS short FROM w WHERE source = 'openalex'",
    "fn_prompt_render": _with(_W, _ONE) + """, u AS (SELECT trend_id, label, unnest(top_doc_ids) AS doc_id, generate_subscripts(top_doc_ids, 1) AS pos FROM t1),
v AS (SELECT trend_id, label, count(*) AS n, string_agg(concat('[', doc_id, '] (', year, ') ', title, CASE WHEN coalesce(abstract, '') <> '' THEN concat(chr(10), '  ', substr(abstract, 1, 400)) ELSE '' END), chr(10) ORDER BY pos) AS lines FROM u JOIN w USING (doc_id) GROUP BY 1, 2)
SELECT trend_id, concat('Topic: ', label, chr(10), CASE WHEN n = 1 THEN 'Only one document is known; say so.' ELSE concat(n, ' documents; say what several of them support.') END, chr(10), lines) AS prompt FROM v""",
    "filter_clusters": _with(_W) + f""", c AS (SELECT cand_id, min(emb_row) AS emb_row FROM candidates WHERE kind = 'cluster' GROUP BY 1),
m AS (SELECT cand_id, bool_or(regexp_matches(t, '{_marker(text.TECHNOLOGY)}') AND NOT regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}-])(neural|artificial|convolutional|recurrent)[^\\p{{L}}\\p{{N}}]*$')) AS ok FROM cand_docs JOIN (SELECT doc_id, regexp_replace(trim(lower(title)), '\\s+', ' ', 'g') AS t FROM w) USING (doc_id) GROUP BY 1)
SELECT cand_id, CASE WHEN coalesce(ok, false) THEN (row_number() OVER (PARTITION BY coalesce(ok, false) ORDER BY emb_row NULLS FIRST, cand_id) - 1)::INTEGER END AS emb_row, CASE WHEN coalesce(ok, false) THEN NULL ELSE 'no technology marker' END AS reason FROM c LEFT JOIN m USING (cand_id)""",
    "embed_guard": "WITH l AS (SELECT concat_ws('|', emb_row, min(cand_id), min(label)) AS line FROM candidates WHERE emb_row IS NOT NULL GROUP BY emb_row) SELECT count(*) AS n_rows, sum(('0x' || substr(sha256(line), 1, 12))::BIGINT)::VARCHAR AS digest FROM l",
    "reject_rules": f"WITH {_MADE} SELECT cand_id, CASE WHEN {_FRAG} THEN 'phrase fragment' WHEN counts_recent < 20 THEN 'too little data' WHEN age > 8 THEN 'too old' WHEN active_years < 3 THEN 'one-year spike' WHEN last_year_share > 0.8::DOUBLE AND n_countries < 10 THEN 'bulk dump' WHEN n_countries < 5 THEN 'no geographic spread' END AS reason FROM made",
    "reject_rules_live": f"""WITH {_MADE}, lv AS (SELECT * REPLACE (counts_recent // 30 AS counts_recent), list_distinct(list_transform(list_filter(regexp_split_to_array(replace(lower(label), '-', ' '), '\\s+'), lambda x: length(x) >= 3), lambda x: substr(x, 1, 4))) AS st FROM made)
SELECT cand_id, CASE WHEN len(st) > 0 AND len(list_filter(st, lambda x: x NOT IN ('crop', 'moni'))) = 0 THEN 'the topic of the query' WHEN len(ws) > 1 AND (ws[1] IN {_HEADWORDS} OR ws[-1] IN {_HEADWORDS}) THEN 'headline fragment' WHEN science > 10000 THEN concat('studied widely: ', replace(format('{{:,}}', science), ',', ' '), ' works in 10 years')
WHEN counts_recent < 2 THEN 'single mention' WHEN months > 24 THEN 'too old' WHEN n_domains < 2 THEN 'one publisher' WHEN trusted_share < 0.34::DOUBLE THEN 'indicator sources only' WHEN months >= 18 AND growth <= 0.03::DOUBLE THEN 'plateau' END AS reason,
CASE WHEN counts_recent < 4 OR active_years < 3 THEN 'low' WHEN counts_recent >= 15 AND n_domains >= 8 THEN 'high' WHEN counts_recent >= 6 AND n_domains >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM lv""",
    "run_live_ingest": _with(_W) + f"SELECT source, count(*) AS collected, count(*) FILTER (WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' crop monitoring ') OR contains(' ' || array_to_string(ws, ' ') || ' ', ' quantum sensing methods ') OR (list_contains(ws, 'crop') AND list_contains(ws, 'monitoring')) OR len(list_intersect(ws, ['quantum', 'sensing', 'methods'])) >= 2) AS on_topic, true AS bounded FROM (SELECT source, {_TOK.format('title')} AS ws FROM w WHERE year >= 2025) GROUP BY 1",
    "export_terms": "SELECT * FROM (VALUES ('sum of counts is the number of links', 0::BIGINT), ('each count is its links', 0), ('a link stands once', 0)) t(rule, violations)",
    "demo_documents": _with(_W) + ", p AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in POOL) + f"]) AS term), c AS (SELECT unnest([{CUTOFFS[0]}, {CUTOFFS[1]}]) AS as_of)\nSELECT term, as_of, (row_number() OVER (PARTITION BY term, as_of ORDER BY year DESC, cited_by DESC NULLS LAST, doc_id))::INTEGER AS place, doc_id FROM w, p, c WHERE year <= as_of AND (contains(lower(title), term) OR contains(lower(abstract), term)) QUALIFY place <= 20",
    "stream_term_counts": "WITH " + _NGRAM.replace("FROM w)", "FROM w)").replace(_W, "w AS (SELECT row_number() OVER () AS doc_id, title FROM works)") + " SELECT term, count(*) AS n FROM ng GROUP BY 1 HAVING count(*) >= 20",
}
