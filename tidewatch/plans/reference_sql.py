"""The queries of reference_queries in DuckDB's SQL, written from what they mean."""

from __future__ import annotations

from tidewatch.functions.text import DISEASE, ENTITY, EVENT, TECHNOLOGY
from tidewatch.operators.entities import CATALOGUE


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# the time of a harvest, whose strings have many forms: day and time as written, then the zone they name or that of their source
_W = r"""hs AS (SELECT works.*, zone, day_first, regexp_replace(trim(harvested_at, ' ' || chr(9) || chr(10) || chr(160)), '\[.*\]$', '') AS h FROM works LEFT JOIN sources USING (source)),
hp AS (SELECT *, regexp_extract(h, '[tT ]([0-9]{1,2}):?([0-9]{2})(?::?([0-9]{2}))?(?:[.,][0-9]+)?(?: ?[AaPp][Mm])? ?([zZ]|[A-Z]{3,4}|МСК|[-+][0-9:]{2,6})?$', ['h', 'm', 's', 'z']) AS x FROM hs),
hd AS (SELECT *, CASE WHEN regexp_matches(h, '^[0-9]{4}-') THEN substr(h, 1, 10)::TIMESTAMP WHEN regexp_matches(h, '^[0-9]{8}T') THEN strptime(substr(h, 1, 8), '%Y%m%d')
  WHEN regexp_matches(h, '^[0-9]{2}/') THEN CASE WHEN day_first THEN strptime(substr(h, 1, 10), '%d/%m/%Y') ELSE strptime(substr(h, 1, 10), '%m/%d/%Y') END
  WHEN regexp_matches(h, '^[0-9]{2}\.') THEN strptime(substr(h, 1, 10), '%d.%m.%Y') WHEN regexp_matches(h, '^[A-Z]') THEN strptime(regexp_extract(h, '[0-9]+ [A-Z][a-z]+ [0-9]+'), '%d %b %Y')
  WHEN regexp_matches(h, '^[0-9]{1,2} ') THEN make_timestamp(regexp_extract(h, ' ([0-9]{4})', 1)::BIGINT, list_position(['янв', 'фев', 'мар', 'апр', 'мая', 'июн', 'июл', 'авг', 'сен', 'окт', 'ноя', 'дек'], substr(regexp_extract(h, '[а-я]+'), 1, 3)), regexp_extract(h, '^[0-9]+')::BIGINT, 0, 0, 0)
  END + to_seconds(x.h::INTEGER % (CASE WHEN regexp_matches(h, '[AaPp][Mm]$') THEN 12 ELSE 24 END) * 3600 + CASE WHEN regexp_matches(h, '[Pp][Mm]$') THEN 43200 ELSE 0 END + x.m::INTEGER * 60 + coalesce(nullif(x.s, '')::INTEGER, 0)) AS local FROM hp WHERE x.h <> ''),
ht AS (SELECT hd.* EXCLUDE (zone, day_first, h, x, local), CASE WHEN x.z = '' THEN local::TIMESTAMP AT TIME ZONE zone AT TIME ZONE 'UTC' WHEN regexp_matches(x.z, '^[-+]') THEN local - to_minutes(regexp_extract(x.z, '^([-+][0-9]{2})', 1)::INTEGER * 60 + (substr(x.z, 1, 1) || coalesce(nullif(regexp_extract(x.z, '^...:?([0-9]{2})$', 1), ''), '0'))::INTEGER)
  ELSE local - to_minutes(coalesce(offset_min, 0)) END AS happened FROM hd LEFT JOIN zone_names ON upper(x.z) = upper(abbr)
  UNION ALL SELECT hp.* EXCLUDE (zone, day_first, h, x), make_timestamp(substr(h, 1, 10)::BIGINT * 1000000) FROM hp WHERE x.h = ''),
w AS (SELECT * EXCLUDE (happened) FROM ht WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY happened) = 1)"""
_L = "l AS (SELECT DISTINCT cand_id, doc_id FROM cand_docs WHERE cand_id IS NOT NULL AND doc_id IS NOT NULL)"
_J = "j AS (SELECT l.cand_id, w.* FROM l JOIN w USING (doc_id))"
_WEIGHT = "CASE doc_type WHEN 'model' THEN 1.6 WHEN 'repo' THEN 1.5 WHEN 'preprint' THEN 1.4 WHEN 'article' THEN 1.0 WHEN 'patent' THEN 0.9 WHEN 'report' THEN 0.8 ELSE 1.0 END"
_YC = f"yc AS (SELECT cand_id, year, round_even(sum({_WEIGHT}), 0)::BIGINT AS n FROM j GROUP BY 1, 2)"
_MONTH = "CASE WHEN regexp_matches(date, '^[0-9]{4}-(0[1-9]|1[0-2])(-|$)') THEN substr(date, 1, 7) ELSE concat(year, '-06') END"
_MC = f"mc AS (SELECT cand_id, {_MONTH} AS month, round_even(sum({_WEIGHT}), 0)::BIGINT AS n FROM j GROUP BY 1, 2)"
_LAB = "lab AS (SELECT cand_id, label, domain FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY label, domain) = 1)"
_TAKE = "tk AS (SELECT cand_id, min(takeoff_year) AS takeoff FROM trends GROUP BY 1)"
_ONE = "t1 AS (SELECT * FROM trends QUALIFY row_number() OVER (PARTITION BY trend_id ORDER BY rank, emergence_score, methodology_version, c_novelty, c_growth) = 1)"
_BASE = _with(_W, _L, _J)
_YEARS = _with(_W, _L, _J, _YC)
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)*')"
_HOST = r"nullif(regexp_extract(lower(url), '^https?://([a-z0-9.-]+)', 1), '')"
_STOPS = "('a','an','the','of','in','on','for','to','and','or','with','by','from','at','as','is','are','was','were','this','that','these','those','using','based','study','analysis','approach','new','via','into','и','в','во','на','для','с','со','к','по','из','от','о','об','а','но','или','это','как','при','исследование','анализ','новый','новая','новые')"
_NGRAM = _W + rf""",
tok AS (SELECT doc_id, list_slice({_TOK.format("substr(title, 1, 4096)")}, 1, 128) AS t FROM w),
tp AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM tok),
ng AS (SELECT DISTINCT doc_id, array_to_string(list_slice(t, i, i + n - 1), ' ') AS term FROM tp, range(2, 5) r(n)
  WHERE i + n - 1 <= len(t) AND t[i] NOT IN {_STOPS} AND t[i + n - 1] NOT IN {_STOPS} AND len(list_filter(list_slice(t, i, i + n - 1), lambda x: x IN {_STOPS})) <= n - 2 AND len(list_filter(list_slice(t, i, i + n - 1), lambda x: length(x) > 2)) > 0)"""
_PAST = "past AS (SELECT * FROM yc WHERE year <= 2024)"


def _shape(source: str, as_of: int) -> tuple[str, ...]:
    a, h = as_of, as_of - 4
    return (
        f"norm AS (SELECT year, greatest(sum(n)::DOUBLE, 1.0) AS norm FROM {source} GROUP BY 1)",
        f"fr AS (SELECT cand_id, unnest(range({h}, {a + 1}))::INTEGER AS year FROM (SELECT DISTINCT cand_id FROM {source}))",
        f"dense AS (SELECT fr.cand_id, fr.year, coalesce(p.n, 0) AS n, coalesce(p.n, 0) / coalesce(norm.norm, 1.0) * 1e6 AS freq FROM fr LEFT JOIN {source} p USING (cand_id, year) LEFT JOIN norm USING (year))",
        f"""sh AS (SELECT cand_id, coalesce(regr_slope(ln(freq + 1), year::DOUBLE), 0) AS growth,
  coalesce(regr_slope(ln(freq + 1), year::DOUBLE) FILTER (WHERE year > {a - 2}), 0) - coalesce(regr_slope(ln(freq + 1), year::DOUBLE) FILTER (WHERE year < {h + 2}), 0) AS accel,
  (sum(CASE WHEN year = {a} THEN freq ELSE 0 END) + 0.1) / (sum(CASE WHEN year < {a} THEN freq ELSE 0 END) / 4 + 0.1) AS burst, sum(CASE WHEN year = {a} THEN freq ELSE 0 END) AS maturity,
  sum(n)::BIGINT AS counts_recent, count(*) FILTER (WHERE freq > 0) AS active_years, sum(freq) AS s, array_to_string(list(n ORDER BY year), ',') AS counts FROM dense GROUP BY 1)""",
        f"act AS (SELECT cand_id, year, CASE WHEN year - lag(year) OVER (PARTITION BY cand_id ORDER BY year) <= 3 THEN 0 ELSE 1 END AS new FROM {source} WHERE n >= 5)",
        "sg AS (SELECT cand_id, year, sum(new) OVER (PARTITION BY cand_id ORDER BY year) AS g FROM act)",
        "sgs AS (SELECT cand_id, g, min(year) AS a, max(year) AS b FROM sg GROUP BY 1, 2)",
        "ls AS (SELECT cand_id, arg_max(a, g) AS a, arg_max(b, g) AS b, count(*) AS k FROM sgs GROUP BY 1)",
        f"hist AS (SELECT p.cand_id, p.year, p.n, coalesce(ls.k, 0) AS k, max(p.n) OVER (PARTITION BY p.cand_id) AS peak FROM {source} p LEFT JOIN ls USING (cand_id) WHERE ls.a IS NULL OR p.year BETWEEN ls.a AND ls.b)",
        "cr AS (SELECT cand_id, min(year) FILTER (WHERE n >= 5) AS f, min(year) FILTER (WHERE n >= greatest(10.0::DOUBLE, 0.1::DOUBLE * peak)) AS t, max(k) AS k FROM hist GROUP BY 1)",
        f"bs AS (SELECT x.cand_id, median(coalesce(p.n, 0)) AS base FROM (SELECT cand_id, unnest(range({a - 13}, {a - 8}))::INTEGER AS year FROM (SELECT DISTINCT cand_id FROM {source})) x LEFT JOIN {source} p USING (cand_id, year) GROUP BY 1)",
        f"bk AS (SELECT p.cand_id, min(year) AS b FROM {source} p JOIN bs USING (cand_id) WHERE year BETWEEN {a - 8} AND {a} AND base >= 20 AND n >= base * 2.5 GROUP BY 1)",
        f"""comp AS (SELECT sh.*, CASE WHEN bk.b IS NULL THEN cr.f ELSE least(coalesce(cr.f, bk.b), bk.b) END AS first_mention, coalesce(bk.b, cr.t) AS takeoff, coalesce({a} - coalesce(bk.b, cr.t, cr.f), 99) AS age, cr.k > 1 OR bk.b IS NOT NULL AS homonym,
  CASE WHEN s > 0 THEN round_even(maturity / s, 3) ELSE 1.0 END AS last_year_share FROM sh JOIN cr USING (cand_id) LEFT JOIN bk USING (cand_id))""",
    )


_SPREAD = "sp AS (SELECT cand_id, count(DISTINCT c) AS n_countries FROM (SELECT cand_id, unnest(countries) AS c FROM j WHERE year BETWEEN 2022 AND 2024) GROUP BY 1)"
_EDGE = "('a','an','the','of','for','and','or','in','on','to','with','by','from','using','based','via','as','at','is','are','its','their','our','this','that','new','towards','toward','into','through','under','over','between','during','without','within')"
_INNER = "('a','an','the','and','or','but','vs','versus')"
_FRAG = f"(len(ws) < 2 OR ws[1] IN {_EDGE} OR ws[-1] IN {_EDGE} OR len(list_filter(list_slice(ws, 2, len(ws) - 1), lambda x: x IN {_INNER})) > 0)"
_WORDS = "list_filter(regexp_split_to_array(lower(label), '\\s+'), lambda x: x <> '')"
_REASONED = f"""rs AS (SELECT comp.*, lab.label, lab.domain, coalesce(sp.n_countries, 0) AS n_countries, {_WORDS} AS ws FROM comp JOIN lab USING (cand_id) LEFT JOIN sp USING (cand_id)),
rr AS (SELECT *, CASE WHEN {_FRAG} THEN 'phrase fragment' WHEN counts_recent < 20 THEN 'too little data' WHEN age > 8 THEN 'too old' WHEN active_years < 3 THEN 'one-year spike' WHEN last_year_share > 0.8 AND n_countries < 10 THEN 'bulk dump' WHEN n_countries < 5 THEN 'no geographic spread' END AS reason FROM rs)"""


def _rank(v: str) -> str:
    return f"((rank() OVER (ORDER BY {v})) - 1 + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE) / greatest(1, count(*) OVER () - 1)"


_SCORED = f"""rk AS (SELECT *, {_rank("-age")} AS a, {_rank("round(growth, 9)")} AS g, {_rank("round(accel, 9)")} AS c, {_rank("round(ln(burst + 0.01), 9)")} AS b, {_rank("n_countries")} AS s5, {_rank("round(maturity, 9)")} AS m FROM rr WHERE reason IS NULL),
sc AS (SELECT *, round((a * 0.20::DOUBLE + g * 0.32::DOUBLE + c * 0.23::DOUBLE + b * 0.15::DOUBLE + s5 * 0.10::DOUBLE) * (1.0::DOUBLE - 0.5::DOUBLE * m), 4) AS es, round_even(m, 3) AS maturity_pct FROM rk)"""
_COMP = _with(_W, _L, _J, _YC, _PAST, *_shape("past", 2024))
_POOL = _with(_W, _L, _J, _YC, _PAST, *_shape("past", 2024), _SPREAD, _LAB, _REASONED, _SCORED)
_MIX = lambda m: f"floor({m} / 12)::INTEGER"
_PUB = r"CASE WHEN source = 'gnews' AND contains(title, ' - ') THEN lower(trim(regexp_replace(title, '^.* - ', ''))) ELSE regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^www\.', '') END"
_MCOMP = (
    f"mi AS (SELECT cand_id, n, substr(month, 1, 4)::INTEGER * 12 + substr(month, 6, 2)::INTEGER - 1 AS m FROM mc), mp AS (SELECT * FROM mi WHERE m <= {2026 * 12 + 5})",
    "mn AS (SELECT m, greatest(sum(n)::DOUBLE, 1.0) AS norm FROM mp GROUP BY 1)",
    f"mf AS (SELECT cand_id, unnest(range({2026 * 12 + 5 - 23}, {2026 * 12 + 6}))::INTEGER AS m FROM (SELECT DISTINCT cand_id FROM mp))",
    "md AS (SELECT mf.cand_id, mf.m, coalesce(mp.n, 0) AS n, coalesce(mp.n, 0) / coalesce(mn.norm, 1.0) * 1e6 AS freq FROM mf LEFT JOIN mp USING (cand_id, m) LEFT JOIN mn USING (m))",
    f"ms AS (SELECT *, ln(sum(freq) OVER (PARTITION BY cand_id ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) + 1) AS y, (m - {2026 * 12 + 5 - 23})::DOUBLE AS x FROM md)",
    """mcp AS (SELECT cand_id, coalesce(regr_slope(y, x), 0) AS growth, coalesce(regr_slope(y, x) FILTER (WHERE x >= 12), 0) - coalesce(regr_slope(y, x) FILTER (WHERE x < 12), 0) AS accel,
  (sum(CASE WHEN x >= 21 THEN freq ELSE 0 END) / 3 + 0.1) / (sum(CASE WHEN x < 21 THEN freq ELSE 0 END) / 21 + 0.1) AS burst, sum(n)::BIGINT AS counts_recent, count(*) FILTER (WHERE freq > 0) AS active_months, array_to_string(list(n ORDER BY m), ',') AS counts FROM ms GROUP BY 1)""",
    "mx AS (SELECT cand_id, min(m) FILTER (WHERE n >= 2) AS f, min(m) FILTER (WHERE n >= greatest(3.0::DOUBLE, 0.1::DOUBLE * peak)) AS t FROM (SELECT *, max(n) OVER (PARTITION BY cand_id) AS peak FROM mp) GROUP BY 1)",
    f"mcomp AS (SELECT mcp.*, {_MIX('f')} AS first_mention, {_MIX('t')} AS takeoff_year, CASE WHEN coalesce(t, f) >= {2026 * 12 + 5 - 23} THEN {2026 * 12 + 5} - coalesce(t, f) ELSE 99 END AS age FROM mcp JOIN mx USING (cand_id))",
)
_TRUST = "CASE WHEN source = 'gnews' THEN 0.5 WHEN trust_level = 'trusted' THEN 1.0 WHEN trust_level = 'indicator' THEN 0.0 ELSE 0.5 END::DOUBLE"
_HEADWORDS = "('raises','raised','raise','raising','launches','launched','launch','unveils','unveiled','announces','announced','secures','secured','lands','closes','debuts','acquires','acquired','partners','expands','first','new','top','best','pure-play','largest','leading','biggest','latest','how','why','what','inside','meet','says','said','gets','wins','hits','nears','eyes')"
_STEMS = "list_distinct(list_transform(list_filter(regexp_split_to_array(replace(lower({}), '-', ' '), '\\s+'), lambda x: length(x) >= 3), lambda x: substr(x, 1, 4)))"
_TOPIC = "(len({0}) > 0 AND (len(list_filter({0}, lambda x: x NOT IN ('crop', 'moni'))) = 0 OR len(list_filter({0}, lambda x: x NOT IN ('quan', 'sens', 'meth'))) = 0))".format(_STEMS.format("label"))
_LIVE = _with(
    _W, _L, _J, _MC, *_MCOMP, _LAB, f"dm AS (SELECT cand_id, count(DISTINCT {_PUB}) AS n_domains FROM j GROUP BY 1)", f"tr AS (SELECT cand_id, avg({_TRUST}) AS ts FROM j GROUP BY 1)",
    f"""lr AS (SELECT *, CASE WHEN {_TOPIC} THEN 'the topic of the query' WHEN len(ws) > 1 AND (ws[1] IN {_HEADWORDS} OR ws[-1] IN {_HEADWORDS}) THEN 'headline fragment' WHEN counts_recent < 2 THEN 'single mention' WHEN age > 24 THEN 'too old' WHEN n_domains < 2 THEN 'one publisher'
  WHEN ts < 0.34 THEN 'indicator sources only' WHEN age >= 18 AND growth <= 0.03 THEN 'plateau' END AS reason FROM (SELECT mcomp.*, label, domain, n_domains, ts, {_WORDS} AS ws FROM mcomp JOIN lab USING (cand_id) JOIN dm USING (cand_id) JOIN tr USING (cand_id)))""",
)


def _marker(words: str) -> str:
    """A list of marker words, for a dialect whose word borders and classes know ASCII only."""
    return words.replace(r"\b(?:", r"(^|[^\p{L}\p{N}_])(").replace(r")\b", r")($|[^\p{L}\p{N}_])").replace(r"\w*", r"[\p{L}\p{N}_]*")


_REASON = rf"""CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '(^|[^\p{{L}}\p{{N}}-])(neural|artificial|convolutional|recurrent)[^\p{{L}}\p{{N}}]*$') THEN 'terminal modifier' WHEN regexp_matches(t, '{_marker(TECHNOLOGY)}') THEN NULL
WHEN regexp_matches(t, '{_marker(EVENT)}') THEN 'event' WHEN regexp_matches(t, '{_marker(DISEASE)}') THEN 'disease' WHEN regexp_matches(t, '{_marker(ENTITY)}') THEN 'entity' ELSE 'no technology marker' END"""
_CATALOGUE = ", ".join(f"'{name}'" for name in CATALOGUE)
_REF = "ref AS (SELECT label FROM (SELECT unnest(concepts) AS label FROM works) WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)"
_NORM = "regexp_replace(trim(replace(lower({}), '-', ' ')), 's+$', '')"
_BT = "bt AS (SELECT cand_id, coalesce(max(n) FILTER (WHERE year = 2024), 0) AS a, max(n) FILTER (WHERE year > 2024) AS p FROM yc GROUP BY 1)"
_LEAD = "ld AS (SELECT cand_id, arg_min(year, (-n, year)) - takeoff AS lead FROM yc LEFT JOIN tk USING (cand_id) GROUP BY cand_id, takeoff)"


def _quota(budget: int) -> str:
    base, rest = divmod(budget, 5)
    return f"q AS (SELECT doc_id, year FROM w WHERE year BETWEEN 2022 AND 2026 QUALIFY row_number() OVER (PARTITION BY year ORDER BY sha256(concat(doc_id, ':', 42)), doc_id) <= {base} + CASE WHEN year - 2022 < {rest} THEN 1 ELSE 0 END)"


_TOKSET = "list_distinct({})"
_L_TOK, _T_TOK = _TOK.format("label"), _TOK.format("coalesce(array_to_string(top_terms, ' '), '')")
_MATCH = _with(
    _REF, r"c AS (SELECT cand_id, lower(trim(label)) AS key, aliases, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(label), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS cw FROM candidates QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY label) = 1)",
    r"r AS (SELECT DISTINCT label AS ref, lower(trim(label)) AS key, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(label), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ('of','the','for','and','data','systems','models'))) AS w FROM ref)",
    "hit AS (SELECT ref, cand_id, 1 AS tier FROM r JOIN c USING (key) UNION ALL SELECT ref, cand_id, 2 FROM r JOIN (SELECT cand_id, lower(trim(unnest(aliases))) AS key FROM c) USING (key) UNION ALL SELECT ref, cand_id, 3 FROM r, c WHERE len(w) > 0 AND list_has_all(cw, w))",
    "m AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY ref ORDER BY tier, cand_id) = 1)",
)
_NEWS = "(source IN ('gnews', 'hackernews') OR coalesce(source_type, '') IN ('news', 'blog', 'press_release', 'aggregator'))"
_MI = "CASE WHEN regexp_matches(substr(date, 1, 7), '^[0-9]{4}-(0[1-9]|1[0-2])$') THEN substr(date, 1, 4)::INTEGER * 12 + substr(date, 6, 2)::INTEGER - 1 END"
_E = 2026 * 12 + 5

SQL = {
    "scan_parquet": "SELECT doc_id, source, year, cited_by FROM works",
    "scan_multi_with_filename": "SELECT 'candidates.parquet' AS file_name, count(*) AS n FROM candidates",
    "scan_projected_batches": "SELECT count(*) AS n, sum(length(title))::BIGINT AS chars FROM works WHERE length(title) > 60",
    "scan_metadata": "SELECT count(*) AS n_rows FROM counts",
    "scan_json_cache": "SELECT doi AS key, min(lower(url)) AS target FROM works WHERE doi IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(url)) = 1",
    "src_concept": "SELECT lower(trim(c)) AS concept, count(*) AS n, count(DISTINCT domain) AS n_domains FROM (SELECT unnest(concepts) AS c, domain FROM works) WHERE lower(trim(c)) IN (SELECT lower(trim(label)) FROM candidates) GROUP BY 1",
    "src_science_base": _with(_W, _LAB, "s AS (SELECT label, count(*) AS k FROM (SELECT unnest(concepts) AS label FROM w) WHERE label IS NOT NULL GROUP BY 1)") + "SELECT cand_id, k AS science_10y FROM lab LEFT JOIN s USING (label)",
    "upsert_journal": "SELECT domain AS dataset, cand_id AS tbl, as_of AS version, max(n_docs)::BIGINT AS n_rows FROM trends GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY domain, cand_id ORDER BY as_of DESC) = 1",
    "sink_cards_merge": "WITH t AS (SELECT DISTINCT trend_id, as_of FROM trends) SELECT trend_id, CASE WHEN as_of % 2 = 0 THEN 'new' ELSE 'old' END AS made FROM t WHERE as_of % 2 = 0 OR as_of <= 2023",
    "status_listing": "SELECT 'index' AS dataset, 'trends' AS tbl, count(*) AS n_rows FROM trends",
    "fingerprint": "SELECT count(*) AS n_rows, sum(('0x' || substr(sha256(concat(cand_id, chr(31), doc_id)), 1, 12))::BIGINT)::VARCHAR AS digest FROM cand_docs",
    "mock_export": "SELECT cand_id, concat('{\"label\":\"', min(label), '\",\"n_docs\":', max(n_docs), '}') AS body FROM candidates GROUP BY 1",
    "sink_parquet_zstd": "SELECT cand_id, doc_id, max(weight) AS weight FROM cand_docs GROUP BY 1, 2",
    "filter_as_of": _YEARS + "SELECT * FROM yc WHERE year <= 2024",
    "filter_year_between": _with(_W) + "SELECT doc_id, year FROM w WHERE year BETWEEN 2020 AND 2022",
    "filter_since": _BASE + "SELECT j.cand_id, count(*) AS n FROM j LEFT JOIN (SELECT cand_id, max(takeoff_year) AS t FROM trends GROUP BY 1) USING (cand_id) WHERE year >= coalesce(t, 0) GROUP BY 1",
    "filter_eq_as_of": "SELECT DISTINCT trend_id, rank, cand_id FROM trends WHERE as_of = 2024",
    "filter_like_doc": _with(_W) + "SELECT doc_id, year FROM w WHERE year BETWEEN 2018 AND 2026 AND (lower(title) LIKE '%crop monitoring%' OR lower(abstract) LIKE '%crop monitoring%')",
    "filter_in_list": _with(_W, _ONE, "u AS (SELECT trend_id, unnest(top_doc_ids) AS doc_id, unnest(range(len(top_doc_ids))) AS p FROM t1)", "f AS (SELECT trend_id, doc_id, min(p) AS p FROM u GROUP BY 1, 2)") + "SELECT trend_id, (row_number() OVER (PARTITION BY trend_id ORDER BY p) - 1)::INTEGER AS pos, doc_id, year FROM f JOIN w USING (doc_id)",
    "pred_invalid_rows": "SELECT count(*) AS n FROM works WHERE domain IS DISTINCT FROM 'artificial-intelligence' OR year > 2024 OR doi IS NULL",
    "pred_fragment": _with(_LAB) + f"SELECT cand_id, {_FRAG} AS fragment FROM (SELECT *, {_WORDS} AS ws FROM lab)",
    "pred_headline_fragment": _with(_W) + f"SELECT doc_id, len(ws) > 1 AND (ws[1] IN {_HEADWORDS} OR ws[-1] IN {_HEADWORDS}) AS piece FROM (SELECT doc_id, {_WORDS.replace('label', 'title')} AS ws FROM w)",
    "pred_technology": _with(_LAB) + f"SELECT cand_id, {_REASON} AS reason FROM (SELECT cand_id, regexp_replace(trim(lower(label)), '\\s+', ' ', 'g') AS t FROM lab)",
    "pred_live_technology": _with(_W) + f"SELECT doc_id, CASE WHEN title IN ({_CATALOGUE}) THEN NULL ELSE {_REASON} END AS reason FROM (SELECT doc_id, title, regexp_replace(trim(lower(title)), '\\s+', ' ', 'g') AS t FROM w)",
    "pred_topic_match": _with(_W) + f"SELECT doc_id FROM (SELECT doc_id, {_TOK.format('title')} AS ws FROM w) WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' crop monitoring ') OR contains(' ' || array_to_string(ws, ' ') || ' ', ' quantum sensing methods ') OR (list_contains(ws, 'crop') AND list_contains(ws, 'monitoring')) OR len(list_intersect(ws, ['quantum', 'sensing', 'methods'])) >= 2",
    "pred_query_topic": _with(_LAB) + f"SELECT cand_id, {_TOPIC} AS topic FROM lab",
    "pred_public_url": _with(_W) + r"SELECT doc_id, regexp_matches(lower(url), '^https?://[a-z0-9-]+(\.[a-z0-9-]+)+(/|$)') AND NOT regexp_matches(lower(url), '^https?://([^/]*\.)?(local|internal|localdomain|home|lan)(/|$)') AS public FROM w",
    "pred_phrases": "SELECT DISTINCT cand_id, coalesce(len(aliases) BETWEEN 1 AND 3 AND len(list_filter(aliases, lambda a: regexp_full_match(a, '[\\x20-\\x7e]{1,200}') AND regexp_matches(a, '[A-Za-z]'))) = len(aliases), false) AS valid FROM candidates",
    "pred_dataset_name": "SELECT DISTINCT domain, regexp_full_match(domain, '[a-z0-9][a-z0-9-]{0,63}') AS valid FROM works",
    "validate_contract": "SELECT 'repeated key' AS problem, count(*) AS n FROM (SELECT 1 FROM cand_docs GROUP BY cand_id, doc_id HAVING count(*) > 1) HAVING count(*) > 0",
    "project_contract": "SELECT cand_id, kind, label, n_docs, true AS no_aliases FROM candidates",
    "project_api_trend": _with(_ONE) + "SELECT trend_id, array_to_string(list_transform(range(1, len(years) + 1), lambda i: concat(years[i], ':', counts[i])), ' ') AS series, bt_at_cutoff IS NOT NULL AND bt_peak_after IS NOT NULL AND bt_growth_x IS NOT NULL AS backtest FROM t1",
    "join_links_works": _BASE + "SELECT cand_id, doc_id, year FROM j",
    "join_labels": _with(_W, _L, _J, _YC, _LAB) + "SELECT cand_id, label, year, n FROM yc JOIN lab USING (cand_id)",
    "join_quota": _with(_W, _quota(500)) + "SELECT year, count(*) AS n FROM q GROUP BY 1",
    "join_selected": _with(_W, _quota(300)) + "SELECT doc_id, w.year, title FROM w JOIN q USING (doc_id)",
    "join_incoming_accepted": "WITH " + _NGRAM + " SELECT term, doc_id FROM ng WHERE term IN (SELECT term FROM ng GROUP BY 1 HAVING count(*) >= 20)",
    "check_left_join": _with(_L) + "SELECT cand_id, n_docs, coalesce(n, 0) AS n FROM (SELECT cand_id, max(n_docs) AS n_docs FROM candidates GROUP BY 1) LEFT JOIN (SELECT cand_id, count(*) AS n FROM l GROUP BY 1) USING (cand_id) WHERE n_docs <> coalesce(n, 0)",
    "anti_unknown_fk": "SELECT doc_id FROM documents WHERE work_id IS NOT NULL AND work_id NOT IN (SELECT doc_id FROM cand_docs JOIN candidates USING (cand_id) WHERE kind = 'cluster' AND doc_id IS NOT NULL)",
    "anti_merge": "SELECT DISTINCT cand_id FROM candidates WHERE cand_id NOT IN (SELECT cand_id FROM trends)",
    "left_defaults": _with(_W, _L, _J, _SPREAD, _LAB) + "SELECT cand_id, coalesce(n_countries, 0) AS n_countries FROM lab LEFT JOIN sp USING (cand_id)",
    "unnest_lateral": _with(_W) + "SELECT doc_id, unnest(countries) AS country FROM w",
    "lateral_top_docs": _with(_W, _ONE) + "SELECT trend_id, count(*) AS n, max(year) AS newest FROM (SELECT DISTINCT trend_id, unnest(top_doc_ids) AS doc_id FROM t1) JOIN w USING (doc_id) GROUP BY 1",
    "suffix_join_trust": _with(_W) + f"SELECT doc_id, CASE WHEN h >= 'g' THEN h ELSE 'example' END AS rule, CASE WHEN h < 'g' THEN 'unknown' WHEN h < 'm' THEN 'trusted' ELSE 'indicator' END AS trust_level FROM (SELECT doc_id, {_HOST} AS h FROM w)",
    "term_title_match": _with(_W, "t AS (SELECT DISTINCT lower(label) AS term FROM candidates WHERE kind = 'term')", f"k AS (SELECT doc_id, concat(' ', array_to_string({_TOK.format('title')}, ' '), ' ') AS x FROM w)") + "SELECT DISTINCT term, doc_id FROM t, k WHERE len(regexp_split_to_array(term, ' ')) <= 4 AND (contains(x, concat(' ', term, ' ')) OR contains(x, concat(' ', term, 's ')))",
    "reference_match": _MATCH + "SELECT * FROM m",
    "agg_recall": _MATCH + "SELECT count(cand_id) AS found, count(*) AS total, count(*) FILTER (WHERE tier = 1) AS exact, coalesce(round(count(cand_id) / nullif(count(*), 0), 4), 0.0) AS recall FROM (SELECT label AS ref FROM ref) LEFT JOIN m USING (ref)",
    "agg_year_counts": _YEARS + "SELECT * FROM yc",
    "agg_month_counts": _with(_W, _L, _J, _MC) + "SELECT * FROM mc",
    "agg_country_spread": _with(_W, _L, _J, _SPREAD) + "SELECT * FROM sp",
    "agg_domain_spread": _BASE + f"SELECT cand_id, count(DISTINCT {_PUB}) AS n_domains FROM j GROUP BY 1",
    "agg_trusted_share": _BASE + f"SELECT cand_id, round(avg({_TRUST}), 6) AS trusted_share FROM j GROUP BY 1",
    "agg_peer_norm": _YEARS + "SELECT year, greatest(sum(n)::DOUBLE, 1.0) AS norm FROM yc GROUP BY 1",
    "agg_doc_frequency": "WITH " + _NGRAM + " SELECT term, count(*) AS n_docs FROM ng GROUP BY 1 HAVING count(*) >= 20",
    "agg_upsert_counter": "SELECT term, sum(n)::BIGINT AS n FROM counts WHERE n > 0 GROUP BY 1",
    "agg_filtered": _with(_W) + "SELECT year, count(*) FILTER (WHERE trim(abstract) <> '') AS n_abstracts, count(doi) AS n_dois FROM w GROUP BY 1",
    "agg_distinct_per_year": _with(_W, "c AS (SELECT year, unnest(countries) AS c FROM w)") + "SELECT a.year, a.n_works, coalesce(b.n_countries, 0) AS n_countries FROM (SELECT year, count(*) AS n_works FROM w GROUP BY ROLLUP (year)) a LEFT JOIN (SELECT year, count(DISTINCT c) AS n_countries FROM c WHERE c <> '' GROUP BY ROLLUP (year)) b ON a.year IS NOT DISTINCT FROM b.year",
    "agg_rejected_summary": _POOL + "SELECT reason, count(*) AS n FROM rr WHERE reason IS NOT NULL GROUP BY 1",
    "agg_evidence": "WITH a AS (SELECT cand_id, domain, unnest(aliases) AS s FROM candidates), g AS (SELECT cand_id, list(DISTINCT s ORDER BY s) AS s, count(DISTINCT domain) AS k FROM a WHERE s IS NOT NULL GROUP BY 1) SELECT cand_id AS key, s[1] AS label, coalesce(array_to_string(s[2:], '|'), '') AS aliases, k AS n_docs FROM g",
    "agg_news_features": _with(
        _W, _L, _J, f"n AS (SELECT *, {_NEWS} AS news, {_MI} AS m, {_HOST} AS host FROM j)", f"i AS (SELECT *, host IS NOT NULL AND coalesce(source_type, '') <> 'aggregator' AND source NOT IN ('gnews', 'hackernews') AS ok FROM n WHERE news AND m BETWEEN {_E - 23} AND {_E})",
        "h AS (SELECT cand_id, host, bool_and(coalesce(trust_level = 'trusted', false)) AS t, bool_and(coalesce(trust_level IN ('trusted', 'indicator'), false)) AS k FROM i WHERE ok GROUP BY 1, 2)", "hh AS (SELECT cand_id, count(*) AS c, bool_and(k) AS k, avg(t::INTEGER) AS s FROM h GROUP BY 1)",
        "ii AS (SELECT cand_id, count(*) AS c, bool_or(NOT ok) AS un, count(*) FILTER (WHERE regexp_matches(CASE WHEN source = 'gnews' THEN regexp_replace(title, '^(.*) - .*$', '\\1') ELSE title END, '(?i)\\b(raises|raised|funding|series [abc]|seed|stealth|launches|launched|pilot|acquires|acquired|unveils)\\b')) AS f, list(DISTINCT lang ORDER BY lang) FILTER (WHERE lang <> '') AS langs FROM i GROUP BY 1)",
        f"g AS (SELECT cand_id, unnest(range({_E - 23}, {_E + 1}))::INTEGER AS m FROM (SELECT DISTINCT cand_id FROM j))", "b AS (SELECT g.cand_id, array_to_string(list(coalesce(k, 0) ORDER BY g.m), ',') AS by_month FROM g LEFT JOIN (SELECT cand_id, m, count(*) AS k FROM i GROUP BY 1, 2) x USING (cand_id, m) GROUP BY 1)",
        f"a AS (SELECT cand_id, bool_or(news AND m IS NULL) AS und, min(m) FILTER (WHERE news AND m <= {_E}) AS f FROM n GROUP BY 1)",
    ) + """SELECT a.cand_id, CASE WHEN NOT und THEN coalesce(ii.c, 0) END AS news_mentions_24m, CASE WHEN NOT und THEN by_month END AS by_month, CASE WHEN NOT und AND a.f IS NOT NULL THEN printf('%04d-%02d', (a.f // 12)::BIGINT, (a.f % 12 + 1)::BIGINT) END AS news_first_month,
CASE WHEN NOT und AND NOT coalesce(un, false) THEN coalesce(hh.c, 0) END AS n_domains, CASE WHEN NOT und AND NOT coalesce(un, false) AND hh.k THEN round(hh.s, 6) END AS trusted_share, CASE WHEN NOT und THEN coalesce(ii.f, 0) END AS funding_mentions, CASE WHEN NOT und THEN coalesce(array_to_string(langs, ','), '') END AS langs
FROM a JOIN b USING (cand_id) LEFT JOIN ii USING (cand_id) LEFT JOIN hh USING (cand_id)""",
    "agg_host_trust": _with(_W) + f"SELECT host, bool_and(coalesce(trust_level = 'trusted', false)) AS trusted, count(*) AS n FROM (SELECT {_HOST} AS host, trust_level FROM w) GROUP BY 1",
    "agg_status_counts": _with(_W) + "SELECT coalesce(trust_level, 'none') AS trust_level, count(*) AS n FROM w GROUP BY 1",
    "agg_cluster_centroid": "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INTEGER AS pos FROM embeddings WHERE label >= 0), m AS (SELECT label, pos, avg(x) AS x, count(*) AS n_docs FROM e GROUP BY 1, 2) SELECT label, n_docs, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM m",
    "agg_ctf_idf": r"""WITH t AS (SELECT substr(source, 1, 3) AS label, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
c AS (SELECT label, term, count(*) AS n FROM t WHERE term NOT IN ('the','of','and','in','is','to','for','that','with','on','we','this','are','as','an','by','from','has','it') GROUP BY 1, 2), k AS (SELECT label, sum(n) AS size FROM c GROUP BY 1), q AS (SELECT term, sum(n) AS f FROM c GROUP BY 1),
s AS (SELECT label, term, round(n / size * ln(1 + (SELECT floor(avg(size)) FROM k) / f), 9) AS score FROM c JOIN k USING (label) JOIN q USING (term))
SELECT label, (row_number() OVER (PARTITION BY label ORDER BY score DESC, term))::INTEGER AS place, term, round(score, 6) AS score FROM s QUALIFY place <= 10""",
    "agg_backtest": _with(_W, _L, _J, _YC, _BT) + "SELECT cand_id, CASE WHEN p IS NOT NULL THEN a END AS bt_at_cutoff, p AS bt_peak_after, round_even((p + 1) / (a + 1), 2) AS bt_growth_x FROM bt",
    "agg_lead_time": _with(_W, _L, _J, _YC, _TAKE, _LEAD) + "SELECT * FROM ld",
    "agg_precision_at_k": _with(_REF, f"r AS (SELECT DISTINCT {_NORM.format('label')} AS b FROM ref)", f"t AS (SELECT {_NORM.format('label')} AS a FROM (SELECT cand_id, max(n_docs) AS n, min(label) AS label FROM candidates GROUP BY 1) ORDER BY n DESC, cand_id LIMIT 15)") + "SELECT 15 AS k, count(*) FILTER (WHERE h) AS hits, round(count(*) FILTER (WHERE h) / count(*), 4) AS precision FROM (SELECT EXISTS (SELECT 1 FROM r WHERE b <> '' AND (contains(a, b) OR contains(b, a))) AS h FROM t)",
    "agg_report": _with(_W, _L, _J, _YC, _TAKE, _LEAD, _BT, "x AS (SELECT round_even((p + 1) / (a + 1), 2) AS g, lead, m FROM bt JOIN ld USING (cand_id) JOIN (SELECT cand_id, max(maturity_pct) AS m FROM trends GROUP BY 1) USING (cand_id))") + "SELECT count(*) AS n_trends, round(avg((g > 1.2)::INTEGER), 4) AS share_grown, round(avg((m >= 0.9::DOUBLE)::INTEGER), 4) AS share_mainstream, (list(lead ORDER BY lead) FILTER (WHERE lead IS NOT NULL))[(floor(count(lead) / 2) + 1)::INTEGER] AS median_lead FROM x",
    "agg_stats_header": _with(_W) + "SELECT (SELECT count(*) FROM trends WHERE as_of = 2024 AND emergence_score::VARCHAR <> 'nan') AS n_trends, (SELECT count(*) FROM trends WHERE as_of = 2024 AND emergence_score::VARCHAR <> 'nan' AND emergence_score > 0.75::DOUBLE) AS n_confident, (SELECT count(*) FROM trends WHERE as_of = 2024 AND rank > 15) AS n_rejected, (SELECT count(*) FROM w) AS n_sources",
    "agg_citation_coverage": _with(_ONE) + "SELECT trend_id, CASE WHEN len(top_doc_ids) > 0 THEN 'problem' ELSE '' END AS first, '' AS second, CASE WHEN len(top_doc_ids) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS coverage FROM t1",
    "agg_cyrillic_share": _with(_W) + r"SELECT doc_id, CASE WHEN a > 0 THEN round(b / a, 6) END AS share FROM (SELECT doc_id, len(regexp_extract_all(title, '\p{L}')) AS a, len(regexp_extract_all(title, '[\x{400}-\x{4FF}]')) AS b FROM w)",
    "agg_preprint_lag": _with(_W, _L, _J, "n AS (SELECT cand_id, doc_type, year, count(*) AS n FROM j WHERE doc_type IN ('article', 'preprint') AND year <= 2026 GROUP BY 1, 2, 3)", "p AS (SELECT *, max(n) OVER (PARTITION BY cand_id, doc_type) AS peak FROM n)") + "SELECT cand_id, min(year) FILTER (WHERE doc_type = 'article') - min(year) FILTER (WHERE doc_type = 'preprint') AS lag FROM p WHERE n >= greatest(10.0::DOUBLE, 0.1::DOUBLE * peak) GROUP BY 1",
    "agg_text_concat": _with(_W) + "SELECT domain, count(*) AS lines, sum(length(concat(doc_id, ' ', title)) + 1)::BIGINT - 1 AS chars, sum(('0x' || substr(sha256(concat(doc_id, ' ', title)), 1, 12))::BIGINT)::VARCHAR AS digest FROM w GROUP BY 1",
    "win_dedup_first": _with(_W) + "SELECT doc_id, year, harvested_at FROM w",
    "win_stratified_hash": _with(_W, _quota(250)) + "SELECT * FROM q",
    "win_pct_rank": f"SELECT cand_id, round({_rank('n_docs')}, 9) AS r FROM (SELECT cand_id, max(n_docs) AS n_docs FROM candidates GROUP BY 1)",
    "win_rank_output": _POOL + "SELECT cand_id, row_number() OVER (PARTITION BY domain ORDER BY es DESC, cand_id)::INTEGER AS rank FROM sc",
    "win_moving_sum_3": _YEARS + "SELECT cand_id, x.year, sum(coalesce(n, 0)) OVER (PARTITION BY cand_id ORDER BY x.year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS n3 FROM (SELECT cand_id, unnest(range(2015, 2027))::INTEGER AS year FROM (SELECT DISTINCT cand_id FROM yc)) x LEFT JOIN yc USING (cand_id, year)",
    "win_segments": _YEARS + "SELECT cand_id, g::BIGINT AS segment, min(year) AS first_year, max(year) AS last_year, count(*) AS n_years FROM (SELECT cand_id, year, sum(new) OVER (PARTITION BY cand_id ORDER BY year) AS g FROM (SELECT cand_id, year, CASE WHEN year - lag(year) OVER (PARTITION BY cand_id ORDER BY year) <= 1 THEN 0 ELSE 1 END AS new FROM yc WHERE n >= 5 AND year <= 2026)) GROUP BY 1, 2",
    "win_first_crossing": _COMP + "SELECT cand_id, f AS first_mention, t AS takeoff FROM cr",
    "win_breakout": _with(_W, _L, _J, _YC, "y10 AS (SELECT cand_id, year, n * 10 AS n FROM yc)", *_shape("y10", 2026)) + "SELECT cand_id, base, b AS breakout FROM bs LEFT JOIN bk USING (cand_id)",
    "win_ols_slope": _YEARS + "SELECT cand_id, round(coalesce(regr_slope(n::DOUBLE, year::DOUBLE), 0) + 1e-9, 6) AS slope FROM yc GROUP BY 1",
    "win_accel": _COMP + "SELECT cand_id, round(accel, 6) AS accel FROM comp",
    "win_burst": _COMP + "SELECT cand_id, round(burst, 6) AS burst FROM comp",
    "sort_top_docs": _with(_W, _L, _J, _TAKE) + "SELECT cand_id, row_number() OVER (PARTITION BY cand_id ORDER BY year DESC, cited_by DESC NULLS LAST, doc_id)::INTEGER AS place, doc_id FROM j LEFT JOIN tk USING (cand_id) WHERE year <= 2024 AND year >= coalesce(takeoff, 0) QUALIFY place <= 20",
    "sort_headlines": _with(_W) + r"SELECT doc_id, regexp_replace(title, '^(.*) - .*$', '\1') AS title, coalesce(date, '') AS date FROM w WHERE source = 'gnews' ORDER BY coalesce(date, '') DESC, doc_id LIMIT 300",
    "topk_baseline_abs": _YEARS + "SELECT row_number() OVER (ORDER BY v DESC, cand_id)::INTEGER AS place, cand_id, v AS value FROM (SELECT cand_id, (coalesce(sum(n) FILTER (WHERE year = 2024), 0) - coalesce(sum(n) FILTER (WHERE year = 2021), 0))::DOUBLE AS v FROM yc GROUP BY 1) ORDER BY place LIMIT 15",
    "topk_cagr": _YEARS + "SELECT row_number() OVER (ORDER BY v DESC, cand_id)::INTEGER AS place, cand_id, v AS value FROM (SELECT cand_id, round(pow(a / b, 1.0 / 3) - 1, 6) AS v FROM (SELECT cand_id, coalesce(sum(n) FILTER (WHERE year = 2024), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (WHERE year = 2021), 0)::DOUBLE AS b FROM yc GROUP BY 1) WHERE b >= 5 AND a > 0) ORDER BY place LIMIT 15",
    "topk_ngrams": "WITH " + _NGRAM + " SELECT term, count(*) AS n FROM ng GROUP BY 1 ORDER BY n DESC, term LIMIT 40",
    "union_candidates": "SELECT DISTINCT cand_id, kind FROM candidates",
    "set_intersect": f"SELECT DISTINCT cand_id, len(list_intersect(list_distinct({_L_TOK}), list_distinct({_T_TOK})))::INTEGER AS n FROM candidates",
    "set_except": "SELECT DISTINCT cand_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(aliases, lambda x: x <> label))), '|'), '') AS rest FROM candidates",
    "set_subset": f"SELECT DISTINCT cand_id, list_has_all({_L_TOK}, {_T_TOK}) AS inside FROM candidates",
    "distinct_ordered": "WITH u AS (SELECT trend_id, top_doc_ids, unnest(top_doc_ids) AS x, unnest(range(len(top_doc_ids))) AS p FROM (SELECT DISTINCT trend_id, top_doc_ids FROM trends WHERE len(top_doc_ids) > 0)), f AS (SELECT trend_id, top_doc_ids, x, min(p) AS p FROM u GROUP BY 1, 2, 3) SELECT DISTINCT trend_id, array_to_string(list(x ORDER BY p), ',') AS ids FROM f GROUP BY trend_id, top_doc_ids UNION SELECT trend_id, '' FROM trends WHERE len(top_doc_ids) = 0",
    "sample_equal_year_quota": _with(_W, _quota(997)) + "SELECT * FROM q",
    "sample_first_valid": _with(_W) + "SELECT doc_id, year FROM w WHERE doi IS NOT NULL AND abstract IS NOT NULL ORDER BY year, doc_id LIMIT 20",
    "split_stratified_kfold": _with(_W, "x AS (SELECT doc_id, CASE WHEN source_type = 'preprint' THEN 1 ELSE 0 END AS label FROM w)") + "SELECT label, fold, count(*) AS n FROM (SELECT label, ((row_number() OVER (PARTITION BY label ORDER BY sha256(concat(doc_id, ':', 7)), doc_id) - 1) % 5)::INTEGER AS fold FROM x) GROUP BY 1, 2",
    "fn_tokens": _with(_W) + f"SELECT doc_id, array_to_string({_TOK.format('title')}, ' ') AS t FROM w",
    "fn_ngrams": "WITH " + _NGRAM + " SELECT doc_id, term FROM ng",
    "fn_lemma": f"""WITH x AS (SELECT DISTINCT unnest({_L_TOK}) AS w FROM candidates) SELECT w, CASE WHEN w IN ('analysis','bus','gas','lens','series','bias','physics','mathematics','statistics','genesis','basis','corpus') OR length(w) <= 3 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN concat(left(w, -3), 'y')
WHEN regexp_matches(w, '(s|x|z|ch|sh)es$') THEN left(w, -2) WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN left(w, -1) ELSE w END AS lemma FROM x""",
    "fn_publisher": _with(_W) + f"SELECT doc_id, {_PUB} AS publisher FROM w",
    "fn_strip_publisher": _with(_W) + r"SELECT doc_id, regexp_replace(title, '^(.*) - .*$', '\1') AS t FROM w",
    "fn_norm_host": _with(_W) + f"SELECT doc_id, {_HOST} AS host FROM w",
    "fn_canonical_url": _with(_W) + "SELECT doc_id, concat(lower(regexp_extract(url, '^([^/]+://[^/?]*)', 1)), regexp_extract(url, '^[^/]+://[^/?]*([^?]*)', 1), '?', array_to_string(list_sort(list_filter(list_concat(regexp_split_to_array(regexp_extract(url, '\\?(.*)$', 1), '&'), ['a=1', 'b=2']), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&')) AS url FROM w",
    "fn_norm_title": _with(_W) + r"SELECT doc_id, array_to_string(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+'), ' ') AS t FROM w",
    "fn_norm_entity": _with(_W) + r"SELECT doc_id, regexp_replace(trim(title), '(?i)^(?:(?:the|new|this|a|an)\s+)?(?:(?:american|british|chinese|french|german|indian|israeli|russian|european|ai|fintech|biotech|startup)\s+)?', '') AS t FROM w",
    "fn_clean_term": r"SELECT DISTINCT cand_id, CASE WHEN len(ws) BETWEEN 1 AND 4 AND length(t) >= 4 AND len(list_filter(ws, lambda x: x IN ('market','funding','startup','company','industry','report','news','business'))) = 0 THEN t END AS t FROM (SELECT cand_id, t, regexp_split_to_array(t, ' ') AS ws FROM (SELECT cand_id, regexp_replace(trim(lower(label)), '\s+', ' ', 'g') AS t FROM candidates))",
    "fn_slug": _with(_W) + r"SELECT doc_id, trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug FROM w",
    "fn_stems4": _with(_LAB) + f"SELECT cand_id, coalesce(array_to_string(list_sort({_STEMS.format('label')}), ' '), '') AS stems FROM lab",
    "fn_hash_ids": _with(_LAB) + "SELECT cand_id, concat('t:', domain, ':', substr(sha256(concat(domain, chr(0), label)), 1, 24)) AS made FROM lab",
    "fn_month_number": _with(_W) + f"SELECT doc_id, {_MI} AS m FROM w",
    "fn_month_coalesce": _with(_W) + f"SELECT doc_id, {_MONTH} AS month FROM w",
    "fn_abstract_rebuild": _with(_W) + "SELECT doc_id, true AS same FROM w WHERE abstract IS NOT NULL",
    "components_yearly": _COMP + "SELECT cand_id, first_mention, takeoff, age, homonym, round(growth, 6) AS growth, round(accel, 6) AS accel, round(burst, 6) AS burst, round(maturity, 4) AS maturity, counts_recent, active_years, last_year_share, counts FROM comp",
    "components_monthly": _with(_W, _L, _J, _MC, *_MCOMP) + "SELECT cand_id, first_mention, takeoff_year, age, round(growth, 6) AS growth, round(accel, 6) AS accel, round(burst, 6) AS burst, counts_recent, active_months, counts FROM mcomp",
    "emergence_score": _POOL + "SELECT cand_id, es, maturity_pct, round_even(a, 3) AS c_novelty, round_even(g, 3) AS c_growth, round_even(c, 3) AS c_accel, round_even(b, 3) AS c_burst, round_even(s5, 3) AS c_diffusion FROM sc",
    "reject_reason_index": _POOL + "SELECT cand_id, reason, counts_recent::INTEGER AS n_docs FROM rr WHERE reason IS NOT NULL",
    "reject_mature": _POOL + "SELECT cand_id, maturity_pct FROM sc WHERE maturity_pct >= 0.9::DOUBLE",
    "reject_reason_live": _LIVE + "SELECT cand_id, reason, counts_recent::INTEGER AS n_docs FROM lr WHERE reason IS NOT NULL",
    "emergence_score_live": _LIVE + f""", rk AS (SELECT *, {_rank("-age")} AS a, {_rank("round(growth, 9)")} AS g, {_rank("round(accel, 9)")} AS c, {_rank("round(ln(burst + 0.01), 9)")} AS b, {_rank("n_domains")} AS s5 FROM lr WHERE reason IS NULL)
SELECT cand_id, round(a * 0.20::DOUBLE + g * 0.32::DOUBLE + c * 0.23::DOUBLE + b * 0.15::DOUBLE + s5 * 0.10::DOUBLE, 4) AS es, round_even(a, 3) AS c_novelty, round_even(g, 3) AS c_growth FROM rk""",
    "stage_confidence": _POOL + "SELECT cand_id, CASE WHEN maturity_pct >= 0.9::DOUBLE THEN 'scaling' WHEN age <= 3 THEN 'emerging' WHEN age <= 6 THEN 'early_growth' ELSE 'scaling' END AS stage, CASE WHEN counts_recent >= 200 AND n_countries >= 15 THEN CASE WHEN homonym THEN 'medium' ELSE 'high' END WHEN counts_recent >= 50 AND n_countries >= 8 THEN 'medium' ELSE 'low' END AS confidence FROM sc",
    "extract_terms": "WITH " + _NGRAM + r", f AS (SELECT term, count(*) AS n FROM ng JOIN w USING (doc_id) WHERE domain = 'artificial-intelligence' GROUP BY 1 HAVING count(*) >= 2) SELECT concat('t:artificial-intelligence:', substr(sha256(concat('artificial-intelligence', chr(0), term)), 1, 24)) AS cand_id, term AS label, n AS n_docs, n AS n_links FROM f WHERE NOT regexp_matches(term, '(^|[^\p{L}\p{N}-])(neural|artificial|convolutional|recurrent)$') AND regexp_matches(term, '" + _marker(TECHNOLOGY) + "')",
    "cluster_candidates": "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INTEGER AS pos FROM embeddings WHERE label >= 0), m AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY 1, 2), c AS (SELECT label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS v FROM m) SELECT e.label, vec_id, round(greatest(0.0, least(1.0, sum(x * v) / sqrt(sum(x * x)))), 6) AS weight FROM e JOIN c USING (label, pos) GROUP BY e.label, vec_id",
    "validate_index": """SELECT 'duplicate candidate' AS rule, count(*) AS violations FROM (SELECT 1 FROM candidates GROUP BY cand_id HAVING count(*) > 1) UNION ALL SELECT 'duplicate link', count(*) FROM (SELECT 1 FROM cand_docs GROUP BY cand_id, doc_id HAVING count(*) > 1)
UNION ALL SELECT 'link without candidate', count(*) FROM cand_docs WHERE cand_id NOT IN (SELECT cand_id FROM candidates) UNION ALL SELECT 'link without document', count(*) FROM cand_docs WHERE doc_id NOT IN (SELECT doc_id FROM works)
UNION ALL SELECT 'candidate without link', count(*) FROM (SELECT DISTINCT cand_id FROM candidates WHERE cand_id NOT IN (SELECT cand_id FROM cand_docs)) UNION ALL SELECT 'cluster without vector', count(*) FROM candidates WHERE kind = 'cluster' AND emb_row IS NULL
UNION ALL SELECT 'weight outside 0..1', count(*) FROM cand_docs WHERE weight < 0 OR weight > 1 UNION ALL SELECT 'blank label', count(*) FROM candidates WHERE trim(label) = ''
UNION ALL SELECT 'count differs', count(*) FROM (SELECT DISTINCT cand_id, n_docs FROM candidates) LEFT JOIN (SELECT cand_id, count(DISTINCT doc_id) AS k FROM cand_docs GROUP BY 1) USING (cand_id) WHERE n_docs <> coalesce(k, 0)""",
    "tech_features": _with(_W, _L, _J, _YC, "p10 AS (SELECT * FROM yc WHERE year BETWEEN 2015 AND 2024)", *_shape("p10", 2024)) + "SELECT t.cand_id, t.s AS pub_total_10y, round(CASE WHEN t.s > 0 THEN t.s3 / t.s ELSE 0 END, 6) AS pub_last_3y_share, least(age, 30)::INTEGER AS pub_age, round(ln(1 + t.s), 6) AS log_pub_total, repos AS github_repos FROM (SELECT cand_id, sum(n)::BIGINT AS s, sum(CASE WHEN year >= 2022 THEN n ELSE 0 END) AS s3 FROM p10 GROUP BY 1) t JOIN comp USING (cand_id) LEFT JOIN (SELECT cand_id, max(n_docs) AS repos FROM candidates GROUP BY 1) USING (cand_id)",
    "resolve_query": "SELECT 'artificial-intelligence' AS domain, 1 AS tier",
    "api_trends": "WITH t AS (SELECT domain, as_of, rank, min(trend_id) AS trend_id FROM trends WHERE rank BETWEEN 1 AND 15 GROUP BY 1, 2, 3) SELECT * FROM t WHERE domain = 'artificial-intelligence' AND as_of = (SELECT max(as_of) FROM t WHERE domain = 'artificial-intelligence')",
}
