"""Remaining operators: plateaus, month windows, card columns, fixed pools, rising terms, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import candidates, series, shape
from tidewatch.plans import cards, pipeline
from tidewatch.plans.reference_queries import AS_OF, LIVE_AS_OF, counts, joined, labels, month_counts, works
from tidewatch.plans.reference_sql import _LAB, _MC, _MCOMP, _NGRAM, _POOL, _W, _J, _L, _with
from tidewatch.runtime import read


def pred_plateau(s, d):
    c = shape.components_monthly(month_counts(s, d), LIVE_AS_OF)
    return c.select("cand_id", ((F.col("age") >= 18) & (F.col("growth") <= 0.03)).alias("plateau"))


def fn_month_window(s, d):
    end = F.to_date(F.lit(LIVE_AS_OF + "-01"))
    months = F.sequence(F.add_months(end, -23), end, F.expr("interval 1 month"))
    return read(s, d, "sources").select("source", F.explode(months).alias("m")).select("source", F.date_format("m", "yyyy-MM").alias("month"))


def fn_iso_parse(s, d):
    return works(s, d, "date").select("doc_id", F.when(F.col("date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.date_format(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")), "yyyy-MM-dd")).alias("day"))


def fn_yyyymm(s, d):
    m = shape.month_index(series.month_of(F.col("date"), F.col("year")))
    return works(s, d, "date", "year").select("doc_id", (F.floor(m / 12) * 100 + m % 12 + 1).cast("int").alias("yyyymm"))


def project_card_row(s, d):
    rows = labels(s, d).select(F.col("cand_id").alias("trend_id"), "label", F.lit("").alias("title"), F.when(F.length("label") % 2 == 0, "company").otherwise("rumour").alias("case_type"))
    return cards.card_columns(rows, {"neural networks": "Neuronale Netze"}).select("trend_id", "title_ru", "case_type")


def scoring_probe(s, d):
    spread = series.country_spread(joined(s, d, "year", "countries"), AS_OF - 2, AS_OF)
    return pipeline.score_counts(counts(s, d), spread, labels(s, d).select("cand_id", "label"), AS_OF)[0].select("cand_id", "es", "maturity_pct")


def rising_terms(s, d):
    return candidates.rising_terms(works(s, d, "title", "year"), AS_OF, 3, 5, 25)


NAMES = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")]
QUERIES = {n: globals()[n] for n in NAMES}
_M = "CASE WHEN regexp_matches(date, '^[0-9]{4}-(0[1-9]|1[0-2])(-|$)') THEN substr(date, 1, 7) ELSE concat(year, '-06') END"
SQL = {
    "pred_plateau": _with(_W, _L, _J, _MC, *_MCOMP) + "SELECT cand_id, age >= 18 AND growth <= 0.03 AS plateau FROM mcomp",
    "fn_month_window": "SELECT source, strftime(DATE '2026-06-01' - to_months(k::INTEGER), '%Y-%m') AS month FROM sources, range(24) r(k)",
    "fn_iso_parse": _with(_W) + "SELECT doc_id, CASE WHEN regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN strftime(try_cast(date AS DATE), '%Y-%m-%d') END AS day FROM w",
    "fn_yyyymm": _with(_W) + f"SELECT doc_id, replace({_M}, '-', '')::INTEGER AS yyyymm FROM w",
    "project_card_row": _with(_LAB) + "SELECT cand_id AS trend_id, CASE WHEN label = 'neural networks' THEN 'Neuronale Netze' ELSE label END AS title_ru, CASE WHEN length(label) % 2 = 0 THEN 'company' ELSE 'research' END AS case_type FROM lab",
    "scoring_probe": _POOL + "SELECT cand_id, es, maturity_pct FROM sc WHERE maturity_pct < 0.9::DOUBLE",
    "rising_terms": "WITH " + _NGRAM + """, c AS (SELECT term, count(*) FILTER (WHERE year > 2021) AS recent, count(*) FILTER (WHERE year <= 2021) AS old FROM ng JOIN w USING (doc_id) WHERE year <= 2024 GROUP BY 1 HAVING recent >= 5),
v AS (SELECT *, (recent + 1) / (old + 1) AS lift, row_number() OVER (ORDER BY round((recent + 1) / (old + 1) * ln(1 + recent), 9) DESC, term) AS place FROM c QUALIFY place <= 250)
SELECT term, recent, old, round_even(lift, 2) AS lift FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.place < a.place AND contains(b.term, a.term)) ORDER BY place LIMIT 25""",
}
