"""Cards of trends written by a text model behind a small interface, checked against the documents they cite."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import contracts
from tidewatch.plans import serve
from tidewatch.sources import publish

#: Trends of one run; a card is a call of a model.
MOST_CARDS = 50
CASE_TYPES = ("research", "company")
FIELDS = ("problem", "advantage", "case_text")


class Writer(Protocol):
    name: str

    def write(self, prompt: str) -> str:
        """An answer in JSON, maybe with text around it."""


def card_columns(answers: DataFrame, titles: dict[str, str]) -> DataFrame:
    """answers (trend_id, label, title, case_type, ...) with the title by override, answer or label, and a known case type."""
    override: Column = F.coalesce(*(F.when(F.col("label") == k, F.lit(v)) for k, v in sorted(titles.items())), F.lit(None).cast("string"))
    kind = F.when(F.col("case_type").isin(*CASE_TYPES), F.col("case_type")).otherwise(CASE_TYPES[0])
    return answers.withColumn("title_ru", F.coalesce(override, F.nullif(F.col("title"), F.lit("")), F.col("label"))).withColumn("case_type", kind).drop("title")


def supported(card: dict, allowed: set[str]) -> tuple[dict, float]:
    """The card without claims whose documents aren't allowed, and the share of claims that stay."""
    kept, out = 0, dict(card)
    for text in FIELDS:
        key = f"{text.removesuffix('_text')}_docs"
        docs = [d for d in card.get(key) or [] if d in allowed]
        good = bool(docs) and bool(str(card.get(text) or "").strip())
        out[text], out[key] = (card[text], docs) if good else ("", [])
        kept += good
    return out, kept / len(FIELDS)


def build(trends: DataFrame, works: DataFrame, writer: Writer, titles: dict[str, str] | None = None, accept: Callable[[dict], bool] = lambda card: True, retry: str = "\n\nAnswer in JSON only.") -> DataFrame:
    """Cards of at most MOST_CARDS trends; an answer that isn't JSON or isn't accepted is asked for once more, then left out."""
    rows = trends.select("trend_id", "label", "top_doc_ids").limit(MOST_CARDS + 1).collect()
    if len(rows) > MOST_CARDS:
        raise ValueError(f"more than {MOST_CARDS} trends")
    out = []
    for r in rows:
        docs = [d.asDict() for d in serve.documents(works, r.top_doc_ids or []).select("doc_id", "title", "abstract", "year").collect()]
        prompt = serve.prompt(r.label, docs)
        card = next((c for p in (prompt, prompt + retry) if (c := serve.parse_json(writer.write(p))) and accept(c)), None)
        if card is None:
            continue
        card, coverage = supported(card, {d["doc_id"] for d in docs})
        text = lambda k: str(card.get(k) or "")  # noqa: B023, E731
        lists = lambda k: [str(x) for x in card.get(k) or []]  # noqa: B023, E731
        out.append((r.trend_id, r.label, text("title_ru"), text("problem"), lists("problem_docs"), text("advantage"), lists("advantage_docs"), text("case_type"), text("case_name"), text("case_text"), lists("case_docs"), float(coverage), writer.name, dt.datetime.now(dt.UTC).isoformat(timespec="seconds")))
    schema = "trend_id string, label string, title string, problem string, problem_docs array<string>, advantage string, advantage_docs array<string>, case_type string, case_name string, case_text string, case_docs array<string>, citation_coverage double, model string, generated_at string"
    return contracts.project(card_columns(trends.sparkSession.createDataFrame(out, schema), titles or {}), "cards")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cards of the same trend are replaced, the rest stays."""
    return publish.merge_rows(old, new, "trend_id")
