"""Contract tables: schemas, keys, checks, projections, DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "f": T.FloatType(), "b": T.BooleanType(), "l": T.LongType(), "t": T.TimestampType(), "as": T.ArrayType(T.StringType()), "ai": T.ArrayType(T.IntegerType()), "af": T.ArrayType(T.FloatType())}


def _schema(text: str) -> T.StructType:
    """'name:type' separated by blanks; a trailing ! means never null."""
    fields = []
    for part in text.split():
        name, kind = part.split(":")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


CONTRACTS = {
    "works": _schema("doc_id:s! source:s! doc_type:s! title:s! abstract:s year:i! date:s lang:s doi:s url:s! cited_by:i countries:as institutions:as authors:as concepts:as domain:s! harvested_at:s! source_type:s trust_level:s summary_ru:s summary_model:s"),
    "candidates": _schema("cand_id:s! kind:s! label:s! aliases:as top_terms:as emb_row:i n_docs:i! domain:s!"),
    "cand_docs": _schema("cand_id:s! doc_id:s! weight:f"),
    "trends": _schema(
        "trend_id:s! domain:s! as_of:i! rank:i! cand_id:s! label:s! aliases:as emergence_score:f! c_novelty:f! c_growth:f! c_accel:f! c_burst:f! c_diffusion:f! maturity_pct:f! first_mention:i takeoff_year:i years:ai! counts:ai! freq_per_million:af! n_docs:i! n_countries:i! n_orgs:i n_patents:i "
        "top_doc_ids:as! stage:s! confidence:s! methodology_version:s! series_granularity:s bt_at_cutoff:i bt_peak_after:i bt_growth_x:f"
    ),
    "rejected": _schema("cand_id:s! label:s! domain:s! reason:s! n_docs:i! as_of:i!"),
    "cards": _schema("trend_id:s! title_ru:s! problem:s! problem_docs:as! advantage:s! advantage_docs:as! case_type:s! case_name:s! case_text:s! case_docs:as! fintech_note:s citation_coverage:f! model:s! generated_at:s!"),
    "features": _schema(
        "cand_id:s! label:s! domain:s! as_of:s! news_mentions_24m:i news_mentions_by_month:ai news_first_month:s n_domains:i trusted_share:f n_companies:i funding_mentions:i langs:as github_repos:i github_stars_max:i hf_models:i pub_counts_by_year:ai pub_countries:i pub_company_share:f "
        "is_weak_signal:b dataset_score:i dataset_stage:s"
    ),
    "loads": _schema("dataset:s! tbl:s! n_rows:l! source:s! sha256:s! loaded_at:t!"),
}
KEYS = {"works": ["doc_id"], "candidates": ["cand_id"], "cand_docs": ["cand_id", "doc_id"], "trends": ["trend_id"], "rejected": ["cand_id", "as_of"], "cards": ["trend_id"], "features": ["cand_id", "as_of"], "loads": ["dataset", "tbl"]}


def problems(df: DataFrame, name: str) -> DataFrame:
    """(problem, n): missing required, extra and mistyped columns, nulls in required ones, repeated keys. An absent nullable
    column is legal."""
    contract, have = CONTRACTS[name], {f.name: f.dataType for f in df.schema}
    fixed = [(f"missing: {f.name}", 1) for f in contract if f.name not in have and not f.nullable]
    fixed += [(f"extra: {c}", 1) for c in have if c not in contract.names]
    fixed += [(f"type: {f.name}", 1) for f in contract if f.name in have and have[f.name].simpleString() != f.dataType.simpleString()]
    out = df.sparkSession.createDataFrame(fixed, "problem string, n long")
    need = [f.name for f in contract if not f.nullable and f.name in have]
    if need:
        nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in need))  # one pass
        out = out.unionByName(nulls.select(F.explode(F.array(*(F.struct(F.lit(f"null: {c}").alias("problem"), F.col(c).alias("n")) for c in need))).alias("x")).select("x.*").where("n > 0"))
    if set(KEYS[name]) <= have.keys():
        repeated = df.groupBy(*KEYS[name]).agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n"))
        out = out.unionByName(repeated.select(F.lit("repeated key").alias("problem"), "n").where("n > 0"))
    return out


def project(df: DataFrame, name: str) -> DataFrame:
    """Columns in contract order and type; absent nullable ones are null; extra ones go."""
    missing = [f.name for f in CONTRACTS[name] if f.name not in df.columns and not f.nullable]
    if missing:
        raise ValueError(f"{name}: required columns are missing: {missing}")
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CONTRACTS[name]))


_SQL = {"string": "TEXT", "int": "INTEGER", "float": "REAL", "boolean": "BOOLEAN", "bigint": "BIGINT", "double": "DOUBLE PRECISION", "timestamp": "TIMESTAMPTZ"}


def sql_type(kind: T.DataType) -> str:
    """Type in PostgreSQL; unknown types are an error, never text."""
    if isinstance(kind, T.ArrayType):
        return sql_type(kind.elementType) + "[]"
    if kind.simpleString() not in _SQL:
        raise TypeError(f"no SQL type for {kind.simpleString()}")
    return _SQL[kind.simpleString()]


def ddl(name: str, table: str | None = None) -> str:
    cols = ", ".join(f"{f.name} {sql_type(f.dataType)}{'' if f.nullable else ' NOT NULL'}" for f in CONTRACTS[name])
    return f"CREATE TABLE IF NOT EXISTS {table or name} (dataset TEXT NOT NULL, {cols}, PRIMARY KEY (dataset, {', '.join(k for k in KEYS[name] if k != 'dataset')}))"


def added_columns(name: str, table: str | None = None) -> list[str]:
    return [f"ALTER TABLE {table or name} ADD COLUMN IF NOT EXISTS {f.name} {sql_type(f.dataType)}" for f in CONTRACTS[name] if f.nullable]
