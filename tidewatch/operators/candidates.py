"""Candidates from texts and clusters, their links and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.text import hash_id, let, ngrams, technology_reason, tokens
from tidewatch.runtime import lookup_join, materialise


def title_terms(works: DataFrame) -> DataFrame:
    """(doc_id, term): the distinct n-grams of each title."""
    return works.select("doc_id", F.explode(ngrams(F.col("title"))).alias("term"))


def doc_frequency(terms: DataFrame, min_docs: int = 20) -> DataFrame:
    """(term, n_docs) of at least min_docs documents; terms are distinct in a document."""
    return terms.groupBy("term").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def extract_terms(works: DataFrame, domain: str, min_docs: int = 20, technology: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, links, rejected): frequent n-grams that the lexical filter accepts, their documents, and why others fell."""
    terms = materialise(title_terms(works), "title-terms")
    frequent = doc_frequency(terms, min_docs).withColumn("reason", technology_reason(F.col("term"), technology) if technology else technology_reason(F.col("term")))
    kept = frequent.where("reason is null").select(hash_id("t", F.lit(domain), F.col("term")).alias("cand_id"), F.col("term").alias("label"), "n_docs")
    kept = materialise(kept, "kept-terms")
    links = lookup_join(terms, kept.select("cand_id", F.col("label").alias("term")), ["term"], F.col("doc_id")).select("cand_id", "doc_id")
    return kept, links, frequent.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def ctf_idf(texts: DataFrame, label: str, text: str, stop: list[str], top: int = 10) -> DataFrame:
    """(label, place, term, score): class-based TF-IDF, terms of two letters or more outside the stop list.

    score = share of the term in its class x ln(1 + floor(mean class length) / frequency of the term)."""
    words = texts.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term"))
    counts = words.where(~F.col("term").isin(*stop)).groupBy("label", "term").agg(F.count("*").alias("n"))
    per_class = counts.groupBy("label").agg(F.sum("n").alias("size"))
    per_term = counts.groupBy("term").agg(F.sum("n").alias("freq"))
    mean = per_class.agg(F.floor(F.avg("size"))).first()[0] or 0  # one number
    scored = counts.join(per_class, "label").join(per_term, "term")
    scored = scored.withColumn("score", F.round(F.col("n") / F.col("size") * F.log(1 + F.lit(mean) / F.col("freq")), 9))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= top).select("label", "place", "term", "score")


def cluster_centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, n_docs, pos, value): mean vector of a cluster, of unit length; clusters of length zero or NaN give no row."""
    spread = vectors.where(F.col(label).isNotNull() & (F.col(label) >= 0)).select(F.col(label).alias("label"), F.posexplode(vector).alias("pos", "x"))
    mean = spread.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n_docs"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("label")))
    return mean.withColumn("norm", norm).where((F.col("norm") > 0) & ~F.isnan("norm")).select("label", "n_docs", "pos", (F.col("x") / F.col("norm")).alias("value"))


def cluster_links(vectors: DataFrame, centroids: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, key, weight): cosine of a member to its centroid, clipped to 0..1."""
    c = centroids.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s.value).alias("__c"))  # one vector a cluster
    v = vectors.withColumn("__v", F.transform(vector, lambda x: x.cast("double")))
    dot = F.aggregate(F.zip_with("__v", "__c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
    return v.join(F.broadcast(c), label).select(F.col(label).alias("label"), key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.when(length > 0, length))).alias("weight"))


def evidence(mentions: DataFrame, min_docs: int = 2) -> DataFrame:
    """mentions (key, doc_id, surface) -> (key, label, aliases, n_docs): label is the smallest surface."""
    g = mentions.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.array_sort(F.collect_set("surface")).alias("s"))
    return g.where(F.col("n_docs") >= min_docs).select("key", F.get("s", F.lit(0)).alias("label"), F.slice("s", F.lit(2), F.size("s")).alias("aliases"), "n_docs")


def term_matches(works: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id): terms of one to four words that stand in a title as whole words, plural s allowed.

    The titles' n-grams meet the terms in an equi-join, so no title is held against every term."""
    def grams(words: Column, n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    all_grams = let(tokens(F.col("title")), lambda w: F.flatten(F.array(*(grams(w, n) for n in range(1, 5)))))
    spread = works.select("doc_id", F.explode(F.array_distinct(all_grams)).alias("gram"))
    forms = terms.select("term", F.explode(F.array(F.col("term"), F.concat("term", F.lit("s")))).alias("gram"))
    return spread.join(forms, "gram").select("term", "doc_id").distinct()


def integrity(candidates: DataFrame, cand_docs: DataFrame, works: DataFrame) -> DataFrame:
    """(rule, violations), one row a rule."""
    c, l = candidates, cand_docs
    checks = [
        ("duplicate candidate", c.groupBy("cand_id").count().where("count > 1")), ("duplicate link", l.groupBy("cand_id", "doc_id").count().where("count > 1")),
        ("link without candidate", l.join(c.select("cand_id").distinct(), "cand_id", "left_anti")), ("link without document", l.join(works.select("doc_id").distinct(), "doc_id", "left_anti")),
        ("candidate without link", c.select("cand_id").distinct().join(l.select("cand_id").distinct(), "cand_id", "left_anti")), ("cluster without vector", c.where("kind = 'cluster' and emb_row is null")),
        ("weight outside 0..1", l.where("weight < 0 or weight > 1")), ("blank label", c.where("trim(label) = ''")),
        ("count differs", c.select("cand_id", "n_docs").distinct().join(l.groupBy("cand_id").agg(F.count_distinct("doc_id").alias("k")), "cand_id", "left").where("n_docs != coalesce(k, 0)")),
    ]
    out = None
    for rule, rows in checks:
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def filter_clusters(clusters: DataFrame, links: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) of clusters (cand_id, label, emb_row): a cluster stays if one of its titles has a technology marker; rows of
    its vectors are numbered anew without gaps, in the order they had."""
    titles = works.select("doc_id", technology_reason(F.col("title")).isNull().alias("technical"))
    marked = links.join(titles, "doc_id").groupBy("cand_id").agg(F.bool_or("technical").alias("technical"))
    judged = clusters.join(marked, "cand_id", "left").withColumn("technical", F.coalesce("technical", F.lit(False)))
    dense = F.row_number().over(Window.orderBy("emb_row", "cand_id")) - 1  # clusters are few
    kept = judged.where("technical").withColumn("emb_row", dense).drop("technical")
    return kept, judged.where(~F.col("technical")).select("cand_id", "label", F.lit("no technology marker").alias("reason"))


def check_terms(kept: DataFrame, links: DataFrame) -> DataFrame:
    """(rule, violations): the counts of exported terms are those of their links."""
    per = links.groupBy("cand_id").agg(F.count("*").alias("k"), (F.count("*") - F.count_distinct("doc_id")).alias("twice"))
    joined = kept.select("cand_id", "n_docs").join(per, "cand_id", "full")
    return joined.agg(
        F.abs(F.coalesce(F.sum("n_docs"), F.lit(0)) - F.coalesce(F.sum("k"), F.lit(0))).alias("a"), F.count_if(~F.col("n_docs").eqNullSafe(F.col("k"))).alias("b"), F.coalesce(F.sum("twice"), F.lit(0)).alias("c"),
    ).select(F.inline(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(c).cast("long").alias("violations")) for c, rule in (("a", "sum of counts is the number of links"), ("b", "each count is its links"), ("c", "a link stands once"))))))


def rising_terms(works: DataFrame, cutoff: int, recent: int, min_recent: int, top: int) -> DataFrame:
    """(term, recent, old, lift): n-grams frequent in the last ``recent`` years and rare before, by lift x ln(1 + recent).

    A term that stands inside a better one falls. The walk sees the best terms, and twice as many again until ``top`` of them
    stand; what it sees is as long as the families of the best terms, not as the table."""
    terms = works.where(F.col("year") <= cutoff).select("year", F.explode(ngrams(F.col("title"))).alias("term"))
    counts = terms.groupBy("term").agg(F.count_if(F.col("year") > cutoff - recent).alias("recent"), F.count_if(F.col("year") <= cutoff - recent).alias("old")).where(F.col("recent") >= min_recent)
    scored = materialise(counts.withColumn("lift", (F.col("recent") + 1) / (F.col("old") + 1)).withColumn("v", F.round(F.col("lift") * F.log1p("recent"), 9)), "rising")
    size, total = 10 * top, scored.count()
    while True:
        best = scored.orderBy(F.desc("v"), "term").limit(size)
        place = F.row_number().over(Window.orderBy(F.desc("v"), "term"))  # over the best terms only
        ranked = materialise(best.withColumn("place", place), "rising-best")
        better = ranked.select(F.col("term").alias("t2"), F.col("place").alias("p2"))
        inside = ranked.join(F.broadcast(better), (F.col("p2") < F.col("place")) & F.col("t2").contains(F.col("term")) & (F.col("t2") != F.col("term")), "left_anti")
        kept = materialise(inside.orderBy("place").limit(top).select("term", "recent", "old", F.bround("lift", 2).alias("lift")), "rising-kept")
        if size >= total or kept.count() == top:
            return kept
        size *= 2
