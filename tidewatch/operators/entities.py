"""Technologies and names of live titles: what titles name, found again wherever it stands, with the titles as evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import TITLE_CHARS, let, strip_publisher, technology_reason, term_pattern
from tidewatch.operators.candidates import evidence
from tidewatch.runtime import lookup_join, materialise

# fixed values: named technologies and how they are written; only what is in (?i:) ignores case
CATALOGUE = {
    "prompt engineering": "(?i:prompt[- ]engineering)", "retrieval augmented generation": "(?i:retrieval[- ]augmented[- ]generation)|RAG", "mixture of experts": "(?i:mixture[- ]of[- ]experts)|MoE", "LoRA": "LoRA|(?i:low[- ]rank adaptation)", "vector database": "(?i:vector databases?)",
    "differentiable rendering": "(?i:differentiable rendering)", "machine learning": "(?i:machine learning)", "deep learning": "(?i:deep learning)", "large language model": "(?i:large language models?)|LLMs?", "small language model": "(?i:small language models?)|SLMs?", "federated learning": "(?i:federated learning)",
    "confidential computing": "(?i:confidential computing)", "post-quantum cryptography": "(?i:post[- ]quantum cryptography)", "zero trust": "(?i:zero[- ]trust)", "prompt injection": "(?i:prompt[- ]injection)", "machine unlearning": "(?i:machine unlearning)", "AI agent": "(?i:AI agents?|agentic AI)",
    "synthetic data": "(?i:synthetic data)", "neuromorphic computing": "(?i:neuromorphic computing)",
}
# fixed values: adjectives and nouns of open technical terms, and plurals that a label gives up
NOUN = (
    r"(?i)\b(?:quantum|neural|photonic|optical|neuromorphic|tactile|autonomous|robotic|biomedical|semiconductor|adaptive|generative|federated)(?:[- ](?:quantum|neural|photonic|optical|vision|language|edge|memory))*"
    r"[- ](?:sensors?|processors?|networks?|computing|robotics|models?|learning|chips?|vision|actuators?|imaging)\b"
)
PLURALS = "sensors processors networks models chips actuators".split()
# fixed values: shape of a capitalised name, verbs of a company and of a product, words before a company's name
TOKEN = r"[A-Z][A-Za-z0-9&-]*(?:\.[A-Za-z0-9&-]+)*"
NAME = rf"{TOKEN}(?:[ \t]+{TOKEN}){{0,3}}"
ACTOR = rf"(?<![\w.-])({NAME})[ \t]+(?i:launches|builds|raises|unveils|introduces|develops|releases|announces|secures|deploys|partners|acquires)\b"
OWNER = rf"(?<![\w.-])({NAME})[’']s\b"
PRODUCT = rf"\b(?i:launches|unveils|introduces|releases|deploys)\s+({NAME})"
OWNED = rf"(?<![\w.-])({NAME})[’']s\s+({NAME})"
ARTICLES = r"(?i)^(?:(?:the|new|this|a|an)\s+)+"
DESCRIPTION = r"(?i)^(?:(?:Italian|Nigerian|French|German|American|British|Israeli|Indian|Canadian|Australian|Japanese|European|Swiss|Swedish|Finnish|Dutch)\s+)?(?:(?:Cybersecurity|AI|Robotics|Biotech|Quantum)\s+)?(?:Startup|Company|Firm)\s+"
# fixed values: words that are no name alone
STOP_NAMES = (
    "the new this how why what a an algorithms researchers scientists study report company startup team government china us here there ai brain llm llms technology technologies quantum robot robots model models it its he she they we you our their "
    "nation state city country federal national cybersecurity cyber security firm firms companies encryption cryptography intelligence artificial platform platforms tool tools software service services senator minister president ministry governor mayor"
).split()
GENERIC = (
    "guide guides agent agents agentic behavior behaviour control controls database databases edge first identity identities industry law network networks neuromorphic next payment payments problem problems protocol protocols roadmap robotics rule rules signature signatures "
    "web where who with without world strategy strategies phone phones full-stack safety system systems ai-powered best scientific paper papers version versions funding top week powerful robotic lab high school"
).split()
# fixed values: offices, people, places and fragments that are no companies; names that need a company's verb; products under an owner's name
OFFICES = "senator minister president governor mayor".split()
PEOPLE = ["isaac asimov", "dean kamen", "sebastian thrun", "travis kalanick", "elon musk", "josh brown", "vinod paul"]
NO_COMPANIES = [
    "germany", "japan", "france", "india", "canada", "australia", "ukraine", "israel", "iran", "brazil", "italy", "spain", "europe", "european union", "uk", "usa", "eu", "white house", "congress", "senate", "parliament", "cisa", "nsa", "fbi", "cia", "nist", "fcc", "hhs", "irs", "enisa",
    "elon musk", "silicon valley", "g7", "josh brown", "vinod paul", "afghanistan", "korea", "utah", "pittsburgh", "navy", "three laws", "taps meta",
]
AMBIGUOUS = ["humanoid", "run robotics"]
PRODUCTS = {"NVIDIA Isaac": r"(?i)\bNVIDIA(?:[’']s)?\s+Isaac\b", "Weave Isaac 1": r"(?i)\bWeave Robotics(?:[’']s)?\s+(?:(?:launches|unveils|introduces|releases)\s+)?Isaac\s+1(?![\w-]|\.\d)"}
PERSON = rf"(?i)(?<![\w.-])(?:{'|'.join(PEOPLE)})(?![\w-]|\.[A-Za-z0-9])"



def whole(pattern: str) -> str:
    """The pattern where no letter, digit or underscore stands beside it."""
    return rf"(?U)(?<!\w)(?:{pattern})(?!\w)"


def noun_label(surface: Column) -> Column:
    """Label of a technical term: lower case, blanks for hyphens, last word singular; the catalogue's name if it is one of it."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower(surface), r"[-\s]+", " ")), rf"\b({'|'.join(p[:-1] for p in PLURALS)})s$", "$1")
    return let(plain, lambda label: F.coalesce(*(F.when(label.rlike(f"^(?:{p})$"), F.lit(name)) for name, p in CATALOGUE.items()), label))


def live_technology_reason(label: Column) -> Column:
    """As technology_reason, but what the catalogue names passes."""
    return F.when(~label.isin(*CATALOGUE), technology_reason(label))


def entity_name(label: Column) -> Column:
    """A name without leading articles and what describes a company before it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(label), r"\s+", " "), ARTICLES, ""), DESCRIPTION, "")


def _is_name(label: Column) -> Column:
    """Whether a seed may be the name of a company or product."""
    low = F.lower(label)
    reason = technology_reason(label)
    word = F.forall(F.split(low, r"\s+"), lambda w: w.isin(*STOP_NAMES, *GENERIC))
    no_term = ~label.rlike(f"^(?:{NOUN})$")
    for p in CATALOGUE.values():
        no_term = no_term & ~label.rlike(f"^(?:{p})$")
    return (low != "") & ~low.isin(*NO_COMPANIES, *PEOPLE) & ~F.substring_index(low, " ", 1).isin(*OFFICES) & no_term & (reason.isNull() | (reason == "no technology marker")) & ~word


def _found(title: Column, pattern: str, kind: str, key: str | None = None, group: int = 0) -> Column:
    """Mentions of a pattern: (kind, key, surface)."""
    return F.transform(F.regexp_extract_all(title, F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(kind).alias("kind"), (F.lit(key) if key else x).alias("key"), x.alias("surface")))


def titles_of(works: DataFrame) -> DataFrame:
    """(doc_id, whole, title, technical, product): titles without an aggregator's publisher, with persons blanked, whether they
    speak of technology, and the owned products they name."""
    whole_title = F.substring(F.when(F.col("source") == "gnews", strip_publisher(F.col("title"))).otherwise(F.col("title")), 1, TITLE_CHARS)
    rows = works.where("title is not null").select("doc_id", whole_title.alias("whole")).withColumn("title", F.regexp_replace("whole", PERSON, " "))
    named = F.lit(False)
    for p in CATALOGUE.values():
        named = named | F.col("title").rlike(whole(p))
    products = F.filter(F.array(*(F.when(F.col("title").rlike(p), F.lit(name)) for name, p in PRODUCTS.items())), lambda x: x.isNotNull())
    rows = rows.withColumn("technical", technology_reason(F.col("title")).isNull() | named)
    return rows.withColumn("products", F.when(F.col("technical"), products).otherwise(F.array().cast("array<string>")))


def mentions(titles: DataFrame, extra_terms: Sequence[str] = ()) -> DataFrame:
    """(doc_id, kind, key, surface): named technologies and technical terms of all titles, and in technical titles names before
    or after a verb of business and with a possessive. extra_terms count where they stand word by word."""
    title = F.col("title")
    terms = [_found(title, whole(p), "technology", name) for name, p in CATALOGUE.items()] + [_found(F.col("whole"), term_pattern(t), "technology", _known(t)) for t in extra_terms]
    nouns = F.filter(F.transform(F.regexp_extract_all(title, F.lit(NOUN), F.lit(0)), lambda x: F.struct(F.lit("technology").alias("kind"), noun_label(x).alias("key"), x.alias("surface"))), lambda m: technology_reason(m.key).isNull())
    # an owner made of stop words gives its product no name
    owned = F.arrays_zip(F.regexp_extract_all("whole", F.lit(OWNED), F.lit(1)).alias("owner"), F.regexp_extract_all("whole", F.lit(OWNED), F.lit(2)).alias("product"))
    owned = F.transform(F.filter(owned, lambda o: ~F.forall(F.split(F.lower(o.owner), r"\s+"), lambda w: w.isin(*STOP_NAMES))), lambda o: o.product)
    acting = F.concat(F.regexp_extract_all(title, F.lit(ACTOR), F.lit(1)), F.regexp_extract_all(title, F.lit(OWNER), F.lit(1)))
    others = F.concat(F.regexp_extract_all(title, F.lit(PRODUCT), F.lit(1)), owned)
    seeds = F.concat(F.transform(acting, lambda x: F.struct(entity_name(x).alias("name"), F.lit(True).alias("acts"))), F.transform(others, lambda x: F.struct(entity_name(x).alias("name"), F.lit(False).alias("acts"))))
    found = titles.select("doc_id", F.concat(*terms, nouns).alias("terms"), F.when(F.col("technical"), seeds).alias("seeds"), "products")
    technologies = found.select("doc_id", F.explode("terms").alias("m")).select("doc_id", "m.kind", "m.key", "m.surface")
    named = found.select("doc_id", "products", F.explode("seeds").alias("s")).select("doc_id", "products", "s.name", "s.acts").distinct()
    named = named.where(_is_name(F.col("name")) & ~((F.size("products") > 0) & F.col("name").rlike(r"(?i)\bisaac\b")))
    # a word of the language is a company only where it acts as one
    acts = named.where("acts").select("doc_id", F.lower("name").alias("low")).distinct()
    unclear = F.lower("name").isin(*AMBIGUOUS)
    sure = named.where(~unclear).unionByName(named.where(unclear).join(acts, (named["doc_id"] == acts["doc_id"]) & (F.lower("name") == acts["low"]), "left_semi"))
    entities = sure.select("doc_id", F.lit("entity").alias("kind"), F.lower("name").alias("key"), F.col("name").alias("surface"))
    owned_products = found.select("doc_id", F.explode("products").alias("surface")).select("doc_id", F.lit("entity").alias("kind"), F.lower("surface").alias("key"), "surface")
    return technologies.unionByName(entities).unionByName(owned_products).distinct()


def _known(term: str) -> str:
    """An asked term that the catalogue names in another case is the catalogue's."""
    return next((name for name in CATALOGUE if name.lower() == term.lower()), term)


def rescan(titles: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, key, surface): every technical title in which a discovered name (key) stands whole, whatever its case.

    Runs of one to four words of the titles meet the names in an equi-join, so no title is held against every name."""
    word = r"[A-Za-z0-9&][A-Za-z0-9&-]*(?:\.[A-Za-z0-9&-]+)*"
    runs = [F.regexp_extract_all("title", F.lit(rf"(?<![\w.-])(?=({word}(?: {word}){{{n}}})(?![\w-]|\.[A-Za-z0-9]))"), F.lit(1)) for n in range(4)]
    rows = titles.where("technical").select("doc_id", "products", F.explode(F.array_distinct(F.concat(*runs))).alias("surface")).withColumn("key", F.lower("surface"))
    rows = rows.where(~F.col("key").isin(*AMBIGUOUS, *(p.lower() for p in PRODUCTS)) & ~((F.col("key") == "isaac") & (F.size("products") > 0)))
    return lookup_join(rows, names, ["key"], F.col("doc_id")).select("doc_id", "key", "surface")


def extract_live(works: DataFrame, domain: str, min_docs: int = 3, extra_terms: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(candidates, links): what at least min_docs documents name. Names are discovered by the context of one title and then
    found again in all technical titles, before documents are counted.

    candidates: cand_id, kind, key, label (of an entity its smallest surface), aliases, n_docs; links: cand_id, doc_id. works has
    unique doc_id, source and title; null titles name nothing."""
    if min_docs < 2:
        raise ValueError("a live candidate needs two documents at least")
    titles = materialise(titles_of(works), "live-titles")
    seen = materialise(mentions(titles, extra_terms), "live-mentions")
    again = rescan(titles, seen.where("kind = 'entity'").select("key").distinct())
    all_ = materialise(seen.unionByName(again.withColumn("kind", F.lit("entity"))).distinct(), "live-evidence")
    strong = evidence(all_.withColumn("key", F.concat_ws("\0", "kind", "key")), min_docs)
    parts = F.split("key", "\0")
    strong = strong.select(F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).alias("key"), "label", "aliases", "n_docs")
    surfaces = F.array_union(F.array("label"), "aliases")
    label = F.when(F.col("kind") == "entity", F.col("label")).otherwise(F.col("key"))
    digest = F.substring(F.sha2(F.concat(F.lit(domain + "\0"), F.lower("key")), 256), 1, 24)
    named = strong.select(F.concat(F.when(F.col("kind") == "entity", "e:").otherwise("t:"), F.lit(domain + ":"), digest).alias("cand_id"), "kind", "key", label.alias("label"), F.array_except(surfaces, F.array(label)).alias("aliases"), "n_docs")
    links = lookup_join(all_.select("kind", "key", "doc_id").distinct(), named.select("kind", "key", "cand_id"), ["kind", "key"], F.col("doc_id"))
    return named, links.select("cand_id", "doc_id")
