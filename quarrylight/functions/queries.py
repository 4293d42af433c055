"""Search plans from claims: regions, query texts, and the plan that needs no model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import normalize_ws

# Stop words of the planner, and patterns of technical subjects.
PLANNER_STOPWORDS = "a an and are as at be by do does doesnt dont for from has have in into is it its of on or that the their this to was were will with than then not no really very more most less".split()
TECHNICAL_DOMAIN = (
    r"(?i)\b(computer|computing|cs|physics|physical|math|mathematics|mathematical|statistics|statistical|stats|quantitative|engineering|artificial intelligence|ai|machine learning|robotics|astronomy"
    r"|astrophysics|cosmology|electrical|signal processing|information theory|cryptography|econometrics|quantitative finance|q-fin|q-bio|computational|data science|materials science|condensed matter|quantum)\b"
)
TECHNICAL_TERM = (
    r"(?i)\b(algorithms?|neural|deep learning|machine learning|transformers?|large language models?|llms?|language models?|gpt|reinforcement learning|computer vision|datasets?|benchmarks?"
    r"|artificial intelligence|ai|robots?|robotics|quantum|qubits?|cryptograph\w*|blockchain|encryption|semiconductors?|gpus?|chips?|photovoltaic|solar cells?|batter(?:y|ies)|superconduct\w*|particles?"
    r"|galax(?:y|ies)|black holes?|dark matter|cosmolog\w*|exoplanets?|gravitational|relativity|thermodynamic\w*|entropy|theorem|proofs?|topolog\w*|bayesian|stochastic|monte carlo|simulations?"
    r"|optimization|graph theory|genomics?|protein folding|crispr|neural networks?|climate models?|epidemiological models?|computational|software|compilers?|networks? security|signal processing"
    r"|autonomous vehicles?|self-driving|nlp|natural language processing|econometric\w*)\b"
)


def ascii_edges(pattern: str) -> str:
    """The pattern with its word boundaries seen among ASCII letters only; the JVM's own also count accented letters."""
    return pattern.replace(r"\b(", r"(?<![A-Za-z0-9_])(").replace(r")\b", r")(?![A-Za-z0-9_])")


def _clean(texts: Column) -> Column:
    return F.filter(F.transform(F.coalesce(texts, F.expr("cast(array() as array<string>)")), lambda t: normalize_ws(F.coalesce(t, F.lit("")))), lambda t: t != "")


def regions_of(regions: Column) -> Column:
    """Regions in order, each spelling once whatever its case."""
    seen = lambda done, r: F.exists(done, lambda d: F.lower(d) == F.lower(r))
    return F.aggregate(_clean(regions), F.expr("cast(array() as array<string>)"), lambda done, r: F.when(seen(done, r), done).otherwise(F.concat(done, F.array(r))))


def _missing(query: Column, regions: Column) -> Column:
    return F.filter(regions, lambda r: ~F.contains(F.lower(query), F.lower(r)))


def with_region_keywords(query: Column, regions: Column) -> Column:
    return normalize_ws(F.concat_ws(" ", query, F.array_join(_missing(query, regions), " ")))


def with_region_sentence(query: Column, regions: Column) -> Column:
    base = normalize_ws(query)
    extra = _missing(base, regions)
    return F.when(F.size(extra) == 0, base).otherwise(F.concat(F.regexp_replace(base, "[.!?]+$", ""), F.lit(" in "), F.array_join(extra, " or ")))


def academic_queries(queries: Column, key_terms: Column, core: Column, claim: Column, most: int) -> Column:
    """Given queries; else the first six key terms; else the claim."""
    given, terms = _clean(queries), F.array_join(F.slice(_clean(key_terms), 1, 6), " ")
    text = normalize_ws(F.coalesce(F.when(core != "", core), claim, F.lit("")))
    return F.when(F.size(given) > 0, F.slice(given, 1, most)).when(terms != "", F.array(terms)).when(text != "", F.array(text)).otherwise(F.expr("cast(array() as array<string>)"))


def first_query(lists: list[Column], claim: Column) -> Column:
    return F.coalesce(*(F.try_element_at(_clean(q), F.lit(1)) for q in lists), normalize_ws(F.coalesce(claim, F.lit(""))))


def term_query(terms: Column, strict: bool) -> Column:
    """Terms of a strict (all of five) or loose (any of four) query."""
    return F.slice(F.array_distinct(_clean(terms)), 1, 5 if strict else 4)


def technical(domains: Column, texts: Column) -> Column:
    """Whether a claim is technical: a domain says so, else one technical term, or two if domains say otherwise."""
    given = _clean(domains)
    hits = F.size(F.array_distinct(F.regexp_extract_all(F.lower(F.array_join(texts, " | ")), F.lit(ascii_edges(TECHNICAL_TERM)), F.lit(1))))
    return F.exists(given, lambda d: d.rlike(ascii_edges(TECHNICAL_DOMAIN))) | F.when(F.size(given) > 0, hits >= 2).otherwise(hits >= 1)


def detect_regions(text: Column, names: list[tuple[str, str]], most: int = 3) -> Column:
    """First region names, in list order, whose pattern the text has.  names: (name, pattern)."""
    found = F.array(*(F.when(text.rlike(pattern), F.lit(name)) for name, pattern in names))
    return F.slice(F.array_distinct(F.array_compact(found)), 1, most)


def fallback_plan(claims: DataFrame) -> DataFrame:
    """Plans from the claims' own words: claim_id, normalized_claim, key_terms, paraphrases, queries, counter_query and the rest of a plan."""
    claim = F.substring(normalize_ws(F.col("text")), 1, 400)
    words = F.split(F.trim(F.regexp_replace(F.lower(claim), r"[^a-z0-9\s-]", " ")), r"\s+")
    stop = F.array(*map(F.lit, PLANNER_STOPWORDS))
    terms = F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))), 1, 8)
    rows = claims.select("claim_id", claim.alias("normalized_claim"), terms.alias("key_terms"))
    joined = F.array_join(F.slice("key_terms", 1, 6), " ")
    academic = F.when(joined != "", joined).otherwise(F.col("normalized_claim"))
    c = F.col("normalized_claim")
    return rows.select(
        "claim_id", "normalized_claim", F.lit("empirical").alias("claim_type"), c.alias("core_proposition"), F.array(c, c, c).alias("paraphrases"), "key_terms",
        F.struct(F.array(academic).alias("academic"), F.array(c).alias("semantic"), F.array(academic).alias("news"), F.array(academic).alias("policy")).alias("queries"),
        F.concat(F.lit("evidence against: "), academic).alias("counter_query"),
    )


def tidy_plan(plans: DataFrame) -> DataFrame:
    """Reversed years swapped, a single "several claims" dropped, English as input language dropped."""
    low, high = F.least("year_from", "year_to"), F.greatest("year_from", "year_to")
    both = F.col("year_from").isNotNull() & F.col("year_to").isNotNull()
    return plans.withColumns({
        "year_from": F.when(both, low).otherwise(F.col("year_from")),
        "year_to": F.when(both, high).otherwise(F.col("year_to")),
        "multiple_claims": F.when(F.size("multiple_claims") > 1, F.col("multiple_claims")),
        "input_language": F.when(~F.col("input_language").rlike("^(?i)en(glish)?$"), F.col("input_language")),
    })
