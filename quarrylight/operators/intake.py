"""From claims to work: which sources a claim goes to, what kind of claim it is, where it is about, and what the summariser gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.dates import year_of
from quarrylight.functions.queries import detect_regions
from quarrylight.functions.text import normalize_ws, truncate
from quarrylight.sources.scholarly import split_byline

#: Places and the adjectives that stand for them.
REGIONS = {
    "Argentina": "argentine argentinian", "Australia": "australian", "Austria": "austrian", "Bangladesh": "bangladeshi", "Belgium": "belgian", "Brazil": "brazilian", "Canada": "canadian", "Chile": "chilean",
    "China": "chinese", "Colombia": "colombian", "Denmark": "danish", "Egypt": "egyptian", "Ethiopia": "ethiopian", "Finland": "finnish", "France": "french", "Germany": "german", "Greece": "greek",
    "Hungary": "hungarian", "India": "indian", "Indonesia": "indonesian", "Iran": "iranian", "Iraq": "iraqi", "Ireland": "irish", "Israel": "israeli", "Italy": "italian", "Japan": "japanese", "Kenya": "kenyan",
    "Malaysia": "malaysian", "Mexico": "mexican", "Morocco": "moroccan", "Mozambique": "mozambican", "Netherlands": "dutch", "New Zealand": "", "Nigeria": "nigerian", "Norway": "norwegian", "Pakistan": "pakistani",
    "Peru": "peruvian", "Philippines": "filipino philippine", "Poland": "polish", "Portugal": "portuguese", "Romania": "romanian", "Russia": "russian", "Saudi Arabia": "saudi", "Singapore": "singaporean",
    "South Africa": "", "South Korea": "korea korean", "Spain": "spanish", "Sweden": "swedish", "Switzerland": "swiss", "Taiwan": "taiwanese", "Thailand": "thai", "Turkey": "turkish", "Ukraine": "ukrainian",
    "United Kingdom": "britain british england scotland wales", "United States": "usa american", "Vietnam": "vietnamese",
    "Africa": "african", "Asia": "asian", "Europe": "european eu", "Latin America": "", "Middle East": "", "Global": "worldwide",
}
SUMMARIES, OPENING, PASSAGES = 10, 800, 2


def region_patterns(regions: dict[str, str] = REGIONS) -> list[tuple[str, str]]:
    """(name, pattern) of each region: its name or one of its adjectives as a whole word, whatever the case."""
    return [(name, r"(?i)(?:^|[^a-z0-9_])(?:" + "|".join([name.lower().replace(" ", r"\s+"), *more.split()]) + r")(?:[^a-z0-9_]|$)") for name, more in regions.items()]


def detect(text: Column, most: int = 3) -> Column:
    """The first regions, in the table's order, that a text names."""
    return detect_regions(text, region_patterns(), most)


def eligible_sources(claims: DataFrame, sources: DataFrame, skipped: DataFrame) -> DataFrame:
    """claim_id, source: the sources that a claim is sent to.

    claims: claim_id, technical; sources: source, enabled, needs_key, has_key, technical_only (a small table of settings);
    skipped: claim_id, source.  A source must be enabled, have its key if it needs one, and suit the claim.
    """
    usable = sources.where(F.col("enabled") & (~F.col("needs_key") | F.col("has_key")))
    # The kinds of claims that a source suits, so that claims meet sources by equality.
    kinds = F.when(F.col("technical_only"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    suited = claims.select("claim_id", "technical").join(usable.select("source", F.explode(kinds).alias("technical")), "technical")
    return suited.select("claim_id", "source").join(skipped.select("claim_id", "source"), ["claim_id", "source"], "left_anti")


def claim_flags(plans: DataFrame) -> DataFrame:
    """claim_id, values_claim (what ought to be, not what is), several_claims.  plans: claim_id, claim_type, multiple_claims (array)."""
    return plans.select("claim_id", F.coalesce(F.col("claim_type") == "normative", F.lit(False)).alias("values_claim"), (F.coalesce(F.size("multiple_claims"), F.lit(0)) > 1).alias("several_claims"))


def publisher_year(publisher: Column, published: Column) -> Column:
    return F.concat_ws(", ", F.when(publisher != "", publisher), year_of(published).cast("string"))


def summary_requests(results: DataFrame, docs: DataFrame, most: int = SUMMARIES) -> DataFrame:
    """claim_id, rank, doc_id, title, publisher_year, abstract_only, opening, passages: what a summariser gets of a claim's best results.

    results: claim_id, rank, doc_id, title, publisher, published, text_source, passages (array, best first); docs: doc_id, text.
    """
    order = Window.partitionBy("claim_id").orderBy("rank", "doc_id")
    best = results.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return best.join(docs.select("doc_id", "text"), "doc_id").select(
        "claim_id", "rank", "doc_id", "title", publisher_year(F.col("publisher"), F.col("published")).alias("publisher_year"), (F.col("text_source") == "abstract_only").alias("abstract_only"),
        truncate(normalize_ws(F.col("text")), OPENING).alias("opening"), F.slice("passages", 1, PASSAGES).alias("passages"),
    )


def fill_metadata(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates whose missing title, authors and date come from the document that was read; failing a title, the address stands.

    candidates: candidate_id, title, url, authors (array), published, ...; docs: candidate_id, doc_title, byline, doc_published.
    """
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    rows = candidates.join(docs.select("candidate_id", "doc_title", "byline", "doc_published"), "candidate_id", "left")
    authors = F.when(F.size("authors") > 0, F.col("authors")).when(filled("byline").isNotNull(), split_byline(F.col("byline"))).otherwise(F.expr("cast(array() as array<string>)"))
    out = rows.withColumns({"title": F.coalesce(filled("title"), filled("doc_title"), "url"), "authors": authors, "published": F.coalesce(filled("published"), filled("doc_published"))})
    return out.drop("doc_title", "byline", "doc_published")
