"""Records of scholarly sources and web searches in the candidate schema.

Each normaliser reads with a fixed schema (no inference over the data) and is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.text import excerpt
from quarrylight.functions.urls import candidate_id, normalize_doi, to_https
from quarrylight.operators.dedupe import SCHEMA, numbered

LOCATION = "struct<landing_page_url:string,pdf_url:string,is_oa:boolean,source:struct<display_name:string,type:string,host_organization_name:string>>"
WORKS_A = (
    "id string, doi string, display_name string, publication_date string, publication_year int, language string, type string, cited_by_count long, relevance_score double, "
    f"authorships array<struct<author:struct<display_name:string>,raw_author_name:string>>, primary_location {LOCATION}, best_oa_location {LOCATION}, abstract_inverted_index map<string,array<int>>"
)
WORKS_B = (
    "paperId string, title string, abstract string, year int, publicationDate string, authors array<struct<name:string>>, venue string, journal struct<name:string>, url string, "
    "openAccessPdf struct<url:string>, externalIds map<string,string>, citationCount long, publicationTypes array<string>"
)
WEB = "id string, title string, url string, publishedDate string, author string, score double, text string, highlights array<string>"
ENTRY = (
    "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, link array<struct<_href:string,_rel:string,_type:string,_title:string>>, "
    "category array<struct<_term:string>>, `arxiv:doi` string, `arxiv:journal_ref` string"
)


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def abstract_text(index: Column, longest: int = 50_000) -> Column:
    """Text of an inverted index {word: [positions]}; of words with the same position the later one wins."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(e["value"], lambda p: (p >= 0) & (p < longest)), lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    # Sorted once: a word whose place the next one has too is overwritten by it.
    last = lambda ordered: F.filter(ordered, lambda x, i: F.coalesce(F.try_element_at(ordered, i + 2)["at"] != x["at"], F.lit(True)))
    text = F.transform(F.array(F.array_sort(places)), lambda ordered: F.array_join(F.transform(last(ordered), lambda x: x["word"]), " "))
    return _filled(F.element_at(text, 1))


def inverted_index(words: Column) -> Column:
    """{word: [places]} of an array of words: sorted once inside its row, so an index needs no shuffle and no row a word."""

    def grouped(pairs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: (i == 0) | (F.get(pairs, i)["word"] != F.get(pairs, F.greatest(i - 1, F.lit(0)))["word"]))
        places = lambda s, end: F.transform(F.slice(pairs, s + 1, end - s), lambda p: p["at"])
        entries = lambda starts: F.transform(starts, lambda s, k: F.struct(F.get(pairs, s)["word"], places(s, F.coalesce(F.get(starts, k + 1), F.size(pairs)))))
        return F.element_at(F.transform(F.array(starts), entries), 1)

    pairs = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))
    return F.map_from_entries(F.element_at(F.transform(F.array(pairs), grouped), 1))


def _candidate(rows: DataFrame, **columns: Column) -> DataFrame:
    base = {
        "source_ids": F.array("source_id"), "authors": F.expr("cast(array() as array<string>)"), "publisher": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "pdf_url": F.lit(None).cast("string"),
        "cited_by_count": F.lit(None).cast("long"), "search_score": F.lit(None).cast("double"), "for_counter": F.lit(False), "low_quality": F.lit(False), "is_wikipedia": F.lit(False), "round": F.lit(1),
    }
    out = rows.withColumns({k: v for k, v in columns.items()})
    out = out.withColumns({k: v for k, v in base.items() if k not in columns})
    names = "pos source_id source_ids tier title url pdf_url doi authors publisher published snippet text cited_by_count search_score search_rank for_counter low_quality is_wikipedia round".split()
    return out.withColumn("candidate_id", candidate_id(F.coalesce("doi", F.lit("")), F.col("url"))).select("candidate_id", *names)


def works_a(spark: SparkSession, path: str, source: str = "works_a") -> DataFrame:
    """Works as JSON lines: open-access page before publisher page before DOI; English works with a title only."""
    return normalize_works_a(spark.read.schema(f"search_rank int, {WORKS_A}").json(path), source)


def normalize_works_a(w: DataFrame, source: str = "works_a") -> DataFrame:
    oa, own = F.col("best_oa_location"), F.col("primary_location")
    doi = normalize_doi(F.col("doi"))
    url = to_https(F.coalesce(_filled(oa["landing_page_url"]), _filled(own["landing_page_url"]), _filled(F.col("doi")), F.col("id")))
    venue = F.coalesce(own["source"]["type"], F.lit(""))
    tier = F.when((F.col("type") == "preprint") | (venue == "repository"), "preprint").when(venue.isin("journal", "conference", "book series"), "peer_reviewed").when(F.col("type").isin("article", "review", "book-chapter", "book"), "peer_reviewed").otherwise("web")
    names = F.filter(F.transform("authorships", lambda a: F.coalesce(_filled(a["author"]["display_name"]), _filled(a["raw_author_name"]))), lambda n: n.isNotNull())
    kept = w.where((F.coalesce(F.trim("display_name"), F.lit("")) != "") & (F.coalesce("language", F.lit("en")) == "en")).withColumn("source_id", F.lit(source))
    return _candidate(
        kept.withColumn("pos", F.col("search_rank").cast("long")).withColumn("old_doi", F.col("doi")), tier=tier, title=F.trim("display_name"), url=url, pdf_url=to_https(F.coalesce(_filled(oa["pdf_url"]), _filled(own["pdf_url"]))),
        authors=F.coalesce(names, F.expr("cast(array() as array<string>)")), publisher=F.coalesce(_filled(own["source"]["display_name"]), _filled(own["source"]["host_organization_name"])),
        published=F.coalesce("publication_date", F.col("publication_year").cast("string")), snippet=abstract_text(F.col("abstract_inverted_index")), cited_by_count=F.col("cited_by_count"), search_score=F.col("relevance_score"), doi=doi,
    )


def normalize_works_b(w: DataFrame, source: str = "works_b") -> DataFrame:
    """Papers of a graph service; a preprint's id makes its DOI where there is none."""
    arxiv = _filled(F.col("externalIds")["ArXiv"])
    doi = F.coalesce(normalize_doi(_filled(F.col("externalIds")["DOI"])), F.concat(F.lit("10.48550/arxiv."), F.lower(arxiv)))
    venue = F.coalesce(_filled(F.col("journal")["name"]), _filled(F.col("venue")))
    preprint = F.coalesce(venue.rlike(r"(?i)arxiv|biorxiv|medrxiv|ssrn|preprint|working paper"), F.lit(False)) | F.coalesce(doi.rlike(r"^10\.(48550|1101|2139|31219|31234|31235|20944|21203|3386|26434)/"), F.lit(False))
    reviewed = F.exists(F.coalesce("publicationTypes", F.expr("cast(array() as array<string>)")), lambda t: t.rlike("(?i)journal|conference|review|clinicaltrial|meta"))
    tier = F.when(preprint, "preprint").when(reviewed | venue.isNotNull(), "peer_reviewed").otherwise("web")
    kept = w.where(F.coalesce(F.trim("title"), F.lit("")) != "").withColumn("source_id", F.lit(source))
    url = to_https(F.coalesce(_filled(F.col("url")), F.concat(F.lit("https://doi.org/"), doi), _filled(F.col("openAccessPdf")["url"]), F.concat(F.lit("https://arxiv.org/abs/"), arxiv)))
    names = F.filter(F.transform("authors", lambda a: _filled(a["name"])), lambda n: n.isNotNull())
    return _candidate(
        kept.withColumn("pos", F.col("search_rank").cast("long")), tier=tier, title=F.trim("title"), pdf_url=to_https(_filled(F.col("openAccessPdf")["url"])), published=F.coalesce("publicationDate", F.col("year").cast("string")), snippet=_filled(F.col("abstract")),
        publisher=venue, cited_by_count=F.col("citationCount"), doi=doi, url=url, authors=F.coalesce(names, F.expr("cast(array() as array<string>)")),
    ).where("url is not null")


def works_b(spark: SparkSession, path: str, source: str = "works_b") -> DataFrame:
    return normalize_works_b(spark.read.schema(f"search_rank int, {WORKS_B}").json(path), source)


def feed(spark: SparkSession, path: str, source: str = "feed") -> DataFrame:
    """Entries of an Atom feed; the version suffix leaves the id, file address and DOI follow from it; error entries go."""
    e = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    paper = F.regexp_replace(F.regexp_extract("id", r"/abs/(.+)$", 1), r"v[0-9]+$", "")
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    pdf = F.try_element_at(F.transform(F.filter("link", lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf")), lambda x: x["_href"]), F.lit(1))
    kept = e.where(~F.coalesce(F.col("id").rlike("/api/errors"), F.lit(False)) & (F.coalesce(flat(F.col("title")), F.lit("")) != "") & (flat(F.col("title")) != "Error")).withColumn("paper", paper)
    # Numbered over ranges in the order of files and entries: the ids that Spark gives out leave gaps too large for an int.
    kept = numbered(kept.withColumn("__order", F.monotonically_increasing_id()), "__order").withColumn("pos", F.col("n").cast("long") - 1)
    kept = kept.withColumn("search_rank", F.col("pos").cast("int")).withColumn("source_id", F.lit(source))
    doi = F.coalesce(normalize_doi(_filled(F.col("`arxiv:doi`"))), F.when(F.col("paper") != "", F.concat(F.lit("10.48550/arxiv."), F.lower("paper"))))
    return _candidate(
        kept, tier=F.lit("preprint"), title=flat(F.col("title")), url=F.concat(F.lit("https://arxiv.org/abs/"), F.col("paper")), pdf_url=to_https(F.coalesce(pdf, F.concat(F.lit("https://arxiv.org/pdf/"), F.col("paper")))),
        authors=F.coalesce(F.filter(F.transform("author", lambda a: flat(a["name"])), lambda n: n != ""), F.expr("cast(array() as array<string>)")), published=F.substring("published", 1, 10), snippet=flat(F.col("summary")), publisher=F.lit("arXiv"), doi=doi,
    )


def split_byline(byline: Column) -> Column:
    """Authors of a byline: parted by semicolons, else by commas, "and" and ampersands."""
    parts = F.when(byline.contains(";"), F.split(byline, r"\s*;\s*")).otherwise(F.split(byline, r"\s*,\s*|\s+(?i:and)\s+|\s*&\s*"))
    plain = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^(?i)by\s+", ""))), lambda p: p != "")
    return F.array_distinct(plain)


def web_results(spark: SparkSession, path: str, preset: str, source: str) -> DataFrame:
    """Results of a web search: snippet from highlights, else an excerpt, else the title.  Tiers by domain are joined later (``tiers``)."""
    r = spark.read.schema(f"search_rank int, {WEB}").json(path)
    day = F.regexp_extract("publishedDate", r"^([0-9]{4}(?:-[0-9]{2}-[0-9]{2})?)", 1)
    marks = F.array_join(F.filter("highlights", lambda h: F.trim(h) != ""), " … ")
    snippet = F.coalesce(_filled(marks), excerpt(_filled(F.col("text"))), F.col("title"))
    tier = F.lit({"papers": "peer_reviewed", "news": "major_news", "policy": "think_tank"}.get(preset, "web"))
    kept = r.where(F.col("url").rlike("^(?i)https?://")).withColumn("source_id", F.lit(source)).withColumn("pos", F.col("search_rank").cast("long"))
    return _candidate(kept.withColumn("doi", F.lit(None).cast("string")), tier=tier, title=F.coalesce(_filled(F.col("title")), F.col("url")), pdf_url=F.when(F.lower("url").rlike(r"\.pdf([?#]|$)"), F.col("url")), published=_filled(day), snippet=snippet, authors=F.coalesce(split_byline(F.col("author")), F.expr("cast(array() as array<string>)")), search_score=F.col("score"))


def conforming(rows: DataFrame) -> DataFrame:
    """The candidates of a source of one's own, in the schema's order; columns that lack or have another type are an error before anything runs."""
    want = dict(part.strip().split(" ") for part in ("pos long, candidate_id string, " + SCHEMA).replace("array<string>", "array_string").split(","))
    want = {name: {"long": "bigint", "array_string": "array<string>"}.get(kind, kind) for name, kind in want.items()}
    have = dict(rows.dtypes)
    wrong = [f"{name} {kind} (found {have.get(name, 'none')})" for name, kind in want.items() if have.get(name) != kind]
    if wrong:
        raise ValueError("not in the candidate schema: " + ", ".join(wrong))
    return rows.select(*want)


def union_sources(parts: dict[str, DataFrame], round_: int) -> DataFrame:
    """All sources' candidates with the round stamped; a source that brought nothing adds nothing."""
    out: DataFrame | None = None
    for name, part in sorted(parts.items()):
        stamped = part.withColumn("source_id", F.coalesce("source_id", F.lit(name))).withColumn("round", F.lit(round_))
        out = stamped if out is None else out.unionByName(stamped, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source given")
    return out
