"""Registered queries of citing and of source intake: works as services give them, references in three styles, references in the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import dates as D
from quarrylight.operators import biblio
from quarrylight.plans.catalog import _case, _list, _pick
from quarrylight.plans.common import table
from quarrylight.sources import scholarly

#: Author lists as sources give them; the SQL twin has what each comes to, written out.
PEOPLE = [
    ["Ada King Lovelace"],
    ["van der Berg, Jan", "Mary Shelley Jr."],
    ["World Bank"],
    ["By Jean-Paul Sartre and Simone de Beauvoir"],
    [],
    ["Ann Lee", "Bo Diaz", "Cy Young", "ann lee", "unknown"],
]
KINDS = ["peer_reviewed", "major_news", "think_tank", "web"]
PUBLISHERS = ["World Bank", "Nature", "Daily"]
ACCESSED = "May 1, 2026"


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as works to cite: by each list of authors, dated to the year, month, day or not, some titles with their outlet."""
    k = F.col("o_orderkey")
    date = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
    people = F.element_at(F.array(*(F.array(*map(F.lit, p)).cast("array<string>") for p in PEOPLE)), (k % len(PEOPLE) + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("claim_id"), k.alias("rank"), F.concat("o_orderpriority", F.when(k % 5 == 0, " | Nature").otherwise("")).alias("title"), people.alias("authors"),
        F.when(k % 7 != 0, _pick(PUBLISHERS, k)).alias("publisher"), date.alias("published"), _pick(KINDS, F.floor(k / 4)).alias("tier"), F.when(k % 2 == 0, F.concat(F.lit("10.1/x"), k.cast("string"))).alias("doi"),
        F.concat(F.lit("https://e.com/"), k.cast("string")).alias("url"),
    )
    return biblio.works(o)


def cited_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of reference lists in three styles."""
    return biblio.references(_works(spark, sf_dir), ACCESSED).select(F.col("rank").alias("o_orderkey"), "style", "reference")


def cited_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in the running text in three styles, with pages."""
    k = F.col("rank")
    pages = F.when(k % 3 == 0, F.array((k % 400 + 1).cast("int"))).when(k % 3 == 1, F.array((k % 400 + 9).cast("int"), F.lit(0), (k % 400 + 1).cast("int")))
    return biblio.in_text_styles(_works(spark, sf_dir).withColumn("pages", pages)).select(k.alias("o_orderkey"), "style", "in_text")


def rebuilt_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as inverted indexes, from words to places, put back into running text (as far as a service's index goes)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("words")).where("size(words) > 0")
    held = d.select("doc_id", scholarly.inverted_index(F.col("words")).alias("index"))
    return held.select("doc_id", F.md5(scholarly.abstract_text(F.col("index"))).alias("text"))


def _candidates(rows: DataFrame) -> DataFrame:
    return rows.select("pos", "source_id", "tier", F.md5("title").alias("title"), "url", "pdf_url", "doi", F.array_join("authors", "|").alias("authors"), "publisher", "published", "cited_by_count")


def works_a_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as works of an open index: English ones with a title become candidates."""
    k, text = F.col("doc_id"), lambda *parts: F.concat(*parts).cast("string")
    source = lambda name, kind, host: F.struct(name.alias("display_name"), kind.alias("type"), host.alias("host_organization_name"))
    place = lambda page, pdf, s: F.struct(page.alias("landing_page_url"), pdf.alias("pdf_url"), F.lit(True).alias("is_oa"), s.alias("source"))
    nothing = F.lit(None).cast("string")
    name = lambda shown, raw: F.struct(F.struct(shown.alias("display_name")).alias("author"), raw.alias("raw_author_name"))
    own = place(F.when(k % 5 != 0, text(F.lit("http://pub.example/"), k)), nothing, source(F.when(k % 4 != 0, F.col("source")).otherwise(" "), _pick(["journal", "repository", "ebook platform"], k), F.lit("Host")))
    free = place(F.lit(" "), text(F.lit("http://files.example/"), k, F.lit(".pdf")), source(nothing, nothing, nothing))
    w = table(spark, sf_dir, "documents").select(
        k.cast("int").alias("search_rank"), text(F.lit("https://index.example/W"), k).alias("id"), F.when(k % 3 == 0, text(F.lit("https://doi.org/10.1234/Ab."), k)).alias("doi"), F.substring("text", 1, 60).alias("display_name"),
        F.when(k % 2 == 0, "2020-05-06").alias("publication_date"), (1990 + k % 30).cast("int").alias("publication_year"), F.when(k % 6 != 0, F.col("lang")).alias("language"), _pick(["article", "preprint", "dataset", "book"], k).alias("type"),
        (k % 300).alias("cited_by_count"), (k % 9 / 9).alias("relevance_score"), F.array(name(text(F.lit(" By "), "source"), nothing), name(nothing, F.col("lang")), name(F.lit(" "), F.lit(""))).alias("authorships"),
        own.alias("primary_location"), F.when(k % 4 == 0, free).alias("best_oa_location"), F.create_map(F.lit("word"), F.array(F.lit(0))).alias("abstract_inverted_index"),
    )
    return _candidates(scholarly.normalize_works_a(w))


def works_b_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers of a graph service: identifiers, addresses and tiers from whatever is given."""
    k, text = F.col("doc_id"), lambda *parts: F.concat(*parts).cast("string")
    ids = F.map_from_entries(F.array_compact(F.array(F.when(k % 3 == 0, F.struct(F.lit("DOI"), text(F.lit("10.1234/B."), k))), F.when(k % 4 == 0, F.struct(F.lit("ArXiv"), text(F.lit("2101.X"), k))))))
    w = table(spark, sf_dir, "documents").select(
        k.cast("int").alias("search_rank"), F.when(k % 8 != 7, F.substring("text", 1, 60)).otherwise(" ").alias("title"), F.lit("a").alias("abstract"), (1990 + k % 30).cast("int").alias("year"), F.when(k % 2 == 0, "2020-05-06").alias("publicationDate"),
        F.array(F.struct(F.col("source").alias("name")), F.struct(F.lit(" ").alias("name"))).alias("authors"), F.when(k % 5 == 0, "arXiv.org").when(k % 5 == 1, "A Journal").alias("venue"), F.struct(F.when(k % 10 == 1, "Letters").alias("name")).alias("journal"),
        F.when(k % 5 == 2, text(F.lit("http://graph.example/"), k)).alias("url"), F.struct(F.when(k % 6 == 1, text(F.lit("http://files.example/"), k)).alias("url")).alias("openAccessPdf"), ids.alias("externalIds"), (k % 300).alias("citationCount"),
        F.when(k % 7 == 0, F.array(F.lit("JournalArticle"))).alias("publicationTypes"),
    )
    return _candidates(scholarly.normalize_works_b(w))


QUERIES = {f.__name__: f for f in (cited_works, cited_in_text, rebuilt_abstracts, works_a_candidates, works_b_candidates)}

_MONTHS, _SHORT = _list(D.MONTHS), _list(D.SHORT_MONTHS)
_CITED = f"""p(i, n, first, pair_apa, pair_chicago, apa, chicago, mla) AS (VALUES
  (0, 1, 'Lovelace', 'Lovelace', 'Lovelace', 'Lovelace, A. K.', 'Lovelace, Ada King', 'Lovelace, Ada King'),
  (1, 2, 'van der Berg', 'van der Berg & Shelley', 'van der Berg and Shelley', 'van der Berg, J., & Shelley, M., Jr', 'van der Berg, Jan, and Mary Shelley Jr', 'van der Berg, Jan, and Mary Shelley'),
  (2, 1, 'World Bank', 'World Bank', 'World Bank', 'World Bank', 'World Bank', 'World Bank'),
  (3, 2, 'Sartre', 'Sartre & de Beauvoir', 'Sartre and de Beauvoir', 'Sartre, J.-P., & de Beauvoir, S.', 'Sartre, Jean-Paul, and Simone de Beauvoir', 'Sartre, Jean-Paul, and Simone de Beauvoir'),
  (5, 3, 'Lee', 'Lee et al.', 'Lee et al.', 'Lee, A., Diaz, B., & Young, C.', 'Lee, Ann, Bo Diaz, and Cy Young', 'Lee, Ann, et al.')),
o AS (SELECT o_orderkey AS k, o_orderpriority AS t0, CASE WHEN o_orderkey % 7 <> 0 THEN {_case(PUBLISHERS, "o_orderkey")} END AS box0, {_case(KINDS, "(o_orderkey // 4)")} AS tier,
  CASE WHEN o_orderkey % 4 < 3 THEN year(o_orderdate) END AS y, CASE WHEN o_orderkey % 4 IN (1, 2) THEN month(o_orderdate) END AS m, CASE WHEN o_orderkey % 4 = 2 THEN day(o_orderdate) END AS d,
  CASE WHEN o_orderkey % 2 = 0 THEN 'https://doi.org/10.1/x' || o_orderkey ELSE 'https://e.com/' || o_orderkey END AS link FROM orders),
q AS (SELECT o.*, CASE WHEN k % 5 = 0 AND box0 IS DISTINCT FROM 'Nature' THEN t0 || ' | Nature' ELSE t0 END AS title, p.*, k % 6 = 4 AND tier = 'think_tank' AND box0 IS NOT NULL AS own FROM o LEFT JOIN p ON p.i = k % 6),
r AS (SELECT k, title, tier, y, m, d, link, CASE WHEN own THEN 1 ELSE coalesce(n, 0) END AS n, CASE WHEN own THEN NULL WHEN n = 1 AND first = box0 THEN NULL ELSE box0 END AS box,
  CASE WHEN own THEN box0 ELSE first END AS first, CASE WHEN own THEN box0 ELSE pair_apa END AS pair_apa, CASE WHEN own THEN box0 ELSE pair_chicago END AS pair_chicago,
  CASE WHEN own THEN box0 ELSE apa END AS apa, CASE WHEN own THEN box0 ELSE chicago END AS chicago, CASE WHEN own THEN box0 ELSE mla END AS mla FROM q)"""
_DAY = f"CASE WHEN d IS NOT NULL THEN y || ', ' || {_MONTHS}[m] || ' ' || d WHEN m IS NOT NULL THEN y || ', ' || {_MONTHS}[m] ELSE coalesce(y::VARCHAR, 'n.d.') END"
_LONG = f"CASE WHEN d IS NOT NULL THEN {_MONTHS}[m] || ' ' || d || ', ' || y ELSE {_MONTHS}[m] || ' ' || y END"
_BRIEF = f"CASE WHEN d IS NOT NULL THEN d || ' ' || {_SHORT}[m] || ' ' || y WHEN m IS NOT NULL THEN {_SHORT}[m] || ' ' || y ELSE y::VARCHAR END"


def _dot(x: str) -> str:
    return f"CASE WHEN right({x}, 1) IN ('.', '?', '!', '…') THEN {x} ELSE {x} || '.' END"


SQL = {
    "cited_works": f"""WITH {_CITED}
SELECT k AS o_orderkey, 'apa' AS style, CASE WHEN n > 0 THEN {_dot("apa")} || ' (' || CASE WHEN tier IN ('peer_reviewed', 'think_tank') THEN coalesce(y::VARCHAR, 'n.d.') ELSE {_DAY} END || '). ' || title || '.'
  ELSE title || '. (' || CASE WHEN tier IN ('peer_reviewed', 'think_tank') THEN coalesce(y::VARCHAR, 'n.d.') ELSE {_DAY} END || ').' END || coalesce(' ' || box || '.', '') || CASE WHEN y IS NULL THEN ' Retrieved {ACCESSED}, from' ELSE '' END || ' ' || link AS reference FROM r
UNION ALL SELECT k, 'chicago', CASE WHEN n > 0 THEN {_dot("chicago")} || ' ' ELSE '' END || coalesce(y::VARCHAR, 'n.d.') || '. “' || title || '.”'
  || CASE WHEN tier IN ('major_news', 'web') AND m IS NOT NULL THEN ' ' || coalesce(box, '') || ', ' || {_LONG} || '.' ELSE coalesce(' ' || box || '.', '') END || CASE WHEN y IS NULL THEN ' Accessed {ACCESSED}.' ELSE '' END || ' ' || link || '.' FROM r
UNION ALL SELECT k, 'mla', CASE WHEN n > 0 THEN {_dot("mla")} || ' ' ELSE '' END || '“' || title || '.” ' || concat_ws(', ', box, {_BRIEF}, regexp_replace(link, '^https?://', '')) || '.' || CASE WHEN y IS NULL THEN ' Accessed {ACCESSED}.' ELSE '' END FROM r""",
    "cited_in_text": f"""WITH {_CITED},
g AS (SELECT *, CASE WHEN k % 3 < 2 THEN k % 400 + 1 END AS a, CASE WHEN k % 3 = 1 THEN k % 400 + 9 END AS z, coalesce(y::VARCHAR, 'n.d.') AS yy,
  CASE WHEN n = 0 THEN '“' || title || '”' WHEN n <= 2 THEN pair_apa ELSE first || ' et al.' END AS wa, CASE WHEN n = 0 THEN '“' || title || '”' WHEN n <= 2 THEN pair_chicago ELSE first || ' et al.' END AS wc FROM r)
SELECT k AS o_orderkey, 'apa' AS style, '(' || wa || ', ' || yy || coalesce(', ' || CASE WHEN z IS NULL THEN 'p. ' || a ELSE 'pp. ' || a || '–' || z END, '') || ')' AS in_text FROM g
UNION ALL SELECT k, 'chicago', '(' || wc || ' ' || yy || coalesce(', ' || CASE WHEN z IS NULL THEN a::VARCHAR ELSE a || '–' || z END, '') || ')' FROM g
UNION ALL SELECT k, 'mla', '(' || wc || coalesce(' ' || CASE WHEN z IS NULL THEN a::VARCHAR WHEN a >= 100 AND a // 100 = z // 100 THEN a || '-' || lpad((z % 100)::VARCHAR, 2, '0') ELSE a || '-' || z END, '') || ')' FROM g""",
    "rebuilt_abstracts": r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, md5(array_to_string(w[1:50000], ' ')) AS text FROM w WHERE len(w) > 0""",
    "works_a_candidates": f"""WITH d AS (SELECT doc_id AS k, source, lang, trim(left(text, 60), ' ') AS title, ['journal', 'repository', 'ebook platform'][doc_id % 3 + 1] AS venue, ['article', 'preprint', 'dataset', 'book'][doc_id % 4 + 1] AS type FROM documents)
SELECT k AS pos, 'works_a' AS source_id, CASE WHEN type = 'preprint' OR venue = 'repository' THEN 'preprint' WHEN venue = 'journal' OR type IN ('article', 'book') THEN 'peer_reviewed' ELSE 'web' END AS tier, md5(title) AS title,
  CASE WHEN k % 5 <> 0 THEN 'https://pub.example/' || k WHEN k % 3 = 0 THEN 'https://doi.org/10.1234/Ab.' || k ELSE 'https://index.example/W' || k END AS url, CASE WHEN k % 4 = 0 THEN 'https://files.example/' || k || '.pdf' END AS pdf_url,
  CASE WHEN k % 3 = 0 THEN '10.1234/ab.' || k END AS doi, 'By ' || source || '|' || lang AS authors, CASE WHEN k % 4 <> 0 THEN source ELSE 'Host' END AS publisher, CASE WHEN k % 2 = 0 THEN '2020-05-06' ELSE (1990 + k % 30)::VARCHAR END AS published, k % 300 AS cited_by_count
FROM d WHERE title <> '' AND (k % 6 = 0 OR lang = 'en')""",
    "works_b_candidates": """WITH d AS (SELECT doc_id AS k, source, trim(left(text, 60), ' ') AS title, CASE WHEN doc_id % 3 = 0 THEN '10.1234/b.' || doc_id WHEN doc_id % 4 = 0 THEN '10.48550/arxiv.2101.x' || doc_id END AS doi,
  CASE WHEN doc_id % 10 = 1 THEN 'Letters' WHEN doc_id % 5 = 0 THEN 'arXiv.org' WHEN doc_id % 5 = 1 THEN 'A Journal' END AS venue FROM documents WHERE doc_id % 8 <> 7),
u AS (SELECT *, CASE WHEN k % 5 = 2 THEN 'https://graph.example/' || k WHEN doi IS NOT NULL THEN 'https://doi.org/' || doi WHEN k % 6 = 1 THEN 'https://files.example/' || k END AS url FROM d)
SELECT k AS pos, 'works_b' AS source_id, CASE WHEN coalesce(venue = 'arXiv.org', false) OR coalesce(doi LIKE '10.48550/%', false) THEN 'preprint' WHEN k % 7 = 0 OR venue IS NOT NULL THEN 'peer_reviewed' ELSE 'web' END AS tier, md5(title) AS title, url,
  CASE WHEN k % 6 = 1 THEN 'https://files.example/' || k END AS pdf_url, doi, source AS authors, venue AS publisher, CASE WHEN k % 2 = 0 THEN '2020-05-06' ELSE (1990 + k % 30)::VARCHAR END AS published, k % 300 AS cited_by_count
FROM u WHERE url IS NOT NULL AND title <> ''""",
}
