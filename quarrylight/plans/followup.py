"""Registered queries of later rounds: counter queries, newcomers that meet known records, what was answered, picked and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import queries as P
from quarrylight.operators import biblio, dedupe, ledger, ranking, retrieval, segment
from quarrylight.plans.common import claims, table
from quarrylight.plans.evidence import _BM25, _S, _counter_asked, _pages, counted
from quarrylight.plans.records import _CANON, SQL as RECORDS

#: Words that a page of a later place must mention to be kept.
PAGE_TERMS = ["of", "the", "para", "und"]


def counter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's five best chunks by the words of its plan, the query against it included."""
    best = counted(spark, sf_dir).best_chunks(_counter_asked(spark, sf_dir), 5)
    return best.select("claim_id", "doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.round("score", 4).alias("score"), "rank")


def matched_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an odd number as newcomers: the known page that each one's most trusted key hits."""
    nothing = F.lit(None).cast("string")
    title = F.regexp_extract("html", r"(?is)<title>([^<]*)", 1)
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), nothing.alias("doi"), "url", nothing.alias("pdf_url"), title.alias("title"))
    return dedupe.matching(p.where("pos % 2 = 0"), p.where("pos % 2 = 1")).select(F.col("pos").alias("page_id"), F.col("old").alias("known"))


def unanswered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that no document states word for word."""
    c = claims(spark, sf_dir)
    found = retrieval.verbatim_pairs(c, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ranking.empty_claims(c, found).select("claim_id")


def kept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents as pages the first, and later ones up to the fifth that mention a key term."""
    kept = segment.keep_pages(_pages(spark, sf_dir), F.array(*map(F.lit, PAGE_TERMS)), first=1, scanned=5)
    return kept.select("doc_id", F.col("page_no").cast("long").alias("page"), F.md5("text").alias("text"))


def filtered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one role as a history, searched for a word."""
    h = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("mode"), F.col("text").alias("claim"))
    return ledger.filter_history(h, "user", "  The ").select("conv_id", "turn")


def picked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's picks among each claim's documents, the latest first and some unknown, in the order of picking."""
    c = claims(spark, sf_dir)
    found = retrieval.verbatim_pairs(c, table(spark, sf_dir, "documents").select("doc_id", "text")).select("claim_id", F.col("doc_id").alias("candidate_id"), F.lit(0).alias("rank"))
    ids = F.array_sort(F.collect_list("candidate_id"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    picks = found.groupBy("claim_id").agg(ids.alias("ids")).select("claim_id", F.concat(F.array(F.lit(-1).cast("long")), "ids").alias("picked"))
    return biblio.picked_results(picks, found).select("claim_id", F.col("candidate_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


def answered_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans whose lines are answers: the last of a kind counts, blank ones and "keep as is" change nothing."""
    k = F.col("o_orderkey")
    plans = table(spark, sf_dir, "orders").select(
        k.alias("claim_id"), F.lit("c").alias("claim"), F.lit(1900).alias("year_from"), F.lit(None).cast("int").alias("year_to"), F.array(F.lit("Asia")).alias("regions"), F.lit("support").alias("side"), F.lit("any").alias("strength")
    )
    n = F.col("l_linenumber")
    kinds = F.element_at(F.array(*map(F.lit, ("years", "regions", "side", "strength", "which_claim"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, ("from 1999 to 2012", "Chile; Peru and Spain", "Keep as is", "  ", "against it"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), ((n * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("pos"), kinds.alias("affects"), said.alias("answer"))
    out = ledger.apply_answers(plans, answers)
    return out.select("claim_id", "claim", "year_from", "year_to", F.array_join("regions", "|").alias("regions"), "side", "strength")


def cited_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page spans of orders' lines as citations shorten them."""
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 500).cast("int")).alias("pages"))
    span = biblio.page_span(F.col("pages"))
    return pages.select("l_orderkey", span["first"].cast("long").alias("first"), span["last"].cast("long").alias("last"), biblio.page_range(span["first"], span["last"]).alias("pages"))


def tidied_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans as a model might give them: years the wrong way round, a single claim listed, English named."""
    k = F.col("o_orderkey")
    plans = table(spark, sf_dir, "orders").select(
        k, F.when(k % 3 != 0, (1990 + k % 40).cast("int")).alias("year_from"), F.when(k % 5 != 0, (1990 + k % 23).cast("int")).alias("year_to"),
        F.when(k % 4 == 0, F.array("o_orderpriority")).when(k % 4 == 1, F.array("o_orderpriority", "o_orderstatus")).alias("multiple_claims"),
        F.when(k % 6 == 0, "English").when(k % 6 == 1, "en").when(k % 6 == 2, "de").alias("input_language"),
    )
    return P.tidy_plan(plans).select("o_orderkey", "year_from", "year_to", F.array_join("multiple_claims", "|").alias("claims"), "input_language")


QUERIES = {f.__name__: f for f in (counter_scores, matched_candidates, unanswered_claims, kept_pages, filtered_turns, picked_passages, answered_plans, cited_spans, tidied_plans)}

_PLANS = RECORDS["fallback_plans"].rsplit("SELECT claim_id, md5(c)", 1)[0].removeprefix("WITH ").rstrip()
_FOUND = r"""c AS (SELECT item_id AS claim_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS claim FROM benchmark),
d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM documents),
f AS (SELECT claim_id, doc_id FROM c JOIN d ON contains(body, claim) WHERE claim <> '')"""
SQL = {
    "counter_scores": f"""WITH {_S}, {_PLANS.replace("c AS (SELECT item_id", "pc AS (SELECT item_id").replace("FROM c)", "FROM pc)").replace("w AS (SELECT", "pw AS (SELECT").replace("FROM w)", "FROM pw)")},
pj AS (SELECT *, CASE WHEN len(k) > 0 THEN array_to_string(list_slice(k, 1, 6), ' ') ELSE c END AS words FROM k),
pt AS (SELECT claim_id, unnest(list_concat(list_concat(k, k), [c, c, c, c, 'evidence against: ' || words, 'evidence against: ' || words])) AS text FROM pj),
{_BM25.replace('FROM benchmark)', 'FROM pt)').replace('SELECT item_id AS claim_id, ', 'SELECT claim_id, ').replace('least(2 * count(*), 3)', 'least(count(*), 3)')},
rk AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id, chunk_idx)::INT AS rank FROM sc)
SELECT claim_id, doc_id, chunk_idx::BIGINT AS chunk_idx, round(score, 4) AS score, rank FROM rk WHERE rank <= 5""",
    "matched_candidates": rf"""WITH {_CANON},
t AS (SELECT page_id, trim(regexp_replace(regexp_replace(strip_accents(lower(regexp_extract(html, '(?is)<title>([^<]*)', 1))), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages),
ks AS (SELECT page_id, 'url:' || canonical AS key, 0 AS trust FROM g WHERE canonical <> '' UNION SELECT page_id, 'title:' || t, 1 FROM t WHERE len(string_split(t, ' ')) >= 4),
m AS (SELECT n.page_id, n.trust, o.page_id AS known FROM ks n JOIN ks o USING (key) WHERE n.page_id % 2 = 1 AND o.page_id % 2 = 0)
SELECT page_id, arg_min(known, (trust, known)) AS known FROM m GROUP BY 1""",
    "unanswered_claims": f"WITH {_FOUND} SELECT claim_id FROM c WHERE claim_id NOT IN (SELECT claim_id FROM f)",
    "kept_pages": """WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l0),
p AS (SELECT doc_id, i // 10 + 1 AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM l GROUP BY 1, 2)
SELECT doc_id, page, md5(text) AS text FROM p WHERE page = 1 OR page <= 5 AND (contains(lower(text), 'the') OR contains(lower(text), 'para') OR contains(lower(text), 'und'))""",
    "filtered_turns": "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'the')",
    "picked_passages": f"WITH {_FOUND} SELECT claim_id, doc_id, row_number() OVER (PARTITION BY claim_id ORDER BY doc_id DESC) + 1 AS rank FROM f",
    "answered_plans": """WITH a AS (SELECT l_orderkey AS k, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS pos, ['years', 'regions', 'side', 'strength', 'which_claim'][l_partkey % 5 + 1] AS kind, l_suppkey % 5 AS s FROM lineitem),
l AS (SELECT k, kind, arg_max(s, pos) AS s FROM a WHERE s IN (0, 1, 4) GROUP BY 1, 2),
w AS (SELECT o_orderkey AS k, max(s) FILTER (kind = 'years') AS years, max(s) FILTER (kind = 'regions') AS regions, max(s) FILTER (kind = 'side') AS side, max(s) FILTER (kind = 'strength') AS strength, max(s) FILTER (kind = 'which_claim') AS claim
  FROM orders LEFT JOIN l ON l.k = o_orderkey GROUP BY 1),
t(s, said, parts) AS (VALUES (0, 'from 1999 to 2012', 'from 1999 to 2012'), (1, 'Chile; Peru and Spain', 'Chile|Peru|Spain'), (4, 'against it', 'against it'))
SELECT k AS claim_id, coalesce(c.said, 'c') AS claim, CASE WHEN years = 0 THEN 1999 ELSE 1900 END::INT AS year_from, CASE WHEN years = 0 THEN 2012 END::INT AS year_to, coalesce(r.parts, 'Asia') AS regions,
  CASE WHEN side = 4 THEN 'attack' ELSE 'support' END AS side, coalesce(lower(g.said), 'any') AS strength
FROM w LEFT JOIN t c ON c.s = w.claim LEFT JOIN t r ON r.s = w.regions LEFT JOIN t g ON g.s = w.strength""",
    "cited_spans": """WITH p AS (SELECT l_orderkey, min(l_partkey % 500) FILTER (l_partkey % 500 > 0) AS a, max(l_partkey % 500) FILTER (l_partkey % 500 > 0) AS z FROM lineitem GROUP BY 1)
SELECT l_orderkey, a AS first, CASE WHEN z > a THEN z END AS last, CASE WHEN z = a THEN a::VARCHAR WHEN a >= 100 AND a // 100 = z // 100 THEN a || '-' || lpad((z % 100)::VARCHAR, 2, '0') ELSE a || '-' || z END AS pages FROM p""",
    "tidied_plans": """WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN 1990 + o_orderkey % 40 END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN 1990 + o_orderkey % 23 END AS b FROM orders)
SELECT o_orderkey, (CASE WHEN a > b THEN b ELSE a END)::INT AS year_from, (CASE WHEN a > b THEN a ELSE b END)::INT AS year_to, CASE WHEN o_orderkey % 4 = 1 THEN o_orderpriority || '|' || o_orderstatus END AS claims,
  CASE WHEN o_orderkey % 6 = 2 THEN 'de' END AS input_language FROM o""",
}
