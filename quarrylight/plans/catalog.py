"""Registered queries over records: identifiers, dates, tiers, ranking, merging, guards, coverage and intake, each with its SQL twin."""

from __future__ import annotations

import re
from html import _invalid_charrefs, _invalid_codepoints
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import dates as D
from quarrylight.functions import queries as P
from quarrylight.functions import text as T
from quarrylight.functions import urls as U
from quarrylight.operators import dedupe, filters, intake, ledger, ranking, retrieval, segment, tiers, verification
from quarrylight.plans.common import claims, table
from quarrylight.plans.evidence import _list, content
from quarrylight.plans.records import SQL as RECORDS
from quarrylight.sources import pages as pages_source

#: Ways in which identifiers are written, and tails that stick to them in running text.
DOI_HEADS, DOI_TAILS = ["https://doi.org/10.", "doi: 10.", " 10.", "http://dx.doi.org/10.", "HTTPS://DOI.ORG/10."], [".", "),", "]", ""]
HOSTS = sorted({d for names in tiers.DOMAINS.values() for d in names}) + ["en.wikipedia.org", "data.gov.uk", "moh.gov.sg", "unknown.example", "doi.org/10.1101", "doi.org/10.1000"]
RELATIONS = ["direct", "paraphrase", "partial", "contradicts"]
TIERS = list(tiers.TIER_WEIGHT)


def _pick(values: list, key: Column) -> Column:
    """The value that a non-negative number points to, round and round."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def doi_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers made of part keys, as people write them, and what they are brought to."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, F.concat(_pick(DOI_HEADS, k), (1000 + k % 9000).cast("string"), F.lit("/ABC("), k.cast("string"), F.lit(")"), _pick(DOI_TAILS, k)).alias("raw"))
    page = F.concat(F.lit("https://pub.example/doi/full/10.1234/x."), k.cast("string"), F.when(k % 2 == 0, "/abstract").otherwise(""))
    return p.select(k, U.normalize_doi(F.col("raw")).alias("normal"), U.clean_doi(F.col("raw")).alias("clean"), U.find_doi(F.concat(F.lit("see "), F.col("raw"), F.lit(" for more"))).alias("found"), U.doi_from_url(page).alias("of_page"))


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates cut to years, months and days, in three styles; bounds of years put in order."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    d, bounds = D.parse_date(F.col("d")), D.year_bounds((k % 2500).cast("int"), ((k * 7) % 2500).cast("int"))
    return o.select(k, D.year_of(F.concat(F.lit("c. "), F.col("d"))).alias("year"), D.apa_date(d).alias("apa"), D.mla_date(d).alias("mla"), D.long_date(d).alias("long"), bounds["from"].alias("low"), bounds["to"].alias("high"))


def source_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier, name and flags of addresses under known and unknown domains, one for each supplier."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k, F.concat(F.lit("https://"), F.when(k % 3 == 0, "").when(k % 3 == 1, "www.").otherwise("sub."), _pick(HOSTS, k), F.lit("/a/"), k.cast("string")).alias("url"))
    return tiers.tiers(s, tiers.domain_table(spark)).select("s_suppkey", "tier", "publisher_name", "low_quality", "is_wikipedia")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as a labeller might give them: one a document, for the claim of its source, from one of a few sources."""
    d, k = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), F.col("doc_id")
    return d.select(
        F.col("source").alias("claim_id"), F.concat(F.lit("c"), (k % 23).cast("string")).alias("candidate_id"), k.alias("pos"), k, F.lit(0).alias("chunk_idx"), _pick(RELATIONS, k).alias("relation"),
        (F.lit(1.0) - (k % 10) / F.lit(20.0)).alias("confidence"), _pick(TIERS, k).alias("tier"), F.concat((1990 + k % 35).cast("string"), F.lit("-05")).alias("published"),
        F.when(k % 2 == 0, F.array((k % 7).cast("int"))).otherwise(F.array((k % 7).cast("int"), (k % 7 + 1).cast("int"))).alias("sentence_idx"), F.col("text").alias("passage"),
        F.when(k % 5 == 0, "abstract_only").otherwise("page").alias("text_source"), (k % 11 == 0).alias("low_quality"), F.when(k % 13 == 0, "other place").alias("scope_mismatch"), F.lit(None).cast("string").alias("scope_note"), "lang",
    )


def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the matches in the three modes."""
    m = _judged(spark, sf_dir)
    for mode in ("web", "paper", "debate"):
        m = ranking.match_score(m, mode, 2025).withColumnRenamed("score", f"score_{mode}")
    return m.select("doc_id", "score_web", "score_paper", "score_debate")


def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per claim the best results on both sides, with the other passages of each."""
    # All of a candidate's passages are taken to be of one document, so that sentences can be shared.
    scored = ranking.match_score(_judged(spark, sf_dir), "paper", 2025).withColumn("doc_id", F.col("pos") % 23)
    out = ranking.rank_results(scored.select("claim_id", "candidate_id", "pos", "relation", "score", "sentence_idx", "doc_id", "chunk_idx", "passage"), side="attack")
    return out.select("claim_id", "candidate_id", "side", "score", F.col("best.pos").alias("best"), F.size("more").cast("long").alias("more"), F.col("rank").cast("long").alias("rank"))


def pre_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates for one claim each: overlap with the claim's words, scores and the 15 best."""
    k = F.col("doc_id")
    c = claims(spark, sf_dir).select("claim_id", F.slice(F.array_distinct(T.content_tokens(F.col("text"))), 1, 5).alias("key_terms"), F.col("text").alias("paraphrase"), F.lit("").alias("counter_query"), F.when(F.col("claim_id") % 2 == 0, 2000).alias("year_from"), F.lit(None).cast("int").alias("year_to"))
    d = table(spark, sf_dir, "documents").select(
        (k % 40).alias("claim_id"), k.alias("pos"), F.col("text").alias("title"), F.lit(None).cast("string").alias("snippet"), _pick(TIERS, k).alias("tier"), F.when(k % 3 == 0, (k % 50) / F.lit(50.0)).alias("search_score"), (k % 12).cast("int").alias("search_rank"),
        (1990 + k % 35).cast("string").alias("published"), (k % 300).alias("cited_by_count"), (k % 11 == 0).alias("low_quality"), (k % 17 == 0).alias("is_wikipedia"), F.lit(False).alias("for_counter"),
    )
    ranked = ranking.pre_rank(d, c)
    return ranking.select_to_read(ranked).select("claim_id", F.col("pos").alias("doc_id"), F.round("overlap", 6).alias("overlap"), F.round("score", 4).alias("score"))


def guarded_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the summary of the next one: sentences with numbers that the source lacks go."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = verification.guard_numbers(d.select(F.lit(1).alias("claim_id"), "doc_id", F.col("text").alias("summary")), d.select((F.col("doc_id") - 1).alias("doc_id"), "text"))
    return s.select("doc_id", F.md5("summary").alias("summary"), F.col("dropped").cast("long").alias("dropped"))


def drifted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages found word for word, checked again on a snapshot in which odd documents have changed."""
    c, d = claims(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = retrieval.verbatim_pairs(c, d).join(c, "claim_id")
    matches = pairs.select("claim_id", "doc_id", F.lit(0).alias("chunk_idx"), F.array(F.struct("text")).alias("fragments"))
    newer = d.select("doc_id", F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("th"), F.lit("ht"))).otherwise(F.col("text")).alias("text"))
    return verification.reverify(matches, newer).select("claim_id", "doc_id", "still_there")


def coverage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per claim what its results cover, and what they lack."""
    results = _judged(spark, sf_dir).withColumn("region", F.col("lang"))
    profile = ledger.coverage(results)
    found = ledger.gaps(profile.withColumn("several_claims", F.col("n") % 2 == 0), 2025)
    counts = [F.col(x).cast("long").alias(x) for x in ("n", "regions", "first_year", "last_year", "abstracts", "contradicting", "academic", "scope_notes")]
    return profile.join(found, "claim_id").select("claim_id", *counts, F.array_join("gaps", ",").alias("gaps"))


def distinct_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as warnings: how many different messages each kind has."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.date_format("ts", "yyyy-MM-dd HH").alias("message"), "event_id")
    return ledger.distinct_warnings(e).groupBy("code").agg(F.count("*").alias("n"))


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("round"), "source")
    return ledger.source_counts(rows)


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each user in long form."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("types"))
    return ledger.long_metrics(e, ["user_id"])


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs: time to the first purchase, and in all."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.when(F.col("event_type") == "purchase", "result").otherwise("other").alias("stage"), "ts")
    return ledger.stage_times(e)


def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as candidates, those of one work merged into one record."""
    nothing, k = F.lit(None).cast("string"), F.col("page_id")
    title = F.regexp_extract("html", r"(?is)<title>([^<]*)", 1)
    values = {
        "source_id": F.concat(F.lit("s"), (k % 3).cast("string")), "source_ids": F.lit(None).cast("array<string>"), "tier": _pick(TIERS, k), "title": title, "url": F.col("url"), "pdf_url": nothing, "doi": nothing,
        "authors": F.expr("cast(array() as array<string>)"), "publisher": F.when(k % 2 == 0, "P"), "published": F.when(k % 4 == 0, "2020").when(k % 4 == 1, "2020-05").otherwise(nothing), "snippet": title, "text": nothing,
        "cited_by_count": F.when(k % 5 == 0, k), "search_score": F.lit(None).cast("double"), "search_rank": (k % 9).cast("int"), "for_counter": k % 2 == 0, "low_quality": F.lit(False), "is_wikipedia": F.lit(False), "round": (k % 4).cast("int"),
    }
    rows = table(spark, sf_dir, "pages").select(k.alias("pos"), *(v.alias(n) for n, v in values.items()))
    m = dedupe.dedupe(rows)
    return m.select("pos", "url", "title", "tier", F.array_join(F.array_sort("source_ids"), ",").alias("sources"), "cited_by_count", F.col("search_rank").cast("long").alias("search_rank"), "for_counter", F.col("round").cast("long").alias("round"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of pages by native expressions, with their titles."""
    p = pages_source.read_pages(table(spark, sf_dir, "pages"))
    return p.select("page_id", F.md5("text").alias("text"), F.length("text").cast("long").alias("n"), "title", "byline")


def detected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that texts name: part names and regions put into sentences."""
    k, names = F.col("p_partkey"), ["German", "the United  States", "Swiss and Dutch", "nothing", "Mexico, Peru and Chile or Spain", "Indiana", "thai"]
    p = table(spark, sf_dir, "part").select(k, F.concat(F.col("p_name"), F.lit(" of "), _pick(names, k), F.lit(" made")).alias("t"))
    return p.select("p_partkey", F.array_join(intake.detect(F.col("t")), ",").alias("regions"))


def summary_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summariser gets of each claim's best results."""
    m = _judged(spark, sf_dir)
    order = Window.partitionBy("claim_id").orderBy(F.desc("confidence"), "doc_id")
    results = m.select("claim_id", F.row_number().over(order).alias("rank"), "doc_id", F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.col("tier").alias("publisher"), "published", "text_source", F.array("relation", "candidate_id", "tier").alias("passages"))
    r = intake.summary_requests(results, table(spark, sf_dir, "documents"))
    return r.select("claim_id", F.col("rank").cast("long").alias("rank"), "doc_id", "title", "publisher_year", "abstract_only", F.md5("opening").alias("opening"), F.array_join("passages", "|").alias("passages"))


def filled_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates without title, authors or date, filled from their nations' documents."""
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("candidate_id"), k, F.when(k % 3 == 0, F.col("s_name")).otherwise("").alias("title"), F.col("s_name").alias("url"), F.when(k % 4 == 0, F.array("s_name")).otherwise(F.expr("cast(array() as array<string>)")).alias("authors"), F.when(k % 5 == 0, "2001").alias("published"))
    n = F.col("n_nationkey")
    d = table(spark, sf_dir, "nation").select(n.alias("candidate_id"), F.when(n % 2 == 0, F.col("n_name")).alias("doc_title"), F.when(n % 3 == 0, F.concat(F.lit("By "), F.col("n_name"), F.lit(" and Ann B"))).when(n % 3 == 1, F.concat(F.lit("C; "), F.col("n_name"))).alias("byline"), F.lit("1999").alias("doc_published"))
    return intake.fill_metadata(c, d).select("s_suppkey", "title", F.array_join("authors", "|").alias("authors"), "published")


def routed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as claims: how many go to each source, by what the claim and the source are like."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    c = table(spark, sf_dir, "customer").select(k.alias("claim_id"), (k % 3 == 0).alias("technical"))
    s = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), (n % 2 == 0).alias("enabled"), (n % 4 == 0).alias("needs_key"), (n % 8 == 0).alias("has_key"), (n % 3 == 0).alias("technical_only"))
    skipped = c.where("claim_id % 5 = 0").select("claim_id", F.lit("NATION_2").alias("source"))
    return intake.eligible_sources(c, s, skipped).groupBy("source").agg(F.count("*").alias("claims"))


def flagged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    plans = table(spark, sf_dir, "customer").select(k.alias("claim_id"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "normative").when(k % 2 == 0, "causal").alias("claim_type"), F.when(k % 3 == 0, F.array("c_name", "c_mktsegment")).when(k % 3 == 1, F.array("c_name")).alias("multiple_claims"))
    return intake.claim_flags(plans)


def region_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the region names that they lack, as keywords and as a sentence; term queries, strict and loose."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, F.concat(F.lit(" Wages  in "), F.col("c_mktsegment"), F.lit(" rise.")).alias("q"), P.regions_of(F.array(F.lit(" Asia"), F.col("c_mktsegment"), F.lit("asia"), F.when(k % 2 == 0, "EU").otherwise(""))).alias("r"))
    terms = F.array("c_name", F.lit("a"), F.lit(" b "), F.lit("a"), F.lit(""), F.lit("c"), F.lit("d"), F.lit("e"))
    c = c.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return c.select("c_custkey", P.with_region_keywords(F.col("q"), F.col("r")).alias("keywords"), P.with_region_sentence(F.col("q"), F.col("r")).alias("sentence"), F.array_join(P.term_query(terms, True), " ").alias("strict"), F.array_join(P.term_query(terms, False), " ").alias("loose"))


def page_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order line in force at a price: as-of lookup of offsets among an order's running starts."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_linenumber") * 1000).cast("long").alias("start")).distinct()
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") * 5 % 9000).cast("long").alias("offset"))
    return segment.page_for(o, l).select("doc_id", "offset", F.col("page").cast("long").alias("page"))


def best_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best text of each source among documents that serve as files, pages, supplied texts and snippets."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select((k / 5).cast("long").alias("candidate_id"), _pick(["pdf", "supplied", "page", "snippet", "page"], k).alias("kind"), "text", F.when(k % 4 == 0, "paywall").alias("problem"))
    # Of two texts of one kind and size either may serve; what is returned is the same for both.
    b = filters.best_texts(d)
    return b.select("candidate_id", "text_source", F.length("text").cast("long").alias("n"), "reasons")


def unread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were neither labelled nor are toxic copies of what was read, by source."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    left = ledger.exclude(d, l.where("quality = 1"), l.where("toxic = 1"), on=["doc_id"])
    return left.groupBy("source").agg(F.count("*").alias("n"))


def pooled_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of two rounds: of those with the same chunk and sentences the earlier stays."""
    m = _judged(spark, sf_dir).select("claim_id", (F.col("pos") % 50).alias("doc_id"), "chunk_idx", "sentence_idx", (F.col("pos") % 4).cast("int").alias("round"))
    pool = verification.upsert_pool(m.where("round < 2"), m.where("round >= 2"))
    return pool.groupBy("claim_id", "round").agg(F.count("*").alias("n"))


def scope_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, F.date_format("o_orderdate", "yyyy-MM").alias("d"), F.when(k % 2 == 0, 1996).alias("low"), F.when(k % 3 == 0, 1998).alias("high"))
    year = D.year_of(F.col("d"))
    return o.select(k, ranking.scope_note(F.col("d"), F.col("low"), F.col("high")).alias("note"), D.within(year, F.col("low"), F.col("high")).alias("inside"))


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sources: label, and links that scroll to a passage or open a page."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k, "o_orderpriority", F.when(k % 2 == 0, F.col("o_orderstatus")).alias("who"), F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    words = F.array_join(F.transform(F.sequence(F.lit(1), (k % 12 + 1).cast("int")), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    return o.select(k, T.source_label(F.col("o_orderpriority"), F.col("who"), F.col("d")).alias("label"), U.text_fragment_url(F.lit("https://e.com/a#b"), words).alias("link"), U.pdf_page_url(F.lit("https://e.com/a.pdf#x"), F.when(k % 2 == 0, k)).alias("page"))


QUERIES = {
    f.__name__: f
    for f in (doi_forms, date_forms, source_tiers, match_scores, ranked_results, pre_ranked, guarded_summaries, drifted_passages, coverage_profile, distinct_warnings, source_counts, metric_rows, stage_times, merged_pages, page_texts)
    + (detected_regions, summary_requests, filled_metadata, routed_sources, flagged_claims, region_queries, page_of_offset, best_texts, unread_documents, pooled_matches, scope_notes, source_labels)
}


def _case(values: list[str], key: str) -> str:
    return f"{_list(values)}[{key} % {len(values)} + 1]"


def _tail(source: str, name: str, rounds: int = 3) -> str:
    """Common tables that take what sticks to the end of an identifier (column d) off, step by step."""
    out, last = [], source
    for i in range(rounds):
        out += [
            f"{name}{i}a AS (SELECT * REPLACE (regexp_replace(d, '[.,;:''\">}}]+$', '') AS d) FROM {last})",
            f"{name}{i}b AS (SELECT * REPLACE (CASE WHEN ends_with(d, ')') AND len(replace(d, '(', '')) > len(replace(d, ')', '')) THEN left(d, len(d) - 1) ELSE d END AS d) FROM {name}{i}a)",
            f"{name}{i}c AS (SELECT * REPLACE (CASE WHEN ends_with(d, ']') AND len(replace(d, '[', '')) > len(replace(d, ']', '')) THEN left(d, len(d) - 1) ELSE d END AS d) FROM {name}{i}b)",
        ]
        last = f"{name}{i}c"
    return ",\n".join(out)


def _bare(x: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace(trim({x}), '^(?i)https?://(dx\.)?doi\.org/', ''), '^(?i)doi:\s*', '')))"


def _cleaned(x: str) -> str:
    return f"regexp_replace({x}, '/(full|abstract|pdf|epdf|html)$', '')"


_DOMAINS = ", ".join(f"('{d}', '{kind}', '{name.replace(chr(39), chr(39) * 2)}')" for kind, names in tiers.DOMAINS.items() for d, name in names.items())
_RANKS = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(tiers.ORDER))
_WEIGHT = "CASE tier " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in tiers.TIER_WEIGHT.items()) + " END"
_MATCHES = f"""m AS (SELECT source AS claim_id, 'c' || (doc_id % 23) AS candidate_id, doc_id, doc_id AS pos, {_case(RELATIONS, "doc_id")} AS relation, 1.0::DOUBLE - (doc_id % 10) / 20.0::DOUBLE AS confidence,
  {_case(TIERS, "doc_id")} AS tier, 1990 + doc_id % 35 AS year, CASE WHEN doc_id % 2 = 0 THEN [doc_id % 7] ELSE [doc_id % 7, doc_id % 7 + 1] END AS sentence_idx, text AS passage, doc_id % 5 = 0 AS abstract, doc_id % 11 = 0 AS low_quality, doc_id % 13 = 0 AS scope, lang FROM documents)"""
_BASE = f"CASE relation WHEN 'paraphrase' THEN 0.85::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * confidence * {_WEIGHT}"
_LESS = "- CASE WHEN scope THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN abstract THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN low_quality THEN 0.5::DOUBLE ELSE 0 END"
_WORDS = r"len(string_split_regex(trim(passage, ' ' || chr(9) || chr(10) || chr(13)), '\s+'))"




def _numbers(x: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({x}, '(?:^|[^\w.])([0-9]+(?:[.,][0-9]+)*)', 1), lambda n: regexp_replace(regexp_replace(regexp_replace(n, ',([0-9]{{3}})\b', '\1', 'g'), '(\.[0-9]*?)0+$', '\1'), '\.$', '')))"


_MONTHS, _SHORT = _list(D.MONTHS), _list(D.SHORT_MONTHS)
SQL = {
    "doi_forms": rf"""WITH p AS (SELECT p_partkey, {_case(DOI_HEADS, "p_partkey")} || (1000 + p_partkey % 9000) || '/ABC(' || p_partkey || ')' || {_case(DOI_TAILS, "p_partkey")} AS raw FROM part),
n AS (SELECT p_partkey, {_bare("raw")} AS d FROM p), {_tail("n", "n")},
f AS (SELECT p_partkey, {_bare("regexp_extract('see ' || raw || ' for more', '(?i)' || chr(92) || 'b(10[.][0-9]{4,9}/[^[:space:]\"''<>{}[' || chr(92) || ']|' || chr(92) || chr(92) || '^`]+)', 1)")} AS d FROM p), {_tail("f", "f")},
q AS (SELECT p_partkey, {_bare("'10.1234/x.' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/abstract' ELSE '' END")} AS d FROM p), {_tail("q", "q")}
SELECT p_partkey, n2c.d AS normal, CASE WHEN regexp_matches({_cleaned("n2c.d")}, '^10\.[0-9]{{4,9}}/\S+$') THEN {_cleaned("n2c.d")} END AS clean,
  CASE WHEN f2c.d <> '' THEN {_cleaned("f2c.d")} END AS found, {_cleaned("q2c.d")} AS of_page FROM n2c JOIN f2c USING (p_partkey) JOIN q2c USING (p_partkey)""",
    "date_forms": f"""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN o_orderkey % 3 > 0 THEN month(o_orderdate) END AS m, CASE WHEN o_orderkey % 3 = 2 THEN day(o_orderdate) END AS d,
  CASE WHEN o_orderkey % 2500 BETWEEN 1500 AND 2200 THEN o_orderkey % 2500 END AS a, CASE WHEN o_orderkey * 7 % 2500 BETWEEN 1500 AND 2200 THEN o_orderkey * 7 % 2500 END AS b FROM orders)
SELECT o_orderkey, y::INT AS year, CASE WHEN d IS NOT NULL THEN y || ', ' || {_MONTHS}[m] || ' ' || d WHEN m IS NOT NULL THEN y || ', ' || {_MONTHS}[m] ELSE y::VARCHAR END AS apa,
  CASE WHEN d IS NOT NULL THEN d || ' ' || {_SHORT}[m] || ' ' || y WHEN m IS NOT NULL THEN {_SHORT}[m] || ' ' || y ELSE y::VARCHAR END AS mla,
  CASE WHEN d IS NOT NULL THEN {_MONTHS}[m] || ' ' || d || ', ' || y WHEN m IS NOT NULL THEN {_MONTHS}[m] || ' ' || y ELSE y::VARCHAR END AS long,
  (CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) ELSE a END)::INT AS low, (CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) ELSE b END)::INT AS high FROM o""",
    "source_tiers": rf"""WITH dom(domain, kind, name) AS (VALUES {_DOMAINS}),
u AS (SELECT s_suppkey, (CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'www.' ELSE 'sub.' END) || {_case(HOSTS, "s_suppkey")} AS place FROM supplier),
h AS (SELECT s_suppkey, regexp_replace(split_part(place, '/', 1), '^www[0-9]?\.', '') AS host, split_part(place, '/', 2) AS prefix FROM u),
j AS (SELECT s_suppkey, kind, name, row_number() OVER (PARTITION BY s_suppkey ORDER BY CASE kind {_RANKS} END, -length(domain)) AS n FROM h JOIN dom ON host = domain OR ends_with(host, '.' || domain)),
x AS (SELECT h.*, j.kind, j.name, host = 'wikipedia.org' OR ends_with(host, '.wikipedia.org') AS wiki FROM h LEFT JOIN j ON j.s_suppkey = h.s_suppkey AND n = 1),
t AS (SELECT *, CASE WHEN wiki OR kind = 'low_quality' THEN 'web' WHEN host IN ('doi.org', 'dx.doi.org') THEN CASE WHEN list_contains({_list(list(tiers.PREPRINT_DOIS))}, prefix) THEN 'preprint' ELSE 'peer_reviewed' END
  WHEN kind IN ('peer_reviewed', 'preprint', 'gov_igo') THEN kind WHEN regexp_matches(host, '{tiers.GOVERNMENT}') THEN 'gov_igo' ELSE coalesce(kind, 'web') END AS tier FROM x)
SELECT s_suppkey, tier, CASE WHEN wiki THEN 'Wikipedia' WHEN tier = kind AND name <> '' THEN name END AS publisher_name, coalesce(kind = 'low_quality', false) AND NOT wiki AS low_quality, wiki AS is_wikipedia FROM t""",
    "match_scores": f"""WITH {_MATCHES} SELECT doc_id, round({_BASE} {_LESS}, 3) AS score_web, round({_BASE} * CASE WHEN tier IN ('peer_reviewed', 'gov_igo') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END {_LESS}, 3) AS score_paper,
  round({_BASE} * (CASE WHEN 2025 - year <= 5 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN len(sentence_idx) = 1 AND relation <> 'partial' AND {_WORDS} BETWEEN 8 AND 45 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) {_LESS}, 3) AS score_debate FROM m""",
    "ranked_results": f"""WITH {_MATCHES}, s AS (SELECT *, round({_BASE} * CASE WHEN tier IN ('peer_reviewed', 'gov_igo') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END {_LESS}, 3) AS score FROM m),
l AS (SELECT claim_id, candidate_id, min(pos) AS first_pos, list({{'pos': pos, 'score': score, 'contra': relation = 'contradicts', 's': sentence_idx}} ORDER BY score DESC, pos) AS every FROM s GROUP BY ALL),
d AS (SELECT claim_id, candidate_id, first_pos, list_reduce(list_transform(every, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda t: list_has_any(t.s, x[1].s))) > 0 THEN a ELSE list_concat(a, x) END) AS d FROM l),
o AS (SELECT *, list_filter(d, lambda x: x.contra)[1] AS ons, list_filter(d, lambda x: NOT x.contra)[1] AS offs FROM d),
b AS (SELECT *, CASE WHEN ons IS NOT NULL AND (offs IS NULL OR ons.score >= offs.score * 0.8::DOUBLE) THEN ons ELSE d[1] END AS best FROM o),
r AS (SELECT *, CASE WHEN best.contra THEN 'pushback' ELSE 'support' END AS side, row_number() OVER (PARTITION BY claim_id, best.contra ORDER BY best.score DESC, first_pos, candidate_id) AS rank FROM b)
SELECT claim_id, candidate_id, side, best.score AS score, best.pos AS best, len(list_filter(d, lambda x: x.pos <> best.pos AND x.contra = best.contra))::BIGINT AS more, rank FROM r WHERE rank <= CASE side WHEN 'support' THEN 7 ELSE 3 END""",
    "pre_ranked": f"""WITH c AS (SELECT item_id AS claim_id, {content("text")} AS t FROM benchmark), k AS (SELECT claim_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS para FROM c),
p AS (SELECT claim_id, para, list_filter(list_transform(para[1:5], lambda v: {content("v")}), lambda t: len(t) > 0) AS terms FROM k),
d AS (SELECT doc_id, doc_id % 40 AS claim_id, list_distinct({content("text")}) AS w, {_case(TIERS, "doc_id")} AS tier, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 50) / 50.0::DOUBLE END AS ss FROM documents),
j AS (SELECT *, CASE WHEN len(terms) > 0 THEN least(1.0::DOUBLE, len(list_filter(terms, lambda t: list_has_all(w, t)))::DOUBLE / least(len(terms), 5)) ELSE 0 END AS ts, CASE WHEN len(para) > 0 THEN least(1.0::DOUBLE, len(list_intersect(para, w))::DOUBLE / len(para) * 2) ELSE 0 END AS ps FROM d JOIN p USING (claim_id)),
o AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE WHEN len(terms) = 0 THEN ps ELSE 0.6::DOUBLE * ts + 0.4::DOUBLE * ps END AS overlap, max(CASE WHEN ss > 0 THEN ss END) OVER (PARTITION BY claim_id) AS top FROM j),
s AS (SELECT claim_id, doc_id, overlap, round({_WEIGHT} + overlap + CASE WHEN ss IS NOT NULL AND coalesce(top, 0) > 0 THEN 0.3::DOUBLE * greatest(0, least(1, ss / top)) ELSE 0.1::DOUBLE * greatest(0, 1 - (doc_id % 12) / 10.0::DOUBLE) END
  + CASE WHEN claim_id % 2 = 0 THEN CASE WHEN 1990 + doc_id % 35 >= 2000 THEN 0.2::DOUBLE ELSE -0.3::DOUBLE END ELSE 0 END + CASE WHEN doc_id % 300 > 0 THEN 0.1::DOUBLE * log10(doc_id % 300 + 1) ELSE 0 END
  - CASE WHEN doc_id % 11 = 0 THEN 1.0::DOUBLE ELSE 0 END - CASE WHEN doc_id % 17 = 0 THEN 0.3::DOUBLE ELSE 0 END, 6) AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id) AS n FROM s) SELECT claim_id, doc_id, round(overlap, 6) AS overlap, round(score, 4) AS score FROM r WHERE n <= 15""",
    "guarded_summaries": rf"""WITH p AS (SELECT s.doc_id, list_filter(list_transform(regexp_extract_all(s.text, '[^.!?]+(?:[.!?]+[^\s.!?][^.!?]*)*[.!?]*'), lambda t: trim(t)), lambda x: x <> '') AS parts, coalesce({_numbers("n.text")}, []) AS allowed FROM documents s LEFT JOIN documents n ON n.doc_id = s.doc_id + 1),
k AS (SELECT doc_id, parts, list_filter(parts, lambda x: len(list_filter({_numbers("x")}, lambda v: NOT list_contains(allowed, v))) = 0) AS kept FROM p)
SELECT doc_id, md5(array_to_string(kept, ' ')) AS summary, (len(parts) - len(kept))::BIGINT AS dropped FROM k""",
    "drifted_passages": r"""WITH c AS (SELECT item_id AS claim_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS claim FROM benchmark),
d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body, trim(regexp_replace(CASE WHEN doc_id % 2 = 1 THEN replace(text, 'th', 'ht') ELSE text END, '\s+', ' ', 'g')) AS newer FROM documents)
SELECT claim_id, doc_id, contains(newer, claim) AS still_there FROM c JOIN d ON contains(body, claim) WHERE claim <> ''""",
    "coverage_profile": f"""WITH {_MATCHES}, c AS (SELECT claim_id, count(*) AS n, count(DISTINCT lang) AS regions, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (WHERE abstract) AS abstracts, count(*) FILTER (WHERE relation = 'contradicts') AS contradicting,
  count(*) FILTER (WHERE tier IN ('peer_reviewed', 'preprint')) AS academic, count(*) FILTER (WHERE scope) AS scope_notes FROM m GROUP BY claim_id)
SELECT *, array_to_string(list_slice(list_filter([CASE WHEN n % 2 = 0 THEN 'which_claim' END, CASE WHEN n > 1 AND regions = 1 THEN 'regions' END, CASE WHEN last_year < 2015 THEN 'years' END, CASE WHEN abstracts * 2 > n THEN 'full_text' END,
  CASE WHEN contradicting * 2 > n THEN 'side' END, CASE WHEN academic * 4 < n THEN 'strength' END], lambda x: x IS NOT NULL), 1, 3), ',') AS gaps FROM c""",
    "distinct_warnings": "SELECT event_type AS code, count(DISTINCT strftime(ts, '%Y-%m-%d %H')) AS n FROM events GROUP BY 1",
    "source_counts": "SELECT doc_id % 3 AS round, source, count(*) AS n FROM documents GROUP BY ROLLUP (doc_id % 3, source)",
    "metric_rows": """WITH e AS (SELECT user_id, count(*)::DOUBLE AS events, count(DISTINCT event_type)::DOUBLE AS types FROM events GROUP BY 1)
SELECT user_id, 'events' AS metric, events AS value FROM e UNION ALL SELECT user_id, 'types', types FROM e""",
    "stage_times": """SELECT user_id AS job, epoch_us(min(ts) FILTER (WHERE event_type = 'purchase')) // 1000 - epoch_us(min(ts)) // 1000 AS first_result_ms, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS total_ms FROM events GROUP BY 1""",
    "detected_regions": "WITH p AS (SELECT p_partkey, p_name || ' of ' || "
    + _case(["German", "the United  States", "Swiss and Dutch", "nothing", "Mexico, Peru and Chile or Spain", "Indiana", "thai"], "p_partkey")
    + " || ' made' AS t FROM part)\nSELECT p_partkey, array_to_string(list_slice(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(t, '{pattern}') THEN '{name}' END" for name, pattern in intake.region_patterns())
    + "], lambda x: x IS NOT NULL), 1, 3), ',') AS regions FROM p",
    "summary_requests": rf"""WITH {_MATCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY confidence DESC, doc_id) AS rank FROM m), b AS (SELECT *, trim(regexp_replace(passage, '\s+', ' ', 'g')) AS t FROM r WHERE rank <= 10)
SELECT claim_id, rank, doc_id, 'T' || doc_id AS title, tier || ', ' || year AS publisher_year, abstract AS abstract_only, md5(CASE WHEN length(t) > 800 THEN rtrim(left(t, 799)) || '…' ELSE t END) AS opening, relation || '|' || candidate_id AS passages FROM b""",
    "filled_metadata": """WITH n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS t, CASE n_nationkey % 3 WHEN 0 THEN n_name || '|Ann B' WHEN 1 THEN 'C|' || n_name ELSE '' END AS people FROM nation)
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE coalesce(t, s_name) END AS title, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE people END AS authors, CASE WHEN s_suppkey % 5 = 0 THEN '2001' ELSE '1999' END AS published FROM supplier JOIN n ON s_nationkey = n_nationkey""",
    "routed_sources": """SELECT n_name AS source, count(*) AS claims FROM customer JOIN nation ON c_custkey % 3 = 0 OR n_nationkey % 3 <> 0
WHERE n_nationkey % 2 = 0 AND (n_nationkey % 4 <> 0 OR n_nationkey % 8 = 0) AND NOT (c_custkey % 5 = 0 AND n_name = 'NATION_2') GROUP BY 1""",
    "flagged_claims": "SELECT c_custkey AS claim_id, c_mktsegment = 'HOUSEHOLD' AS values_claim, c_custkey % 3 = 0 AS several_claims FROM customer",
    "region_queries": """WITH c AS (SELECT c_custkey, c_name, c_mktsegment AS s, c_custkey % 2 = 0 AS eu FROM customer)
SELECT c_custkey, 'Wages in ' || s || ' rise. Asia' || CASE WHEN eu THEN ' EU' ELSE '' END AS keywords, 'Wages in ' || s || ' rise in Asia' || CASE WHEN eu THEN ' or EU' ELSE '' END AS sentence, c_name || ' a b c d' AS strict, c_name || ' a b c' AS loose FROM c""",
    "page_of_offset": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber AS page, l_linenumber * 1000 AS start FROM lineitem), o AS (SELECT o_orderkey AS doc_id, o_custkey * 5 % 9000 AS "offset" FROM orders)
SELECT doc_id, "offset", coalesce(max(page) FILTER (WHERE start <= "offset"), min(page))::BIGINT AS page FROM o LEFT JOIN l ON l_orderkey = doc_id GROUP BY ALL""",
    "best_texts": """WITH p AS (SELECT doc_id // 5 AS candidate_id, ['pdf', 'supplied', 'page', 'snippet', 'page'][doc_id % 5 + 1] AS kind, length(trim(text)) AS size, length(text) AS n, doc_id % 4 = 0 AS walled FROM documents),
q AS (SELECT *, kind <> 'snippet' AND NOT walled AND size >= 400 AS whole FROM p),
r AS (SELECT *, CASE WHEN whole THEN CASE kind WHEN 'pdf' THEN 1 WHEN 'supplied' THEN 2 ELSE 3 END WHEN kind IN ('snippet', 'supplied') AND size >= 40 THEN 4 END AS place FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY place ASC NULLS LAST, size DESC, kind) AS k FROM r),
w AS (SELECT candidate_id, coalesce(string_agg(CASE WHEN walled THEN 'paywall' ELSE 'too short' END, ', ' ORDER BY CASE kind WHEN 'pdf' THEN 1 ELSE 2 END, CASE WHEN walled THEN 'paywall' ELSE 'too short' END) FILTER (WHERE kind IN ('pdf', 'page') AND NOT whole), '') AS reasons FROM q GROUP BY 1)
SELECT candidate_id, CASE WHEN place = 4 THEN 'abstract_only' ELSE kind END AS text_source, n, CASE WHEN place = 4 THEN CASE WHEN reasons = '' THEN 'no full text' ELSE reasons END END AS reasons FROM o JOIN w USING (candidate_id) WHERE k = 1 AND place IS NOT NULL""",
    "unread_documents": "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)) GROUP BY 1",
    "pooled_matches": f"""WITH {_MATCHES}, p AS (SELECT claim_id, doc_id % 50 AS d, sentence_idx, min(doc_id % 4)::INT AS round FROM m GROUP BY ALL) SELECT claim_id, round, count(*) AS n FROM p GROUP BY ALL""",
    "scope_notes": """WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN o_orderkey % 2 = 0 THEN 1996 END AS low, CASE WHEN o_orderkey % 3 = 0 THEN 1998 END AS high FROM orders)
SELECT o_orderkey, CASE WHEN y < low OR y > high THEN 'Published ' || y || ', outside ' || coalesce(low::VARCHAR, '…') || '–' || coalesce(high::VARCHAR, '…') END AS note, coalesce(y >= low, true) AND coalesce(y <= high, true) AS inside FROM o""",
    "source_labels": """WITH o AS (SELECT *, (o_orderkey % 12 + 1)::INT AS n FROM orders), w AS (SELECT *, list_transform(range(1, n + 1), lambda i: 'w' || i) AS w FROM o)
SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' — ' || o_orderstatus ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ' (' || year(o_orderdate) || ')' ELSE '' END AS label,
  'https://e.com/a#:~:text=' || CASE WHEN n <= 8 THEN array_to_string(w, '%20') ELSE array_to_string(w[1:5], '%20') || ',' || array_to_string(w[n - least(5, n - 5) + 1:n], '%20') END AS link,
  CASE WHEN o_orderkey % 2 = 0 THEN 'https://e.com/a.pdf#page=' || o_orderkey ELSE 'https://e.com/a.pdf#x' END AS page FROM w""",
}


def _wide(pattern: str) -> str:
    """A pattern of sources/pages.py inside a SQL string; DuckDB's white space lacks the vertical tab."""
    return re.sub(r"(\[[^\]]*)?\\s", lambda m: m[0] + r"\x0B" if m[1] else r"[\s\x0B]", pattern).replace("'", "''")


def _page_text_sql(x: str) -> str:
    for pattern, to in pages_source._STEPS:
        to = "chr(10)" if to == "\n" else f"'{to}'"
        x = f"regexp_replace({x}, '{_wide(pattern)}', {to}, 'g')"
    return x


def _sign(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


def _meta_sql(names: str) -> str:
    element = _wide(rf"(?is)<meta\s[^>]*(?:name|property)\s*=\s*[\"'](?:{names})[\"'][^>]*>")
    content = _wide(r"(?is)content\s*=\s*[\"']([^\"']*)")
    return f"nullif(trim(regexp_extract(regexp_extract(html, '{element}', 0), '{content}', 1)), '')"


#: Character references as HTML 5 has them: all names, those that stand without a semicolon also before further letters, and numbers.
_REFERENCES = f"""names AS MATERIALIZED (SELECT MAP {{{", ".join(f"'{name}': {_sign(text)}" for name, text in html5.items())}}} AS named,
  MAP {{{", ".join(f"{n}: {_sign(text)}" for n, text in _invalid_charrefs.items())}}} AS numbered, {sorted(_invalid_codepoints)} AS void)"""


def _decoded(x: str) -> str:
    """The text with its character references decoded, each once, from the left; names has to be joined."""
    number = "CASE WHEN starts_with(lower(r), '#x') THEN TRY_CAST('0x' || regexp_extract(r, '^#[xX]0*([0-9a-fA-F]+)', 1) AS HUGEINT) ELSE TRY_CAST(regexp_extract(r, '^#([0-9]+)', 1) AS HUGEINT) END"
    of_number = f"""list_transform([coalesce({number}, 1114112)], lambda n: CASE WHEN map_contains(numbered, n::INT) THEN numbered[n::INT] WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533)
  WHEN list_contains(void, n::INT) THEN '' ELSE chr(n::INT) END)[1]""".replace("n::INT", "least(n, 1114112)::INT")
    of_name = "coalesce(named[r], list_filter(list_transform(range(length(r) - 1, 1, -1), lambda k: named[r[1:k]] || r[k + 1:]), lambda v: v IS NOT NULL)[1], '&' || r)"
    parts = f"regexp_extract_all({x}, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{{1,32}};?)|[^&]+|&')"
    one = f"list_transform([p[2:]], lambda r: CASE WHEN starts_with(r, '#') THEN {of_number} ELSE {of_name} END)[1]"
    return f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform({parts}, lambda p: CASE WHEN starts_with(p, '&') AND length(p) > 1 THEN {one} ELSE p END), '') ELSE {x} END"


SQL["page_texts"] = rf"""WITH {_REFERENCES}, p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), b AS (SELECT page_id, html, {_page_text_sql("html")} AS body FROM p),
t AS (SELECT page_id, html, string_split({_decoded("body")}, chr(10)) AS l FROM b, names),
c AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: list_contains({_list(pages_source.REFERENCE_TITLES)}, regexp_replace(lower(l[i]), '^[0-9.\s\x0B]+|[\s\x0B:]+$', '', 'g')) AND length(array_to_string(l[1:i - 1], '')) > {pages_source.BODY_BEFORE_REFERENCES})[1] AS e FROM t),
x AS (SELECT page_id, html, array_to_string(CASE WHEN e IS NULL THEN l ELSE l[1:e - 1] END, chr(10)) AS text FROM c),
m AS (SELECT page_id, text, coalesce({_meta_sql("og:title|twitter:title")}, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)), '')) AS title, {_meta_sql("author|article:author|citation_author")} AS byline FROM x)
SELECT page_id, md5(text) AS text, length(text) AS n, {_decoded("title")} AS title, {_decoded("byline")} AS byline FROM m, names"""

SQL["merged_pages"] = f"""WITH g0 AS ({RECORDS["page_groups"]}),
p AS (SELECT page_id AS pos, url, regexp_extract(html, '(?is)<title>([^<]*)', 1) AS title, {_case(TIERS, "page_id")} AS tier FROM pages),
b AS (SELECT p.*, component, row_number() OVER (PARTITION BY component ORDER BY length(title) DESC, pos) = 1 AS base FROM p JOIN g0 ON g0.page_id = pos), o AS (SELECT *, CASE WHEN base THEN -1 ELSE pos END AS others FROM b)
SELECT min(pos) AS pos, arg_min(url, others) AS url, coalesce(arg_min(title, others) FILTER (WHERE title <> ''), '') AS title, arg_max(tier, ({_WEIGHT}, -others)) AS tier, array_to_string(list_sort(list_distinct(list('s' || pos % 3))), ',') AS sources,
  max(CASE WHEN pos % 5 = 0 THEN pos END) AS cited_by_count, min(pos % 9) AS search_rank, bool_and(pos % 2 = 0) AS for_counter, min(pos % 4) AS round FROM o GROUP BY component"""
