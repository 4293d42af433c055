"""Pre-ranking of candidates, choice of what to read, and final ranking into support and pushback."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.dates import within, year_of
from quarrylight.functions.text import content_tokens, count_words
from quarrylight.operators.ranges import running
from quarrylight.operators.tiers import TIER_WEIGHT

# Weights and limits of the final ranking.
RELATION_WEIGHT = {"direct": 1.0, "paraphrase": 0.85, "partial": 0.5, "contradicts": 1.0}
SUPPORT_LIMIT, PUSHBACK_LIMIT = 7, 3
SCOPE_PENALTY, ABSTRACT_PENALTY, LOW_QUALITY_PENALTY = 0.15, 0.05, 0.5


def _map(values: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for pair in values.items() for v in pair)), key)


def tier_weight(tier: Column) -> Column:
    return F.coalesce(_map(TIER_WEIGHT, tier), F.lit(TIER_WEIGHT["web"]))


def plan_terms(key_terms: Column) -> Column:
    """The tokens of each key term, those without any left out."""
    return F.filter(F.transform(F.coalesce(key_terms, F.expr("cast(array() as array<string>)")), content_tokens), lambda t: F.size(t) > 0)


def plan_words(paraphrase: Column) -> Column:
    return F.array_distinct(content_tokens(F.coalesce(paraphrase, F.lit(""))))


def keyword_overlap(text: Column, key_terms: Column, paraphrase: Column) -> Column:
    """0 to 1: how much of a plan's vocabulary (array of key terms, paraphrases as one text) title and snippet cover."""
    return token_overlap(F.array_distinct(content_tokens(text)), plan_terms(key_terms), plan_words(paraphrase))


def token_overlap(doc: Column, terms: Column, para: Column) -> Column:
    """``keyword_overlap`` of the distinct tokens of a text and of ``plan_terms`` and ``plan_words``.

    All three are referred to several times, so they have to be columns that were worked out before.
    """
    hits = F.size(F.filter(terms, lambda t: F.size(F.array_except(t, doc)) == 0))
    term_score = F.when(F.size(terms) > 0, F.least(F.lit(1.0), hits / F.least(F.size(terms), F.lit(5)))).otherwise(0.0)
    para_score = F.when(F.size(para) > 0, F.least(F.lit(1.0), F.size(F.array_intersect(para, doc)) / F.size(para) * 2)).otherwise(0.0)
    return F.when(F.size(doc) == 0, 0.0).when(F.size(terms) == 0, para_score).otherwise(0.6 * term_score + 0.4 * para_score)


def pre_rank(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds overlap, score and rank (from 1; ties by pos) per claim.

    candidates: claim_id, pos, title, snippet, tier, search_score, search_rank, published, cited_by_count, low_quality, is_wikipedia, for_counter;
    plans: claim_id, key_terms, paraphrase, counter_query, year_from, year_to.
    """
    # A plan's words are found once a plan, a candidate's once a candidate.
    said = F.coalesce("paraphrase", F.lit(""))
    known = plans.withColumns({"__terms": plan_terms(F.col("key_terms")), "__words": plan_words(said), "__more": plan_words(F.concat(said, F.lit(" "), F.coalesce("counter_query", F.lit(""))))})
    read = candidates.withColumn("__doc", F.array_distinct(content_tokens(F.concat_ws(" ", "title", "snippet"))))
    rows = read.join(known, "claim_id").withColumn("__para", F.when(F.coalesce("for_counter", F.lit(False)), F.col("__more")).otherwise(F.col("__words")))
    rows = rows.withColumn("overlap", token_overlap(F.col("__doc"), F.col("__terms"), F.col("__para"))).drop("__doc", "__terms", "__words", "__more", "__para")
    top = F.max(F.when(F.col("search_score") > 0, F.col("search_score"))).over(Window.partitionBy("claim_id"))
    found = F.when(F.col("search_score").isNotNull() & (F.coalesce(top, F.lit(0.0)) > 0), 0.3 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("search_score") / top))).when(
        F.col("search_rank").isNotNull(), 0.1 * F.greatest(F.lit(0.0), 1 - F.col("search_rank") / 10)
    ).otherwise(0.0)
    year, bounded = year_of(F.col("published")), F.col("year_from").isNotNull() | F.col("year_to").isNotNull()
    recency = F.when(bounded & year.isNotNull(), F.when(within(year, F.col("year_from"), F.col("year_to")), 0.2).otherwise(-0.3)).otherwise(0.0)
    cited = F.when(F.col("cited_by_count") > 0, 0.1 * F.log10(F.col("cited_by_count") + 1)).otherwise(0.0)
    flag = lambda c, x: F.when(F.coalesce(F.col(c), F.lit(False)), x).otherwise(0.0)
    score = F.round(tier_weight(F.col("tier")) + F.col("overlap") + found + recency + cited - flag("low_quality", 1.0) - flag("is_wikipedia", 0.3), 6)
    order = Window.partitionBy("claim_id").orderBy(F.desc("score"), "pos")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def select_to_read(ranked: DataFrame, most: int = 15, reserve: int = 3) -> DataFrame:
    """The best ``most`` per claim, with up to ``reserve`` places kept for counter-query candidates; in rank order.  No two of a claim have one rank.

    Every task first keeps its own best of each claim, so a claim's final choice is made among the best ``most`` and the reserved ones alone.
    """
    counter = F.coalesce("for_counter", F.lit(False))
    order = Window.partitionBy("claim_id").orderBy("rank")
    nth = lambda rows, most: rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")
    kept = nth(ranked.where(counter), min(reserve, most)).withColumn("reserved", F.lit(True))
    best = nth(ranked, most).withColumn("reserved", F.lit(False))
    both = kept.union(best).withColumn("__n", F.row_number().over(Window.partitionBy("claim_id", "rank").orderBy(F.desc("reserved")))).where("__n = 1")
    final = Window.partitionBy("claim_id").orderBy(F.desc("reserved"), "rank")
    return both.withColumn("place", F.row_number().over(final)).where(F.col("place") <= most).drop("place", "__n")


def quotable(relation: Column, sentence_idx: Column, passage: Column) -> Column:
    return (F.size(sentence_idx) == 1) & relation.isin("direct", "paraphrase", "contradicts") & count_words(passage).between(8, 45)


def match_score(matches: DataFrame, mode: str, now_year: int) -> DataFrame:
    """Adds score: relation x confidence x tier x boost of the mode, less penalties.

    matches need relation, confidence, tier, published, sentence_idx, passage, text_source, low_quality, scope_mismatch, scope_note.
    """
    boost = F.lit(1.0)
    if mode == "paper":
        boost = F.when(F.col("tier").isin("peer_reviewed", "gov_igo"), 1.15).otherwise(1.0)
    if mode == "debate":
        recent = F.coalesce(now_year - year_of(F.col("published")) <= 5, F.lit(False))
        boost = F.when(recent, 1.1).otherwise(1.0) * F.when(quotable(F.col("relation"), F.col("sentence_idx"), F.col("passage")), 1.1).otherwise(1.0)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    less = lambda when, x: F.when(when, x).otherwise(0.0)
    raw = _map(RELATION_WEIGHT, F.col("relation")) * F.col("confidence") * tier_weight(F.col("tier")) * boost
    raw = raw - less(filled("scope_mismatch") | filled("scope_note"), SCOPE_PENALTY) - less(F.col("text_source") == "abstract_only", ABSTRACT_PENALTY) - less(F.coalesce("low_quality", F.lit(False)), LOW_QUALITY_PENALTY)
    return matches.withColumn("score", F.round(raw, 3))


def _greedy(passages: pd.DataFrame) -> pd.DataFrame:
    """Of one document's passages, best first, those that share no sentence with one that was taken before."""
    taken: set[int] = set()
    kept = []
    for i, idx in zip(passages.index, passages["sentence_idx"], strict=True):
        if taken.isdisjoint(idx):
            taken.update(idx)
            kept.append(i)
    return passages.loc[kept]


def distinct_passages(scored: DataFrame) -> DataFrame:
    """claim_id, candidate_id, pos, doc_id, chunk_idx, relation, score of the passages that share no sentence with a better one.

    Passages can only meet in their document, so the choice is made document by document, over sentence numbers alone: what it remembers is a
    document's taken sentences.
    """
    key = ["claim_id", "candidate_id", "doc_id"]
    fields = ["claim_id", "candidate_id", "pos", "doc_id", "chunk_idx", "relation", "score", "sentence_idx"]

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        return _greedy(rows.sort_values(["score", "pos", "chunk_idx"], ascending=[False, True, True], kind="stable"))

    rows = scored.select(*fields)
    return rows.groupBy(*key).applyInPandas(choose, rows.schema).drop("sentence_idx")


def rank_results(scored: DataFrame, side: str = "support", support: int = SUPPORT_LIMIT, pushback: int = PUSHBACK_LIMIT) -> DataFrame:
    """claim_id, candidate_id, side, score, best, more, rank: one result per source, support and pushback cut to their limits.

    scored: claim_id, candidate_id, pos, relation, score, sentence_idx, doc_id, chunk_idx, passage.  Passages that share a sentence with
    a better one go.  A source with passages on both sides stands on the asked side unless the other is much better.  Texts are
    gathered for the results that stay only.
    """
    place = ["pos", "doc_id", "chunk_idx"]
    kept = distinct_passages(scored).withColumn("contra", F.col("relation") == "contradicts")
    order = F.struct((-F.col("score")).alias("neg"), *place)
    on, off = (F.min(F.when((F.col("contra") == F.lit(side == "attack")) == wanted, order)) for wanted in (F.lit(True), F.lit(False)))
    first = scored.groupBy("claim_id", "candidate_id").agg(F.min("pos").alias("first_pos"))
    found = kept.groupBy("claim_id", "candidate_id").agg(on.alias("on"), off.alias("off"))
    stays = F.col("on").isNotNull() & (F.col("off").isNull() | (-F.col("on.neg") >= -F.col("off.neg") * 0.8))
    best = F.when(stays, F.col("on")).otherwise(F.least("on", "off"))
    asked = F.lit("pushback" if side == "attack" else "support")
    other = F.lit("support" if side == "attack" else "pushback")
    rows = found.join(first, ["claim_id", "candidate_id"]).withColumn("at", best)
    rows = rows.withColumn("side", F.when(F.coalesce(F.col("at") == F.col("on"), F.lit(False)), asked).otherwise(other)).withColumn("score", -F.col("at.neg"))
    ranking = Window.partitionBy("claim_id", "side").orderBy(F.desc("score"), "first_pos", "candidate_id")
    limit = lambda name, most: rows.where(F.col("side") == name).withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= most)
    top = limit("support", support).union(limit("pushback", pushback)).select("claim_id", "candidate_id", "side", "score", "rank", F.col("at").alias("place"))

    same = kept.withColumn("of", F.when(F.col("contra"), "pushback").otherwise("support")).select("claim_id", "candidate_id", *place, "of")
    shown = top.join(same, ["claim_id", "candidate_id"]).where(F.col("of") == F.col("side"))
    full = shown.join(scored.select("claim_id", "candidate_id", *place, "relation", F.col("score").alias("own"), "sentence_idx", "passage"), ["claim_id", "candidate_id", *place])
    passage = F.struct((-F.col("own")).alias("neg"), *place, "relation", F.col("own").alias("score"), "sentence_idx", "passage")
    is_best = (F.col("pos") == F.col("place.pos")) & (F.col("doc_id") == F.col("place.doc_id")) & (F.col("chunk_idx") == F.col("place.chunk_idx"))
    out = full.groupBy("claim_id", "candidate_id", "side", "score", "rank").agg(
        F.first(F.when(is_best, passage), ignorenulls=True).alias("best"), F.array_sort(F.collect_list(F.when(~is_best, passage))).alias("more")
    )
    return out.select("claim_id", "candidate_id", "side", "score", "best", "more", "rank")


def scope_note(published: Column, low: Column, high: Column) -> Column:
    y = year_of(published)
    outside = y.isNotNull() & (F.coalesce(y < low, F.lit(False)) | F.coalesce(y > high, F.lit(False)))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("…"))
    return F.when(outside, F.concat(F.lit("Published "), y.cast("string"), F.lit(", outside "), text(low), F.lit("–"), text(high)))


def budgeted_prefix(batches: DataFrame, cap: float, reserve: float = 0.0) -> DataFrame:
    """The batches of each job, in order, whose running estimate stays within the cap less the reserve.  batches: job, batch, estimate.

    A job's batches are summed over ranges, so one job may hold all rows.
    """
    return running(batches, "job", [F.col("batch")], F.col("estimate"), "running").where(F.col("running") <= cap - reserve)


def affordable_sources(costs: DataFrame, budget: float) -> DataFrame:
    """The sources of each job that its budget can bear: those that are to go first (highest ``drop_order``) go until the rest costs no more.

    costs: job, source, drop_order, cost.
    """
    return running(costs, "job", [F.col("drop_order"), F.col("source")], F.col("cost"), "running").where(F.col("running") <= budget).drop("running")


def empty_claims(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claims for which nothing was verified."""
    return claims.join(results.select("claim_id").distinct(), "claim_id", "left_anti")
