"""A lexical labeller: says of a claim and a chunk whether the chunk's sentences state, repeat in part or deny the claim.

It needs no model and no file.  Each sentence of a chunk is aligned with the claim: the claim's words, weighed by how rare they are in the
corpus, and its neighbouring pairs of words are looked up in the sentence.  Sentences that are mostly made of the claim's words are cited; the
share of the claim's weight and of its pairs that they cover together makes the strength.  Negation on one side only, or other
numbers in the place of the claim's, turn a strong match into a contradiction and a weak one into none.

The labels have the columns that parsed labels have, so verification, ranking and all that follows take them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import numbers_in, terms_of_tokens, tokens
from quarrylight.operators.counting import Counted
from quarrylight.operators.postings import Index
from quarrylight.sources.labels import MOST_SENTENCES

#: Least strength of each relation; weight of the pairs in it; share of a cited sentence's words that the claim has.
DIRECT, PARAPHRASE, PARTIAL = 0.9, 0.6, 0.35
ORDER_WEIGHT, FOCUS = 0.25, 0.5
NEGATION = r"(?i)\b(not|no|never|none|nor|neither|nobody|nothing|cannot|without)\b|n['’]t\b"


def term_weights(index: Index | Counted, terms: DataFrame) -> DataFrame:
    """term, idf of the terms (term), also of those that the corpus lacks."""
    df = index.document_frequencies(terms)
    rows = terms.select("term").distinct().join(df, "term", "left").crossJoin(F.broadcast(index.statistics()))  # one row
    held = F.coalesce("df", F.lit(0))
    return rows.select("term", F.log(F.lit(1.0) + (F.col("n") - held + F.lit(0.5)) / (held + F.lit(0.5))).alias("idf"))


def claim_profiles(claims: DataFrame, index: Index | Counted) -> DataFrame:
    """claim_id, terms (array of term and idf), weight (their sum), pairs, numbers, negated.  claims: claim_id, text."""
    words = claims.select("claim_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    weighed = words.join(term_weights(index, words), "term").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("terms"))
    toks = tokens(F.col("text"))
    pairs = F.array_distinct(F.array_except(terms_of_tokens(toks), toks))
    read = claims.select("claim_id", pairs.alias("pairs"), numbers_in(F.col("text")).alias("numbers"), F.col("text").rlike(NEGATION).alias("negated"))
    return read.join(weighed, "claim_id").withColumn("weight", sum_of("terms"))


def sum_of(terms: str | Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t["idf"])


def label(claims: DataFrame, chunks: DataFrame, index: Index | Counted, sents: DataFrame | None = None) -> DataFrame:
    """claim_id, doc_id, chunk_idx, pos, relation, sentence_ids, confidence, reason, scope_mismatch for each pair of a claim and a chunk.

    claims: claim_id, text; chunks: claim_id, doc_id, chunk_idx, sent_start, sent_end.  A pair whose sentences share too little is
    ``irrelevant`` and cites nothing.  A claim without words has no labels.  sents may hold the sentences of the chunks' documents alone.
    """
    profiles = claim_profiles(claims, index)
    shown = chunks.select("claim_id", "doc_id", "chunk_idx", F.explode(F.sequence("sent_start", "sent_end")).alias("sent_idx"))
    rows = shown.join((index.sentences if sents is None else sents).select("doc_id", "sent_idx", "text"), ["doc_id", "sent_idx"]).join(profiles, "claim_id")
    rows = rows.withColumn("toks", tokens(F.col("text"))).withColumn("own", F.array_distinct("toks"))
    rows = rows.withColumn("hits", F.filter("terms", lambda t: F.array_contains("own", t["term"])))
    rows = rows.withColumn("together", F.array_intersect("pairs", terms_of_tokens(F.col("toks"))))
    cited = (F.size("hits") > 0) & (F.size("hits") >= FOCUS * F.size("own"))
    facts = F.struct(
        (-sum_of("hits")).alias("less"), "sent_idx", "hits", "together", F.col("text").rlike(NEGATION).alias("negated"), numbers_in(F.col("text")).alias("numbers")
    )
    best = rows.groupBy("claim_id", "doc_id", "chunk_idx").agg(F.slice(F.array_sort(F.collect_list(F.when(cited, facts))), 1, MOST_SENTENCES).alias("cited"))
    rows = best.join(profiles, "claim_id")
    every = lambda field: F.array_distinct(F.flatten(F.transform("cited", lambda s: s[field])))
    rows = rows.withColumns({"covered": sum_of(every("hits")) / F.col("weight"), "paired": F.size(every("together")) / F.size("pairs"), "theirs": every("numbers")})
    strength = F.when(F.size("pairs") == 0, F.col("covered")).otherwise((1 - ORDER_WEIGHT) * F.col("covered") + ORDER_WEIGHT * F.col("paired"))
    denied = F.exists("cited", lambda s: s["negated"]) != F.col("negated")
    other = (F.size(F.array_except("numbers", "theirs")) > 0) & (F.size(F.array_except("theirs", "numbers")) > 0)
    rows = rows.withColumns({"strength": F.round(strength, 4), "denied": denied, "other": other})
    conflict = F.col("denied") | F.col("other")
    relation = (
        F.when((F.size("cited") == 0) | (F.col("strength") < PARTIAL), "irrelevant")
        .when(conflict, F.when(F.col("strength") >= PARAPHRASE, "contradicts").otherwise("irrelevant"))
        .when(F.col("strength") >= DIRECT, "direct")
        .when(F.col("strength") >= PARAPHRASE, "paraphrase")
        .otherwise("partial")
    )
    sid = lambda s: F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".s"), s.cast("string"))
    ids = F.transform(F.array_sort(F.transform("cited", lambda s: s["sent_idx"])), sid)
    reason = F.concat(
        F.lit("states "), F.round(100 * F.col("covered")).cast("int").cast("string"), F.lit(" % of the claim's words"),
        F.when(F.col("denied"), "; one is negated").otherwise(""), F.when(F.col("other"), "; numbers differ").otherwise(""),
    )
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("relation", relation)
    return rows.select(
        "claim_id", "doc_id", "chunk_idx", F.lit(0).alias("pos"), "relation", F.when(F.col("relation") == "irrelevant", none).otherwise(ids).alias("sentence_ids"),
        F.col("strength").alias("confidence"), reason.alias("reason"), F.lit(None).cast("string").alias("scope_mismatch"),
    )
