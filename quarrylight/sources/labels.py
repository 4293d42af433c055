"""Labels from outside: JSON that may be wrapped in prose, checked against a schema, with rejects kept apart; and plain writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "chunkId string, relation string, sentenceIds array<string>, confidence string, reason string, scopeMismatch string"
RELATIONS = ("direct", "paraphrase", "partial", "contradicts", "irrelevant")
MOST_SENTENCES = 4


def json_object(c: Column) -> Column:
    """The outermost object of an answer with fences or prose around it."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def parse_labels(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, rejects) of answers (claim_id, batch, answer).

    Numbers may be texts, sentence lists are cut to their limit; an answer that is no JSON, or a label without a chunk or with
    an unknown relation, is a reject with its reason.
    """
    parsed = answers.withColumn("json", json_object(F.col("answer"))).withColumn("o", F.from_json("json", f"matches array<struct<{LABEL.replace(' string', ':string').replace(' array', ':array')}>>", {"mode": "PERMISSIVE"}))
    bad = parsed.where(F.col("o.matches").isNull()).select("claim_id", "batch", F.lit("no_json").alias("reason"), F.substring("answer", 1, 200).alias("detail"))
    rows = parsed.where(F.col("o.matches").isNotNull()).select("claim_id", "batch", F.posexplode("o.matches").alias("pos", "m"))
    place = F.regexp_extract("m.chunkId", r"^\s*d([0-9]+)\.c([0-9]+)\s*$", 1)
    rows = rows.withColumn("doc_id", place.try_cast("long")).withColumn("chunk_idx", F.regexp_extract("m.chunkId", r"^\s*d([0-9]+)\.c([0-9]+)\s*$", 2).try_cast("int")).withColumn("relation", F.lower(F.trim("m.relation")))
    ok = F.coalesce(F.col("doc_id").isNotNull() & F.col("relation").isin(*RELATIONS), F.lit(False))
    ids = F.slice(F.coalesce("m.sentenceIds", F.expr("cast(array() as array<string>)")), 1, MOST_SENTENCES)
    good = rows.where(ok).select("claim_id", "doc_id", "chunk_idx", (F.col("batch") * 1000 + F.col("pos")).alias("pos"), "relation", ids.alias("sentence_ids"), F.coalesce(F.col("m.confidence").try_cast("double"), F.lit(0.5)).alias("confidence"), F.coalesce("m.reason", F.lit("")).alias("reason"), F.col("m.scopeMismatch").alias("scope_mismatch"))
    odd = rows.where(~ok).select("claim_id", "batch", F.when(F.col("doc_id").isNull(), "no_chunk").otherwise("bad_relation").alias("reason"), F.to_json("m").alias("detail"))
    return good, bad.unionByName(odd)


PLAN = (
    "normalizedClaim string, claimType string, coreProposition string, paraphrases array<string>, keyTerms array<string>, counterQuery string, inputLanguage string, multipleClaims array<string>, "
    "constraints struct<yearFrom:string,yearTo:string,regions:array<string>,side:string,strength:string>, queries struct<academic:array<string>,semantic:array<string>,news:array<string>,policy:array<string>>"
)
CLAIM_TYPES = ("empirical", "causal", "statistical", "normative", "definitional", "prediction")
MOST_PARAPHRASES, MOST_TERMS, MOST_QUERIES, MOST_CLAIMS = 4, 12, 4, 5


def _list(c: str, most: int) -> Column:
    """Filled entries, trimmed, up to a limit; null becomes empty."""
    given = F.coalesce(F.col(c), F.expr("cast(array() as array<string>)"))
    return F.slice(F.filter(F.transform(given, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))), 1, most)


def parse_plans(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, rejects) of answers (claim_id, answer).

    Years may be texts and count from 1800 to 2100; lists are cut to their limits; side and strength have defaults.  No JSON, no claim, or an unknown
    kind of claim makes a reject with its reason.
    """
    o = answers.select("claim_id", "answer", F.from_json(json_object(F.col("answer")), PLAN, {"mode": "PERMISSIVE"}).alias("o"))
    kind, claim = F.lower(F.trim("o.claimType")), F.trim("o.normalizedClaim")
    reason = F.when(F.col("o").isNull() | (claim.isNull() & kind.isNull()), "no_json").when(F.coalesce(claim, F.lit("")) == "", "no_claim").when(~F.coalesce(kind.isin(*CLAIM_TYPES), F.lit(False)), "bad_type")
    judged = o.withColumn("reason", reason)
    year = lambda c: F.when(F.col(f"o.constraints.{c}").try_cast("int").between(1800, 2100), F.col(f"o.constraints.{c}").try_cast("int"))
    choice = lambda c, values, default: F.when(F.lower(F.trim(f"o.constraints.{c}")).isin(*values), F.lower(F.trim(f"o.constraints.{c}"))).otherwise(default)
    plans = judged.where("reason is null").select(
        "claim_id", claim.alias("normalized_claim"), kind.alias("claim_type"), F.coalesce(F.trim("o.coreProposition"), claim).alias("core_proposition"), _list("o.paraphrases", MOST_PARAPHRASES).alias("paraphrases"), _list("o.keyTerms", MOST_TERMS).alias("key_terms"),
        F.coalesce(F.trim("o.counterQuery"), F.lit("")).alias("counter_query"), F.trim("o.inputLanguage").alias("input_language"), _list("o.multipleClaims", MOST_CLAIMS).alias("multiple_claims"), year("yearFrom").alias("year_from"), year("yearTo").alias("year_to"),
        _list("o.constraints.regions", MOST_CLAIMS).alias("regions"), choice("side", ("support", "attack", "either"), "support").alias("side"), choice("strength", ("causal", "associational", "any"), "any").alias("strength"),
        F.struct(*(_list(f"o.queries.{q}", MOST_QUERIES).alias(q) for q in ("academic", "semantic", "news", "policy"))).alias("queries"),
    )
    return plans, judged.where("reason is not null").select("claim_id", "reason", F.substring("answer", 1, 200).alias("detail"))


def parse_summaries(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, rejects) of answers (claim_id, answer): claim_id, doc_id, summary for each source with an id and a text."""
    o = answers.select("claim_id", "answer", F.from_json(json_object(F.col("answer")), "sources array<struct<docId:string,summary:string>>", {"mode": "PERMISSIVE"}).alias("o"))
    bad = o.where("o.sources is null").select("claim_id", F.lit("no_json").alias("reason"), F.substring("answer", 1, 200).alias("detail"))
    rows = o.where("o.sources is not null").select("claim_id", F.explode("o.sources").alias("s")).withColumn("doc_id", F.regexp_extract("s.docId", r"^\s*d([0-9]+)\s*$", 1).try_cast("long"))
    ok = F.col("doc_id").isNotNull() & (F.coalesce(F.trim("s.summary"), F.lit("")) != "")
    odd = rows.where(~F.coalesce(ok, F.lit(False))).select("claim_id", F.when(F.col("doc_id").isNull(), "no_source").otherwise("no_summary").alias("reason"), F.to_json("s").alias("detail"))
    return rows.where(ok).select("claim_id", "doc_id", F.trim("s.summary").alias("summary")), bad.unionByName(odd)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").partitionBy("round").parquet(path)


def write_requests(batches: DataFrame, path: str) -> None:
    """One JSON line a batch of chunks, for the labeller."""
    batches.write.mode("overwrite").json(path)
