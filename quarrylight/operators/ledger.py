"""Counters, usage and cost, history, warnings, coverage of a result set, and what must be run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.dates import year_of


def usage_cost(usage: DataFrame, miss: float, hit: float, output: float) -> DataFrame:
    """Adds cost_usd from prompt, cached and completion tokens; prices are per million."""
    missed = F.greatest(F.lit(0), F.coalesce("miss_tokens", F.col("prompt_tokens") - F.coalesce("hit_tokens", F.lit(0))))
    return usage.withColumn("cost_usd", (missed * miss + F.coalesce("hit_tokens", F.lit(0)) * hit + F.coalesce("completion_tokens", F.lit(0)) * output) / 1e6)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def ledger(usage: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Sums per group, per leading groups and in all, with the number of calls (rollup)."""
    return usage.rollup(*by).agg(F.count("*").alias("calls"), *(F.round(F.sum(v), 6).alias(v) for v in values))


def source_counts(rows: DataFrame) -> DataFrame:
    """Hits per round and source, per round, and in all."""
    return rows.rollup("round", "source").agg(F.count("*").alias("n"))


def long_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metric columns in long form: keys, metric, value."""
    names = [c for c in metrics.columns if c not in keys]
    wide = metrics.select(*keys, *(F.col(c).cast("double").alias(c) for c in names))
    return wide.unpivot(keys, names, "metric", "value")


def upsert_history(history: DataFrame, key: str = "job_id", at: str = "saved_at", keep: int = 200) -> DataFrame:
    """The latest entry of each job, newest first, at most ``keep``."""
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc("pos"))) == 1
    return history.withColumn("__latest", latest).where("__latest").drop("__latest").orderBy(F.desc(at), key).limit(keep)


def filter_history(history: DataFrame, mode: str | None, needle: str) -> DataFrame:
    rows = history if mode is None else history.where(F.col("mode") == mode)
    return rows.where(F.contains(F.lower("claim"), F.lit(needle.strip().lower()))) if needle.strip() else rows


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.dropDuplicates(["code", "message"])


def coverage(results: DataFrame) -> DataFrame:
    """Per claim: counts by tier, relation and region, year range, and shares of abstracts and scope notes."""
    year = year_of(F.col("published"))
    return results.groupBy("claim_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("region").alias("regions"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.count_if(F.col("text_source") == "abstract_only").alias("abstracts"),
        F.count_if(F.col("relation") == "contradicts").alias("contradicting"),
        F.count_if(F.col("tier").isin("peer_reviewed", "preprint")).alias("academic"),
        F.count_if(F.coalesce("scope_mismatch", F.lit("")) != "").alias("scope_notes"),
    )


def gaps(profile: DataFrame, now_year: int, most: int = 3) -> DataFrame:
    """claim_id, gaps: up to ``most`` flags of what a result set lacks; none is an answer too."""
    n = F.col("n")
    flags = F.array(
        F.when(F.coalesce("several_claims", F.lit(False)), "which_claim"),
        F.when((n > 1) & (F.col("regions") == 1), "regions"),
        F.when(F.col("last_year").isNotNull() & (F.col("last_year") < now_year - 10), "years"),
        F.when(F.col("abstracts") * 2 > n, "full_text"),
        F.when(F.col("contradicting") * 2 > n, "side"),
        F.when(F.col("academic") * 4 < n, "strength"),
    )
    return profile.select("claim_id", F.slice(F.array_compact(flags), 1, most).alias("gaps"))


def changed_requests(before: DataFrame, after: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Keys whose request differs from the last round's, or is new."""
    sign = lambda df, to: df.select(*keys, F.xxhash64(F.to_json(F.struct(*parts), {"ignoreNullFields": "true"})).alias(to))
    both = sign(after, "new").join(sign(before, "old"), keys, "left")
    return both.where(F.col("old").isNull() | (F.col("old") != F.col("new"))).select(*keys)


def apply_answers(plans: DataFrame, answers: DataFrame) -> DataFrame:
    """Plans with a round's answers taken in: years, regions, side, strength and which claim is meant.

    plans: claim_id, claim, year_from, year_to, regions, side, strength; answers: claim_id, pos, affects, answer.  Blank answers and
    "keep as is" change nothing; the last answer of a kind counts.
    """
    said = answers.where((F.trim("answer") != "") & ~F.lower(F.trim("answer")).startswith("keep as is"))
    kinds = ["years", "regions", "side", "strength", "which_claim"]
    wide = said.groupBy("claim_id").pivot("affects", kinds).agg(F.max_by("answer", "pos")).select("claim_id", *(F.col(k).alias(f"a_{k}") for k in kinds))
    years = F.transform(F.regexp_extract_all("a_years", F.lit(r"((?:1[5-9]|20|21)[0-9]{2})"), F.lit(1)), lambda y: y.cast("int"))
    rows = plans.join(wide, "claim_id", "left").withColumn("y", F.when(F.col("a_years").isNotNull(), years))
    some = F.coalesce(F.size("y"), F.lit(0))
    regions = F.filter(F.transform(F.split("a_regions", r"\s*[,;]\s*|\s+and\s+"), lambda t: F.trim(t)), lambda r: r != "")
    side = F.when(F.col("a_side").rlike("(?i)against|attack|oppos"), "attack").when(F.col("a_side").rlike("(?i)both|either"), "either").when(F.col("a_side").isNotNull(), "support")
    out = rows.withColumns({
        "year_from": F.when(some >= 1, F.array_min("y")).otherwise(F.col("year_from")),
        "year_to": F.when(some >= 2, F.array_max("y")).otherwise(F.col("year_to")),
        "regions": F.when(F.col("a_regions").isNotNull(), regions).otherwise(F.col("regions")),
        "side": F.coalesce(side, "side"),
        "strength": F.coalesce(F.lower("a_strength"), "strength"),
        "claim": F.coalesce("a_which_claim", "claim"),
    })
    return out.select(*plans.columns)


def exclude(rows: DataFrame, *others: DataFrame, on: list[str]) -> DataFrame:
    """Rows that none of the other tables (attempted, not relevant, hidden) lists."""
    for other in others:
        rows = rows.join(other.select(*on).distinct(), on, "left_anti")
    return rows


def stage_times(log: DataFrame) -> DataFrame:
    """job, first_result_ms, total_ms from a run log (job, stage, ts)."""
    first = F.min("ts")
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return log.groupBy("job").agg((ms(F.min(F.when(F.col("stage") == "result", F.col("ts")))) - ms(first)).alias("first_result_ms"), (ms(F.max("ts")) - ms(first)).alias("total_ms"))
