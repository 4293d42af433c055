"""Micro-batch jobs: candidate upserts, process-once work and continuous matching.

All state is in tables or in the query's checkpoint, so a restart goes on where the last finished batch ended and repeats no output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import dedupe, retrieval, segment


def _snapshot(spark: SparkSession, root: str, number: int) -> str:
    return f"{root}/batch={number:09d}"


def _latest(spark: SparkSession, root: str, before: int) -> DataFrame | None:
    """The newest snapshot of a batch before the given one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    done = [n for n in names if n.startswith("batch=") and int(n[6:]) < before and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{root}/{done[-1]}") if done else None


def upsert_candidates(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that merges each micro-batch of candidates into a new snapshot under ``root``.

    A batch that is run again overwrites its own snapshot and starts from the one before it, so nothing is merged twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _latest(spark, root, number)
        merged = dedupe.merge_incremental(old if old is not None else dedupe.empty_candidates(spark), batch)
        merged.write.mode("overwrite").parquet(_snapshot(spark, root, number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def process_once(stream: DataFrame, keys: list[str], delay: str = "7 days", at: str = "fetched_at") -> DataFrame:
    """Each key's first row; keys are remembered for the watermark's delay, so state does not grow for ever."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def continuous_matches(stream: DataFrame, query_terms: DataFrame, statistics: DataFrame, totals: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that scores the chunks of new documents against standing claims.

    query_terms: claim_id, term, weight; statistics: term, df; totals: n, avg_len (one row): corpus statistics frozen for the run.
    Output: claim_id, doc_id, chunk_idx, score, round (the micro-batch), one folder a batch.
    """

    def match(batch: DataFrame, number: int) -> None:
        terms = retrieval.chunk_terms(segment.sentences(segment.build_docs(batch)))
        tf = retrieval.term_frequencies(terms, query_terms.select("term").distinct())
        scored = retrieval.scored_terms(tf, statistics, totals, query_terms)
        scored.withColumn("round", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number:09d}")

    return stream.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
