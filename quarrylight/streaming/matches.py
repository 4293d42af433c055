"""Continuous matching with statistics that move: every micro-batch adds its postings and counts, and scores follow the corpus as it stands.

A batch's index lies in a folder of its own, so what is written grows with the batch.  Document frequencies, the number of chunks and their
lengths are sums over batches; scores after n batches equal those of one index of all their documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import postings, retrieval


def _stored(spark: SparkSession, root: str, number: int) -> str:
    return f"{root}/batch={number:09d}"


def add(batch: DataFrame, root: str, number: int, buckets: int = 8) -> None:
    """Indexes a batch's documents (doc_id, text).  The totals are written last and make the batch complete; a batch that is run again starts anew."""
    spark = batch.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(_stored(spark, root, number))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    postings.build(batch.select("doc_id", "text"), _stored(spark, root, number), buckets)


def batches(spark: SparkSession, root: str, upto: int) -> list[int]:
    """Numbers of the complete batches up to a number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    done = [n for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/totals/_SUCCESS"))]
    return sorted(n for n in (int(name[6:]) for name in done) if n <= upto)


def merged(spark: SparkSession, root: str, upto: int) -> postings.Index | None:
    """The index of all batches up to a number: their postings and sentences together, their totals added up."""
    paths = [_stored(spark, root, n) for n in batches(spark, root, upto)]
    if not paths:
        return None
    together = lambda name, schema: reduce(DataFrame.unionByName, (spark.read.schema(schema).parquet(f"{p}/{name}") for p in paths))
    totals = together("totals", postings.TOTALS).agg(F.sum("n").alias("n"), F.sum("len").alias("len"))
    return postings.Index(together("sentences", postings.SENTENCES), together("postings", postings.POSTINGS), totals)


def standing_scores(spark: SparkSession, root: str, upto: int, query_terms: DataFrame) -> DataFrame:
    """claim_id, doc_id, chunk_idx, score of all documents seen so far, by the statistics of all of them.  query_terms: claim_id, term, weight."""
    index = merged(spark, root, upto)
    return index.bm25(query_terms) if index else spark.createDataFrame([], "claim_id long, doc_id long, chunk_idx int, score double")


def new_scores(spark: SparkSession, root: str, number: int, query_terms: DataFrame) -> DataFrame:
    """Scores of a batch's own chunks by the statistics of all batches up to it."""
    index = merged(spark, root, number)
    tf = index.term_frequencies(query_terms)
    own = spark.read.schema(postings.POSTINGS).parquet(f"{_stored(spark, root, number)}/postings").join(query_terms.select("term").distinct(), "term", "left_semi")
    return retrieval.scored_terms(own, postings.document_frequencies(tf), index.statistics(), query_terms)


def match(stream: DataFrame, query_terms: DataFrame, root: str, sink: str, checkpoint: str, buckets: int = 8, trigger: dict | None = None):
    """Starts a query that scores the chunks of new documents against standing claims as the corpus grows.

    Output: claim_id, doc_id, chunk_idx, score, round (the micro-batch), one folder a batch.  ``standing_scores`` gives the scores of all
    documents by the newest statistics.
    """

    def run(batch: DataFrame, number: int) -> None:
        add(batch, root, number, buckets)
        scored = new_scores(batch.sparkSession, root, number, query_terms).withColumn("round", F.lit(number))
        scored.write.mode("overwrite").parquet(f"{sink}/batch={number:09d}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
