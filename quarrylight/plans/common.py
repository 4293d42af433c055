"""Table access for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import postings, segment, tables
from quarrylight.operators.postings import Index


#: Tables whose rows are texts, on which work is bound by the processor.
TEXT_TABLES = ("documents", "pages", "conversations")


def spread(rows: DataFrame) -> DataFrame:
    """Rows that are stored in fewer pieces than there are cores, dealt out to all of them; large tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXT_TABLES else rows


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), "text")


_INDEXES: dict[tuple[str, str], Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The inverted index of a folder's documents, built once an application and then shared by all queries that read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        _INDEXES[key] = postings.build(table(spark, sf_dir, "documents").select("doc_id", "text"), tables.fresh_path(spark, "index"), buckets)
    return _INDEXES[key]


_STORED: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def stored_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A folder's documents with normalised texts, and their sentences, both bucketed by document: written once an application, for queries that go through all of them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        docs = tables.write_buckets(segment.build_docs(table(spark, sf_dir, "documents")), tables.fresh_path(spark, "texts"), "doc_id", ["doc_id"], buckets)
        sents = segment.sentences(docs).select("doc_id", "sent_idx", "text", "start", "end")
        _STORED[key] = docs, tables.write_buckets(sents, tables.fresh_path(spark, "sentences"), "doc_id", ["doc_id", "sent_idx"], buckets, dealt=True)
    return _STORED[key]
