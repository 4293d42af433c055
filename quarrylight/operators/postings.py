"""A stored inverted index of chunks, with the sentences it was made from.

``postings`` (term, doc_id, chunk_idx, len, tf) holds single words and neighbouring pairs, bucketed by term: a query reads it without a shuffle
of the index, and term frequencies, document frequencies and scores all come from it.  ``sentences`` (doc_id, sent_idx, text, start, end) is
bucketed by document.  Segmentation and stemming are done once, when the index is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.operators import retrieval, scoring, segment, tables

SENTENCES = "doc_id bigint, sent_idx int, text string, start bigint, end bigint"
POSTINGS = "term string, doc_id bigint, chunk_idx int, len int, tf bigint"
TOTALS = "n bigint, len bigint"


@dataclass(frozen=True)
class Index:
    sentences: DataFrame
    postings: DataFrame
    #: One row: the number of chunks, and the sum of their lengths in terms.
    totals: DataFrame

    def term_frequencies(self, asked: DataFrame) -> DataFrame:
        """doc_id, chunk_idx, len, term, tf of the asked terms (term)."""
        terms = tables.cut(asked.select("term").distinct(), "terms")
        few = tables.bounded(terms)
        return self.postings.join(terms if few is None else few, "term", "left_semi")

    def document_frequencies(self, terms: DataFrame) -> DataFrame:
        """term, df of those of the terms (term) that some chunk has."""
        return document_frequencies(self.term_frequencies(terms))

    def statistics(self) -> DataFrame:
        """n, avg_len as scoring takes them."""
        return self.totals.select(F.col("n").cast("double").alias("n"), (F.col("len") / F.col("n")).alias("avg_len"))

    def spans(self) -> DataFrame:
        """doc_id, chunk_idx, sent_start, sent_end of every chunk."""
        return segment.chunks(self.sentences)

    def bm25(self, queries: DataFrame, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
        """claim_id, doc_id, chunk_idx, score of every chunk that has a term of a claim.  queries: claim_id, term, weight."""
        tf = self.term_frequencies(queries)
        return retrieval.scored_terms(tf, document_frequencies(tf), self.statistics(), queries, k1, b)

    def best_chunks(self, queries: DataFrame, most: int, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
        """claim_id, doc_id, chunk_idx, score, rank (from 1) of every claim's best chunks; ties by doc_id and chunk_idx.  Rows of ``bm25``, of which no more are made than may be best."""
        rows = scoring.best(self.postings, self.statistics(), queries, most, 0, 0, k1, b)
        order = Window.partitionBy("claim_id").orderBy(F.desc("score"), "doc_id", "chunk_idx")
        scored = self.bm25(queries, k1, b) if rows is None else rows.drop("doc_rank")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    def select_chunks(self, queries: DataFrame, per_doc: int = 3, total: int = 25, size: int = 4, overlap: int = 1) -> DataFrame:
        """``retrieval.select_chunks`` of the scores of ``bm25``."""
        rows = scoring.best(self.postings, self.statistics(), queries, total, per_doc, (size - 1) // (size - overlap), retrieval.K1, retrieval.B)
        return retrieval.select_chunks(self.bm25(queries), per_doc, total, size, overlap) if rows is None else retrieval.best_picks(rows, total)


def document_frequencies(tf: DataFrame) -> DataFrame:
    """term, df: how many chunks hold each term, of rows that are one a term and chunk."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def chunk_postings(sents: DataFrame) -> DataFrame:
    """term, doc_id, chunk_idx, len, tf of sentences: words are counted where their chunk was gathered."""
    rows = retrieval.chunk_terms(sents).select("doc_id", "chunk_idx", "len", F.explode("terms").alias("term"))
    return rows.groupBy("doc_id", "chunk_idx", "len", "term").agg(F.count("*").alias("tf")).select("term", "doc_id", "chunk_idx", "len", "tf")


def build(docs: DataFrame, root: str, buckets: int) -> Index:
    """Indexes documents (doc_id, text) under ``root``, an empty folder."""
    sents = segment.sentences(segment.build_docs(docs))
    kept = tables.write_buckets(sents.select("doc_id", "sent_idx", "text", "start", "end"), f"{root}/sentences", "doc_id", ["doc_id", "sent_idx"], buckets)
    posted = tables.write_buckets(chunk_postings(kept), f"{root}/postings", "term", ["term", "doc_id", "chunk_idx"], buckets)
    chunks = segment.chunk_counts(kept.groupBy("doc_id").agg((F.max("sent_idx") + 1).alias("n"))).agg(F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("n"))
    lengths = chunks.crossJoin(posted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("len")))  # one row each
    lengths.write.parquet(f"{root}/totals")
    return Index(kept, posted, docs.sparkSession.read.schema(TOTALS).parquet(f"{root}/totals"))


def load(spark: SparkSession, root: str, buckets: int) -> Index:
    """An index that was built under ``root`` with as many buckets."""
    kept = tables.read_buckets(spark, f"{root}/sentences", SENTENCES, "doc_id", ["doc_id", "sent_idx"], buckets)
    posted = tables.read_buckets(spark, f"{root}/postings", POSTINGS, "term", ["term", "doc_id", "chunk_idx"], buckets)
    return Index(kept, posted, spark.read.schema(TOTALS).parquet(f"{root}/totals"))


def keyword_hits(index: Index, queries: DataFrame) -> DataFrame:
    """``retrieval.keyword_hits`` with the documents' words from the index."""
    asked = queries.select("claim_id", "term").distinct()
    return retrieval.keyword_modes(asked, index.term_frequencies(asked).select("doc_id", "term").distinct())
