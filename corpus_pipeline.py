"""From raw documents to packed training sequences: five of the training-data operators, one after another.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame.  All but the last return
the columns of documents.  Models are fitted anew from the documents that a stage gets and the labels of sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import langid, neardup, packing, substrings, toxicity
from quarrylight.llm.common import stash, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, words=5, similarity=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.shorten(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # Fewer remembered words than the operator takes alone: earlier stages have left the executors' heaps full.
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache=200_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("packing", pack_sequences),
]
#: Learned models, sketches and tokenizers are outside SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
