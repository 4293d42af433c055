"""Candidates as a table of changes: a micro-batch reads the records that it meets and writes those and its own, not the table.

records: the newest version of a position counts, a version with ``gone`` is a tombstone.  keys: which position first had a key.  heads: the last
position after each batch.  The result equals ``dedupe.merge_incremental`` run batch by batch over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import dedupe
from quarrylight.operators.tables import cut
from quarrylight.streaming import changes

BUCKETS = 64
RECORD = "pos long, candidate_id string, " + dedupe.SCHEMA + ", gone boolean"
KEY = "key string, pos long"
_COLUMNS = ["pos", "candidate_id", *dedupe.FIELDS]


def _bucket(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _keys(df: DataFrame):
    return dedupe.keys_of(*(F.col(c) for c in ("doi", "url", "pdf_url", "title")))


def newest(rows: DataFrame) -> DataFrame:
    """The newest version of each position; tombstones included."""
    last = rows.groupBy("pos").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["pos", "batch"])


def snapshot(spark: SparkSession, root: str, before: int) -> DataFrame:
    """pos, candidate_id and all fields of the candidates that stand before a batch."""
    return newest(changes.read(spark, f"{root}/records", RECORD, before)).where("not gone").select(*_COLUMNS)


def _last(spark: SparkSession, root: str, before: int) -> int:
    heads = [n for n in changes.folders(spark, f"{root}/heads", "batch") if n < before]
    return spark.read.schema("last long").parquet(f"{root}/heads/batch={heads[-1]:09d}").first()["last"] if heads else -1


def merge(incoming: DataFrame, root: str, number: int, buckets: int = BUCKETS) -> None:
    """Merges a micro-batch: incoming records join the standing one that their most trusted key hits, the earliest on a tie, or are appended.

    Only buckets of keys and positions that the batch touches are read.
    """
    spark = incoming.sparkSession
    new = cut(dedupe.dedupe(incoming).withColumn("in_pos", F.col("pos")))
    asked = cut(new.select("in_pos", F.posexplode(_keys(new)).alias("trust", "key")).withColumn("bucket", _bucket("key", buckets)))
    known = changes.read(spark, f"{root}/keys", KEY, number, changes.numbers(asked, "bucket"))
    gone = changes.read(spark, f"{root}/gone", "pos long", number)
    standing = known.join(asked.select("key").distinct(), "key", "left_semi").join(gone, "pos", "left_anti")
    first = standing.groupBy("key").agg(F.min("pos").alias("old"))
    target = cut(asked.join(first, "key").groupBy("in_pos").agg(F.min_by("old", F.struct("trust", "old")).alias("old")).withColumn("bucket", _bucket("old", buckets)))
    met = changes.read(spark, f"{root}/records", RECORD, number, changes.numbers(target, "bucket"))
    met = newest(met.join(target.select(F.col("old").alias("pos")).distinct(), "pos", "left_semi"))

    last = F.lit(_last(spark, root, number)).cast("long")
    matched = new.join(target.select("in_pos", "old"), "in_pos", "left")
    fresh = dedupe.numbered(matched.where("old is null").select("in_pos"), "in_pos")
    placed = matched.join(fresh, "in_pos", "left").withColumn("component", F.coalesce("old", last + F.col("n")))
    place = F.when(F.col("old").isNotNull(), last + 1 + F.col("in_pos")).otherwise(F.col("component"))
    own = met.withColumn("component", F.col("pos")).select("component", *_COLUMNS)
    both = own.unionByName(placed.select("component", place.alias("pos"), "candidate_id", *dedupe.FIELDS))
    merged = dedupe.merge_groups(both, keep_identity=True).withColumn("pos", F.col("component")).select(*_COLUMNS)
    merged = cut(merged.withColumn("gone", F.lit(False)).withColumn("bucket", _bucket("pos", buckets)))

    keys = merged.select("pos", F.explode(F.array_distinct(_keys(merged))).alias("key")).withColumn("bucket", _bucket("key", buckets))
    changes.write(keys.join(standing.select("key", "pos"), ["key", "pos"], "left_anti"), f"{root}/keys", number)
    changes.write(merged, f"{root}/records", number)
    heads = merged.agg(F.greatest(F.coalesce(F.max("pos"), last), last).alias("last"))
    changes.write(heads, f"{root}/heads", number, bucket=False)


def retract(spark: SparkSession, root: str, number: int, candidate_ids: DataFrame, buckets: int = BUCKETS) -> None:
    """Writes tombstones, as a batch of their own, for candidates (candidate_id); their keys no longer lead to them, and their positions stay empty."""
    found = cut(snapshot(spark, root, number).join(candidate_ids.select("candidate_id").distinct(), "candidate_id", "left_semi"))
    dead = found.withColumn("gone", F.lit(True)).withColumn("bucket", _bucket("pos", buckets))
    changes.write(dead.select("pos", "bucket"), f"{root}/gone", number)
    changes.write(dead, f"{root}/records", number)


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Makes one base of all batches up to a number: newest versions without tombstones, and their keys."""
    changes.fold(spark, f"{root}/records", upto, newest(changes.read(spark, f"{root}/records", RECORD, upto + 1)).where("not gone").drop("batch"))
    gone = changes.read(spark, f"{root}/gone", "pos long", upto + 1)
    changes.fold(spark, f"{root}/keys", upto, changes.read(spark, f"{root}/keys", KEY, upto + 1).drop("batch").join(gone, "pos", "left_anti").distinct())


def upsert(stream: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS, trigger: dict | None = None):
    """Starts a query that merges each micro-batch of candidates into the table of changes under ``root``."""
    merged = stream.writeStream.foreachBatch(lambda batch, number: merge(batch, root, number, buckets))
    return merged.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
