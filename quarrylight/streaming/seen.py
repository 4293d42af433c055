"""Process once, for ever: keys are remembered in buckets behind Bloom filters, without a horizon after which they are forgotten.

A micro-batch first asks the filters of its buckets, which fit in memory; only keys that may have been seen are compared with the stored ones,
and only in their buckets.  Filters have a fixed size, so a full one sends more keys to the comparison and changes no answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.tables import cut
from quarrylight.streaming import changes

BUCKETS, FILTER_BYTES, PROBES = 64, 1 << 16, 4
SEEN = "key binary"
FILTER = "bits binary"


def _keyed(rows: DataFrame, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """row (all columns), key (16 bytes), bucket, place: what one row of a key is chosen by."""
    every = F.struct(*rows.columns)
    key = F.unhex(F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})))
    packed = rows.select(every.alias("row"), key.alias("key"), F.struct(*order, every.alias("row")).alias("place"))
    return packed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def _probes(keys: pd.Series) -> np.ndarray:
    """Positions of each key's bits, from four parts of its digest."""
    return np.frombuffer(b"".join(keys), "<u4").reshape(len(keys), PROBES) % np.uint32(8 * FILTER_BYTES)


def _bits(stored: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(stored["bits"].iat[0], np.uint8).copy() if len(stored) else np.zeros(FILTER_BYTES, np.uint8)


def _perhaps(keys: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
    """The keys of a bucket whose bits are all set."""
    if keys.empty:
        return keys[["key", "bucket"]]
    at, bits = _probes(keys["key"]), _bits(stored)
    return keys.loc[(bits[at >> 3] >> (at & 7) & 1).all(axis=1), ["key", "bucket"]]


def _added(keys: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
    """A bucket's filter with its new keys."""
    if keys.empty:
        return pd.DataFrame({"bucket": [], "bits": []})
    at, bits = _probes(keys["key"]).ravel(), _bits(stored)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return pd.DataFrame({"bucket": [keys["bucket"].iat[0]], "bits": [bits.tobytes()]})


def _filters(spark: SparkSession, root: str, number: int, buckets: list[int]) -> DataFrame:
    """bucket, bits: the newest filter of each bucket."""
    rows = changes.read(spark, f"{root}/filters", FILTER, number, buckets)
    return rows.groupBy("bucket").agg(F.max_by("bits", "batch").alias("bits"))


def unseen(batch: DataFrame, keys: list[str], root: str, number: int, order: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The batch's rows whose key no batch before had, one a key (the first by ``order``, ties by all columns); the keys are remembered under ``root``.

    A batch that is run again gives the same rows.  Null keys are keys.
    """
    spark = batch.sparkSession
    once = cut(_keyed(batch, keys, order or [], buckets).groupBy("bucket", "key").agg(F.min_by("row", "place").alias("row")))
    touched = changes.numbers(once, "bucket")
    filters = cut(_filters(spark, root, number, touched))
    asked = once.select("key", "bucket")
    perhaps = cut(asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_perhaps, "key binary, bucket int"))
    stored = changes.read(spark, f"{root}/keys", SEEN, number, changes.numbers(perhaps, "bucket"))
    known = perhaps.join(stored.select("key"), "key", "left_semi")
    fresh = cut(once.join(known.select("key"), "key", "left_anti"))
    added = fresh.select("key", "bucket").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_added, "bucket int, bits binary")
    changes.write(fresh.select("key", "bucket"), f"{root}/keys", number)
    changes.write(added, f"{root}/filters", number)
    return fresh.select("row.*")


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """One base of all batches up to a number."""
    changes.fold(spark, f"{root}/keys", upto, changes.read(spark, f"{root}/keys", SEEN, upto + 1).drop("batch"))
    changes.fold(spark, f"{root}/filters", upto, _filters(spark, root, upto + 1, list(range(BUCKETS))))


def state_size(spark: SparkSession, root: str, before: int) -> DataFrame:
    """bucket, keys, filled (share of the filter's bits that are set): what is remembered before a batch."""
    keys = changes.read(spark, f"{root}/keys", SEEN, before).groupBy("bucket").agg(F.count("*").alias("keys"))
    newest = changes.read(spark, f"{root}/filters", FILTER, before).groupBy("bucket").agg(F.max_by("bits", "batch").alias("bits"))

    @F.pandas_udf("double")
    def filled(bits: pd.Series) -> pd.Series:
        return bits.map(lambda b: float(np.unpackbits(np.frombuffer(b, np.uint8)).mean()))

    return keys.join(newest, "bucket").select("bucket", "keys", filled("bits").alias("filled"))


def process_once(stream: DataFrame, keys: list[str], root: str, sink: str, checkpoint: str, order: list[str] | None = None, buckets: int = BUCKETS, trigger: dict | None = None):
    """Starts a query that writes each key's first row, whenever it comes, to ``sink``, a folder a batch."""

    def run(batch: DataFrame, number: int) -> None:
        unseen(batch, keys, root, number, order, buckets).write.mode("overwrite").parquet(f"{sink}/batch={number:09d}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
