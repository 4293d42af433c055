"""Tables of our own: in the folder that all executors share, cut from their lineage or bucketed by a key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a folder of our own only on a local master where that is unset."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="quarrylight-")
        spark.sparkContext.setCheckpointDir(place)
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes a table into the shared folder and reads it back, so that iterations have short plans and survive lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a small table that may be broadcast.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """The table marked for broadcast, if a count shows that it has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def write_buckets(df: DataFrame, path: str, key: str, order: list[str], buckets: int, dealt: bool = False) -> DataFrame:
    """Writes rows bucketed by a key, one file a bucket, so that joins and aggregations on the key read them without a shuffle.  ``dealt``: whether they lie so already."""
    name = f"bucketed_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(buckets, key)).write.format("parquet").bucketBy(buckets, key).sortBy(*order).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_buckets(spark: SparkSession, path: str, schema: str, key: str, order: list[str], buckets: int) -> DataFrame:
    """A table that ``write_buckets`` wrote, perhaps in another application."""
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
