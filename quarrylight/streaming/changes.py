"""Change files: state that grows by what a micro-batch changes.

A table is a folder of batches.  Batch n's rows lie in ``batch=n/bucket=b`` and are complete once their ``_SUCCESS`` file is there; a batch that
is run again overwrites its own folder and reads only the ones before it, so nothing counts twice.  ``base=n`` holds
all that the batches up to n came to; readers start from the newest base before their batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folders(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the complete folders ``<kind>=<number>`` of a table, in order."""
    fs, at = _path(spark, root)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [n for n in names if n.startswith(f"{kind}=") and fs.exists(_path(spark, f"{root}/{n}/_SUCCESS")[1])]
    return sorted(int(n.partition("=")[2]) for n in done)


def write(df: DataFrame, root: str, number: int, bucket: bool = True) -> None:
    """A batch's rows, by bucket if they have that column; one file a bucket."""
    out = df.repartition("bucket").write.partitionBy("bucket") if bucket else df.write
    out.mode("overwrite").parquet(f"{root}/batch={number:09d}")


def read(spark: SparkSession, root: str, schema: str, before: int, buckets: list[int] | None = None) -> DataFrame:
    """Rows of the newest base and the batches after it, all before a batch, with ``batch`` (a base's number for its rows) and ``bucket``.

    With ``buckets`` only the folders of those are listed and read.
    """
    bases = [n for n in folders(spark, root, "base") if n < before]
    found = [(f"{root}/base={bases[-1]:09d}", bases[-1])] if bases else []
    found += [(f"{root}/batch={n:09d}", n) for n in folders(spark, root, "batch") if n < before and (not bases or n > bases[-1])]
    rows = spark.createDataFrame([], f"{schema}, bucket int, batch long")
    for path, number in found:
        part = spark.read.schema(f"{schema}, bucket int").parquet(path)
        rows = rows.unionByName(part.withColumn("batch", F.lit(number).cast("long")), allowMissingColumns=True)
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets)) if buckets else rows.where("false")


def fold(spark: SparkSession, root: str, number: int, rows: DataFrame) -> None:
    """Makes the given rows (all that the batches up to ``number`` came to) the base, and drops the batches that an earlier base already holds."""
    bases = folders(spark, root, "base")
    rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/base={number:09d}")
    fs, _ = _path(spark, root)
    for n in folders(spark, root, "batch"):  # the batches since then stay for readers that began before
        if bases and n <= bases[-1]:
            fs.delete(_path(spark, f"{root}/batch={n:09d}")[1], True)
    for n in bases[:-1]:
        fs.delete(_path(spark, f"{root}/base={n:09d}")[1], True)


def size(spark: SparkSession, root: str, number: int) -> int:
    """Bytes that a batch wrote."""
    fs, at = _path(spark, f"{root}/batch={number:09d}")
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def numbers(df: DataFrame, column: str) -> list[int]:
    """The distinct bucket numbers of a batch; there are no more than buckets."""
    return sorted(r[0] for r in df.select(column).distinct().collect())
