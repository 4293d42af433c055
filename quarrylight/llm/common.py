"""Helpers shared by the training-data operators: table access, durable cuts, row identity, id folds."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.plans.common import table  # noqa: F401  (the operators read their tables through this module)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Taken from ``spark.checkpoint.dir``; a folder of our own only where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quarrylight-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Whether shuffle files go as soon as their query ends, not when the driver's heap is next collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it back.  It goes when the application ends; what was shuffled for it goes at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3.  Remainder 1 is the held-out part."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % 3


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a table of ids that may be broadcast (16 MB of longs).
BROADCAST_ROWS = 2_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table marked for broadcast if it has few rows; else as it is, for a shuffled join."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


#: Bytes of text, and rows, that a worker handles at once; rows that are sent to it at once.
SLICE_BYTES, SLICE_ROWS, BATCH_ROWS = 3_000_000, 2_048, 1_000


def text_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as a number and text as a string (with the columns asked for besides), sent to workers in batches that suit rows of text.

    Batches of Spark's 10,000 rows would hold tens of megabytes of text in the JVM and in each worker at once.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(key)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(key, BATCH_ROWS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded size, at least one row each; column ``text`` holds the texts."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and (held + size > SLICE_BYTES or i - begin >= SLICE_ROWS):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


#: Bytes of a text that are split into words at once.
PIECE = 1 << 20


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text whose separators are blanks, in lists of bounded length."""
    begin = 0
    while begin < len(data):
        cut = data.find(b" ", begin + PIECE)
        end = cut if cut >= 0 else len(data)
        yield data[begin:end].split()
        begin = end


def keep_rows(docs: DataFrame, decide) -> DataFrame:
    """The rows, with all their columns, for whose texts ``decide`` (list of texts or nulls -> list of bool) says yes."""
    at = docs.columns.index("text")
    text_rows(docs)

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(decide(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_CACHES: dict[str, Callable[[], object]] = {}


def sole_cache(name: str, clear: Callable[[], object] = lambda: None) -> None:
    """At the start of an operator's work in a worker, let the caches that other operators left there go, back to the system.

    Workers live on from job to job, so a pipeline would gather the caches of all its stages.
    """
    if name in _CACHES:
        return
    others = list(_CACHES.values())
    _CACHES.clear()
    _CACHES[name] = clear
    for other in others:
        other()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: the memory is reused, but not given back
            pass
