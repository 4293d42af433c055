"""What both vector searches share: usable rows, bounded samples, and scoring inside cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates, and queries, that a cell holds on average.
CELL_ROWS, CELL_QUERIES = 4_000, 2_000


def usable(table: DataFrame, nonzero: bool) -> DataFrame:
    """(row, vec_id, v): doubles, all of one length, with a number for each row.  To be stashed, which fixes the numbers.

    Left out: null ids, vectors that are null, empty or hold null or non-finite components (if asked, also zero vectors), and vectors
    of another length than most have.  Rows that repeat an id, or all of a row, each take part, as queries and as candidates.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine & (F.size("v") > 0))
    if nonzero:
        kept = kept.where(F.exists("v", lambda x: x != 0))
    sizes = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    kept = kept.where(F.size("v") == (sizes[0]["n"] if sizes else 0))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's vectors as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows, np.float64)], pa.binary())


def unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def sample(vectors: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``rows`` vectors, those with the smallest hash of their row's number, and these numbers."""
    found = vectors.orderBy(F.xxhash64("row"), "row").limit(rows).select("row", "v").collect()
    return np.array([r["row"] for r in found], np.int64), np.array([r["v"] for r in found])


def mixed(rows: np.ndarray) -> np.ndarray:
    """Numbers of rows, spread evenly over 31 bits."""
    return (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


#: Rows that are dealt to cells, as (cell, row, id, x).
DEALT = "cell long, row long, id long, x binary"


def dealt(cell: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), packed(x)], ["cell", "row", "id", "x"])


def best_in_cells(queries: DataFrame, candidates: DataFrame, top: Callable[[np.ndarray, np.ndarray], np.ndarray], exact: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, kind: str) -> DataFrame:
    """row, query_id, rank, vec_id, score: for each row of queries the k best of all cells.

    Queries and candidates (both as ``DEALT``) meet in cells, which are small by construction; no row is a candidate of its own.  ``top`` scores all
    pairs of a cell quickly, ``exact`` row by row those that may be among the best; ties go to the smaller vec_id.
    """

    def run(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        names = ["row", "query_id", "vec_id", "score"]
        if q.empty or s.empty:
            return pd.DataFrame({n: [] for n in names})
        x, y, ids, held = unpacked(q["x"]), unpacked(s["x"]), s["id"].to_numpy(), s["row"].to_numpy()
        asking = list(zip(q["row"].to_numpy(), q["id"].to_numpy(), strict=True))
        out: list[tuple] = []
        for begin in range(0, len(x), 256):
            part = x[begin : begin + 256]
            scores = top(part, y)
            for i, (own, query_id) in enumerate(asking[begin : begin + 256]):
                row = scores[i]
                row[held == own] = -np.inf
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    at = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
                else:
                    at = np.arange(len(row))
                at = at[held[at] != own]
                fine = exact(part[i], y[at])
                for j in np.lexsort((ids[at], -fine))[:k]:
                    out.append((own, query_id, ids[at[j]], fine[j]))
        return pd.DataFrame(out, columns=names)

    met = queries.groupBy("cell").cogroup(candidates.groupBy("cell")).applyInPandas(run, f"row long, query_id long, vec_id long, score {kind}")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("row", "query_id", "rank", "vec_id", "score")


def batches_of(fn: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]):
    """mapInArrow function that hands each batch's numbers of rows, ids and vectors to ``fn``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)), matrix(batch.column(2)))

    return run
