"""Exact top-k inner products by a Voronoi join.

Method.  Inner products become distances: with R the largest candidate norm, a candidate s is lifted to
(s, sqrt(R^2 - |s|^2)) and a query q to (q, 0); then |q - s|^2 = |q|^2 + R^2 - 2 q.s, so nearest means largest product.  Pivots
cut the lifted space into Voronoi cells, for queries and candidates alike.  Summaries hold, for each cell, the k + 1 candidates nearest to its pivot
(one more, as a query is no candidate of its own); with them the triangle inequality bounds the k-th distance of a cell's queries.
Solving each query among (a bounded part of) its own cell's candidates gives it a closer bound theta.  From these come the summaries
of pairs of cells, least and largest distance to the other pivot less and plus theta, and whether the hyperplane between the pivots is within theta:
a candidate is replicated only to those cells of queries whose bounds it meets.  What a cell of queries gets is solved
locally with exact integer products, and the lists are merged.

Scale.  Pivots grow with the square root of the table up to ``MOST_PIVOTS``; only summaries, whose size is pivots squared, reach the driver.  Cells with
few queries are bundled up to ``CELL_QUERIES``, so a candidate is sent once to a bundle, and crowded cells (one vector that a third of
the rows share) are dealt over several bundles; candidates of a bundle are dealt over blocks of ``CELL_ROWS``, as many as it gets.

Defined cases: see ``vectors.usable``; every row whose id is asked for is a query, so rows that repeat an id each give a list under it, and find
each other; fewer than k candidates give shorter lists; ties go to the smaller vec_id; vectors are never cut, whatever their length; a table
without usable rows gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm import vectors
from quarrylight.llm.common import stash, table

LEAST_PIVOTS, MOST_PIVOTS, SAMPLE = 16, 256, 2048


def pick_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots, then a few rounds of moving each to the mean of its group."""
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(points)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
    pivots = points[chosen].copy()
    for _ in range(5):
        group = distances(points, pivots).argmin(1)
        for g in np.unique(group):
            pivots[g] = points[group == g].mean(0)
    return pivots


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def lifted(x: np.ndarray, square: float, query: bool) -> np.ndarray:
    return np.column_stack((x, np.zeros(len(x)) if query else np.sqrt(np.maximum(square - (x * x).sum(1), 0))))


def thresholds(pivots: np.ndarray, radius: dict[int, float], nearest: dict[int, list[float]], k: int) -> dict[int, float]:
    """For each query group the bound within which its queries have k candidates besides themselves."""
    between = distances(pivots, pivots)
    out = {}
    for i, r in radius.items():
        bounds = sorted(r + between[i, j] + d for j, ds in nearest.items() for d in ds)
        out[i] = bounds[k] if len(bounds) > k else np.inf
    return out


def bundles(pivots: np.ndarray, asked: dict[int, int], most: int) -> tuple[dict[int, np.ndarray], int]:
    """For each cell the numbers of the bundles that its queries are dealt to, and how many bundles there are.

    Cells are walked from each to the nearest not yet met, so that neighbours share a bundle.
    """
    between = distances(pivots, pivots)
    left, at, order = set(asked), min(asked), []
    while left:
        at = min(left, key=lambda g: (between[at, g], g))
        order.append(at)
        left.discard(at)
    out: dict[int, np.ndarray] = {}
    now, held = 0, 0
    for g in order:
        decks = -(-asked[g] // most)
        if decks > 1 or held + asked[g] > most:
            now, held = now + (held > 0), 0
        out[g] = np.arange(now, now + decks)
        now, held = (now + decks, 0) if decks > 1 else (now, held + asked[g])
    return out, now + (held > 0)


def product_search(embeddings: DataFrame, k: int, every: int = 50, scale: int = 256, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k candidates with the largest integer product for each query (vec_id divisible by ``every``)."""
    known = vectors.usable(embeddings, nonzero=False).select("row", "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    known = stash(known, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, square = known.agg(F.count("*"), F.max(norm)).first()
    empty = "query_id long, rank int, vec_id long, score long"
    queries = known.where(F.pmod("vec_id", F.lit(every)) == 0)
    if total < 2 or not queries.limit(1).count():
        return embeddings.sparkSession.createDataFrame([], empty)
    count = pivots or min(max(isqrt(total), LEAST_PIVOTS), MOST_PIVOTS)
    centres = pick_pivots(lifted(vectors.sample(known, SAMPLE)[1], square, False), count)
    cells, between = len(centres), distances(centres, centres)
    slack = 1e-6 * (1 + square**0.5)  # of floating-point distances; products are exact

    def exact(q: np.ndarray, s: np.ndarray) -> np.ndarray:
        return s.astype(np.int64) @ q.astype(np.int64)

    def radii(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        d = distances(lifted(x, square, True), centres)
        group = d.argmin(1)
        yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(d[np.arange(len(d)), group])], ["g", "d"])

    def closest(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        d = distances(lifted(x, square, False), centres)
        group, low = d.argmin(1), d.min(1)
        g, at, n = [], [], []
        for i in np.unique(group):
            mine = np.flatnonzero(group == i)
            mine_first = mine[np.argsort(low[mine])[: k + 1]]
            g += [i] * len(mine_first)
            at += list(low[mine_first])
            n += [len(mine)] + [0] * (len(mine_first) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(at, pa.float64()), pa.array(n, pa.int64())], ["g", "d", "n"])

    found = queries.mapInArrow(vectors.batches_of(radii), "g int, d double").groupBy("g").agg(F.max("d").alias("d"), F.count("*").alias("n")).collect()
    radius, asked = {r["g"]: r["d"] + slack for r in found}, {r["g"]: r["n"] for r in found}
    order = Window.partitionBy("g").orderBy("d")
    listed = stash(known.mapInArrow(vectors.batches_of(closest), "g int, d double, n long"), "nearest")
    nearest: dict[int, list[float]] = {}
    for r in listed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).collect():
        nearest.setdefault(r["g"], []).append(r["d"] + slack)
    theta = thresholds(centres, radius, nearest, k)
    groups = np.array(sorted(radius))
    sizes = np.ones(cells)
    for r in listed.groupBy("g").agg(F.sum("n").alias("n")).collect():
        sizes[r["g"]] = r["n"]
    share = np.minimum(1.0, vectors.CELL_ROWS / sizes)  # of a cell's candidates that serve for the bound
    dealt_to, number = bundles(centres, asked, vectors.CELL_QUERIES)

    def bundle_of(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
        return np.array([dealt_to[g][i % len(dealt_to[g])] for g, i in zip(group.tolist(), vectors.mixed(rows).tolist(), strict=True)], np.int64)

    # Each query among its own cell's candidates.  Decks of a crowded cell's queries each get the same candidates.
    decks = {g: len(dealt_to[g]) for g in asked}
    widest = max(decks.values())

    def own_queries(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = distances(lifted(x, square, True), centres).argmin(1)
        deck = np.array([i % decks[g] for g, i in zip(group.tolist(), vectors.mixed(rows).tolist(), strict=True)], np.int64)
        yield vectors.dealt(group * widest + deck, rows, ids, x)

    def own_candidates(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = distances(lifted(x, square, False), centres).argmin(1)
        chosen = np.flatnonzero((vectors.mixed(rows) % 1_000_003 < share[group] * 1_000_003) & np.isin(group, groups))
        for deck in range(widest):
            at = chosen[[decks[g] > deck for g in group[chosen].tolist()]]
            yield vectors.dealt(group[at] * widest + deck, rows[at], ids[at], x[at])

    near = (queries.mapInArrow(vectors.batches_of(own_queries), vectors.DEALT), known.mapInArrow(vectors.batches_of(own_candidates), vectors.DEALT))
    own = vectors.best_in_cells(*near, lambda q, s: q @ s.T, exact, k, "long")
    kth = own.where(F.col("rank") == k).select("row", "score")
    bounded = stash(queries.join(kth, "row", "left").select("vec_id", "v", F.col("score").cast("double").alias("score")), "bounds")

    def pair_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each cell of queries: reach, and for every other cell least and largest distance to its pivot, widened, and how near its hyperplane comes."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x, score = vectors.matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            d = distances(lifted(x, square, True), centres)
            group = d.argmin(1)
            own_d = d[np.arange(len(d)), group]
            t = np.array([theta[g] for g in group.tolist()])
            real = np.sqrt(np.maximum((x * x).sum(1) + square - 2 * score, 0)) + slack
            t = np.where(np.isnan(real), t, np.minimum(t, real))
            apart = between[group]
            with np.errstate(divide="ignore", invalid="ignore"):
                wall = np.where(apart > 0, (d * d - (own_d * own_d)[:, None]) / (2 * apart), -np.inf)
            out = []
            for g in np.unique(group).tolist():
                m = group == g
                out.append((g, float((own_d[m] + t[m]).max()) + slack, (d[m] - t[m, None]).min(0) - slack, (d[m] + t[m, None]).max(0) + slack, (wall[m] - t[m, None]).min(0) - slack))
            lists = [pa.array([r[i].tolist() for r in out], pa.list_(pa.float64())) for i in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.float64()), *lists], ["g", "reach", "low", "high", "wall"])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        low, high, wall = (np.array(part[c].tolist()) for c in ("low", "high", "wall"))
        return pd.DataFrame({"g": [part["g"].iloc[0]], "reach": [part["reach"].max()], "low": [low.min(0).tolist()], "high": [high.max(0).tolist()], "wall": [wall.min(0).tolist()]})

    schema = "g int, reach double, low array<double>, high array<double>, wall array<double>"
    summary = {r["g"]: r for r in bounded.mapInArrow(pair_bounds, schema).groupBy("g").applyInPandas(merged, schema).collect()}  # a row a cell
    reach = np.array([summary[g]["reach"] for g in groups.tolist()])
    low, high, wall = (np.array([summary[g][c] for g in groups.tolist()]) for c in ("low", "high", "wall"))
    member = np.zeros((len(groups), number), bool)
    for i, g in enumerate(groups.tolist()):
        member[i, dealt_to[g]] = True

    def wanted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates and the bundles they go to."""
        d = distances(lifted(x, square, False), centres)
        cell = d.argmin(1)
        e = d[np.arange(len(d)), cell][:, None]
        admitted = (d[:, groups] <= reach) & (low[:, cell].T <= e) & (e <= high[:, cell].T) & (wall[:, cell].T <= 0)
        return np.nonzero(admitted.astype(np.float32) @ member.astype(np.float32) > 0)

    def counted(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        to, n = np.unique(wanted(x)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(n, pa.int64())], ["bundle", "n"])

    blocks = np.ones(number, np.int64)
    for r in known.mapInArrow(vectors.batches_of(counted), "bundle long, n long").groupBy("bundle").agg(F.sum("n").alias("n")).collect():  # a row a bundle
        blocks[r["bundle"]] = -(-r["n"] // vectors.CELL_ROWS)
    first = np.concatenate(([0], np.cumsum(blocks)))

    def deal(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, to = wanted(x)
        yield vectors.dealt(first[to] + vectors.mixed(rows[at]) % blocks[to], rows[at], ids[at], x[at])

    def ask(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        bundle = bundle_of(rows, distances(lifted(x, square, True), centres).argmin(1))
        at = np.repeat(np.arange(len(ids)), blocks[bundle])
        cell = np.concatenate([np.arange(first[b], first[b + 1]) for b in bundle.tolist()])
        yield vectors.dealt(cell, rows[at], ids[at], x[at])

    asking, given = queries.mapInArrow(vectors.batches_of(ask), vectors.DEALT), known.mapInArrow(vectors.batches_of(deal), vectors.DEALT)
    return vectors.best_in_cells(asking, given, lambda q, s: q @ s.T, exact, k, "long").drop("row")


def op2_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_search(table(spark, sf_dir, "embeddings"), k=5)


QUERIES = {"op2_voronoi_topk": op2_voronoi_topk}
SQL = {
    "op2_voronoi_topk": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n AS n, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
