"""Approximate nearest neighbours by learned partitions.

Method.  On a bounded sample the exact neighbour graph is cut into parts of equal size with few edges
across (greedy assignment, then moves that keep the balance).  A small network with one hidden layer learns, from a vector, the
parts that its neighbours lie in.  Every vector of the table is indexed under its most probable part; a query
visits its most probable parts, where cosines are exact.  How many is measured against the table: some of the sample, the judges, are kept from learning,
their true nearest are found among all rows, and as many parts are visited as hold ``RECALL`` of these (more if they hold too few rows).

Scale.  Parts grow with the table, up to ``MOST_PARTS``.  The sample (at most 64 vectors for each of 512 parts, at least ``SAMPLE``) is all that the driver sees; the network is
a few hundred kilobytes.  The judges cost one pass over the index, in which a task holds k rows a judge.  The index is a table
keyed by part and block; a part that holds much of the table is dealt over more blocks, so no cell is large.

Defined cases: see ``vectors.usable`` (zero vectors too are left out); every row whose id is asked for is a query, so rows that repeat an id each give a list
under it, and find each other; fewer than k candidates give shorter lists; ties go to the smaller vec_id; vectors are never cut, whatever their length; a
table without usable rows gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm import vectors
from quarrylight.llm.common import stash, table

SAMPLE, NEIGHBOURS = 4096, 10
HIDDEN = 128
#: Parts at least and at most; there is one for each PART_ROOT of the square root of the table's rows.
LEAST_PARTS, MOST_PARTS, PART_ROOT = 8, 512, 14
#: Sampled vectors for each part, where parts are so many that SAMPLE would not do.
PART_SAMPLE = 64
#: Sampled vectors, kept from learning, whose nearest in the whole table tell how many parts to visit.
JUDGES = 256
#: Share of the judges' neighbours that the visited parts hold.
RECALL = 0.94


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, by cosine."""
    near = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 512):
        sims = x[at : at + 512] @ x.T
        sims[np.arange(len(sims)), at + np.arange(len(sims))] = -np.inf
        near[at : at + 512] = np.argpartition(-sims, near.shape[1] - 1, 1)[:, : near.shape[1]]
    return near


def balanced_parts(near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Parts of nearly equal size that cut few edges: breadth-first growth, then gainful moves and swaps."""
    n = len(near)
    room = -(-n // parts)
    links: list[list[int]] = [list(r) for r in near]
    for i, r in enumerate(near):
        for j in r:
            links[j].append(i)
    part, sizes = np.full(n, -1), np.zeros(parts, np.int64)
    seeds, current = iter(range(n)), 0
    queue: list[int] = []
    done = 0
    while done < n:
        if sizes[current] >= room:
            current, queue = current + 1, []
        i = queue.pop(0) if queue else next(s for s in seeds if part[s] < 0)
        if part[i] >= 0:
            continue
        part[i] = current
        sizes[current] += 1
        done += 1
        queue += [j for j in links[i] if part[j] < 0]
    most = int(room * 1.05) + 1
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            votes = np.bincount(part[links[i]], minlength=parts)
            votes[sizes >= most] = -1
            votes[part[i]] = np.count_nonzero(part[links[i]] == part[i])
            best = int(votes.argmax())
            if votes[best] > votes[part[i]] and best != part[i]:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Vector -> probability of each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int, epochs: int = 40):
        rng = np.random.default_rng(7)
        d, parts = x.shape[1], target.shape[1]
        self.w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
        m, v, step = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                a, t = x[rows], target[rows]
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                g = (self._soft(h @ self.w[2] + self.w[3]) - t) / len(rows)
                back = (g @ self.w[2].T) * (h > 0)
                step += 1
                for i, grad in enumerate((a.T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ g + 1e-4 * self.w[2], g.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    self.w[i] = self.w[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._soft(np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def parts_of_nearest(index: DataFrame, numbers: np.ndarray, judges: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(judge, part) for the k vectors of the whole index that are nearest to each of a few judges, which are rows of it."""
    asked = units(judges)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's k nearest of every judge; only these are held from batch to batch."""
        score, part = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            rows = batch.column(1).to_numpy(zero_copy_only=False)
            sims = np.where(rows[None] == numbers[:, None], -np.inf, asked @ units(x).T)
            score = np.column_stack((score, sims))
            part = np.column_stack((part, np.broadcast_to(batch.column(0).to_numpy(zero_copy_only=False), sims.shape)))
            first = np.argpartition(-score, k - 1, 1)[:, :k]
            score, part = np.take_along_axis(score, first, 1), np.take_along_axis(part, first, 1)
        judge, at = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(judge.astype(np.int32)), pa.array(part[judge, at].astype(np.int32)), pa.array(score[judge, at])], ["judge", "part", "score"])

    order = Window.partitionBy("judge").orderBy(F.desc("score"), "part")
    near = index.select("part", "row", "x").mapInArrow(best, "judge int, part int, score double").withColumn("n", F.row_number().over(order))
    return [(r["judge"], r["part"]) for r in near.where(F.col("n") <= k).select("judge", "part").collect()]  # k rows a judge


def probes_for(router: Router, judges: np.ndarray, found: list[tuple[int, int]], recall: float) -> int:
    """The fewest parts that, visited in each judge's order, hold that share of the judges' nearest."""
    place = np.argsort(np.argsort(-router(units(judges)), 1, kind="stable"), 1)  # of each part in each judge's order
    needed = np.sort([place[judge, part] + 1 for judge, part in found])
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1])


def learn(x: np.ndarray, parts: int, hidden: int = HIDDEN) -> Router:
    x = units(x)
    near = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(near, min(parts, len(x)))
    target = np.zeros((len(x), min(parts, len(x))))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1] + 1), part[np.column_stack((near, np.arange(len(x))))].ravel()), 1.0)
    return Router(x, target / target.sum(1, keepdims=True), hidden)


def cosine_search(embeddings: DataFrame, k: int, every: int = 50, parts: int | None = None, probes: int | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query (vec_id divisible by ``every``)."""
    known = stash(vectors.usable(embeddings, nonzero=True), "vectors")
    queries = known.where(F.pmod("vec_id", F.lit(every)) == 0)
    total, asked = known.count(), queries.count()
    if total < 2 or not asked:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = parts or min(max(isqrt(total) // PART_ROOT, LEAST_PARTS), MOST_PARTS)
    numbers, some = vectors.sample(known, max(SAMPLE, PART_SAMPLE * parts))
    judges = min(len(some) // 5, JUDGES) if probes is None and len(some) // 5 > 2 * k else 0
    router = learn(some[judges:], parts)
    spread = embeddings.sparkSession.sparkContext.broadcast(router)

    def place(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(spread.value(units(x)).argmax(1).astype(np.int32)), pa.array(rows), pa.array(ids), vectors.packed(x)], ["part", "row", "vec_id", "x"])

    index = stash(known.mapInArrow(vectors.batches_of(place), "part int, row long, vec_id long, x binary"), "index")
    held = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    parts = router.w[3].size
    if judges:
        probes = probes_for(router, some[:judges], parts_of_nearest(index, numbers[:judges], some[:judges], k), recall)
    probes = probes or parts  # too few rows to measure: all are visited
    size = np.array([held.get(p, 0) for p in range(parts)])
    blocks = np.maximum(1, -(-size // (vectors.CELL_ROWS // 2)))  # parts vary in size: smaller cells even that out
    first, decks = np.concatenate(([0], np.cumsum(blocks))), -(-asked // vectors.CELL_QUERIES)

    def visit(rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(-spread.value(units(x)), 1, kind="stable")
        enough = (np.cumsum(size[order], 1) > k).argmax(1)
        enough = np.where(np.cumsum(size[order], 1)[:, -1] > k, enough, parts - 1)
        take = np.maximum(probes, enough + 1)
        at, cells, deck = [], [], (vectors.mixed(rows) % decks).tolist()
        for i, row in enumerate(order):
            for p in row[: take[i]]:
                for b in range(blocks[p]):
                    at.append(i)
                    cells.append((first[p] + b) * decks + deck[i])
        yield vectors.dealt(np.array(cells, np.int64), rows[at], ids[at], x[at])

    asking = queries.mapInArrow(vectors.batches_of(visit), vectors.DEALT)
    def of_part(values: np.ndarray) -> Column:
        return F.element_at(F.array(*map(F.lit, values.tolist())), F.col("part") + 1)

    block = of_part(first[:-1]) + F.pmod(F.xxhash64("row"), of_part(blocks))
    given = index.select(F.explode(F.sequence(F.lit(0), F.lit(decks - 1))).alias("deck"), block.alias("block"), "row", F.col("vec_id").alias("id"), "x")
    given = given.select((F.col("block") * decks + F.col("deck")).cast("long").alias("cell"), "row", "id", "x")

    def exact(q: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (s * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((s * s).sum(1)))

    return vectors.best_in_cells(asking, given, lambda q, s: units(q) @ units(s).T, exact, k, "double").drop("row")


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_search(table(spark, sf_dir, "embeddings"), k=5)


QUERIES = {"op9_learned_partitions": op9_learned_partitions}
SQL: dict[str, str] = {}
