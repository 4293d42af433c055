"""Filter interaction audit: what each filter of a set removes, in every order, and its fair share of all that is removed.

Method.  Every document gets a bit mask of the filters that it fails.  Masks are counted a part, and of each part the removals of
all coalitions of filters are tabulated (32 for five filters): a coalition removes the documents whose masks meet it.  What a filter
removes as a step of an order is the difference of two coalitions.  Its Shapley value is the exact solution, in rationals, of the
least squares problem that fits the coalitions' removals by sums of the filters' values, weighted by the Shapley kernel, under
the constraint that all values add up to what all filters remove.

Scale.  Texts are read once and leave only a digest and a mask.  Which text was there first comes from a smallest id a
digest, joined back by (digest, id) after equal rows were counted, so copies never meet in one task.  What reaches a part's group
is a row a mask.

Defined cases: null text is empty; a document without id fails the copy test never and has no label; rows that repeat an id and a text count
each, and none is a copy of the other; of labels that repeat an id any mark counts; a null part is the empty string; an empty table
has no parts.  Texts are the same if their SHA-256 is.  Whole texts are read in pieces that end between words.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import slices, sole_cache, stash, table, text_rows, word_lists

#: The filters' letters; a document's mask has bit i for filter i.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_LATER_BYTES = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"
#: Any of the white space that parts words, as a blank.
_BLANKS = bytes(0x20 if i in b"\t\n\v\f\r" else i for i in range(256))


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words, distinct = 0, set()
    for part in word_lists(text.translate(_BLANKS)):
        words += len(part)
        distinct.update(part)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _LATER_BYTES))
    failed = (
        words < LEAST_WORDS,
        100 * len(distinct) < LEAST_DISTINCT * words,
        100 * capitals > MOST_CAPITALS * points,
        len(text) > len(text.translate(None, _MARKS)),
    )
    return sum(bit << i for i, bit in enumerate(failed))


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, mask, n: how many documents of an id and a part fail which filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("audit")
        for batch in batches:
            for rows in slices(batch, 1):
                texts = [(t or "").encode() for t in rows.column(1).to_pylist()]
                digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                masks = pa.array([text_mask(t) for t in texts], pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), digests, masks], ["doc_id", "part", "digest", "mask"])

    rows = text_rows(docs, F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    judged = rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")
    judged = stash(judged.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "audit-masks")
    first = judged.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("doc_id").isNull() | F.col("first").isNotNull(), 0).otherwise(1 << FILTERS.index("E"))
    return judged.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"), "n")


def counted(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and those with a label quality = 1 and toxic = 1."""
    mark = lambda column: F.max(F.coalesce(F.col(column) == 1, F.lit(False)).cast("int")).alias(column)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(mark("quality"), mark("toxic"))
    of = lambda column: F.coalesce(F.sum(F.col("n") * F.col(column)), F.lit(0)).alias("good" if column == "quality" else column)
    return failed.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality"), of("toxic"))


def coalitions(counts: dict[int, int], players: int) -> list[int]:
    """For each set of filters (as a bit mask) how many documents fail any of them."""
    return [sum(n for mask, n in counts.items() if mask & chosen) for chosen in range(1 << players)]


def solved(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system of linear equations, by elimination."""
    rows = [[*row, b] for row, b in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        pivot = next(k for k in range(i, len(rows)) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(len(rows)):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [row[-1] for row in rows]


def shapley(value: list[int], players: int) -> list[Fraction]:
    """The players' Shapley values in a game, given the value of each coalition.

    They minimise the kernel-weighted squares over all coalitions but none and all, under the constraint that they add up to the value of all;
    the constraint's multiplier is the last unknown of the normal equations.
    """
    if players == 1:
        return [Fraction(value[1])]
    everyone = (1 << players) - 1
    matrix = [[Fraction(0)] * players + [Fraction(1)] for _ in range(players)] + [[Fraction(1)] * players + [Fraction(0)]]
    right = [Fraction(0)] * players + [Fraction(value[everyone])]
    for chosen in range(1, everyone):
        size = chosen.bit_count()
        weight = Fraction(players - 1, comb(players, size) * size * (players - size))
        members = [i for i in range(players) if chosen >> i & 1]
        for i in members:
            right[i] += weight * value[chosen]
            for j in members:
                matrix[i][j] += weight
    return solved(matrix, right)[:players]


_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(rows: pd.DataFrame, filters: str) -> pd.DataFrame:
    """The steps of every order of the filters over one part, whose rows (mask, n, good, toxic) are one a mask."""
    players = len(filters)
    n, good, toxic = (dict(zip(rows["mask"].tolist(), rows[c].tolist(), strict=True)) for c in ("n", "good", "toxic"))
    lost, lost_good, lost_toxic = (coalitions(c, players) for c in (n, good, toxic))
    orders = list(permutations(range(players)))
    share = [int(len(orders) * x) for x in shapley(lost, players)]  # whole numbers, as each order adds a whole number
    total, out = sum(n.values()), []
    for order in orders:
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = lost[after] - lost[before]
            out.append((
                rows["part"].iat[0], name, step, total - lost[after], removed, lost[1 << i] - removed, n.get(1 << i, 0),
                lost_good[after] - lost_good[before], lost_toxic[after] - lost_toxic[before], share[i],
            ))
            before = after
    return pd.DataFrame(out, columns=["part", "filter_order", "step", *_COLUMNS])


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from a table of masks (part, mask, n, good, toxic)."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COLUMNS)
    return counts.groupBy("part").applyInPandas(lambda rows: audited(rows, filters), schema)


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(counted(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


QUERIES = {"op12_filter_interactions": op12_filter_interactions}
#: Every order is walked step by step; a Shapley value is the sum over all orders, by definition.
SQL = {
    "op12_filter_interactions": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source::VARCHAR, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(w) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY x), false) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2
), o AS (SELECT '' AS o UNION ALL SELECT o || letter FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(letter) WHERE NOT contains(o, letter)
), s AS (SELECT o AS filter_order, step::INTEGER AS step, o[step] AS letter, o[:step - 1] AS before FROM o, range(1, 6) AS r(step) WHERE length(o) = 5
), m AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails, contains(fails, letter) AS bad,
    before <> '' AND translate(fails, before, '') <> fails AS gone FROM c, s
), steps AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM steps
"""
}
