"""Language identification by rank-order profiles.

Method.  Each language has a profile: its most frequent letter n-grams (one to three letters, word
boundaries marked), in order of frequency.  A document's own most frequent n-grams are ranked alike, and
the distance to a language is the sum over them of how far each is out of place in the profile, or the profile
length where it is missing.  The nearest language wins, ties going to the smaller name.

Fit.  Profiles come from at most ``DOCS_PER_LANG`` documents of each language outside the held-out part (those
with the smallest hash of doc_id), counted whole by a Spark aggregation; only the profiles reach the driver.

Defined cases: text that is null or has no letter (marks alone are none) gives ``und`` with score 0; rows with a null language or id teach nothing;
repeated rows are answered each for itself; texts of any length are read whole; without anything to learn from, everything is ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import held_out, keep_rows, sole_cache, table, text_rows

PROFILE = 400
DOCS_PER_LANG = 400
#: Share of the largest distance over which confidence falls by the factor e.
TEMPERATURE = 0.03
#: Confidence below which a filter takes the language as unknown.
LEAST_SCORE = 0.3

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point 2 if it is a letter, 1 if it is a mark, which may be part of one, else 0."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter(("ML".find(unicodedata.category(chr(i))[0]) + 1 for i in range(0x110000)), np.int8, 0x110000))
    return _LETTERS[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams as integers (21 bits a letter, 0 a word boundary), and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kind = _letters()[codes]
    codes = np.where(kind > 0, codes, 0)
    if not (kind == 2).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]  # one boundary between words
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    inner = b != 0
    pairs = (codes[:-1] << 21 | codes[1:]) + (1 << 42)
    triples = (a << 42 | b << 21 | c)[inner] + (np.int64(1) << 62)
    return np.unique(np.concatenate((b[inner], pairs, triples)), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent keys, ties to the smaller key (keys come sorted)."""
    if len(keys) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.argsort(-counts, kind="stable")][:most]


class Profiles:
    """Rank of each known n-gram in each language; ``size`` where the language lacks it."""

    def __init__(self, of: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(of), size
        self.keys = np.unique(np.array([k for x in of.values() for k in x], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), size, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, np.array(of[lang], np.int64)), j] = np.arange(len(of[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        keys, counts = ngrams(text)
        if not len(keys):
            return "und", 0.0
        top = ranked(keys, counts, self.size)
        at = np.searchsorted(self.keys, top)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != top)] = len(self.keys)
        ranks = self.ranks[at]
        away = np.where(ranks < self.size, np.abs(ranks - np.arange(len(top))[:, None]), self.size).sum(0)
        best = int(away.argmin())
        odds = np.exp(-(away - away[best]) / (TEMPERATURE * self.size * len(top)))
        return self.langs[best], float(odds[best] / odds.sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sole_cache("langid")
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys, counts = ngrams(text.as_py() or "")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, size: int = PROFILE) -> Profiles:
    """Profiles from documents with a known language outside the held-out part."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # Cut in every hash range of ids first, so no task ranks all documents of a language.
    hashed = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    few = hashed.withColumn("n", F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id"))).where(F.col("n") <= docs_per_lang)
    chosen = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= docs_per_lang)
    ids = chosen.select("doc_id").distinct()  # bounded: docs_per_lang rows a language
    texts = usable.where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi")
    counted = texts.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_counts, "lang string, gram long, n long")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    of: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").collect():  # size rows a language
        of.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(of, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score for every document; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("langid")
        for batch in batches:
            out = [shared.value.predict(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return text_rows(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, with all their columns, whose language can be told."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return keep_rows(docs, lambda texts: [lang != "und" and score >= least for lang, score in map(shared.value.predict, texts)])


def op5_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_rank_order_language": op5_rank_order_language}
SQL: dict[str, str] = {}
