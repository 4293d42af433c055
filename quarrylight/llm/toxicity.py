"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Method.  Two tokens are compared by the subsequences of four symbols they share, each weighted by DECAY to the power
of its span; spans go up to SPAN symbols, so that gapped or padded insults still match.  A few landmark
tokens, chosen by pivoted Cholesky, give the Nystroem feature map, in which a squared-hinge support
vector machine is trained on the tokens of labelled sentences.  Its decision is linear in the subsequences, so
for scoring it is folded into one table of subsequence weights.  A text is described by how much insult it holds, in all and as a share of
its words: a word that looks like an insult by chance stands alone, real ones come together.  A logistic curve over these two, fitted to
the sample, makes a probability.  (Fitted to halves judged by models of the other half it came out worse: half the sample knows too few insults.)

Which tokens of a toxic text make it toxic is learned too: a token is taken as insulting if, of its distinct
contexts (neighbouring words), far more than chance would give stand in toxic texts.  Counting contexts,
not texts, keeps copies of one text from making all of its words look toxic.

Fit.  On at most ``TEXTS`` toxic and three times as many clean labelled texts outside the held-out part (those with the smallest hash of
doc_id), read whole.  Contexts are counted by Spark; what reaches the driver is bounded by ``POSITIVE`` and
``NEGATIVE`` tokens and a few numbers per sampled text.

Defined cases: null or empty texts get the score of a text without any known token; texts of any length are read whole; labels that are null teach
nothing; repeated rows are scored each for itself; without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import held_out, keep_rows, slices, sole_cache, stash, table, text_rows

TEXTS = 1200
POSITIVE, NEGATIVE = 600, 8000
LANDMARKS = 160
SPAN, DECAY = 6, 0.6
#: Log-likelihood ratio from which a token's share of toxic contexts is not chance.
EVIDENCE = 10.0
#: Share of a token's kernel that earlier landmarks must leave unexplained for it to become one.
UNEXPLAINED = 0.2
COST = 10.0
#: Decision from which plain words are used for a second training.
NEAR = -0.5
#: Ridge on the logistic curve's slopes, as a share of the sample; only keeps the curve finite where classes part cleanly.
SOFT = 1e-3
#: Share of insult below which texts count as free of it, and the decision from which a token is insult in part (from 1 on it is in whole).
TRACE, PART = 0.001, 0.25
THRESHOLD = 0.7
LONGEST = 40
CACHE_TOKENS = 200_000

#: Offsets of the later three symbols of a subsequence, with its weight.
_SHAPES = [((b, c, d), DECAY ** (d + 1)) for b in range(1, SPAN) for c in range(b + 1, SPAN) for d in range(c + 1, SPAN)]
_BITS = 5
_SIZE = 1 << 4 * _BITS
_EDGE = 27
#: Bits of a subsequence's number within a token of LONGEST symbols; with its symbols they fit into 31.
_PLACE = 9
#: Letters written apart: three or more single characters in a row.
_APART = re.compile(r"(?<!\S)(?:\S[^\S\n]+){3,}\S(?!\S)")


#: Symbols of accents, which follow their letter: acute, grave, diaeresis, any other.
_MARKS = {"\u0301": "\x1c", "\u0300": "\x1d", "\u0308": "\x1e"}


def _symbols() -> dict[int, str]:
    out = {}
    for i in range(0x250):
        base, *marks = unicodedata.normalize("NFKD", chr(i)).lower()
        if "a" <= base <= "z":
            out[i] = base + "".join(_MARKS.get(m, "\x1f") for m in marks if unicodedata.combining(m))
        else:
            out[i] = {"ß": "ss\x1f", "æ": "ae", "œ": "oe", "ø": "o\x1f"}.get(chr(i).lower(), "")
    return out


_FOLD = _symbols()


#: Symbols of ASCII letters; other ASCII characters are none.
_ASCII = bytes(ord(_FOLD[i]) - 96 if _FOLD[i] else 0 for i in range(128)) + bytes(128)
_NO_LETTERS = bytes(i for i in range(256) if not _ASCII[i])


def letters(word: str) -> bytes:
    """The word's letters as symbols 1 to 26, accents as symbols 28 to 31 behind them, as are letters of other scripts."""
    if word.isascii():
        return word.encode().translate(_ASCII, _NO_LETTERS)
    folded = word.translate(_FOLD)
    if not folded.isascii():
        folded = "".join(c if c <= "z" else chr(28 + ord(c) % 4) for c in folded if c <= "z" or c.isalpha())
    return bytes(ord(c) - 96 if c >= "a" else ord(c) for c in folded)


def words_of(text: str) -> list[str]:
    text = text.lower()
    words = text.split()
    if _APART.search(text):
        words += ["".join(m.split()) for m in _APART.findall(text)]
    return words


def features(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each token (cut into overlapping parts by the caller if long) its subsequences and their weights, padded with weight 0."""
    width = max(map(len, tokens), default=0) + 2
    grid = np.zeros((len(tokens), width + SPAN), np.int64)
    for i, t in enumerate(tokens):
        grid[i, 1 : len(t) + 1] = np.frombuffer(t, np.uint8)
        grid[i, 0] = grid[i, len(t) + 1] = _EDGE
    keys, weights = [], []
    for (b, c, d), w in _SHAPES:
        last = grid[:, d : d + width]
        keys.append(((grid[:, :width] << _BITS | grid[:, b : b + width]) << _BITS | grid[:, c : c + width]) << _BITS | last)
        weights.append(np.where(last > 0, w, 0.0))
    return np.concatenate(keys, 1), np.concatenate(weights, 1)


def unit(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights scaled so that each token's kernel with itself is 1."""
    key = np.where(weights > 0, keys, -1)
    order = np.argsort(key, 1)
    key, w = np.take_along_axis(key, order, 1), np.take_along_axis(weights, order, 1)
    sums = np.cumsum(w, 1)
    last = np.concatenate((key[:, 1:] != key[:, :-1], np.ones((len(key), 1), bool)), 1)
    ends = np.where(last, sums, 0.0)
    before = np.maximum.accumulate(ends, 1)
    own = np.where(last, sums - np.concatenate((np.zeros((len(key), 1)), before[:, :-1]), 1), 0.0)
    norm = np.sqrt((own * own).sum(1, keepdims=True))
    return weights / np.where(norm > 0, norm, 1.0)


@cache
def _starts(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens of n symbols between edges, the places of the four symbols of every subsequence, and the weights."""
    places, weights = zip(*(((a, a + b, a + c, a + d), w) for (b, c, d), w in _SHAPES for a in range(n + 2 - d)), strict=True)
    return np.array(places).T, np.array(weights)


def weighed(tokens: list[bytes], table: np.ndarray) -> np.ndarray:
    """For tokens of one length the sum of their subsequences' weights in the table, times those of ``features`` scaled as ``unit`` does.

    Tokens of one length have their subsequences at the same places, so weights are one row, and numbers short enough for fast sorting say which are equal.
    """
    n = len(tokens[0])
    (a, b, c, d), weights = _starts(n)
    grid = np.full((len(tokens), n + 2), _EDGE, np.int32)
    grid[:, 1:-1] = np.frombuffer(b"".join(tokens), np.uint8).reshape(-1, n)
    keys = ((grid[:, a] << _BITS | grid[:, b]) << _BITS | grid[:, c]) << _BITS | grid[:, d]
    order = np.sort(keys << _PLACE | np.arange(len(weights), dtype=np.int32), axis=1)
    key, w = order >> _PLACE, weights[order & (1 << _PLACE) - 1]
    first = np.concatenate((np.ones((len(key), 1), bool), key[:, 1:] != key[:, :-1]), 1)
    starts = np.flatnonzero(first)
    sums = np.add.reduceat(w.ravel(), starts)
    norm = np.sqrt(np.bincount(starts // len(weights), sums * sums, len(tokens)))
    return np.einsum("ij,j->i", table[keys], weights) / norm


def kernel_column(keys: np.ndarray, weights: np.ndarray, i: int) -> np.ndarray:
    dense = np.zeros(_SIZE)
    np.add.at(dense, keys[i], weights[i])
    return (dense[keys] * weights).sum(1)


def landmarks(keys: np.ndarray, weights: np.ndarray, order: list[int], most: int) -> list[int]:
    """Incomplete Cholesky of the kernel matrix: in the given order, tokens that those chosen before explain badly."""
    left = np.ones(len(keys))
    factor = np.zeros((len(keys), 0))
    chosen: list[int] = []
    for i in order:
        if len(chosen) == most:
            break
        if left[i] > UNEXPLAINED and weights[i].any():
            column = (kernel_column(keys, weights, i) - factor @ factor[i]) / np.sqrt(left[i])
            factor = np.column_stack((factor, column))
            left = np.maximum(left - column * column, 0)
            chosen.append(i)
    return chosen


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Primal Newton steps; the last column of x is constant and serves as the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        active = y * (x @ w) < 1
        a, c = x[active], cost[active]
        new = np.linalg.solve(np.eye(len(w)) * 1.0 + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


#: Decisions of words met before, of the model that this worker used last; older models' are dropped.
_KNOWN: dict[str, float] = {}
_KNOWN_OF: list[str] = [""]


class Model:
    """Weights of subsequences, bias, and the logistic curve over ``measures``: slopes, then the offset."""

    def __init__(self, table_: np.ndarray | None = None, bias: float = -1.0, curve: tuple[float, ...] = (0.0, 0.0, -1e9)):
        self.table, self.bias, self.curve = table_, bias, curve
        self.name = uuid.uuid4().hex

    def decisions(self, words: list[str]) -> np.ndarray:
        """Words of the same letters (in other cases, with other punctuation) are weighed once; a long word is as bad as its worst part."""
        number: dict[bytes, int] = {}
        owner, part = [], []
        for i, word in enumerate(words):
            t = letters(word)
            for at in range(0, max(1, len(t) - SPAN), LONGEST - SPAN) if len(t) > LONGEST else (0,):
                owner.append(i)
                part.append(number.setdefault(t[at : at + LONGEST], len(number)))
        tokens = list(number)
        values = np.full(len(tokens), self.bias)
        sizes = np.array([len(t) for t in tokens])
        for n in np.unique(sizes[sizes >= 2]):
            at = np.flatnonzero(sizes == n)
            for k in range(0, len(at), 4096):
                some = at[k : k + 4096]
                values[some] += np.maximum(weighed([tokens[j] for j in some], self.table), 0.0)
        out = np.full(len(words), self.bias)
        np.maximum.at(out, np.array(owner, int), values[np.array(part, int)])
        return out

    def measures(self, texts: list[str | None]) -> np.ndarray:
        """For each text the logarithm of its share of insult, and that of its amount."""
        out = np.empty((len(texts), 2))
        if self.table is None:
            out[:] = np.log(TRACE), 0.0
            return out
        lists = [words_of(t) if t else [] for t in texts]
        if _KNOWN_OF[0] != self.name:
            _KNOWN.clear()
            _KNOWN_OF[0] = self.name
        sole_cache("toxicity", _KNOWN.clear)
        new = set().union(*lists) - _KNOWN.keys()
        if new:
            if len(_KNOWN) + len(new) > CACHE_TOKENS:
                _KNOWN.clear()
                new = set().union(*lists)
            new = list(new)
            _KNOWN.update(zip(new, self.decisions(new).tolist(), strict=True))
        for i, words in enumerate(lists):
            d = np.fromiter(map(_KNOWN.__getitem__, words), np.float64, len(words))
            amount = np.clip((d - PART) / (1 - PART), 0.0, 1.0).sum()
            out[i] = np.log(TRACE + amount / max(len(words), 1)), np.log1p(amount)
        return out

    def probability(self, measures: np.ndarray) -> np.ndarray:
        *slopes, offset = self.curve
        return 1 / (1 + np.exp(-np.clip(measures @ np.array(slopes) + offset, -40, 40)))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sole_cache("toxicity", _KNOWN.clear)
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = ["", *words_of(text.as_py() or ""), ""]
            rows = [(w, f"{a} {b}") for a, w, b in zip(words, words[1:], words[2:])]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string()), pa.array([toxic] * len(rows), pa.int64())], ["word", "context", "toxic"])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Slopes and offset of P(y=1) over the columns of x, lightly regularised; a slope below 0 is set to 0 and the rest fitted again."""
    use = list(range(x.shape[1]))
    while True:
        a = np.column_stack((x[:, use], np.ones(len(x))))
        w, ridge = np.zeros(a.shape[1]), np.array([SOFT * len(x)] * len(use) + [1e-4])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
            w = w + step * min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            slopes = np.zeros(x.shape[1])
            slopes[use] = w[:-1]
            return (*slopes.tolist(), float(w[-1]))
        use.pop(int(w[:-1].argmin()))


def train(insults: dict[bytes, float], plain: list[str]) -> Model:
    """Support vector machine on Nystroem features of insults (with their costs), spoilt forms of them, and plain words."""
    negative = {t for t in map(letters, plain) if 2 <= len(t) <= LONGEST} - insults.keys()
    if not insults or not negative:
        return Model()
    tokens = {t: (1.0, c) for t, c in insults.items()}
    for t, c in insults.items():
        for at in {len(t) // 2, len(t) // 3 + 1}:
            for more in (t[at : at + 1], b"\x18"):
                tokens.setdefault(t[:at] + more + t[at:], (1.0, c / 8))
    tokens |= {t: (-1.0, 1.0) for t in sorted(negative)}
    y, cost = (np.array([v[k] for v in tokens.values()]) for k in (0, 1))
    keys, weights = features(list(tokens))
    weights = unit(keys, weights)
    positive, others = np.flatnonzero(y > 0), np.flatnonzero(y < 0)
    at = landmarks(keys, weights, [*positive[np.argsort(-cost[positive], kind="stable")]], LANDMARKS * 3 // 4)
    near = np.max([kernel_column(keys, weights, i)[others] for i in at], 0)
    at += landmarks(keys, weights, [*others[np.argsort(-near, kind="stable")]], LANDMARKS - len(at))
    columns = np.column_stack([kernel_column(keys, weights, i) for i in at])
    values, vectors = np.linalg.eigh(columns[at])
    root = vectors / np.sqrt(np.maximum(values, 1e-3))  # the map into Nystroem features
    w = squared_hinge(np.column_stack((columns @ root, np.ones(len(y)))), y, COST * cost)
    folded = np.zeros(_SIZE)
    np.add.at(folded, keys[at].ravel(), (weights[at] * (root @ w[:-1])[:, None]).ravel())
    return Model(folded, float(w[-1]))


def learned(seen: DataFrame) -> Model:
    """A model without its curve, from words and the numbers of their toxic and clean contexts (word, bad, good)."""
    total = seen.agg(F.sum("bad"), F.sum("good")).first()
    if not total[0] or not total[1]:
        return Model()
    share = total[0] / (total[0] + total[1])
    n = F.col("bad") + F.col("good")
    # The log-likelihood ratio of the token's contexts against the classes' shares.
    ratio = F.col("bad") * F.log(F.col("bad") / (n * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share)))).otherwise(0.0)
    odd = (F.col("bad") > 0) & (F.col("bad") > 0.6 * n) & (F.col("bad") / n > 2 * share) & (ratio >= EVIDENCE)
    bad = [(r["word"], r["bad"]) for r in seen.where(odd).orderBy(F.desc(ratio), "word").limit(POSITIVE).collect()]
    plain = seen.where((F.col("good") > 0) & (F.col("bad") / n <= 1.5 * share))
    good = [r["word"] for r in plain.orderBy(F.desc("good"), "word").limit(NEGATIVE // 4).collect()]
    good += [r["word"] for r in plain.orderBy(F.xxhash64("word"), "word").limit(NEGATIVE).collect()]
    insults = {t: 1.0 + float(np.log(n)) for t, n in ((letters(w), n) for w, n in reversed(bad)) if 2 <= len(t) <= LONGEST}
    model = train(insults, good)
    if model.table is None:
        return model
    first = seen.sparkSession.sparkContext.broadcast(model)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first.value.decisions(batch.column(0).to_pylist()), pa.float64())], ["word", "decision"])

    close = plain.select("word").mapInArrow(decide, "word string, decision double").where(F.col("decision") > NEAR)
    hard = [r["word"] for r in close.orderBy(F.desc("decision"), "word").limit(NEGATIVE // 4).collect()]
    return train(insults, good + hard)


def sampled(labels: DataFrame, texts: int) -> DataFrame:
    """doc_id, toxic of the sample: of each class the ids with the smallest hashes, which every task cuts to that number first."""
    usable = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of = lambda toxic, most: usable.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return of(1, texts).union(of(0, 3 * texts))


def fit(docs: DataFrame, labels: DataFrame, texts: int = TEXTS) -> Model:
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    chosen = sampled(usable, texts)
    known = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # 4 * texts rows at most
    known = known.select("toxic", "text").repartition(8, F.xxhash64("text")).persist()
    contexts = known.mapInArrow(_contexts, "word string, context string, toxic long").distinct()
    model = learned(stash(contexts.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "contexts"))
    if model.table is None:
        known.unpersist()
        return model
    spread = known.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                m = spread.value.measures(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(m[:, i])) for i in range(2))], ["toxic", "share", "amount"])

    rows = known.mapInArrow(judged, "toxic long, share double, amount double").collect()  # 4 * texts rows at most
    known.unpersist()
    shares = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    x, y = np.array([[r["share"], r["amount"]] for r in rows]), np.array([r["toxic"] for r in rows], float)
    *slopes, offset = logistic(x, y)
    # The sample holds the classes in other shares than the labels do.
    model.curve = (*slopes, offset + float(np.log(shares[1] / shares[0] * (1 - y).sum() / y.sum())))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every document, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                p = shared.value.probability(shared.value.measures(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return text_rows(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda texts: (shared.value.probability(shared.value.measures(texts)) < threshold).tolist())


def op4_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op4_string_kernel_toxicity": op4_string_kernel_toxicity}
SQL: dict[str, str] = {}
