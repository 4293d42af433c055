"""Spelling variants: frequent words with the rarer words that are one edit away from them.

Method.  A word is reduced by mapping its letters to ``SYMBOLS`` symbols, so words one edit apart have reduced words at most one
edit apart.  Of every distinct reduced word the full neighbourhood (itself, every deletion, replacement and insertion over the
few symbols) is generated and joined with the reduced vocabulary; the original words behind a met pair are then compared.
Reduced words are known by a polynomial hash of 64 bits, from which the hashes of all neighbours follow by arithmetic on arrays.
Two reduced words that share a hash only add candidates, which the comparison of the words turns down.

Scale.  Words are counted in the workers before they are shuffled.  Neighbours that surely are in no vocabulary go before the
shuffle by a filter of ``1 << FILTER_BITS`` bits, whose size does not depend on the data: a fuller filter lets more rows
through and changes no result.  Both joins are shuffled; a crowded reduced word is a skewed key that Spark splits.

Defined cases: a null text has no words and an empty table no rows; rows without doc_id count as others do and are never spoilt;
repeated rows count each; ties go to the word that is smaller in code-point order; whole texts are read in pieces that
end between words; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import slices, sole_cache, stash, table, text_rows, word_lists

#: Letters of a word besides a-z (A-Z are lower-cased).
OTHERS = "".join(map(chr, range(0xC0, 0x100)))
LETTERS = "abcdefghijklmnopqrstuvwxyz" + OTHERS
SYMBOLS = 6
#: Shortest words, and least occurrences, that are looked at; how much more frequent a form is than its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: In the query every so many-th run (by a hash) is misspelt on purpose.
SPOIL = 31
#: Words that a worker counts before it passes their counts on.
HELD = 200_000
FILTER_BITS = 27
#: Neighbours that are generated at once.
BLOCK = 1 << 21

_TABLE = bytes(ord(c.lower()) if c.isascii() and c.isalpha() else i if i >= 0xC0 else 0x20 for i, c in enumerate(map(chr, range(256))))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def symbol(letter: str) -> int:
    """The symbol, from 1, that stands for a letter."""
    return 1 + (ord(letter) * 2654435761 >> 7) % SYMBOLS


def reduced(word: Column) -> Column:
    return F.translate(word, LETTERS, "".join(str(symbol(c)) for c in LETTERS))


def counted(docs: DataFrame, least: int = LEAST_LENGTH, spoil: int | None = None) -> DataFrame:
    """word, n of all runs of letters, A-Z lower-cased, with ``least`` letters or more.

    With ``spoil`` a run for which that number divides h = crc32('<doc_id>:<run>') loses its letter at h % length first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("spelling")
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    data = (text.as_py() or "").encode("latin-1", "replace").translate(_TABLE)
                    prefix = zlib.crc32(f"{doc_id}:".encode())
                    for words in word_lists(data):
                        for word, n in Counter([w for w in words if len(w) >= least]).items():
                            if spoil and doc_id is not None:
                                h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
                                if h % spoil == 0:
                                    at = h % len(word)
                                    word = word[:at] + word[at + 1 :]
                                    if len(word) < least:
                                        continue
                            held[word] = held.get(word, 0) + n
                        if len(held) > HELD:
                            yield out()
                            held.clear()
        yield out()

    rows = text_rows(docs).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places of the reduced words of one length, and their symbols as rows of a matrix, a bounded number at once."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, places in groups.items():
        step = max(1, BLOCK // (16 * n))
        for begin in range(0, len(places), step):
            part = places[begin : begin + step]
            letters = np.frombuffer("".join(words[i] for i in part).encode(), np.uint8)
            yield part, letters.reshape(len(part), n).astype(np.uint64) - np.uint64(ord("0"))


def powers(n: int) -> np.ndarray:
    """The base to the powers 0 to n."""
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))), dtype=np.uint64)


def keys_of(symbols: np.ndarray) -> np.ndarray:
    return (symbols * powers(symbols.shape[1])[:-1][::-1]).sum(axis=1, dtype=np.uint64)


def neighbourhoods(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of all words at most one edit from each row, some places of the word at a time (a row a word)."""
    many, n = symbols.shape
    power = powers(n + 1)
    own = keys_of(symbols)[:, None]
    right = np.zeros((many, n + 1), np.uint64)  # hash of what follows each place
    right[:, :n] = np.cumsum((symbols * power[:n][::-1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    left = own - right  # hash of what precedes it, followed by zeros
    step = max(1, BLOCK // (many * (2 * SYMBOLS + 1)))
    for begin in range(0, n + 1, step):
        at = np.arange(begin, min(begin + step, n + 1))
        inner = at[at < n]
        yield left[:, inner] * _INVERSE + right[:, inner + 1]
        for c in range(1, SYMBOLS + 1):
            yield own + (np.uint64(c) - symbols[:, inner]) * power[n - 1 - inner]
            yield left[:, at] * _BASE + np.uint64(c) * power[n - at] + right[:, at]


def keyed(words: DataFrame) -> DataFrame:
    """The words (word, n) with the hash of their reduced words as ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.uint64)
            for places, symbols in by_length(batch.column(2).to_pylist()):
                keys[places] = keys_of(symbols)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys.view(np.int64))], ["word", "n", "key"])

    return words.select("word", "n", reduced(F.col("word"))).mapInArrow(run, "word string, n long, key long")


def known_keys(vocabulary: DataFrame) -> np.ndarray:
    """A table of 1 << FILTER_BITS bits in which the bit that the highest bits of a key number is set for every key."""
    slot = F.shiftrightunsigned("key", 64 - FILTER_BITS + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63L as int))")
    rows = vocabulary.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas()
    found = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found[rows["slot"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return found.view(np.uint64)


def reduced_pairs(vocabulary: DataFrame) -> DataFrame:
    """key, near: reduced words at most one edit apart (themselves included), near ones being known but for the filter's misses."""
    filtered = vocabulary.sparkSession.sparkContext.broadcast(known_keys(vocabulary))
    low, high = np.uint64(64 - FILTER_BITS), np.uint64(64 - FILTER_BITS + 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filtered.value
        for batch in batches:
            for _, symbols in by_length(batch.column(0).to_pylist()):
                own, places, found = keys_of(symbols), [], []
                for keys in neighbourhoods(symbols):
                    at, to = np.nonzero(bits[keys >> high] >> ((keys >> low) & np.uint64(63)) & np.uint64(1))
                    places.append(at)
                    found.append(keys[at, to])
                at, keys = np.concatenate(places), np.concatenate(found)
                order = np.lexsort((keys, at))
                at, keys = at[order], keys[order]
                first = np.concatenate(([True], (at[1:] != at[:-1]) | (keys[1:] != keys[:-1])))
                at, keys = at[first], keys[first]
                yield pa.RecordBatch.from_arrays([pa.array(own[at].view(np.int64)), pa.array(keys.view(np.int64))], ["key", "near"])

    words = vocabulary.select(reduced(F.col("word")).alias("reduced")).distinct()
    return words.mapInArrow(run, "key long, near long")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, near, near_n for all pairs of words (word, n, key) that differ by exactly one edit, in both directions.

    A pair may be repeated where two reduced words share a hash.
    """
    pairs = vocabulary.select("key", "word").join(reduced_pairs(vocabulary), "key").select("word", F.col("near").alias("key"))
    others = vocabulary.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = pairs.join(others, "key").where(F.col("word") != F.col("near"))
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain from each word by way of its form (word, form) ends.

    Every round doubles the steps that a row has gone; a form is ``RATIO`` times as frequent, so chains are short and have no rings.
    """
    found = stash(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = found.join(onward, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        moved = stash(moved, "spelling-roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        found = moved.select("word", "root")


def variants(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO, spoil: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with at least ``length`` letters and ``count`` occurrences.

    A word's form is its most frequent near word, if that is ``ratio`` (over 1) times as frequent as the word; its root is the end of the chain.
    """
    words = stash(keyed(counted(docs, length, spoil).where(F.col("n") >= count)), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_words(words).groupBy("word").agg(best.alias("best"), F.size(F.collect_set("near")).alias("n_near"))
    form = -F.col("best.n") >= ratio * F.col("n")
    chosen = words.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n"),
    )
    chosen = stash(chosen, "spelling-forms")
    ends = roots(chosen.where("form is not null"))
    return chosen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"), spoil=SPOIL)


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
#: Near words by the strings that a deletion leaves; crc32 by its table of remainders.
SQL = {
    "op11_spelling_variants": r"""
WITH RECURSIVE c0 AS (SELECT range AS i, 0 AS k, range::BIGINT AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM c0 WHERE k < 8
), t AS (SELECT list(c ORDER BY i) AS t FROM c0 WHERE k = 8
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM documents
), per AS (SELECT doc_id, r, count(*) AS n, coalesce(doc_id::VARCHAR || ':', '') || r AS s FROM runs WHERE length(r) >= 7 GROUP BY 1, 2
), bytes AS (
  SELECT doc_id, r, n, flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)) AS b FROM per
), hashed AS (
  SELECT doc_id, r, n, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes, t
), spoilt AS (
  SELECT CASE WHEN doc_id IS NOT NULL AND h % 31 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM hashed
), v AS (SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, near)) AS near FROM near GROUP BY 1
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN near END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n
  FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS stop, form AS onward FROM f
  UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON chain.onward = f.word
)
SELECT f.word, form, stop AS root, n, n_near, form_n FROM f JOIN chain ON chain.word = f.word AND chain.onward IS NULL
"""
}
