"""Benchmark decontamination: words of documents that stand in passages of benchmark items.

Method.  The items' words, lower-cased and numbered, form a generalised suffix automaton.  A document's words are streamed through it;
the automaton's state and the length of the longest match that ends at each word tell which words lie in a run of ``window`` or
more words of one item, or in an item that is shorter.  Each state of which a run of ``window`` words ends knows the items that hold that run.

Scale.  Documents are read where they lie and nothing of them is shuffled.  Items are dealt into blocks of about ``BLOCK_WORDS``
words by a hash; an automaton of one block is sent to the workers at a time.  Any number of blocks is possible: with more than one, what each finds in a
document is joined by id and digest of the text.  Items of over ``PIECE_WORDS`` words are cut into pieces that overlap by ``window - 1`` words.

Defined cases: a null text has no words, nor has a document or item without letters or digits; rows that repeat an id are answered each for
itself; an item without id marks words, but is not listed; items that repeat an id and differ in text are listed once; without items
nothing is hit; whole texts are read in pieces that end between words; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import bounded, slices, sole_cache, stash, table, text_rows, word_lists

#: Words of a run that gives a document away; share of hit words above which a document goes as a whole.
WINDOW, COVERAGE = 10, 0.5
BLOCK_WORDS, PIECE_WORDS = 200_000, 2_000

_IS_WORD = [0x30 <= i <= 0x39 or 0x41 <= i <= 0x5A or 0x61 <= i <= 0x7A or i >= 0x80 for i in range(256)]
#: A-Z in lower case; all that is in no word as a blank.
_TABLE = bytes((i + 0x20 if 0x41 <= i <= 0x5A else i) if _IS_WORD[i] else 0x20 for i in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

_SPANS = "array<struct<start: bigint, end: bigint>>"


def words_of(text: str | None) -> Iterator[list[bytes]]:
    return word_lists((text or "").encode().translate(_TABLE))


class Automaton:
    """The generalised suffix automaton of items, given as (id or None, words, whether they are a whole item).

    ``win[s]``: for states that end runs of ``window`` words, the state among it and its suffixes to which just those last words belong.
    ``short[s]``: the lengths and items of short items that end at the state; ``up[s]`` the nearest suffix that has some.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes], bool]], window: int):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words, whole in items:
            codes = [self.ids.setdefault(w, len(self.ids)) for w in words]
            coded.append((name, codes, whole))
            last = 0
            for code in codes:
                last = self._extend(last, code)
        self._annotate(coded)

    def _state(self, length: int, link: int, onward: dict[int, int]) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, code: int, to: int) -> int:
        """The state of at's longest word followed by code, parted from ``to`` if that state has longer ones."""
        if self.length[to] == self.length[at] + 1:
            return to
        part = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = part
        while at >= 0 and self.next[at].get(code) == to:
            self.next[at][code] = part
            at = self.link[at]
        return part

    def _extend(self, last: int, code: int) -> int:
        known = self.next[last].get(code)
        if known is not None:
            return self._split(last, code, known)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, code, self.next[at][code])
        return new

    def _annotate(self, coded: list[tuple[str | None, list[int], bool]]) -> None:
        states = len(self.next)
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        self.win, self.up, self.holders = [0] * states, [0] * states, {}
        for name, codes, whole in coded:
            if whole and 0 < len(codes) < self.window:
                at = 0
                for code in codes:
                    at = self.next[at][code]
                entry = (len(codes), name)
                if entry not in self.short.setdefault(at, []):
                    self.short[at].append(entry)
        for s in sorted(range(1, states), key=self.length.__getitem__):
            link = self.link[s]
            if self.length[s] >= self.window:
                self.win[s] = s if self.length[link] < self.window else self.win[link]
            self.up[s] = link if link in self.short else self.up[link]
        self.ends = [s in self.short or self.up[s] > 0 for s in range(states)]
        for name, codes, _ in coded:
            at = 0
            for i, code in enumerate(codes, 1):
                at = self.next[at][code]
                if i >= self.window:
                    self.holders.setdefault(self.win[at], set()).add(name)

    def matched(self, lists: Iterable[list[bytes]]) -> tuple[int, list[list[int]], set[str]]:
        """How many words there are, the runs [start, end) of hit ones, and the ids of the items that were met."""
        onward, link, length, win, ends, window = self.next, self.link, self.length, self.win, self.ends, self.window
        root, code_of = onward[0], self.ids.get
        state = run = i = 0
        spans: list[list[int]] = []
        met: set[int] = set()
        names: set[str | None] = set()

        def mark(start: int, end: int) -> None:
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append([start, end])

        for words in lists:
            for code in map(code_of, words):
                i += 1
                if code is None:
                    state = run = 0
                    continue
                to = onward[state].get(code)
                if to is not None:
                    state, run = to, run + 1
                else:
                    while to is None and state:
                        state = link[state]
                        to = onward[state].get(code)
                    state, run = (to, length[state] + 1) if to is not None else (root[code], 1)
                if run >= window:
                    met.add(win[state])
                    mark(i - run, i)
                if ends[state]:
                    at = state
                    while at > 0:
                        for size, name in self.short.get(at, ()):
                            if size <= run:
                                names.add(name)
                                mark(i - size, i)
                        at = self.up[at]
        for s in met:
            names |= self.holders[s]
        names.discard(None)
        return i, spans, names


def pieces_of(items: DataFrame, window: int) -> DataFrame:
    """name, words (joined by blanks), n, whole, block: the items in pieces, each piece once, dealt into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for part in words_of(text) for w in part]
                whole = len(words) <= PIECE_WORDS
                for begin in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    part = words[begin : begin + PIECE_WORDS + window - 1]
                    if part:
                        out.append((name, b" ".join(part).decode(), len(part), whole))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "words", "n", "whole"])

    rows = items.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").alias("text"))
    return stash(rows.mapInArrow(run, "name string, words string, n long, whole boolean").distinct(), "benchmark-pieces")


def automata(items: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """One automaton a block of items; only a block's words are with the driver at a time."""
    pieces = pieces_of(items, window)
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words))
    for block in range(blocks):
        rows = pieces.where(F.pmod(F.xxhash64("name", "words"), F.lit(blocks)) == block).select("name", "words", "whole").collect()
        yield Automaton(((r["name"], r["words"].encode().split(), r["whole"]) for r in rows), window)


def _hit_rows(docs: DataFrame, automaton: Automaton, all_rows: bool = False) -> DataFrame:
    """doc_id, digest, n_words, spans, items of the documents that are hit, or of all."""
    sent = docs.sparkSession.sparkContext.broadcast(automaton)
    names = ["doc_id", "digest", "n_words", "spans", "items"]
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("decontaminate")
        found = sent.value
        for batch in batches:
            for part in slices(batch, 1):
                out: list[list] = [[] for _ in names]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n, spans, items = found.matched(words_of(text))
                    if all_rows or spans:
                        marked = [{"start": a, "end": b} for a, b in spans]
                        for column, value in zip(out, (doc_id, hashlib.sha256((text or "").encode()).digest(), n, marked, sorted(items)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return text_rows(docs).mapInArrow(run, f"doc_id long, digest binary, n_words long, spans {_SPANS}, items array<string>")


#: Joins overlapping and touching spans of an ordered array.
_UNITED = f"""aggregate(spans, cast(array() as {_SPANS}), (a, x) -> if(
  size(a) > 0 and x.start <= element_at(a, -1).end,
  concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
  concat(a, array(x))))"""


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, digest (of the text), n_words, spans, items, a row a document: its hit words as runs [start, end) of word numbers, and the items met."""
    first, *more = automata(items, window, block_words)
    if not more:
        return _hit_rows(docs, first, True)
    # Every block's automaton sees every document.  Hits are few; what the blocks found in a text meets by id and digest.
    parts = [stash(_hit_rows(docs, a).dropDuplicates(["doc_id", "digest"]), "benchmark-hits") for a in (first, *more)]
    found = reduce(DataFrame.union, parts).groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("sha")).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    found = found.select("id", "sha", F.expr(_UNITED).alias("spans"), "items")
    rows = _hit_rows(docs, Automaton([], window), True).select("doc_id", "digest", "n_words")
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha")), "left")
    empty = lambda column, kind: F.coalesce(column, F.expr(f"cast(array() as {kind})")).alias(column)
    return met.select("doc_id", "digest", "n_words", empty("spans", _SPANS), empty("items", "array<string>"))


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def cut(text: str, spans: Iterable[tuple[int, int]]) -> str:
    """The text without the runs [start, end) of words; what stands between words outside them stays."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data)]
    kept, last = [], 0
    for start, end in spans:
        kept.append(data[last : places[start][0]])
        last = places[end - 1][1]
    return b"".join([*kept, data[last:]]).decode()


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The documents, with all their columns, without hit words; those of whose words more than ``coverage`` are hit go."""
    found = hits(docs, items, window).where(F.size("spans") > 0).dropDuplicates(["doc_id", "digest"])
    found = stash(found.select(F.col("doc_id").alias("id"), F.col("digest").alias("sha"), "n_words", "spans"), "benchmark-spans")

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("of"), digest.alias("digest"), F.col("text").cast("string").alias("body"))
    met = rows.join(bounded(found), F.col("of").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha")), "left")
    kept = met.where(F.col("spans").isNull() | (n_hit() <= coverage * F.col("n_words"))).withColumn("body", without("body", "spans"))
    return kept.select(*[F.col("body").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed, (F.size("spans") > 0).alias("contaminated"))


QUERIES = {"op13_benchmark_decontamination": op13_benchmark_decontamination}
#: All windows of all documents, joined with the windows of items as strings.
SQL = {
    "op13_benchmark_decontamination": r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0)
), d AS (
  SELECT r, size, p, array_to_string(w[p:p + size - 1], ' ') AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM w, (SELECT DISTINCT size FROM i) WHERE len(w) >= size)
), m AS (SELECT r, p, d.size, item_id FROM d JOIN i ON d.size = i.size AND d.words = i.words
), h AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + size)) AS word FROM m) GROUP BY 1
), n AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY 1
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
}
