"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

Method.  A document of n tokens costs ``linear * n + quadratic * n * n`` (projections grow with n, attention
inside a document with n squared).  Documents are taken in descending cost and each goes to the sequence with
the lowest cost so far that still has room for it.  A document longer than a sequence first gives up whole
sequences; one that fits nowhere is cut over the roomiest sequences.  Packing runs inside each task over shards
of about ``SHARD_SEQUENCES`` sequences, so nothing is shuffled and memory is bounded by a shard, whatever the
table size.  What is left of a shard after its full sequences becomes sequences whose lengths are powers of two,
which need no padding.

Defined cases: a null text is empty (one piece, the end id alone); a null doc_id is kept as null; repeated rows are packed
each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm.common import sole_cache, table, text_rows

CAPACITY = 4096
END_ID = 2
#: Sequences packed together: large enough for good balance, small enough for a task's memory (8 MB of ids).
SHARD_SEQUENCES = 1024
#: Words whose ids a worker remembers (and, for every five of them, eight runs of letters).
CACHE_WORDS = 500_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_ENCODERS: dict[tuple[str, int], "WordEncoder"] = {}


class _Runs(dict):
    """Run of letters or signs -> ids as little-endian uint32 bytes."""

    def __init__(self, path: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.most = most

        self.tokenizer = Tokenizer.from_file(path)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[run] = ids = self.whole(run)
        return ids


class WordEncoder(dict):
    """Word -> ids as little-endian uint32 bytes.

    The tokenizer drops white space and never joins characters across it, so a text's ids are the concatenated ids
    of its words, and a Latin word's those of its runs of letters and of signs.  What could break
    this (special tokens, controls that only Python counts as white space) is encoded whole.
    """

    runs = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    controls = re.compile("[\x1c-\x1f]")
    #: Letters whose classes every regular-expression engine agrees on.
    latin = re.compile("[\x21-\x7eÀ-ÖØ-öø-ɏ]+")

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.known, self.most = _Runs(path, most * 8 // 5), most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if "<|" not in word and self.latin.fullmatch(word):
            ids = b"".join(map(self.known.__getitem__, self.runs.findall(word)))
        else:
            ids = self.known.whole(word)
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text.isascii():
            low = text.lower()
            # Lower-casing first merges cache entries; it is the tokenizer's own only where normal forms stay put.
            if "\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low):
                text = low
        elif "<|" not in text:
            text = text.lower()
        if self.controls.search(text):
            return self.known.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str, most: int = CACHE_WORDS) -> WordEncoder:
    sole_cache("packing", _ENCODERS.clear)
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = WordEncoder(path, most)
    return _ENCODERS[path, most]


class Sequences:
    """Open sequences by the room they have left; gives the cheapest one with enough of it.

    A heap for each room, and a tree of minima over the rooms.
    """

    _NONE = (float("inf"), -1, -1)

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int, int]]] = [[] for _ in range(capacity + 1)]
        self.least = [self._NONE] * (2 * self.size)

    def _renew(self, room: int) -> None:
        at = room + self.size
        self.least[at] = self.heaps[room][0] if self.heaps[room] else self._NONE
        while at > 1:
            at //= 2
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def add(self, sequence: int, room: int, cost: float) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, sequence, room))
            self._renew(room)

    def take(self, room: int) -> int | None:
        """The cheapest sequence with that much room, taken out; None if there is none."""
        best, low, high = self._NONE, room + self.size, 2 * self.size
        while low < high:
            if low & 1:
                best, low = min(best, self.least[low]), low + 1
            if high & 1:
                high -= 1
                best = min(best, self.least[high])
            low, high = low // 2, high // 2
        if best is self._NONE:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._renew(best[2])
        return best[1]


def pack_lengths(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int, int]]]:
    """For each document its pieces (start, length, sequence, offset), sequences numbered from 0.

    The tokens that fill no whole sequence end in sequences of power-of-two length.
    """
    total = sum(lengths)
    full, tail = divmod(total, capacity)
    sizes = [capacity] * full + [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    used, cost = [0] * len(sizes), [0.0] * len(sizes)
    price = lambda n: linear * n + quadratic * n * n

    def put(doc: int, start: int, n: int, at: int) -> None:
        pieces[doc].append((start, n, at, used[at]))
        used[at] += n
        cost[at] += price(n)

    rest, begun, at = list(lengths), [0] * len(lengths), 0
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    for i in order:  # whole sequences of the long documents
        while rest[i] >= capacity and at < full:
            put(i, begun[i], capacity, at)
            begun[i] += capacity
            rest[i] -= capacity
            at += 1
    order = sorted((i for i in order if rest[i]), key=lambda i: (-rest[i], i))
    open_ = Sequences(max(sizes, default=1))
    for k in range(at, len(sizes)):
        open_.add(k, sizes[k] - used[k], cost[k])
    split: list[int] = []
    for i in order:
        k = open_.take(rest[i])
        if k is None:
            split.append(i)  # fits nowhere whole
            continue
        put(i, begun[i], rest[i], k)
        open_.add(k, sizes[k] - used[k], cost[k])
    room = sorted((k for k in range(len(sizes)) if used[k] < sizes[k]), key=lambda k: (used[k] - sizes[k], k))
    for i in split:
        while rest[i]:
            k = room[0]
            n = min(rest[i], sizes[k] - used[k])
            put(i, begun[i], n, k)
            begun[i] += n
            rest[i] -= n
            if used[k] == sizes[k]:
                room.pop(0)
    return pieces


def _packer(path: str, capacity: int, end_id: int, linear: float, quadratic: float, shard: int, cache: int):
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, cache)
        base = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            placed = pack_lengths([len(t) // 4 for t in tokens], capacity, linear, quadratic)
            rows, most = [], -1
            for doc, data, parts in zip(ids, tokens, placed, strict=True):
                for start, n, at, offset in sorted(parts):
                    rows.append((doc, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(data) // 4, base + at, offset))
                    most = max(most, at)
            base += most + 1
            ids.clear()
            tokens.clear()
            held = 0
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = enc.encode(text.as_py() or "") + tail
                ids.append(doc)
                tokens.append(data)
                held += len(data) // 4
                if held >= shard * capacity:
                    yield flush()
        if ids:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, linear: float = 1.0, quadratic: float = 1.0 / 4096, shard_sequences: int = SHARD_SEQUENCES, cache: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = text_rows(docs)
    return rows.mapInArrow(_packer(tokenizer_path, capacity, end_id, linear, quadratic, shard_sequences, cache), SCHEMA)


def op10_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op10_cost_balanced_packing": op10_cost_balanced_packing}
SQL: dict[str, str] = {}
