"""Near-duplicate documents by a multi-index Hamming join over minhash signatures.

Method.  A document is the set of its shingles; its signature is one minhash per permutation (a symbol of LANE bits).  Two
signatures within ``ERRORS`` differing symbols have, by the pigeonhole principle, at least one of
``CHUNKS`` chunks with at most one differing symbol.  So each chunk is indexed once for every symbol left out: signatures
within the threshold share a key, all such pairs are found, and none beyond the sketch itself is lost.  At a
similarity of 0.8 a pair stays within the threshold but for one case in five million (the binomial tail), at 0.85 but for one in five billion.
Links are confirmed on full shingle sets.

Scale.  Documents with equal sets are one class from the start.  In a key's bucket all members are compared with its smallest
(the hub), not with each other; first with the smallest of its hubs, then with those of other components; whoever they explain is done.  Only a
member outside the hub's component meets the other members of another component, and only within the signature threshold, in the first key that the two share, and
if sketches of parities, which bound the sets' difference from below, allow the similarity: all that is part of the join's condition.  That finds every link between components, so components are those of all links.

Defined cases: a document without words has an empty set and is its own component; rows with a null id take no part and come
back with a null component, kept; rows that repeat an id are one node; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import bounded, slices, sole_cache, stash, table, text_rows
from quarrylight.llm.graph import components

CHUNKS, WIDE = 15, 4
SYMBOLS = CHUNKS * WIDE
#: With 15 chunks, 29 errors leave some chunk with one error at most.
ERRORS = 2 * CHUNKS - 1
#: Bits of a symbol.  A chunk is four lanes of 12 bits, the top one free, in a long.
LANE = 11
#: Bits of the sketch of parities.
ODD = 1024
_LOW = sum(((1 << LANE) - 1) << 12 * i for i in range(WIDE))
_TOP = sum(1 << (12 * i + LANE) for i in range(WIDE))

_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 2**64, SYMBOLS, np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**64, SYMBOLS, np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: ASCII letters lower-cased, words parted by ASCII white space."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, tokens)), np.uint64)
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * _M1
        out ^= out >> np.uint64(29)
    out *= _M2
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minhashes of LANE bits; a minimum's own top bits are nearly always 0, so they are mixed first."""
    low = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 8192):
        np.minimum(low, (hashes[at : at + 8192, None] * _A + _B).min(0), out=low)
    low = (low ^ (low >> np.uint64(31))) * _M2
    low = (low ^ (low >> np.uint64(29))) * _M1
    return (low >> np.uint64(64 - LANE)).astype(np.uint16)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """ODD bits, each the parity of how many shingles fall on it.

    Two sketches differ in at most as many bits as the sets have elements of their own, so sets whose sketches differ too
    much are certainly not similar.
    """
    return np.packbits((np.bincount((hashes % np.uint64(ODD)).astype(np.int64), minlength=ODD) & 1).astype(np.uint8))


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("neardup")
        for batch in batches:
            for part in slices(batch, 1):
                sizes, keys, signatures, odd = [], [], [], []
                for text in part.column(1).to_pylist():
                    hashes = shingle_set(text, words)
                    sizes.append(len(hashes))
                    keys.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                    signatures.append(signature(hashes).tobytes() if len(hashes) else None)
                    odd.append(odd_sketch(hashes).tobytes() if len(hashes) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(odd, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature", "odd"])

    return run


def _lanes(signatures: np.ndarray) -> np.ndarray:
    return (signatures.astype(np.int64).reshape(-1, CHUNKS, WIDE) << (12 * np.arange(WIDE))).sum(2)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document and chunk, one key for every symbol left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            s = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDE).astype(np.uint64)
            out = np.empty((len(s), CHUNKS, WIDE), np.uint64)
            for gone in range(WIDE):
                h = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDE) + np.uint64(gone + 1), s.shape[:2]) * _M2
                for i in range(WIDE):
                    if i != gone:
                        h = (h ^ s[:, :, i]) * _M1
                        h ^= h >> np.uint64(31)
                out[:, :, gone] = h
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), SYMBOLS)), pa.array(np.tile(np.arange(SYMBOLS, dtype=np.int16), len(s))), pa.array(out.reshape(-1).view(np.int64))], ["doc", "slot", "key"])


def _with_lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            lanes = _lanes(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, SYMBOLS))
            odd = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(batch.num_rows, -1)
            columns = [pa.array(np.ascontiguousarray(x[:, i])) for x in (lanes, odd) for i in range(x.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc", *_SIDE])


_SIDE = ["n", *(f"s{i}" for i in range(CHUNKS)), *(f"o{i}" for i in range(ODD // 64))]


def errors(a: str, b: str) -> list[Column]:
    """Differing symbols of each chunk of two signatures (columns s0.. behind the prefixes)."""
    return [F.bit_count(((F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) + F.lit(_LOW)).bitwiseAND(F.lit(_TOP))) for i in range(CHUNKS)]


def near(a: str, b: str, similarity: int) -> Column:
    """Whether two signatures may belong together: sizes in proportion, few errors, and sketches that allow the similarity.

    Sets of similarity s have at most (1 - s) / (1 + s) of their sizes' sum as elements of their own.
    """
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{a}o{i}").bitwiseXOR(F.col(f"{b}o{i}"))) for i in range(ODD // 64)])
    return (100 * F.least(n, m) >= similarity * F.greatest(n, m)) & (reduce(Column.__add__, errors(a, b)) <= ERRORS) & ((100 + similarity) * apart <= (100 - similarity) * (n + m))


def first_meeting(slot: Column, a: str, b: str) -> Column:
    """Whether the key in this slot is the first that two signatures share, so that a pair is made once."""
    chunk, gone = F.floor(slot / WIDE), slot % WIDE
    return reduce(Column.__and__, [(chunk < i) | ((chunk == i) & ((wrong == 1) | (gone == 0))) | ((chunk > i) & (wrong > 1)) for i, wrong in enumerate(errors(a, b))])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingle_set(t, words).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.concatenate(([0], np.cumsum(list(map(len, sets))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["doc", "hashes"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = stash(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = docs.join(bounded(ids), "doc_id", "left_semi").mapInArrow(_sets(words), "doc long, hashes array<long>")
    rows = pairs.join(sets.select(F.col("doc").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("doc").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return rows.where(100 * common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def near_duplicates(documents: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents; similarity in percent."""
    docs = text_rows(documents)
    sketch = stash(docs.mapInArrow(_sketch(words), "doc_id long, n_shingles long, set_key binary, signature binary, odd binary"), "sketch")
    usable = sketch.where("doc_id is not null and set_key is not null")
    classes = stash(usable.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("odd").alias("odd")), "classes")

    keys = classes.select("doc", "signature").mapInArrow(_keys, "doc long, slot short, key long")
    shared = keys.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("hub < last").select("key", "hub")
    buckets = stash(keys.join(shared, "key").where("doc <> hub"), "buckets")
    lanes = classes.select("doc", "n", "signature", "odd").mapInArrow(_with_lanes, "doc long, " + ", ".join(f"{c} long" for c in _SIDE))
    side = lambda p, on: lanes.select(F.col("doc").alias(on), *(F.col(c).alias(p + c) for c in _SIDE))

    def linked(pairs: DataFrame) -> DataFrame:
        close = pairs.join(side("x", "b"), "b").join(side("y", "a"), "a").where(near("x", "y", similarity)).select("a", "b")
        return stash(confirmed(close, docs, words, similarity), "links")

    # Each document meets its smallest hub; after that only hubs of other components.
    first = buckets.groupBy(F.col("doc").alias("b")).agg(F.min("hub").alias("a"))
    links = linked(first)
    found = components(links)
    named = lambda df, on, to: df.join(found.select(F.col("node").alias(on), F.col("component").alias(to)), on, "left").withColumn(to, F.coalesce(to, on))
    hubs = named(named(buckets.select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct(), "a", "u"), "b", "v").where("u <> v").select("a", "b")
    extra = linked(hubs.join(first, ["a", "b"], "left_anti"))
    if extra.limit(1).count():
        links = stash(links.union(extra), "links")
        found = components(links)

    # Members that the hub's component does not explain meet the rest of their buckets.
    strangers = named(named(buckets, "doc", "own"), "hub", "hubs").where("own <> hubs").select("key", "slot", F.col("doc").alias("a"), F.col("own").alias("u"))
    crowded = strangers.select("key").distinct().join(buckets.groupBy("key").count().where("count > 1"), "key")
    members = named(buckets.join(crowded.select("key"), "key", "left_semi"), "doc", "own").select("key", F.col("doc").alias("b"), F.col("own").alias("v"))
    left = stash(strangers.join(side("x", "a"), "a"), "strangers")
    right = stash(members.join(side("y", "b"), "b"), "members")
    met = (left["key"] == right["key"]) & (left["u"] != right["v"]) & near("x", "y", similarity) & first_meeting(left["slot"], "x", "y")
    extra = stash(confirmed(left.join(right, met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), docs, words, similarity), "links")
    if extra.limit(1).count():
        found = components(links.union(extra))

    out = sketch.join(classes.select("set_key", "doc"), "set_key", "left").join(found, F.col("doc") == F.col("node"), "left")
    component = F.coalesce("component", "doc", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """One document of each group, with all its columns; rows with a null id stay.

    Of rows that repeat an id and its text one stays; different texts of one id are told apart and stay if the id does.
    """
    found = near_duplicates(docs, words, similarity)
    gone = bounded(stash(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone"))
    left = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    again = stash(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "again")
    if not again.limit(1).count():
        return left
    once = left.join(bounded(again), F.col("doc_id") == F.col("__again"), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(bounded(again), F.col("doc_id") == F.col("__again"), "left_anti").unionByName(once)


def op6_multi_index_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity=80)


QUERIES = {"op6_multi_index_near_duplicates": op6_multi_index_near_duplicates}
SQL: dict[str, str] = {}
