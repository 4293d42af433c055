"""Removal of byte strings that an earlier document has, by bucket-pointer refinement of suffixes.

Contract.  A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller id.
Strings are judged on the input, never cross documents, and may overlap.

Method.  Every string of ``length`` bytes has an anchor: of the q-grams that start in it, the one with the smallest hash
(the first of equals).  Equal strings have equal anchors at equal places, so suffixes need only be compared within the
initial bucket of their anchor's q-gram, and only one row per anchor is shuffled (about one byte in 15), not
one per suffix.  The row stands for the run of strings that share the anchor.  In a bucket,
rows whose whole run is equal (same hash of its bytes) belong to their smallest document at once.  What is left, the
first row of each different run in a bucket with several that agree on a side of the anchor, is refined: the bytes are fetched and the suffixes of the
runs sorted by bucket pointers, doubling the depth from grams of seven bytes on by sorting on the bucket identifiers of later offsets, until
buckets agree on ``length`` bytes; a bucket's smallest document keeps its string.

Scale.  Copies of one text are settled before (only the smallest id's text is anchored).  Equal runs in one batch are
settled where they are read, so a passage that a third of all documents hold sends one row a batch, not one
a document.  Buckets with very many different runs are refined by the hash of each string instead (``WIDE_BUCKET``).
Texts are shuffled twice, by document: to fetch the bytes of open runs, and to cut what was found.

Defined cases: null text is empty; rows with a null id lose nothing and take nothing from others; rows that repeat an id are
the same document; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import bounded, partitions, slices, sole_cache, stash, table, text_rows

LENGTH, GRAM = 50, 20
#: Bytes of the grams that fill the first buckets of a refinement (they fit into a long).
FIRST_GRAM = 7
#: Rows of one bucket (70 bytes each) from which its strings are told apart by hash, so that no task refines an unbounded group.
WIDE_BUCKET = 50_000
#: Runs that are refined together.
GROUP_RUNS = 5_000
#: Bytes hashed at once, and the longest run of a text that is.
BLOCK = 1 << 16

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    a = b = 1
    for i in range(n + 1):
        up[i], down[i] = a, b
        a, b = a * _BASE & _MASK, b * inverse & _MASK
    return up, down


_UP, _DOWN = _powers(BLOCK)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of strings that share an anchor: first start, number of starts, 48-bit hash of the anchor, 64-bit hash of the run.

    The run's hash holds hashes of the bytes left and right of the anchor, 12 bits each, and of the whole run.  A string reaches
    far to the left or far to the right of its anchor, so runs that agree on neither side share no string.

    A run ends at the blocks in which the text is worked through; that splits it alike wherever
    it is, as far as the findings go, for each string is found by its own anchor.
    """
    wide = length - gram + 1
    last = len(data) - length
    for begin in range(0, last + 1, BLOCK - length):
        part = np.frombuffer(data[begin : begin + BLOCK], np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(part * _UP[:n], out=sums[1:])
        key = _mix((sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1])
        order = (key & np.uint64(_MASK ^ (BLOCK - 1))) | np.arange(len(key), dtype=np.uint64)
        low, have = order, 1
        while have < wide:
            step = min(have, wide - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        at = (low & np.uint64(BLOCK - 1)).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        ends = np.concatenate((starts[1:], [len(at)]))
        runs = (sums[ends - 1 + length] - sums[starts]) * _DOWN[starts]
        anchor = at[starts]
        place = (anchor - starts) * 64 + (ends - starts)
        whole = _mix(runs ^ (place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        side, after = (length - gram) // 2, anchor + gram
        a, b = np.maximum(anchor - side, 0), np.minimum(after + side, n)
        left = np.where(anchor >= side, _mix((sums[anchor] - sums[a]) * _DOWN[a]), np.uint64(0))
        right = np.where(after + side <= n, _mix((sums[b] - sums[after]) * _DOWN[after]), np.uint64(0))
        yield starts + begin, ends - starts, key[anchor] >> np.uint64(16), (left >> np.uint64(52) << np.uint64(52)) | (right >> np.uint64(52) << np.uint64(40)) | (whole >> np.uint64(24))


def refine(runs: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each run, whether the string at each of its starts also is in a run of a smaller owner.

    Suffixes of all runs are bucketed by their first FIRST_GRAM bytes and the buckets refined by sorting on the pairs of
    bucket identifiers (own, that of the suffix as many bytes later), each round reusing the identifiers
    of the last one.  The last round's shift is cut so that buckets agree on exactly ``length`` bytes.
    """
    text = np.frombuffer(b"".join(runs), np.uint8).astype(np.int64)
    depth = min(FIRST_GRAM, length)
    grams = text.copy()
    for i in range(1, depth):
        grams[:-i] |= text[i:] << 8 * i
    sizes = np.array([len(r) for r in runs])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    run = np.repeat(np.arange(len(runs)), sizes)
    left = np.repeat(bounds[1:], sizes) - np.arange(len(text))
    alive = left >= length
    bucket = np.unique(grams, return_inverse=True)[1].reshape(-1)
    while depth < length:
        shift = min(depth, length - depth)
        # A suffix too short for its depth has a bucket of no meaning; no string of whole length looks there.
        pair = bucket * len(text)
        pair[:-shift] += bucket[shift:]
        bucket = np.unique(pair, return_inverse=True)[1].reshape(-1)
        depth += shift
    starts = np.flatnonzero(alive)
    first = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, bucket[starts], owners[run[starts]])
    gone = np.zeros(len(text), bool)
    gone[starts] = first[bucket[starts]] < owners[run[starts]]
    return [gone[bounds[i] : bounds[i] + sizes[i] - length + 1] for i in range(len(runs))]


def _anchored(length: int, gram: int):
    names = ["bucket", "run", "doc", "place"]

    def rows(ids: list, texts: list, done: list) -> pa.RecordBatch | None:
        parts = []
        for doc, text, copy in zip(ids, texts, done, strict=True):
            data = text.encode("utf-8", "surrogatepass")
            if len(data) < length:
                continue
            if copy:  # an earlier document has the whole text
                one = np.array([0]), np.array([len(data) - length + 1]), np.array([doc]).astype(np.uint64), np.zeros(1, np.uint64)
                parts.append((*one, np.array([doc]), np.array([True])))
                continue
            for starts, n, key, run in anchors(data, length, gram):
                parts.append((starts, n, key, run, np.full(len(starts), doc), np.zeros(len(starts), bool)))
        if not parts:
            return None
        start, n, key, run, doc, settled = (np.concatenate([p[i] for p in parts]) for i in range(6))
        order = np.lexsort((doc, run, key))
        same = (key[order][1:] == key[order][:-1]) & (run[order][1:] == run[order][:-1])
        head = np.concatenate(([True], ~same))
        lowest = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        settled[order] |= lowest < doc[order]  # an earlier document in this very batch has the run
        # Settled rows only pass through; buckets of their own, outside the 48 bits, deal them out evenly.
        key = np.where(settled, _mix(doc.astype(np.uint64) * np.uint64(_BASE) + start.astype(np.uint64)) | np.uint64(1 << 63), key)
        run = np.where(settled, np.uint64(0), run)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key).view(np.int64)), pa.array(np.ascontiguousarray(run).view(np.int64)), pa.array(doc), pa.array((start.astype(np.int64) << 32) | n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("substrings")
        for batch in batches:
            ids, texts, done, size = [], [], [], 0
            for doc, text, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc)
                texts.append(text)
                done.append(copy)
                size += len(text)
                if size > 2_000_000:
                    if (out := rows(ids, texts, done)) is not None:
                        yield out
                    ids, texts, done, size = [], [], [], 0
            if (out := rows(ids, texts, done)) is not None:
                yield out

    return run


def _fetched(length: int):
    """(bucket, doc, start, bytes) of the runs listed for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                out += [(r["bucket"], doc, r["start"], data[r["start"] : r["start"] + r["n"] + length - 1]) for r in runs]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.binary())], ["bucket", "doc", "start", "data"])

    return run


def _spans(start: int, gone: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return [(start + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _refined(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        # Equal strings have equal anchors, so a group of whole buckets can be refined together.
        for gone, doc, start in zip(refine(rows["data"].tolist(), rows["doc"].to_numpy(), length), rows["doc"], rows["start"], strict=True):
            out += [(doc, a, n) for a, n in _spans(start, gone)]
        return pd.DataFrame(out, columns=["doc", "start", "n"])

    return run


def _strings(length: int):
    """Each string of a run with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, key = [], [], []
            for d, s, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(len(data) - length + 1):
                    doc.append(d)
                    start.append(s + i)
                    key.append(xxhash.xxh3_128_digest(data[i : i + length]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(key, pa.binary())], ["doc", "start", "string"])

    return run


def repeated_starts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, start, n): strings at n starts from start on that an earlier document has too.  docs: doc_id and text, not null."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    first = docs.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(digest).alias("d"), F.max(digest).alias("e")).where("low < high and d = e")
    marks = bounded(stash(first.select("h", "l", "low"), "copies"))
    marked = docs.withColumn("h", F.xxhash64("text")).withColumn("l", F.length("text")).join(marks, ["h", "l"], "left")
    rows = marked.select("doc_id", "text", F.coalesce(F.col("low") < F.col("doc_id"), F.lit(False)).alias("copy")).mapInArrow(_anchored(length, gram), "bucket long, run long, doc long, place long")
    bucket, run = Window.partitionBy("bucket"), Window.partitionBy("bucket", "run")
    seen = rows.withColumns({"low": F.min("doc").over(run), "a": F.min("run").over(bucket), "b": F.max("run").over(bucket)})
    taken = (F.col("bucket") < 0) | (F.col("low") < F.col("doc"))
    several = seen.where(taken | (F.col("a") < F.col("b"))).withColumn("taken", taken)
    sides = {"left": F.shiftright("run", 52), "right": F.pmod(F.shiftright("run", 40), F.lit(4096))}
    several = several.withColumns(sides)
    for side in sides:
        alike = Window.partitionBy("bucket", side)
        several = several.withColumn(f"{side}_alike", (F.min("run").over(alike) < F.max("run").over(alike)) & (F.min("doc").over(alike) < F.max("doc").over(alike)))
    kept = several.where(F.col("taken") | F.col("left_alike") | F.col("right_alike"))
    found = stash(kept.select("bucket", "doc", F.shiftright("place", 32).cast("int").alias("start"), (F.col("place") % (1 << 32)).cast("int").alias("n"), "taken"), "runs")

    open_ = found.where("not taken").groupBy("doc").agg(F.collect_list(F.struct("bucket", "start", "n")).alias("runs")).withColumnRenamed("doc", "doc_id")
    data = stash(docs.join(open_.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "runs").mapInArrow(_fetched(length), "bucket long, doc long, start int, data binary").distinct(), "bytes")
    sizes = data.groupBy("bucket").count()
    wide = sizes.where(F.col("count") > WIDE_BUCKET).select("bucket")
    narrow = data.join(wide, "bucket", "left_anti")
    groups = max(partitions(docs.sparkSession), data.count() // GROUP_RUNS)
    fine = narrow.groupBy(F.pmod("bucket", F.lit(groups)).alias("group")).applyInPandas(_refined(length), "doc long, start int, n int")
    strings = data.join(wide, "bucket", "left_semi").select("doc", "start", "data").mapInArrow(_strings(length), "doc long, start int, string binary")
    lows = strings.groupBy("string").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    rest = strings.join(lows, "string").where("doc > low").select("doc", "start", F.lit(1).alias("n"))
    return found.where("taken").select("doc", "start", "n").union(fine).union(rest)


def merged(starts: list[int], counts: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges."""
    out: list[list[int]] = []
    for a, n in sorted(zip(starts, counts, strict=True)):
        b = a + n + length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for doc, text, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    ranges = merged([s["start"] for s in spans or ()], [s["n"] for s in spans or ()], length)
                    kept, end = [], 0
                    for a, b in ranges:
                        kept.append(data[end:a])
                        end = b
                    kept = b"".join([*kept, data[end:]])
                    rows.append((doc, len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _with_spans(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """The documents and, in a column __spans, what repeats in each."""
    docs = text_rows(documents)
    starts = repeated_starts(docs.where("doc_id is not null and text is not null"), length, gram)
    spans = stash(starts.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("start", "n")).alias("__spans")), "spans")
    # Texts and findings meet in one shuffle by document at every size; neither is ever broadcast.
    return documents.join(spans.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__doc"), "left").drop("__doc")


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes) for every row of documents."""
    rows = _with_spans(documents.select("doc_id", "text"), length, gram).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "__spans")
    return rows.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def shorten(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents, with all their columns, with repeats taken out of text (parts of characters go too) and n_chars set anew."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, names.index("text")):
                texts = []
                for text, spans in zip(part.column(names.index("text")).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                    if spans:
                        data, kept, end = text.encode("utf-8", "surrogatepass"), [], 0
                        for a, b in merged([s["start"] for s in spans], [s["n"] for s in spans], length):
                            kept.append(data[end:a])
                            end = b
                        text = b"".join([*kept, data[end:]]).decode("utf-8", "ignore")
                    texts.append(text)
                columns = [part.column(i) for i in range(len(names))]
                columns[names.index("text")] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    i = names.index("n_chars")
                    columns[i] = pa.array([None if t is None else len(t) for t in texts], columns[i].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return _with_spans(documents, length, gram).mapInArrow(run, documents.schema)


def op7_bucket_pointer_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op7_bucket_pointer_substrings": op7_bucket_pointer_substrings}
SQL: dict[str, str] = {}
