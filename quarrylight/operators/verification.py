"""Labels from outside against the stored text: only matches whose every cited sentence exists, lies in its chunk and is exact get through."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quarrylight.functions.text import looks_like_injection, normalize_ws, numbers_in

MAX_GAP = 2
#: Into how many arrays the labels of one document may be parted, by claim.
BLOCKS = 64
RELATIONS = ("direct", "paraphrase", "partial", "contradicts")


def request_batches(selected: DataFrame, sents: DataFrame, size: int = 8, batch: int = 8, overlap: int = 1) -> DataFrame:
    """claim_id, batch, chunks: what a labeller gets, ``batch`` chunks a row, sentences numbered as [d<doc>.s<n>] and made harmless.

    selected: claim_id, doc_id, chunk_idx, sent_start, sent_end, pick.  A document's sentences meet its chunks in one row.
    """
    from quarrylight.functions.text import sanitize_source_text

    line = F.concat(F.lit("[d"), F.col("doc_id").cast("string"), F.lit(".s"), F.col("sent_idx").cast("string"), F.lit("] "), sanitize_source_text(F.col("text")))
    lines = _gathered(sents.select("doc_id", "sent_idx", line.alias("line")), "sents")
    fields = ["claim_id", "doc_id", "chunk_idx", "pick"]
    shown = _blocks(selected.select(*fields, "sent_start", "sent_end"), "chunks").join(lines, "doc_id").select("chunks", "sents")
    texts = shown.mapInArrow(_shown, StructType([selected.schema[f] for f in fields]).add("text", "string").add("n", "integer")).where("n > 0").drop("n")
    numbered = texts.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("claim_id").orderBy("pick", "doc_id", "chunk_idx")) - 1) / batch))
    return numbered.groupBy("claim_id", "batch").agg(F.array_sort(F.collect_list(F.struct("pick", "doc_id", "chunk_idx", "text"))).alias("chunks"))


def _gathered(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """doc_id (and keys), and all other columns of a document's rows as an array of structs."""
    kept = [c for c in rows.columns if c not in ("doc_id", *keys)]
    return rows.groupBy("doc_id", *keys).agg(F.collect_list(F.struct(*kept)).alias(name))


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """doc_id, and an array of whole rows (claim_id, doc_id, ...) of some of its claims: a document that very many claims meet has several arrays."""
    blocked = rows.withColumn("__block", F.pmod(F.hash("claim_id"), F.lit(BLOCKS)))
    return blocked.groupBy("doc_id", "__block").agg(F.collect_list(F.struct(*rows.columns)).alias(name)).drop("__block")


def _lists(column: pa.Array) -> tuple[pa.StructArray, Iterator[range]]:
    """The structs of all lists one after another, and the range of each list."""
    offsets = column.offsets.to_numpy()
    return column.values, itertools.starmap(range, itertools.pairwise(offsets.tolist()))


def _field(structs: pa.StructArray, name: str) -> list:
    return structs.field(name).to_pylist()


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (chunks, chunk_ranges), (sents, sent_ranges) = _lists(batch.column("chunks")), _lists(batch.column("sents"))
        first, last, number, line = _field(chunks, "sent_start"), _field(chunks, "sent_end"), _field(sents, "sent_idx"), _field(sents, "line")
        texts, counts = [None] * len(chunks), [0] * len(chunks)
        for mine, held in zip(chunk_ranges, sent_ranges, strict=True):
            at = {number[j]: line[j] for j in held}
            for i in mine:
                found = [at[n] for n in range(first[i], last[i] + 1) if n in at]
                texts[i], counts[i] = "\n".join(x for x in found if x is not None), len(found)
        passed = [chunks.field(f) for f in ("claim_id", "doc_id", "chunk_idx", "pick")]
        yield pa.RecordBatch.from_arrays([*passed, pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["claim_id", "doc_id", "chunk_idx", "pick", "text", "n"])


def first_labels(labels: DataFrame) -> DataFrame:
    """The first label of each claim and chunk (columns claim_id, doc_id, chunk_idx, pos, ...)."""
    order = Window.partitionBy("claim_id", "doc_id", "chunk_idx").orderBy("pos")
    return labels.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def verify(labels: DataFrame, chunks: DataFrame, sents: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, rejects).

    labels: claim_id, doc_id, chunk_idx, pos, relation, sentence_ids (array of text such as d3.s41), confidence, reason;
    chunks: doc_id, chunk_idx, sent_start, sent_end; sents: doc_id, sent_idx, text, start, end; docs: doc_id, text.

    Reasons come in this order: irrelevant, no_sentences, fabricated_id (chunk unknown, id malformed, of another document, outside the
    chunk or unknown), injection, not_verbatim.  A match is dropped whole.  Offsets are code points.  A document's labels meet its text,
    sentences and chunks in one row, so texts are dealt out by document once and never copied for a label.
    """
    part = lambda sid, n: F.regexp_extract(F.trim(sid), r"^d([0-9]+)\.s([0-9]+)$", n)
    cited = F.transform(F.array_distinct("sentence_ids"), lambda sid: F.when(part(sid, 1).try_cast("long") == F.col("doc_id"), part(sid, 2).try_cast("int")))
    # Whoever names a sentence by another document's id still names its number, which may hold an injection.
    numbers = F.transform(F.array_distinct("sentence_ids"), lambda sid: part(sid, 2).try_cast("int"))
    given = first_labels(labels).select(*_PASSED, F.coalesce(F.size("sentence_ids"), F.lit(0)).alias("n_ids"), cited.alias("cited"), numbers.alias("numbers"))
    held = sents.select("doc_id", "sent_idx", "text", "start", "end", F.coalesce(looks_like_injection(F.col("text")), F.lit(False)).alias("bad"))
    rows = _blocks(given, "labels").join(_gathered(held, "sents"), "doc_id", "left").join(_gathered(chunks.select("doc_id", "chunk_idx", "sent_start", "sent_end"), "chunks"), "doc_id", "left")
    rows = rows.join(docs.select("doc_id", "text", F.lit(True).alias("has_doc")), "doc_id", "left").select("labels", "sents", "chunks", "text", "has_doc")
    result = rows.mapInArrow(_judged, StructType([StructField(f, labels.schema[f].dataType) for f in _PASSED] + _JUDGED.fields))
    rejects = result.where("failure is not null").select("claim_id", "doc_id", "chunk_idx", "pos", F.col("failure").alias("reason"))
    good = result.where("failure is null")
    matches = good.select("claim_id", "doc_id", "chunk_idx", "relation", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("confidence"), F.trim("reason").alias("reason"), "sentence_idx", "passage", "fragments", "char_start", "char_end", "context_before", "context_after")
    return matches, rejects


_PASSED = ["claim_id", "doc_id", "chunk_idx", "pos", "relation", "confidence", "reason"]
_PART = StructType().add("text", "string").add("match", "boolean")
_PLACE = StructType().add("frag_no", "long").add("first", "integer").add("last", "integer").add("char_start", "long").add("char_end", "long").add("text", "string").add("parts", ArrayType(_PART))
_JUDGED = StructType().add("failure", "string").add("sentence_idx", ArrayType(IntegerType())).add("passage", "string").add("fragments", ArrayType(_PLACE))
_JUDGED = _JUDGED.add("char_start", "long").add("char_end", "long").add("context_before", "string").add("context_after", "string")
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def _judge(relation: str | None, n_ids: int, cited: list, numbers: list, span: tuple | None, sents: dict, text: str | None, has_doc: bool) -> tuple:
    """The columns of ``_JUDGED`` for one label.  sents: sent_idx -> text, start, end, whether it holds an injection."""
    failed = lambda reason: (reason, *[None] * 7)
    if relation == "irrelevant":
        return failed("irrelevant")
    if n_ids <= 0:
        return failed("no_sentences")
    known = lambda i: i is not None and i in sents and sents[i][0] is not None
    if span is None or None in span or not has_doc or not all(known(i) and span[0] <= i <= span[1] for i in cited):
        return failed("fabricated_id")
    if any(i in sents and sents[i][3] for i in numbers):
        return failed("injection")
    idx = sorted(set(cited))
    # Fragments: cited sentences with at most MAX_GAP others between them, with the gaps filled.
    runs = [[idx[0]]]
    for i in idx[1:]:
        if i - runs[-1][-1] - 1 > MAX_GAP:
            runs.append([i])
        else:
            runs[-1].append(i)
    fragments, gap = [], False
    for number, run in enumerate(runs):
        parts, places = [], []
        for i in range(run[0], run[-1] + 1):
            said, start, end, bad = sents.get(i, (None, None, None, False))
            if text is None or said is None or start is None or end is None or not 0 <= start < end or text[start:end] != said:
                return failed("not_verbatim")
            gap = gap or (bad and i not in run)
            parts.append({"text": said, "match": i in run})
            places.append((start, end))
        begin, stop = min(p[0] for p in places), max(p[1] for p in places)
        fragments.append({"frag_no": number, "first": run[0], "last": run[-1], "char_start": begin, "char_end": stop, "text": text[begin:stop], "parts": parts})
    if gap:
        return failed("injection")
    passage = " […] ".join(_SPACE.sub(" ", f["text"]).strip(" ") for f in fragments)
    near = [None if sents.get(i, (None, 0, 0, True))[3] else sents[i][0] for i in (idx[0] - 1, idx[-1] + 1)]
    return (None, idx, passage, fragments, min(f["char_start"] for f in fragments), max(f["char_end"] for f in fragments), *near)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of documents, each document's with its text, sentences and chunks in one row."""
    types = [f.type for f in to_arrow_schema(_JUDGED)]
    for batch in batches:
        (labels, mine), (sents, held), (chunks, spans) = (_lists(batch.column(c)) for c in ("labels", "sents", "chunks"))
        asked = list(zip(*(_field(labels, f) for f in ("relation", "n_ids", "cited", "numbers", "chunk_idx")), strict=True))
        said = list(zip(_field(sents, "sent_idx"), zip(*(_field(sents, f) for f in ("text", "start", "end", "bad")), strict=True), strict=True))
        span = list(zip(_field(chunks, "chunk_idx"), zip(_field(chunks, "sent_start"), _field(chunks, "sent_end"), strict=True), strict=True))
        out: list = [None] * len(labels)
        for text, has_doc, a, b, c in zip(batch.column("text").to_pylist(), batch.column("has_doc").to_pylist(), mine, held, spans, strict=True):
            known, where = dict(said[b.start : b.stop]), dict(span[c.start : c.stop])
            for i in a:
                relation, n_ids, cited, numbers, chunk = asked[i]
                out[i] = _judge(relation, n_ids, cited, numbers, where.get(chunk), known, text, bool(has_doc))
        columns = [pa.array(column, t) for column, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([*(labels.field(f) for f in _PASSED), *columns], names=[*_PASSED, *_JUDGED.names])


def failure_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def reverify(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """claim_id, doc_id, chunk_idx, still_there: stored passages against a newer snapshot of the texts, fragment by fragment."""
    flat = docs.select("doc_id", normalize_ws(F.col("text")).alias("body"))
    there = F.forall("fragments", lambda f: F.contains("body", F.trim(F.regexp_replace(f["text"], r"\s+", " "))))
    return matches.join(flat, "doc_id", "left").select("claim_id", "doc_id", "chunk_idx", F.coalesce(there, F.lit(False)).alias("still_there"))


def upsert_pool(pool: DataFrame, fresh: DataFrame) -> DataFrame:
    """Matches of all rounds; of those with the same chunk and sentences the earliest round stays."""
    key = ["claim_id", "doc_id", "chunk_idx", "sentence_idx"]
    order = Window.partitionBy(*key).orderBy("round")
    return pool.unionByName(fresh, allowMissingColumns=True).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def guard_numbers(summaries: DataFrame, sources: DataFrame) -> DataFrame:
    """claim_id, doc_id, summary, dropped: summary sentences whose every number stands in the source's text.

    summaries: claim_id, doc_id, summary; sources: doc_id, text.
    """
    allowed = sources.select("doc_id", numbers_in(F.col("text")).alias("allowed"))
    parts = F.filter(F.transform(F.regexp_extract_all("summary", F.lit(r"[^.!?]+(?:[.!?]+[^\s.!?][^.!?]*)*[.!?]*"), F.lit(0)), lambda t: F.trim(t)), lambda s: s != "")
    held = summaries.join(allowed, "doc_id", "left").withColumn("all", parts)
    kept = F.filter("all", lambda s: F.size(F.array_except(numbers_in(s), F.coalesce("allowed", F.expr("cast(array() as array<string>)")))) == 0)
    return held.select("claim_id", "doc_id", F.array_join(kept, " ").alias("summary"), (F.size("all") - F.size(kept)).alias("dropped"))
