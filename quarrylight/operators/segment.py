"""Documents to sentences with exact offsets, to overlapping chunks, and to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import normalize_doc_text

# Abbreviations after which a full stop rarely ends a sentence.
ABBREVIATIONS = (
    "e\\.g i\\.e et\\s{1,9}al etc vs cf approx fig figs no nos vol pp ch sec eq dr mr mrs ms prof jr sr st inc ltd co corp "
    "jan feb mar apr jun jul aug sep sept oct nov dec est resp ibid op cit al"
).split()
#: Stands between two sentences while they are told apart; a noncharacter, which texts don't hold (one that does gets U+FFFD instead).
MARK = "﷐"
#: Where a sentence may end: stops, with what closes behind them, before white space; a line's end always.
END = r"([.!?]+[\"')\]]*\s+|\n\s*)"
#: No end after all: an abbreviation (behind no letter, mark or digit, in any script) before a small letter, a digit or a bracket on the same line, or a number or letter of a list.
#: Each looks back from a mark, of which there are few.
ABBREVIATED = rf"{MARK}(?=[a-z0-9(])(?<=(?<![\p{{L}}\p{{Mn}}\p{{Nd}}_])(?i:{'|'.join(ABBREVIATIONS)})\.[ \t]{{1,9}}{MARK})"
STUB = rf"((?:^|\n|{MARK})[(\[]?[0-9A-Za-z]{{1,2}}[.)\]][ \t]+){MARK}"
#: Characters from which a sentence is cut: after a semicolon or colon past 40 percent of that, else at a space.  The parts are as lossless as the whole.
LONGEST = 600
CUT = r"(?s).{1,600}\z|.{239,598}[;:] |.{1,599}\s|.{1,600}"


def build_docs(docs: DataFrame) -> DataFrame:
    """doc_id, text: composed letters, normalised spacing, the whole text."""
    return docs.select("doc_id", normalize_doc_text(F.col("text")).alias("text"))


def pieces(text: Column) -> Column:
    """The text in pieces that join to it again: sentences, with stubs of lists glued to what follows and long ones in parts.

    Ends are marked in the text and wrong marks taken out again, each by one simple pattern; every character lands in a piece.
    """
    marked = F.regexp_replace(F.translate(text, MARK, "\ufffd"), END, f"$1{MARK}")
    marked = F.regexp_replace(F.regexp_replace(marked, ABBREVIATED, ""), STUB, "$1")
    whole = F.filter(F.split(marked, MARK), lambda p: p != "")
    return F.flatten(F.transform(whole, lambda p: F.when(F.length(p) > LONGEST, F.regexp_extract_all(p, F.lit(CUT), F.lit(0))).otherwise(F.array(p))))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_idx, text, start, end with substring(doc, start, end) = text (code points, from 0).

    One explode and one window, whose shuffle by doc_id chunking and verification reuse.  What the window sums, lengths and marks of
    pieces that are not blank, is worked out before the shuffle.
    """
    part = docs.select("doc_id", F.posexplode(pieces(F.col("text"))).alias("i", "part"))
    bare = part.select("doc_id", "i", F.length("part").alias("size"), (F.length("part") - F.length(F.regexp_replace("part", r"^\s+", ""))).alias("left"), F.regexp_replace("part", r"^\s+|\s+$", "").alias("text"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    placed = bare.withColumns({"at": summed(F.col("size").cast("long")), "sent_idx": summed((F.length("text") > 0).cast("long")).cast("int")})
    full = placed.where(F.length("text") > 0).withColumn("start", F.col("at") + F.col("left"))
    return full.select("doc_id", "sent_idx", "text", "start", (F.col("start") + F.length("text")).alias("end"))


def sentence_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n: how many sentences each document has, counted where it is read."""
    n = F.size(F.filter(pieces(F.col("text")), lambda p: p.rlike(r"\S")))
    # Exploding an array of one keeps the filter from being pushed down, which would segment every text twice.
    return docs.select("doc_id", F.explode(F.array(n)).alias("n")).where("n > 0")


def chunk_counts(counts: DataFrame, size: int = 4, overlap: int = 1) -> DataFrame:
    """Adds chunks, how many a document of n sentences has: the last ends at the last sentence and holds more than the overlap."""
    return counts.withColumn("chunks", F.greatest(F.lit(1), F.ceil((F.col("n") - overlap) / F.lit(size - overlap))).cast("int"))


def chunk_spans(counts: DataFrame, size: int = 4, overlap: int = 1) -> DataFrame:
    """doc_id, chunk_idx, sent_start, sent_end for documents of n sentences: windows of sentences."""
    step = size - overlap
    return chunk_counts(counts, size, overlap).select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_idx")).select(
        "doc_id", "chunk_idx", (F.col("chunk_idx") * step).alias("sent_start"), (F.least(F.col("chunk_idx") * step + size, F.col("n")).cast("int") - 1).alias("sent_end")
    )


def chunks(sents: DataFrame, size: int = 4, overlap: int = 1) -> DataFrame:
    """``chunk_spans`` of documents whose sentences are at hand."""
    return chunk_spans(sents.groupBy("doc_id").agg((F.max("sent_idx") + 1).alias("n")), size, overlap)


def chunk_sentences(sents: DataFrame, size: int = 4, overlap: int = 1) -> DataFrame:
    """Every sentence once for each chunk that shows it: chunk numbers follow from the sentence number, so no range join is needed."""
    step = size - overlap
    n = F.max("sent_idx").over(Window.partitionBy("doc_id")) + 1
    last = F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(step))).cast("int") - 1
    first = F.greatest(F.lit(0), F.ceil((F.col("sent_idx") - (size - 1)) / F.lit(step)).cast("int"))
    return sents.withColumn("last", last).withColumn("chunk_idx", F.explode(F.sequence(F.least(first, "last"), F.least((F.col("sent_idx") / step).cast("int"), F.col("last"))))).drop("last")


def gathered(sents: DataFrame, column: str, size: int = 4, overlap: int = 1) -> DataFrame:
    """doc_id, chunk_idx, parts: each chunk's values of a column of its sentences, in order."""
    shown = chunk_sentences(sents, size, overlap)
    return shown.groupBy("doc_id", "chunk_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", column))), lambda s: s[column]).alias("parts"))


def chunk_texts(sents: DataFrame, size: int = 4, overlap: int = 1) -> DataFrame:
    """doc_id, chunk_idx, text of the shown sentences joined by spaces."""
    return gathered(sents, "text", size, overlap).select("doc_id", "chunk_idx", F.array_join("parts", " ").alias("text"))


def page_for(offsets: DataFrame, starts: DataFrame) -> DataFrame:
    """As-of lookup: adds the page whose start is the last at or before ``offset``, else the document's first page.

    offsets: doc_id, offset, ...; starts: doc_id, page, start.  Page starts are one array a document.
    """
    pages = starts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "page"))).alias("pages"))
    upto = F.filter("pages", lambda p: p["start"] <= F.col("offset"))
    page = F.coalesce(F.try_element_at(upto, F.lit(-1))["page"], F.try_element_at("pages", F.lit(1))["page"])
    return offsets.join(pages, "doc_id", "left").withColumn("page", page).drop("pages")


def edge_lines(pages: DataFrame, edge: int = 3) -> DataFrame:
    """Drops running headers, footers and page numbers: doc_id, page_no, text.

    A line among a page's first or last ``edge`` non-empty ones goes if its key (digits as #) stands there on over half of the document's
    pages (of three or more), or if it looks like a page number.  Pages are dealt out by document once; lines stay in their page's row.
    """
    dealt = pages.select("doc_id", "page_no", "text").repartition("doc_id")
    # Exploding an array of one keeps filters from being pushed down, which would clean every line twice.
    lines = dealt.where("text is not null").select("doc_id", "page_no", F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))).alias("lines"))
    filled = lines.withColumn("filled", F.filter(F.transform("lines", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull()))
    first, last = F.try_element_at("filled", F.lit(edge)), F.try_element_at("filled", F.lit(-edge))
    ends = filled.select("doc_id", "page_no", "lines", F.coalesce(first, F.size("lines")).alias("first"), F.coalesce(last, F.lit(0)).alias("last"))
    key = lambda x, i: F.when((x != "") & ((i <= F.col("first")) | (i >= F.col("last"))), F.regexp_replace(F.lower(x), "[0-9]+", "#"))
    marked = ends.select("doc_id", "page_no", F.transform("lines", lambda x, i: F.struct(x.alias("line"), key(x, i).alias("key"))).alias("lines"))
    counts = marked.select("doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key")).where("key is not null").groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    sizes = dealt.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages")).where("pages >= 3")
    running = counts.join(sizes, "doc_id").where(F.col("n") > F.col("pages") * 0.5).groupBy("doc_id").agg(F.collect_list("key").alias("running"))
    number = r"^(?i)(page\s*)?[-–—]?\s*\d{1,4}\s*[-–—]?(\s*(of|/)\s*\d{1,4})?$"
    goes = lambda x: x["key"].isNotNull() & (F.coalesce(F.array_contains("running", x["key"]), F.lit(False)) | x["line"].rlike(number))
    kept = marked.join(running, "doc_id", "left").select("doc_id", "page_no", F.explode(F.array(F.filter("lines", lambda x: ~goes(x)))).alias("lines"))
    return kept.where("size(lines) > 0").select("doc_id", "page_no", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def keep_pages(pages: DataFrame, terms: Column, first: int = 60, scanned: int = 300) -> DataFrame:
    """Pages up to ``first``, and later ones up to ``scanned`` that mention a key term of over two letters."""
    mentions = F.exists(terms, lambda t: (F.length(t) > 2) & F.contains(F.lower("text"), F.lower(t)))
    return pages.where((F.col("page_no") <= first) | ((F.col("page_no") <= scanned) & mentions))
