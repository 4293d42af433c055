"""Pages of a document as one running text, with the place where each page starts.

Running lines go first (``segment.edge_lines``), then each page's lines are joined, then the pages: a word that is broken across pages is
healed, a sentence that goes on continues after a space, and what ends like a sentence ends a paragraph.  What a page adds depends on the page before it
alone, so the fold is a look back and a running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import join_lines, normalize_doc_text
from quarrylight.operators import segment

#: What a page ends with if its last paragraph is closed.
CLOSED = r"[.!?:;\"”’)\]]$"


def page_parts(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, part, start: what each page adds to its document's text, and where in that text it starts (code points, from 0).

    pages: doc_id, page_no, text.  Pages without text are left out.  The separator belongs to the part of the page before.
    """
    joined = pages.select("doc_id", "page_no", join_lines(F.col("text")).alias("joined"))
    # Normalising refers to its text several times, so that is a column of its own; exploding an array of one keeps the filter from being pushed below it.
    plain = joined.select("doc_id", "page_no", F.explode(F.array(normalize_doc_text(F.col("joined")))).alias("text")).where(F.length("text") > 0)
    order = Window.partitionBy("doc_id").orderBy("page_no")
    onward = F.lead("text").over(order)
    broken = F.col("text").rlike("[A-Za-z]-$") & onward.rlike("^[a-z]")
    healed = F.col("text").substr(F.lit(1), F.length("text") - 1)
    spaced = F.concat("text", F.when(F.col("text").rlike(CLOSED), "\n\n").otherwise(" "))
    parts = plain.withColumn("part", F.when(onward.isNull(), F.col("text")).when(broken, healed).otherwise(spaced))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("part").cast("long")).over(before), F.lit(0))
    return parts.select("doc_id", "page_no", "part", start.alias("start"))


def running_text(pages: DataFrame) -> DataFrame:
    """doc_id, text, page_starts (array of page and start): each document's pages joined, running lines dropped."""
    parts = page_parts(segment.edge_lines(pages))
    listed = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "start", "part"))).alias("all"))
    starts = F.transform("all", lambda p: F.struct(p["page_no"].alias("page"), p["start"].alias("start")))
    return listed.select("doc_id", F.array_join(F.transform("all", lambda p: p["part"]), "").alias("text"), starts.alias("page_starts"))


def sentence_pages(texts: DataFrame) -> DataFrame:
    """doc_id, sent_idx, text, start, end, page of running texts: the page on which each sentence starts."""
    sents = segment.sentences(texts.select("doc_id", "text"))
    starts = texts.select("doc_id", F.explode("page_starts").alias("p")).select("doc_id", F.col("p.page").alias("page"), F.col("p.start").alias("start"))
    found = segment.page_for(sents.withColumn("offset", F.col("start")), starts)
    return found.select("doc_id", "sent_idx", "text", "start", "end", "page")
