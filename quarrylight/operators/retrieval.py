"""BM25 over chunks, key-term retrieval, and the choice of chunks per claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import retrieved, stem, terms_of_tokens, tokens, word_parts
from quarrylight.operators.segment import gathered
from quarrylight.operators.tables import bounded, cut, fresh_path, write_buckets

K1, B = 1.5, 0.75
#: Shingles of claims that are tested inside each document, without a join.
ANCHORS = 2_000
#: Letters by which very short claims are looked up.
LETTERS = 4


def chunk_terms(sents: DataFrame, size: int = 4, overlap: int = 1) -> DataFrame:
    """doc_id, chunk_idx, len, terms: single words and neighbouring pairs of each chunk.  A sentence is tokenised once, however many chunks show it."""
    toks = sents.select("doc_id", "sent_idx", tokens(F.col("text")).alias("toks"))
    terms = gathered(toks, "toks", size, overlap).select("doc_id", "chunk_idx", terms_of_tokens(F.flatten("parts")).alias("terms"))
    return terms.select("doc_id", "chunk_idx", F.size("terms").alias("len"), "terms")


def term_frequencies(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, len, term, tf of the asked terms, which filter the exploded rows before they are counted."""
    rows = terms.select("doc_id", "chunk_idx", "len", F.explode("terms").alias("term")).join(asked, "term", "left_semi")
    return rows.groupBy("doc_id", "chunk_idx", "len", "term").agg(F.count("*").alias("tf"))


def query_terms(claims: DataFrame, most: int = 3) -> DataFrame:
    """claim_id, term, weight: how often the term stands in the claim's query texts (array ``texts``), at most ``most`` times."""
    parts = claims.select("claim_id", F.explode("texts").alias("text")).select("claim_id", tokens(F.col("text")).alias("toks"))
    rows = parts.select("claim_id", F.explode(terms_of_tokens(F.col("toks"))).alias("term"))
    return rows.groupBy("claim_id", "term").agg(F.least(F.count("*"), F.lit(most)).cast("double").alias("weight"))


def query_texts(plans: DataFrame, counter: bool = False) -> DataFrame:
    """claim_id, texts for ``query_terms``: key terms twice, paraphrases and the core proposition; for counter-query documents the counter query twice.

    plans: claim_id, key_terms, paraphrases, core_proposition, counter_query.
    """
    texts = F.concat("key_terms", "key_terms", "paraphrases", F.array("core_proposition"))
    return plans.select("claim_id", F.array_compact(F.concat(texts, F.array("counter_query", "counter_query")) if counter else texts).alias("texts"))


def scored_terms(tf: DataFrame, df: DataFrame, totals: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """claim_id, doc_id, chunk_idx, score from term frequencies, document frequencies (term, df), totals (n, avg_len; one row) and queries.

    Claims of a bounded number of terms are sent to the postings, which were dealt out by document once: scores are summed where they lie,
    and what follows by document needs no further shuffle.  Beyond the bound both sides meet by term.
    """
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    asked = queries.join(df, "term").crossJoin(F.broadcast(totals)).select("term", "claim_id", "weight", idf.alias("idf"), "avg_len")
    asked = cut(asked, "asked")
    few = bounded(asked)
    rows = tf.join(asked, "term") if few is None else tf.repartition("doc_id").join(few, "term")
    norm = F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.col("avg_len")))
    return rows.groupBy("claim_id", "doc_id", "chunk_idx").agg(F.round(F.sum(F.col("weight") * F.col("idf") * norm), 6).alias("score"))


def bm25(terms: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """claim_id, doc_id, chunk_idx, score over the chunks of ``chunk_terms``.

    Document frequencies are only counted for terms that some query has.  Segmentation is done once: statistics, frequencies and
    scores read the same shuffled sentences and the same shuffled counts.
    """
    tf = term_frequencies(terms, queries.select("term").distinct())
    # Counting by tf keeps that column, so this reads the very exchange that the scores read.
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    totals = terms.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg_len"))
    return scored_terms(tf, df, totals, queries, k1, b)


def select_chunks(scored: DataFrame, per_doc: int = 3, total: int = 25, size: int = 4, overlap: int = 1, considered: int = 50) -> DataFrame:
    """Best chunks of a claim: per document up to ``per_doc`` that share no sentence, then all documents' best first, up to ``total``.

    Of a document's chunks the ``considered`` best are looked at, which bounds the array that the greedy choice folds over: a taken
    chunk rules out its two neighbours only, so any 3 * per_doc suffice.
    """
    step = size - overlap
    best = Window.partitionBy("claim_id", "doc_id").orderBy(F.desc("score"), "chunk_idx")
    near = scored.where("score > 0").withColumn("n", F.row_number().over(best)).where(F.col("n") <= max(considered, 3 * per_doc))
    listed = near.groupBy("claim_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "chunk_idx"))).alias("all"))
    nothing = F.expr("cast(array() as array<struct<neg:double,chunk_idx:int>>)")
    reach = (size - 1) // step  # chunks so near share a sentence
    free = lambda taken, c: ~F.exists(taken, lambda t: F.abs(t["chunk_idx"] - c["chunk_idx"]) <= reach)
    picked = F.aggregate("all", nothing, lambda taken, c: F.when((F.size(taken) < per_doc) & free(taken, c), F.concat(taken, F.array(c))).otherwise(taken))
    rows = listed.select("claim_id", "doc_id", F.posexplode(picked).alias("doc_rank", "c")).select("claim_id", "doc_id", "doc_rank", F.col("c.chunk_idx").alias("chunk_idx"), (-F.col("c.neg")).alias("score"))
    return best_picks(rows, total)


def best_picks(rows: DataFrame, total: int) -> DataFrame:
    """Adds pick (from 1): all documents' first chunks before their second ones, up to ``total`` a claim.  rows: claim_id, doc_id, chunk_idx, doc_rank, score."""
    order = Window.partitionBy("claim_id").orderBy("doc_rank", F.desc("score"), "doc_id", "chunk_idx")
    return rows.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= total)


def keyword_hits(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """claim_id, doc_id, matched, mode: documents with all of a claim's terms, or, where there are none and the claim has over two terms, with any.

    queries: claim_id, term; docs: doc_id, text.  Terms meet documents by equality, never by scanning pairs.  A document's distinct words are stemmed
    as rows, and only those with an asked stem are looked at further.
    """
    asked = cut(queries.select("claim_id", "term").distinct(), "asked")
    terms = cut(asked.select("term").distinct(), "terms")
    few = bounded(terms)
    # Exploding an array of one keeps what is asked of the words from being worked out on the texts once more.
    listed = docs.select("doc_id", F.explode(F.array(F.array_distinct(word_parts(F.col("text"))))).alias("words"))
    words = listed.select("doc_id", F.explode("words").alias("word")).where(retrieved(F.col("word"))).select("doc_id", stem(F.col("word")).alias("term"))
    return keyword_modes(asked, words.join(terms if few is None else few, "term", "left_semi").distinct())


def keyword_modes(asked: DataFrame, held: DataFrame) -> DataFrame:
    """claim_id, doc_id, matched, mode of asked terms (claim_id, term) and terms that documents hold (doc_id, term), each once.

    What documents hold is dealt out by document once; pairs are counted where it lies, and those of any term only for claims that no document has whole.
    """
    spark = held.sparkSession
    sizes = asked.groupBy("claim_id").agg(F.count("*").alias("n"))
    asked = cut(asked.join(sizes, "claim_id"), "sized")
    held = write_buckets(held.select("doc_id", "term"), fresh_path(spark, "held"), "doc_id", ["doc_id"], int(spark.conf.get("spark.sql.shuffle.partitions")))

    def counted(claims: DataFrame) -> DataFrame:
        few = bounded(claims)
        return held.join(claims if few is None else few, "term").groupBy("doc_id", "claim_id", "n").agg(F.count("*").alias("matched"))

    strict = cut(counted(asked).where("matched = n").select("claim_id", "doc_id", "matched"), "strict")
    none = cut(asked.where("n > 2").join(strict.select("claim_id").distinct(), "claim_id", "left_anti"), "loose")
    loose = counted(none)
    return strict.withColumn("mode", F.lit("all")).union(loose.select("claim_id", "doc_id", "matched", F.lit("any").alias("mode")))


def verbatim_pairs(claims: DataFrame, docs: DataFrame, words: int = 8) -> DataFrame:
    """claim_id, doc_id for claims that stand verbatim (white space aside) in a document.

    One shingle of each claim, from its second word on, is joined by hash with the shingles of all documents, and
    only those pairs are compared as texts.  Claims of one or two words, which may stand inside words, meet documents by their first letters.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    asked = claims.select("claim_id", flat(F.col("text")).alias("claim")).where(F.length("claim") > 0)
    asked = asked.withColumn("w", F.split("claim", " ")).withColumn("n", F.least(F.lit(words), F.greatest(F.lit(1), F.size("w") - 2)))
    h = F.transform(F.slice("w", 2, "n"), lambda x: F.xxhash64(x))
    anchor = F.coalesce(*(F.when(F.col("n") == n, F.xxhash64(*(F.get(h, F.lit(k)) for k in range(n)))) for n in range(1, words + 1)))
    # Inner words of a claim are whole words of the document; the outer ones may be cut from longer words.
    asked = asked.withColumn("anchor", F.when(F.size("w") >= 3, anchor))
    sizes = [r["n"] for r in asked.where("anchor is not null").select("n").distinct().collect()]  # at most ``words`` numbers
    body = docs.select("doc_id", flat(F.col("text")).alias("body")).withColumn("w", F.split("body", " "))
    body = body.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    shingle = lambda n: F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(n))))
    none = F.expr("cast(array() as array<bigint>)")
    every = F.flatten(F.array(*(F.when(F.size("w") >= n, shingle(n)).otherwise(none) for n in sizes))) if sizes else none
    anchored = asked.where("anchor is not null").select("claim_id", "claim", "anchor")
    few = [r["anchor"] for r in anchored.select("anchor").distinct().limit(ANCHORS + 1).collect()]
    if len(few) <= ANCHORS:  # a document's shingles are tested where they are made; nearly none are left to meet claims
        held = body.select("doc_id", "body", F.explode(F.array_intersect(every, F.array(*map(F.lit, few)) if few else none)).alias("anchor"))
        found = held.join(anchored, "anchor").where(F.contains("body", "claim")).select("claim_id", "doc_id")
    else:
        near = body.select("doc_id", F.explode(F.array_distinct(every)).alias("anchor")).join(anchored, "anchor").select("doc_id", "claim_id", "claim")
        found = near.join(body.select("doc_id", "body"), "doc_id").where(F.contains("body", "claim")).select("claim_id", "doc_id")
    # One or two words may stand inside longer words: they meet documents by their first letters, then as texts.
    tiny = asked.where("anchor is null").select("claim_id", "claim").withColumn("q", F.least(F.length("claim"), F.lit(LETTERS))).withColumn("start", F.expr("left(claim, q)"))
    widths = [r["q"] for r in tiny.select("q").distinct().collect()]  # at most LETTERS numbers
    if not widths:
        return found.distinct()
    starts = lambda q: F.transform(F.sequence(F.lit(1), F.greatest(F.length("body") - q + 1, F.lit(1))), lambda i: F.substring("body", i, F.lit(q)))
    grams = F.array_distinct(F.flatten(F.array(*map(starts, widths))))
    held = body.select("doc_id", F.explode(grams).alias("start")).join(tiny, "start").select("doc_id", "claim_id", "claim")
    return found.union(held.join(body.select("doc_id", "body"), "doc_id").where(F.contains("body", "claim")).select("claim_id", "doc_id")).distinct()
