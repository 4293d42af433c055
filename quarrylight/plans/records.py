"""Registered queries: identity of pages, cleaning, verification of labels, ranking, ledger and incremental steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import urls as U
from quarrylight.functions import queries as P
from quarrylight.operators import dedupe, filters, ledger, ranking, segment, tiers, verification
from quarrylight.operators.ranges import placed
from quarrylight.plans.common import claims, stored_texts, table
from quarrylight.plans.evidence import _R, _list, content


def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", U.canonical_url(F.col("url")).alias("canonical"), U.host_of(F.col("url")).alias("host"), U.candidate_id(F.lit(None).cast("string"), F.col("url")).alias("candidate_id"))


def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the same address or of the same title, transitively."""
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"(?is)<title>([^<]*)", 1)
    nothing = F.lit(None).cast("string")
    keyed = p.select("page_id", dedupe.keys_of(nothing, F.col("url"), nothing, title).alias("keys"))
    return dedupe.group_by_keys(keyed, "page_id").select(F.col("node").alias("page_id"), "component")


def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(U.host_of(F.col("url")).alias("host"), F.length("html").alias("n"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").cast("long").alias("chars"))


def busy_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under hosts that have eight pages or more, with their subdomains."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    busy = p.groupBy(U.host_of(F.col("url")).alias("domain")).count().where("count >= 8")
    return tiers.in_domains(p, busy).select("page_id", "url")


def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.redact_secrets(F.col("text"))).alias("redacted"), F.md5(T.sanitize_source_text(F.col("text"))).alias("sanitized"), T.looks_like_injection(F.col("text")).alias("injection"))


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.normalize_doc_text(F.col("text"))).alias("normalized"), T.count_words(F.col("text")).cast("long").alias("words"), T.truncate(F.col("text"), 80).alias("short"))


def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.numbers_in(F.col("text"))).alias("number"))
    return d.groupBy("number").agg(F.count("*").alias("docs"))


def page_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.coalesce(T.page_problem(F.col("text")), F.lit("usable")).alias("state"), "source")
    return d.groupBy("source", "state").agg(F.count("*").alias("n"))


def _labelled(spark: SparkSession, sf_dir: str):
    """Chunks of all documents with a label each, made from the chunk's number: right ones, and every kind of wrong one."""
    docs, sents = stored_texts(spark, sf_dir)
    chunks = segment.chunks(sents)
    kind = F.pmod(F.col("doc_id") + F.col("chunk_idx"), F.lit(6))
    sid = lambda i: F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".s"), i.cast("string"))
    ids = F.when(kind == 1, F.expr("cast(array() as array<string>)")).when(kind == 2, F.array(sid(F.col("sent_end") + 1))).when(kind == 3, F.array(F.lit("x1"))).otherwise(F.array(sid(F.col("sent_start")), sid(F.col("sent_end"))))
    labels = chunks.select(
        F.lit(1).cast("long").alias("claim_id"), "doc_id", "chunk_idx", F.lit(0).alias("pos"), F.when(kind == 0, "irrelevant").when(kind == 5, "contradicts").otherwise("direct").alias("relation"),
        ids.alias("sentence_ids"), (F.col("chunk_idx") / F.lit(4.0)).alias("confidence"), F.lit(" because ").alias("reason"),
    )
    return labels, chunks, sents, docs


def verified_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, _ = verification.verify(*_labelled(spark, sf_dir))
    return matches.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "relation", "confidence", F.md5("passage").alias("passage"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.md5(F.coalesce("context_before", F.lit(""))).alias("before"), F.md5(F.coalesce("context_after", F.lit(""))).alias("after"))


def rejected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = verification.verify(*_labelled(spark, sf_dir))
    return verification.failure_counts(rejects)


def label_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks in batches of eight a document, as the labeller gets them."""
    _, chunks, sents, _ = _labelled(spark, sf_dir)
    picked = chunks.withColumn("claim_id", F.col("doc_id")).withColumn("pick", F.col("chunk_idx") + 1)
    b = verification.request_batches(picked, sents)
    text = F.array_join(F.transform("chunks", lambda c: c["text"]), "\n\n")
    return b.select("claim_id", F.col("batch").cast("long").alias("batch"), F.size("chunks").cast("long").alias("n_chunks"), F.md5(text).alias("digest"))


def best_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tier = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, "peer_reviewed").otherwise("think_tank")).when(F.col("quality") == 0, "web").otherwise("preprint")
    return tiers.best_tier(rows.select("source", tier.alias("tier")), "source")


def reserved_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the 15 longest documents, three places kept for documents labelled toxic."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    known = rows.select(F.col("source").alias("claim_id"), "doc_id", "n_chars", (F.coalesce("toxic", F.lit(0)) == 1).alias("for_counter"))
    ranked = placed(known, "claim_id", [-F.col("n_chars"), F.col("doc_id")], "rank").withColumn("rank", F.col("rank").cast("int"))
    return ranking.select_to_read(ranked).select("claim_id", "doc_id", "for_counter", "rank")


def interleaved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, events in turn from each type's list, repeats of an hour dropped."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("claim_id"), "event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("id"), "event_id")
    number = F.dense_rank().over(Window.partitionBy("claim_id").orderBy("event_type"))
    rank = F.row_number().over(Window.partitionBy("claim_id", "event_type").orderBy("event_id"))
    return dedupe.interleave(e.select("claim_id", number.alias("list_no"), rank.alias("rank"), "id"), 10).select("claim_id", "id", F.col("rank").cast("long").alias("rank"))


def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a job: tokens and cost by day and type, with totals."""
    e = table(spark, sf_dir, "events")
    tokens = F.floor(F.abs(F.coalesce("value", F.lit(0.0))) * 100).cast("long")
    calls = e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", tokens.alias("prompt_tokens"), F.lit(None).cast("long").alias("miss_tokens"), F.floor(tokens / 4).alias("hit_tokens"), F.floor(tokens / 10).alias("completion_tokens"))
    costed = ledger.usage_cost(calls, 0.27, 0.07, 1.10)
    return costed.rollup("day", "event_type").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("saved_at"), F.col("event_id").alias("pos"), "event_type")
    h = ledger.upsert_history(e)
    return h.select("job_id", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss").alias("saved_at"), "pos", "event_type")


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the documents, in order, whose running cost estimate stays within a budget."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("job"), F.col("doc_id").alias("batch"), ledger.estimate_tokens(F.col("text")).cast("double").alias("estimate"))
    return ranking.budgeted_prefix(d, 20_000.0, 1_000.0).select("job", "batch", F.col("running").cast("long").alias("running"))


def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose latest two days differ in what they asked: request signatures by user and type."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id")
    parts = e.groupBy("user_id", "event_type", F.pmod(F.dayofmonth("day"), F.lit(2)).alias("half")).agg(F.count("*").alias("n"))
    return ledger.changed_requests(parts.where("half = 0"), parts.where("half = 1"), ["user_id", "event_type"], ["n"])


def overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each claim's vocabulary every document that shares a word with it covers.

    The score is that of ranking.keyword_overlap with all of the claim's words as key terms; words meet by equality and are counted per pair.
    """
    c = claims(spark, sf_dir).select("claim_id", F.array_distinct(T.content_tokens(F.col("text"))).alias("w"))
    terms = c.select("claim_id", "w", F.filter(F.transform("w", T.content_tokens), lambda t: F.size(t) > 0).alias("terms"))
    sizes = terms.select("claim_id", F.size("w").alias("n_words"), F.size("terms").alias("n_terms"))
    para = terms.select("claim_id", F.explode("w").alias("word"), F.lit(1).alias("para"), F.lit(0).alias("term"))
    key = terms.select("claim_id", F.explode(F.flatten("terms")).alias("word"), F.lit(0).alias("para"), F.lit(1).alias("term"))
    asked = para.union(key).groupBy("claim_id", "word").agg(F.sum("para").alias("para"), F.sum("term").alias("term"))
    held = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.content_tokens(F.col("text")))).alias("word"))
    hits = held.join(asked, "word").groupBy("claim_id", "doc_id").agg(F.sum("para").alias("para"), F.sum("term").alias("hits")).join(sizes, "claim_id")
    term_score = F.when(F.col("n_terms") > 0, F.least(F.lit(1.0), F.col("hits") / F.least(F.col("n_terms"), F.lit(5)))).otherwise(0.0)
    para_score = F.least(F.lit(1.0), F.col("para") / F.col("n_words") * 2)
    score = F.when(F.col("n_terms") == 0, para_score).otherwise(0.6 * term_score + 0.4 * para_score)
    return hits.select("claim_id", "doc_id", F.round(score, 6).alias("overlap"))


def english_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the function-word test and the language column agree."""
    d = table(spark, sf_dir, "documents").select("lang", filters.english(F.col("text")).alias("english"))
    return d.groupBy("lang", "english").agg(F.count("*").alias("n"))


def fallback_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.fallback_plan(claims(spark, sf_dir))
    return p.select("claim_id", F.md5("normalized_claim").alias("claim"), F.array_join("key_terms", " ").alias("key_terms"), "counter_query")


def technical_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    d = table(spark, sf_dir, "documents").select("source", P.technical(none, F.array("text")).alias("technical"))
    return d.groupBy("source").agg(F.count_if("technical").alias("technical"), F.count("*").alias("n"))


_CANON = r"""
u AS (SELECT page_id, trim(url) AS url, regexp_matches(trim(url), '^(?i)https?://[^\s/?#]+\S*$') AS ok,
  regexp_replace(lower(regexp_extract(trim(url), '^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www[0-9]?\.', '') AS host,
  regexp_extract(trim(url), '^(?i)https?://(?:[^/?#@]*@)?[^/?#:]+(?::[0-9]+)?([^?#]*)', 1) AS path0,
  regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
n AS (SELECT *, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path FROM u),
k AS (SELECT *, path = '/' OR regexp_matches(lower(path), '\.(php|asp|aspx|jsp|cfm)$') AS keep FROM n),
f AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|pk_)') AND NOT list_contains({tracking}, lower(split_part(p, '=', 1))) AND (keep OR list_contains({identity}, lower(split_part(p, '=', 1)))))) AS ps FROM k),
g AS (SELECT page_id, ok, host, CASE WHEN NOT ok THEN url WHEN len(ps) = 0 THEN 'https://' || host || regexp_replace(path, '/+$', '')
  ELSE 'https://' || host || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END || '?' || array_to_string(ps, '&') END AS canonical FROM f)""".replace("{tracking}", str(U.TRACKING)).replace("{identity}", str(U.IDENTITY))

_LAB = f"""{_R},
n AS (SELECT doc_id, max(sent_idx) + 1 AS n FROM s GROUP BY doc_id),
ch AS (SELECT doc_id, n, unnest(range(greatest(1, ceil((n - 1) / 3.0)::INT))) AS chunk_idx FROM n),
l AS (SELECT doc_id, chunk_idx, n, chunk_idx * 3 AS a, least(chunk_idx * 3 + 4, n) - 1 AS z, (doc_id + chunk_idx) % 6 AS kind FROM ch)"""

#: Text without what could pass for a delimiter or a sentence number.
_HARMLESS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<<<|>>>', chr(34), 'g'), '(?i)\b(END_)?SOURCE_(TEXT|CHUNK)\b', 'source', 'g'), '(?i)\[\s*d[0-9]+\s*\.\s*s[0-9]+\s*\]', '[id]', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')"


def _english() -> str:
    votes = []
    for lang, words in filters.FUNCTION_WORDS.items():
        elided = filters._ELIDED.get(lang)
        more = f" + len(regexp_extract_all(low, '{elided.replace(chr(39), chr(39) * 2)}'))" if elided else ""
        votes.append(f"len(list_filter(w, lambda x: list_contains({_list(words)}, x))){more} AS {lang}_")
    rivals = ", ".join(f"{lang}_" for lang in filters.FUNCTION_WORDS if lang != "en")
    return rf"""WITH l AS (SELECT lang, lower(regexp_replace(coalesce(text, ''), 'https?://\S+', ' ', 'g')) AS low FROM documents), t AS (SELECT lang, low, regexp_extract_all(low, '[\p{{L}}\p{{M}}]+') AS w FROM l),
c AS (SELECT lang, len(regexp_extract_all(low, '\p{{L}}')) AS letters, len(regexp_extract_all(low, '\p{{Latin}}')) AS latin, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x7f]'))) AS accented, {", ".join(votes)} FROM t),
r AS (SELECT *, greatest({rivals}) AS rival FROM c)
SELECT lang, n > 0 AND latin >= {filters.LATIN_SHARE} * letters AND accented <= {filters.ACCENTED_SHARE} * n AND CASE WHEN en_ = rival THEN n < {filters.LONG} AND accented = 0 ELSE en_ > rival AND (n < {filters.LONG} OR en_ >= {filters.ENGLISH_SHARE} * n) END AS english, count(*) AS n FROM r GROUP BY ALL"""


_ENGLISH = _english()
QUERIES = {f.__name__: f for f in (page_identity, page_groups, host_counts, busy_domains, redacted_texts, normalized_texts, text_numbers, page_problems, verified_labels, rejected_labels, label_requests, best_tiers, reserved_selection, interleaved_lists, usage_ledger, history_latest, budget_prefix, changed_sources, overlap_scores, english_documents, fallback_plans, technical_claims)}
_HOST = r"regexp_replace(lower(regexp_extract(trim(url), '^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www[0-9]?\.', '')"
_RAW = T.INJECTION.replace("'", "''")
SQL = {
    "page_identity": f"""WITH {_CANON}
SELECT page_id, canonical, CASE WHEN ok THEN host ELSE '' END AS host,
  'c_' || printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(canonical, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS candidate_id FROM g""",
    "page_groups": rf"""WITH RECURSIVE {_CANON},
t AS (SELECT page_id, trim(regexp_replace(regexp_replace(strip_accents(lower(regexp_extract(html, '(?is)<title>([^<]*)', 1))), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages),
ks AS (SELECT page_id, 'url:' || canonical AS key FROM g UNION SELECT page_id, 'title:' || t FROM t WHERE len(string_split(t, ' ')) >= 4),
h AS (SELECT key, min(page_id) AS hub FROM ks GROUP BY key),
e AS (SELECT DISTINCT page_id AS a, hub AS b FROM ks JOIN h USING (key) WHERE page_id <> hub),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT page_id AS a, page_id AS b FROM pages UNION SELECT r.a, b.b FROM r JOIN b ON r.b = b.a)
SELECT a AS page_id, min(b) AS component FROM r GROUP BY a""",
    "host_counts": f"SELECT {_HOST} AS host, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1",
    "busy_domains": f"""WITH p AS (SELECT page_id, url, {_HOST} AS host FROM pages), d AS (SELECT host FROM p GROUP BY host HAVING count(*) >= 8)
SELECT page_id, url FROM p WHERE EXISTS (SELECT 1 FROM d WHERE p.host = d.host OR ends_with(p.host, '.' || d.host))""",
    "redacted_texts": rf"""SELECT doc_id,
  md5(regexp_replace(regexp_replace(text, '\b(sk-[A-Za-z0-9_-]{{8,}})\b', '[redacted]', 'g'), '(?i)(Bearer\s+)[A-Za-z0-9._-]{{8,}}', '\1[redacted]', 'g')) AS redacted,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<<<|>>>', '"', 'g'), '(?i)\b(END_)?SOURCE_(TEXT|CHUNK)\b', 'source', 'g'), '(?i)\[\s*d[0-9]+\s*\.\s*s[0-9]+\s*\]', '[id]', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')) AS sanitized,
  regexp_matches(text, '{_RAW}') AS injection FROM documents""",
    "normalized_texts": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text),
  '\r\n?', chr(10), 'g'), '[   ]', ' ', 'g'), '[​-‍﻿­]', '', 'g'), '[ \t\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS normalized,
  CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE len(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+')) END AS words,
  CASE WHEN length(text) > 80 THEN rtrim(left(text, 79)) || '…' ELSE text END AS short FROM documents""",
    "text_numbers": r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\w.])([0-9]+(?:[.,][0-9]+)*)', 1)) AS x FROM documents),
c AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(regexp_replace(x, ',([0-9]{3})\b', '\1', 'g'), '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS number FROM m)
SELECT number, count(*) AS docs FROM c GROUP BY number""",
    "page_problems": f"""SELECT source, CASE WHEN length(text) < 4000 AND regexp_matches(text, '{T.BLOCKED}') THEN 'blocked' WHEN length(text) < 1500 AND regexp_matches(text, '{T.PAYWALL}') THEN 'paywall'
  WHEN length(text) < 400 THEN 'too_short' ELSE 'usable' END AS state, count(*) AS n FROM documents GROUP BY ALL""",
    "verified_labels": rf"""WITH {_LAB},
m AS (SELECT l.doc_id, l.chunk_idx, l.kind, f.start AS cs, e.start + length(e.text) AS ce, x.text AS bt, y.text AS at2 FROM l
  JOIN s f ON f.doc_id = l.doc_id AND f.sent_idx = l.a JOIN s e ON e.doc_id = l.doc_id AND e.sent_idx = l.z
  LEFT JOIN s x ON x.doc_id = l.doc_id AND x.sent_idx = l.a - 1 LEFT JOIN s y ON y.doc_id = l.doc_id AND y.sent_idx = l.z + 1 WHERE l.kind IN (4, 5))
SELECT m.doc_id, chunk_idx::BIGINT AS chunk_idx, CASE WHEN kind = 5 THEN 'contradicts' ELSE 'direct' END AS relation, least(1.0, chunk_idx / 4.0)::DOUBLE AS confidence,
  md5(trim(regexp_replace(b.text[cs + 1:ce], '\s+', ' ', 'g'))) AS passage, cs::BIGINT AS char_start, ce::BIGINT AS char_end, md5(coalesce(bt, '')) AS before, md5(coalesce(at2, '')) AS after FROM m JOIN b USING (doc_id)""",
    "rejected_labels": f"""WITH {_LAB} SELECT CASE kind WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'no_sentences' ELSE 'fabricated_id' END AS reason, count(*) AS n FROM l WHERE kind < 4 GROUP BY 1""",
    "label_requests": rf"""WITH {_LAB}, x AS (SELECT l.doc_id, chunk_idx, string_agg('[d' || l.doc_id || '.s' || sent_idx || '] ' || {_HARMLESS}, chr(10) ORDER BY sent_idx) AS t FROM l JOIN s ON s.doc_id = l.doc_id AND sent_idx BETWEEN a AND z GROUP BY ALL)
SELECT doc_id AS claim_id, (chunk_idx // 8)::BIGINT AS batch, count(*) AS n_chunks, md5(string_agg(t, chr(10) || chr(10) ORDER BY chunk_idx)) AS digest FROM x GROUP BY ALL""",
    "overlap_scores": f"""WITH c AS (SELECT item_id AS claim_id, list_distinct({content("text")}) AS w FROM benchmark), u AS (SELECT claim_id, len(w) AS n_words, unnest(w) AS word FROM c),
v AS (SELECT *, {content("word")} AS t FROM u), z AS (SELECT claim_id, any_value(n_words) AS n_words, count(*) FILTER (WHERE len(t) > 0) AS n_terms FROM v GROUP BY 1),
q AS (SELECT claim_id, word, sum(para)::BIGINT AS para, sum(term)::BIGINT AS term FROM (SELECT claim_id, word, 1 AS para, 0 AS term FROM v UNION ALL SELECT claim_id, unnest(t), 0, 1 FROM v) GROUP BY ALL),
h AS (SELECT doc_id, unnest(list_distinct({content("text")})) AS word FROM documents), m AS (SELECT claim_id, doc_id, sum(para)::BIGINT AS para, sum(term)::BIGINT AS hits FROM h JOIN q USING (word) GROUP BY ALL),
o AS (SELECT *, CASE WHEN n_terms > 0 THEN least(1.0::DOUBLE, hits::DOUBLE / least(n_terms, 5)) ELSE 0 END AS ts, least(1.0::DOUBLE, para::DOUBLE / n_words * 2) AS ps FROM m JOIN z USING (claim_id))
SELECT claim_id, doc_id, round(CASE WHEN n_terms = 0 THEN ps ELSE 0.6::DOUBLE * ts + 0.4::DOUBLE * ps END, 6) AS overlap FROM o""",
    "english_documents": _ENGLISH,
    "best_tiers": """WITH t AS (SELECT source, CASE WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN 'peer_reviewed' ELSE 'think_tank' END WHEN quality = 0 THEN 'web' ELSE 'preprint' END AS tier FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, arg_max(tier, CASE tier WHEN 'peer_reviewed' THEN 1.0 WHEN 'think_tank' THEN 0.8 WHEN 'preprint' THEN 0.7 ELSE 0.4 END) AS tier FROM t GROUP BY source""",
    "reserved_selection": """WITH r AS (SELECT source AS claim_id, doc_id, coalesce(toxic, 0) = 1 AS for_counter, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT *, for_counter AND row_number() OVER (PARTITION BY claim_id, for_counter ORDER BY rank) <= 3 AS reserved FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY reserved DESC, rank) AS place FROM n)
SELECT claim_id, doc_id, for_counter, rank FROM p WHERE place <= 15""",
    "interleaved_lists": """WITH e AS (SELECT user_id AS claim_id, strftime(ts, '%Y-%m-%d %H') AS id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS list_no, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rank FROM events),
o AS (SELECT claim_id, id, min((rank, list_no)) AS spot FROM e GROUP BY ALL),
n AS (SELECT claim_id, id, row_number() OVER (PARTITION BY claim_id ORDER BY spot, id) - 1 AS rank FROM o) SELECT claim_id, id, rank FROM n WHERE rank < 10""",
    "usage_ledger": """WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, floor(abs(coalesce(value, 0)) * 100)::BIGINT AS t FROM events),
d AS (SELECT day, event_type, t, ((t - floor(t / 4)) * 0.27::DOUBLE + floor(t / 4) * 0.07::DOUBLE + floor(t / 10) * 1.10::DOUBLE) / 1e6 AS cost FROM c)
SELECT day, event_type, count(*) AS calls, sum(t)::BIGINT AS prompt_tokens, round(sum(cost), 4) AS cost_usd FROM d GROUP BY ROLLUP (day, event_type)""",
    "history_latest": """WITH r AS (SELECT user_id AS job_id, ts, event_id AS pos, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS saved_at, pos, event_type FROM r WHERE n = 1 ORDER BY ts DESC, job_id LIMIT 200""",
    "budget_prefix": """WITH r AS (SELECT source AS job, doc_id AS batch, sum(ceil(length(text) / 4.0)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents)
SELECT job, batch, running::BIGINT AS running FROM r WHERE running <= 19000""",
    "changed_sources": """WITH p AS (SELECT user_id, event_type, day(ts) % 2 AS half, count(*) AS n FROM events GROUP BY ALL)
SELECT a.user_id, a.event_type FROM p a LEFT JOIN p b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.half = 0 WHERE a.half = 1 AND (b.n IS NULL OR a.n <> b.n)""",
    "fallback_plans": f"""WITH c AS (SELECT item_id AS claim_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 400) AS c FROM benchmark),
w AS (SELECT claim_id, c, list_filter(string_split_regex(trim(regexp_replace(lower(c), '[^a-z0-9\\s-]', ' ', 'g')), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({P.PLANNER_STOPWORDS}, w)) AS w FROM c),
k AS (SELECT claim_id, c, list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 8) AS k FROM w)
SELECT claim_id, md5(c) AS claim, array_to_string(k, ' ') AS key_terms, 'evidence against: ' || CASE WHEN len(k) > 0 THEN array_to_string(list_slice(k, 1, 6), ' ') ELSE c END AS counter_query FROM k""",
    "technical_claims": f"""SELECT source, count(*) FILTER (WHERE regexp_matches(lower(text), '{P.TECHNICAL_TERM}')) AS technical, count(*) AS n FROM documents GROUP BY source""",
}
