"""Main text of web pages, with a host suffix array that tells boilerplate from text.

Method.  A page is read as a stream of block tokens: the texts of its block elements in order.  The streams of a host's
pages form one sequence whose suffixes start at every word.  The suffix array is built by grouping suffixes on their prefix of
``RUN_WORDS`` words, spread over the cluster by (host, prefix) instead of sorted in one place.  A word lies in a repeated
substring of at least that length exactly if one of the prefixes that cover it repeats, so longer common prefixes need no
refining.  Pages are counted by their content (the block stream, not id, url or markup): a page stored several times counts once.

Scale.  A batch of pages sends its prefixes packed: sorted 40-bit remainders, one row for each slot of the hash range and each number of
pages of the batch that have them.  So a word costs five bytes of shuffle, and a prefix that stands on a third of all pages one entry a
batch.  Slots hold about ``SLOT_WORDS`` words each, whatever the number of pages.  The k copies of one content are found first
and weigh 1 / k each.

The array decides on every block that does not stand in menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments, which go at once.  A block all of whose words lie in repeated prefixes goes; of another block
the sentences that lie whole in repeated prefixes within it go, and unique runs stay.  What counts as repeated depends on the evidence of the markup:
outside an article (or main) element few pages are enough; in an article, whose passages other articles may share,
it takes half of the host's pages and at least ``ARTICLE_PAGES``.

Defined cases: null html gives an empty text; a null url is a host of its own name ''; repeated rows count as one page and
are each answered; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import bounded, slices, stash, table

RUN_WORDS = 8
#: A prefix is boilerplate on at least so many pages, and on this share of the host's.
LEAST_PAGES, SHARE = 3, 0.2
#: The same for a prefix inside an article.
ARTICLE_PAGES, ARTICLE_SHARE = 10, 0.5
#: Repeated prefixes that every worker may hold (16 bytes each); more are joined.
HELD = 2_000_000
#: Words whose prefixes are counted together, and bits of a prefix's hash that are sent besides the slot's.
SLOT_WORDS, PACKED_BITS = 500_000, 40
#: Words from which a task sends what it has packed.
PACK_WORDS = 1_000_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("nav header footer aside form menu button dialog".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that a new one of the given kind ends.
_ENDS = {"p": frozenset({"p"}), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"})}
_NAMES = re.compile(r"\b(?:class|id|role|itemtype)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHROME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|commentlist|disqus|replies|notice|cookies?|consent|gdpr|alert|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommended|complementary|contentinfo|search|widget|pagination|pager|toolbar)(?:$|[\s_-])",
    re.I,
)
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-body|post-content|entry-content|main|main-content|story)(?:$|[\s_-])", re.I)

CHROME, NEUTRAL, ARTICLE = 0, 1, 2


def blocks(page: str | None) -> list[tuple[int, str]]:
    """The page's blocks in order: kind (chrome, neutral, article) and text with white space folded."""
    out: list[tuple[int, str]] = []
    page = page or ""
    stack: list[tuple[str, int, int]] = []  # tag, depth of chrome, depth of article
    chrome = article = 0
    parts: list[str] = []
    kind = NEUTRAL

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((kind, text))
            parts.clear()

    at = 0
    while True:
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            now = CHROME if chrome else ARTICLE if article else NEUTRAL
            if now != kind:
                flush()
                kind = now
            parts.append(page[at:end])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW and not closing:
            if m[3].endswith("/") and tag in ("svg", "math", "object"):
                continue
            parts.append(" ")
            at = _RAW_END[tag].search(page, at).end()
            continue
        if tag in _BLOCKS:
            flush()
        elif tag in _VOID:
            parts.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    chrome, article = stack[i][1], stack[i][2]
                    del stack[i:]
                    break
            continue
        if tag in _VOID:
            continue
        if ends := _ENDS.get(tag):
            while stack and stack[-1][0] in ends or stack and tag == "p" and stack[-1][0] not in _BLOCKS and any(s[0] == "p" for s in stack):
                _, chrome, article = stack.pop()
        stack.append((tag, chrome, article))
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])) if m[3] else ""
        if tag in ("html", "body", "head"):
            continue
        if tag in ("article", "main") or names and _MAIN_NAME.search(names) and not _CHROME_NAME.search(names):
            article += 1
        elif tag in _CHROME or names and _CHROME_NAME.search(names):
            chrome += 1
        elif tag in _HEADINGS and article and chrome and [s[0] for s in stack[-2:-1]] == ["header"]:
            chrome -= 1  # the article's own headline
    flush()
    return out


_FACTORS = [np.uint64(xxhash.xxh3_64_intdigest(str(i)) | 1) for i in range(RUN_WORDS + 1)]


def grams(found: list[tuple[int, str]], host: str | None) -> tuple[list[str], np.ndarray, int]:
    """The stream's words, for each suffix the key of (host, its first RUN_WORDS words), and the key of the host itself."""
    tokens = [w for _, text in found for w in text.split(" ")]
    seed = xxhash.xxh3_64_intdigest(host or "")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = max(len(tokens) - RUN_WORDS + 1, 0)
    keys = np.full(n, seed, np.uint64)
    for j in range(RUN_WORDS):
        keys += hashes[j : j + n] * _FACTORS[j]
    keys = (keys ^ (keys >> np.uint64(31))) * _FACTORS[RUN_WORDS]
    return tokens, (keys ^ (keys >> np.uint64(29))).view(np.int64), seed - (1 << 63)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page its row's key, the hash of its content and its number of words."""
    for batch in batches:
        for part in slices(batch, 2):
            out = []
            for host, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                found = blocks(text)
                content = xxhash.xxh3_64_intdigest("\n".join([host or "", *(t for _, t in found)]))
                out.append((content - (1 << 63), sum(t.count(" ") + 1 for _, t in found)))
            yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array([x[i] for x in out], pa.int64()) for i in (0, 1))], ["own", "content", "words"])


def packed(keys: np.ndarray, bits: int) -> bytes:
    """The 40 bits of each key behind its slot's, as five bytes."""
    rest = (keys << np.uint64(bits)) >> np.uint64(64 - PACKED_BITS)
    return rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : PACKED_BITS // 8].tobytes()


def unpacked(data: bytes, slot: int, bits: int) -> np.ndarray:
    """Keys as they were, but for the bits that were not packed."""
    rest = np.zeros((len(data) * 8 // PACKED_BITS, 8), np.uint8)
    rest[:, : PACKED_BITS // 8] = np.frombuffer(data, np.uint8).reshape(len(rest), -1)
    low = (rest.reshape(-1).view("<u8") << np.uint64(64 - PACKED_BITS)) >> np.uint64(bits)
    return low | np.uint64(slot << (64 - bits) if bits else 0)


def mask(bits: int) -> np.uint64:
    """The bits of a key that survive packing."""
    return np.uint64(((1 << 64) - 1) ^ ((1 << max(64 - PACKED_BITS - bits, 0)) - 1))


def _packs(bits: int):
    """Prefixes of a batch's pages: slot, weight (pages of the batch that have them; copies of a content share one), keys.

    The key of a host stands for its number of pages.
    """

    def rows_of(every: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for copies, lists in every.items():
            keys, n = np.unique(np.concatenate(lists), return_counts=True)
            slots = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            for times in np.unique(n).tolist():
                some = n == times
                mine, at = keys[some], slots[some]
                cuts = np.flatnonzero(np.diff(at)) + 1
                for group, where in zip(np.split(mine, cuts), at[np.concatenate(([0], cuts))].tolist(), strict=True):
                    rows.append((where, times / copies, packed(group, bits)))
        types = (pa.int64(), pa.float64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["slot", "weight", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for part in slices(batch, 2):
                for host, copies, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    _, own, whole = grams(blocks(text), host)
                    every.setdefault(copies, []).append(np.append(np.unique(own), whole).view(np.uint64))
                    size += len(own) + 1
                if size > PACK_WORDS:
                    yield rows_of(every)
                    every, size = {}, 0
        if every:
            yield rows_of(every)

    return run


def _counted(bits: int, least: int):
    """A slot's keys that stand on enough pages, with their number."""

    def run(packs: pd.DataFrame) -> pd.DataFrame:
        lists = [unpacked(k, int(s), bits) for k, s in zip(packs["keys"], packs["slot"], strict=True)]
        keys, at = np.unique(np.concatenate(lists), return_inverse=True)
        n = np.bincount(at.reshape(-1), np.repeat(packs["weight"].to_numpy(), list(map(len, lists))), len(keys))
        enough = n > least - 1e-6
        return pd.DataFrame({"key": keys[enough].view(np.int64), "n": n[enough]})

    return run


def unique(words: list[str], repeated: list[bool]) -> list[str]:
    """The words without the whole sentences that are repeated; the repeated start of a unique sentence is text."""
    out: list[str] = []
    begin = 0
    for i, word in enumerate(words, 1):
        if i == len(words) or word.rstrip("\"')]”’»")[-1:] in (".", "!", "?", "…"):
            if not all(repeated[begin:i]):
                out += words[begin:i]
            begin = i
    return out


def main_text(found: list[tuple[int, str]], tokens: list[str], neutral: np.ndarray, article: np.ndarray) -> tuple[str, int]:
    """The text that is kept, and how many blocks the suffix array removed.

    neutral, article: for each suffix whether its prefix is repeated by the measure of that kind of block.
    """
    if not neutral.any() and not article.any():
        return "\n".join(t for kind, t in found if kind != CHROME), 0
    ends = np.cumsum([t.count(" ") + 1 for _, t in found])
    block = np.repeat(np.arange(len(found)), np.diff(ends, prepend=0))

    def covered(hits: np.ndarray) -> np.ndarray:
        steps = np.zeros(len(tokens) + 1, np.int64)
        steps[: len(hits)] += hits
        steps[RUN_WORDS : RUN_WORDS + len(hits)] -= hits
        return np.cumsum(steps[:-1]) > 0

    within = block[: len(neutral)] == block[RUN_WORDS - 1 :]
    spans = {kind: (covered(hits), covered(hits & within)) for kind, hits in ((NEUTRAL, neutral), (ARTICLE, article))}
    kept, removed, begin = [], 0, 0
    for (kind, text), end in zip(found, ends.tolist(), strict=True):
        if kind != CHROME:
            anywhere, inside = (x[begin:end] for x in spans[kind])
            if anywhere.all():
                removed += 1
            elif inside.any():
                kept.append(" ".join(unique(tokens[begin:end], inside.tolist())))
            else:
                kept.append(text)
        begin = end
    return "\n".join(kept), removed


def _texts(held, bits: int, least_pages: int, share: float):
    """held: the repeated keys, sorted, with their pages (a broadcast); None if each row brings its own."""
    kept = mask(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                done = []
                lists = part.column(4).to_pylist() if held is None else [None] * part.num_rows
                for host, page, own in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), lists, strict=True):
                    found = blocks(page)
                    tokens, keys, whole = grams(found, host)
                    if held is None:
                        pairs = sorted((x["key"], x["n"]) for x in own or ())
                        known, counts = np.array([x[0] for x in pairs], np.int64), np.array([x[1] for x in pairs], np.float64)
                    else:
                        known, counts = held.value
                    asked = (np.append(keys, whole).view(np.uint64) & kept).view(np.int64)
                    n = np.zeros(len(asked))
                    if len(known):
                        place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                        n = np.where(known[place] == asked, counts[place], 0.0)
                    n, pages = n[:-1] + 1e-6, n[-1]
                    done.append(main_text(found, tokens, (n >= least_pages) & (n >= share * pages), (n >= max(least_pages, ARTICLE_PAGES)) & (n >= max(share, ARTICLE_SHARE) * pages)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _ in done], pa.string()), pa.array([len(t) for t, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())], ["page_id", "url", "text", "n_chars", "n_repeated_blocks"])

    return run


def _own_keys(bits: int):
    """For each row its different keys, unpacked: only for joins with more repeated keys than a worker may hold."""
    kept = mask(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                for host, row, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    _, own, whole = grams(blocks(text), host)
                    own = np.unique(np.append(own, whole).view(np.uint64) & kept).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), row, np.int64))], ["key", "row"])

    return run


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, held: int = HELD) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated_blocks for every page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    rows = rows.withColumn("own", F.xxhash64("host", "html"))
    contents = stash(rows.select("host", "own", "html").mapInArrow(_contents, "own long, content long, words long"), "contents")
    words = contents.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    bits = max(0, (words // SLOT_WORDS).bit_length())
    several = contents.groupBy("content").agg(F.count("*").alias("copies")).where("copies > 1")
    copies = bounded(stash(contents.join(several, "content").select("own", "copies").distinct(), "copies"))
    weighed = rows.join(copies, "own", "left").select("host", F.coalesce("copies", F.lit(1)).alias("copies"), "html")
    packs = weighed.mapInArrow(_packs(bits), "slot long, weight double, keys binary")
    frequent = stash(packs.groupBy("slot").applyInPandas(_counted(bits, least_pages), "key long, n double"), "frequent")
    out = "page_id long, url string, text string, n_chars long, n_repeated_blocks long"
    asked = rows.select("page_id", "url", "host", "html")
    if frequent.limit(held + 1).count() <= held:
        found = frequent.orderBy("key").toArrow()
        pair = tuple(found.column(x).to_numpy() for x in ("key", "n"))
        return asked.mapInArrow(_texts(pages.sparkSession.sparkContext.broadcast(pair), bits, least_pages, share), out)
    suffixes = rows.select("host", "own", "html").mapInArrow(_own_keys(bits), "key long, row long").distinct()
    hits = suffixes.join(frequent, "key").groupBy("row").agg(F.collect_list(F.struct("key", "n")).alias("keys"))
    joined = rows.join(hits, F.col("own") == F.col("row"), "left").select("page_id", "url", "host", "html", "keys")
    return joined.mapInArrow(_texts(None, bits, least_pages, share), out)


def op3_host_suffix_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_host_suffix_html": op3_host_suffix_html}
SQL: dict[str, str] = {}
