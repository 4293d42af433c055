"""Text expressions: normalising, tokenising, cleaning and simple tests, as Column -> Column functions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stop words of the retrieval tokenizer.
RETRIEVAL_STOPWORDS = (
    "a an and are as at be been being but by can could did do does doing for from had has have having he her hers him his how i if in into is it its "
    "itself just me more most my no nor not of off on once only or other our ours out over own same she should so some such than that the their theirs them "
    "then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your "
    "yours also may might must shall about above after again against all am any because before below between both down during each few further here "
    "doesn don didn isn wasn weren aren hasn haven hadn won wouldn shouldn couldn really significantly"
).split()

# Stop words of the pre-ranking tokenizer.
CONTENT_STOPWORDS = (
    "the of and to in a is that for on with as by are was be this it from at or an have has had not which their we our "
    "these were been can more than but also its between they there how what will would do does did into about after over "
    "under such may might should could who when where why while if then those them all any each other some most many much "
    "both only very no nor so too just being because through during before against among within without across per up out "
    "study studies evidence paper effect effects result results show shows find finds found"
).split()

# Patterns that mark text aimed at a model, blocked pages and paywalls.
INJECTION = (
    r"(?i)\b(ignore|disregard|forget|override)\b[^.]{0,40}\b(previous|prior|above|earlier|all|your)\b[^.]{0,40}\b(instructions?|prompts?|rules?|directions?)\b"
    r"|\b(mark|label|classify|rate|tag)\s+(this|these|the)\b[^.]{0,40}\b(as\s+)?(direct|paraphrase|partial|supporting|relevant)\b"
    r"|\b(you are|act as)\s+(an?\s+)?(ai|assistant|language model|llm|chatbot)\b|\bsystem\s*prompt\b|\bassistant\s*:"
)
PAYWALL = r"(?i)\b(subscribe to (read|continue)|subscription required|sign in to (read|continue)|create a free account to (read|continue)|enable javascript|you have reached your (free )?article limit)\b"
BLOCKED = (
    r"(?i)\b(you (have been|were) blocked|attention required|checking your browser|verify(ing)? you are (a )?human|are you a robot|access denied|request unsuccessful"
    r"|incapsula incident|enable javascript and cookies to continue|ddos protection by|cloudflare ray id|performance (&|and) security by cloudflare)\b"
)
BLOCKED_BELOW, TOO_SHORT_BELOW, PAYWALLED_BELOW = 4000, 400, 1500

_ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFKD", c)[0].encode()) == 1 and unicodedata.normalize("NFKD", c)[0].isalpha())
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)


def normalize_ws(c: Column) -> Column:
    """White space runs become one space; trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Canonical composition; ASCII rows never reach Python's normaliser."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), _nfc(F.when(c.rlike(r"[^\x00-\x7f]"), c))).otherwise(c)


def normalize_spacing(c: Column) -> Column:
    """Unified line ends and spaces, no zero-width characters, at most one blank line."""
    for pattern, to in ((r"\r\n?", "\n"), ("[   ]", " "), ("[​-‍﻿­]", ""), (r"[ \t\f\x0b]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_doc_text(c: Column) -> Column:
    return normalize_spacing(nfc(c))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters, as 8 hex digits."""
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    folded = F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(2166136261).cast("long"), step)
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def excerpt(c: Column, most: int = 400) -> Column:
    """The text's beginning, cut at a word's end if that lies past 60 percent."""
    flat = normalize_ws(c)
    head = F.substring(flat, 1, most)
    at_word = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(F.length(at_word) > int(most * 0.6), at_word).otherwise(head)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def count_words(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, r"\s+")))


def strip_accents(c: Column) -> Column:
    """Letters without their accents; ASCII rows stay as they are."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), "[̀-ͯ]", "")).otherwise(c)


def stem(w: Column) -> Column:
    """Folds plural, -ing, -ed and -edly endings; a final e of longer words goes last.

    Words are told apart by their last letter first, so most are done after one comparison.
    """
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    doubled = list("bcdfghjkmnpqrtvwxy")
    single = lambda x: F.when((F.substring(x, -1, 1) == F.substring(x, -2, 1)) & F.substring(x, -1, 1).isin(doubled), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    plural = (
        F.when(w.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("sses"), cut(2))
        .when((n > 4) & w.endswith("es") & w.rlike("(ss|x|z|ch|sh)es$"), cut(2))
        .when(~F.substring(w, -2, 2).isin("ss", "us", "is"), cut(1))
        .otherwise(w)
    )
    s = (
        F.when(n <= 3, w)
        .when(w.endswith("s"), plural)
        .when(w.endswith("ing") & (n > 5), single(cut(3)))
        .when(w.endswith("edly") & (n > 6), cut(4))
        .when(w.endswith("ed") & (n > 4), single(cut(2)))
        .otherwise(w)
    )
    return F.when(s.endswith("e") & (F.length(s) > 4), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)


def word_parts(c: Column) -> Column:
    """What stands between separators, in order: words, of which ``retrieved`` tells those that are looked up."""
    return F.split(strip_accents(F.lower(c)), r"[^a-z0-9%$]+")


def retrieved(w: Column) -> Column:
    """Whether a word is long enough to be looked up, and no stop word."""
    return (F.length(w) > 1) & ~w.isin(RETRIEVAL_STOPWORDS)


def _retrieval_words(c: Column) -> Column:
    return F.filter(word_parts(c), retrieved)


def tokens(c: Column) -> Column:
    """Stemmed retrieval tokens."""
    return F.transform(_retrieval_words(c), stem)


def token_set(c: Column) -> Column:
    """Distinct retrieval tokens; each distinct word is stemmed once."""
    return F.array_distinct(F.transform(F.array_distinct(_retrieval_words(c)), stem))


def terms_of_tokens(toks: Column) -> Column:
    """Tokens, then pairs of neighbours joined by an underscore."""
    pairs = F.zip_with(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.when(F.size(toks) > 1, F.concat(toks, pairs)).otherwise(toks)


def content_tokens(c: Column) -> Column:
    """Tokens for pre-ranking: three characters or more, other stop words, plurals folded."""

    def fold(w: Column) -> Column:
        n = F.length(w)
        return (
            F.when((n > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
            .when((n > 3) & w.endswith("s") & ~w.rlike("(ss|us|is)$"), F.substring(w, F.lit(1), n - 1))
            .otherwise(w)
        )

    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(CONTENT_STOPWORDS)), fold)


def title_key(c: Column) -> Column:
    """Lower-cased title without accents and punctuation; null below four words."""
    t = normalize_ws(F.regexp_replace(strip_accents(F.lower(c)), r"[^\p{L}\p{N}\s]+", " "))
    return F.when(F.size(F.split(t, " ")) >= 4, t)


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def decode_entities(c: Column) -> Column:
    """Named and numeric character references; rows without an ampersand stay in the JVM."""
    return F.when(c.contains("&"), _unescape(F.when(c.contains("&"), c))).otherwise(c)


def sanitize_source_text(c: Column) -> Column:
    """Takes delimiters, look-alike sentence ids and control characters out of fetched text."""
    c = F.regexp_replace(c, "<<<|>>>", '"')
    c = F.regexp_replace(c, r"(?i)\b(END_)?SOURCE_(TEXT|CHUNK)\b", "source")
    c = F.regexp_replace(c, r"(?i)\[\s*d[0-9]+\s*\.\s*s[0-9]+\s*\]", "[id]")
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def redact_secrets(c: Column, known: tuple[str, ...] = ()) -> Column:
    for secret in known:
        if len(secret) >= 6:
            c = F.replace(c, F.lit(secret), F.lit("[redacted]"))
    c = F.regexp_replace(c, r"\b(sk-[A-Za-z0-9_-]{8,})\b", "[redacted]")
    return F.regexp_replace(c, r"(?i)(Bearer\s+)[A-Za-z0-9._-]{8,}", "$1[redacted]")


def join_lines(c: Column) -> Column:
    """Lines of a page as running text: blank lines part paragraphs, words hyphenated at a line's end are healed."""
    c = F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n")
    c = F.regexp_replace(c, r"([A-Za-z])-\n([a-z])", "$1$2")
    c = F.regexp_replace(c, r"\n{2,}", "\u0001")
    c = F.regexp_replace(c, r"\n", " ")
    return F.trim(F.regexp_replace(c, "\u0001", "\n\n"))


def source_label(title: Column, publisher: Column, published: Column) -> Column:
    year = F.substring(published, 1, 4)
    return F.concat(title, F.coalesce(F.concat(F.lit(" — "), publisher), F.lit("")), F.coalesce(F.concat(F.lit(" ("), year, F.lit(")")), F.lit("")))


def numbers_in(c: Column) -> Column:
    """Distinct numbers of a text: group commas and a trailing .0 dropped."""
    found = F.regexp_extract_all(c, F.lit(r"(?:^|[^\w.])([0-9]+(?:[.,][0-9]+)*)"), F.lit(1))
    plain = F.transform(found, lambda n: F.regexp_replace(F.regexp_replace(n, r",([0-9]{3})\b", "$1"), r"(\.\d*?)0+$", "$1"))
    return F.array_distinct(F.transform(plain, lambda n: F.regexp_replace(n, r"\.$", "")))


def looks_like_injection(c: Column) -> Column:
    return c.rlike(INJECTION)


def page_problem(text: Column) -> Column:
    """blocked, paywall, too_short, or null for a usable page text."""
    n = F.length(text)
    return (
        F.when((n < BLOCKED_BELOW) & text.rlike(BLOCKED), "blocked")
        .when((n < PAYWALLED_BELOW) & text.rlike(PAYWALL), "paywall")
        .when(n < TOO_SHORT_BELOW, "too_short")
    )
